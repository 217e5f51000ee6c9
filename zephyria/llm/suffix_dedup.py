"""Long repeats: bytes covered by a 100-byte string that also starts earlier.

1. Routing. Every 100-byte window belongs to the least hash among its 24-byte strings,
   so equal windows share that route wherever they stand. A run of windows with one
   route is a piece: about 40 windows, one in 40 bytes.
2. Pieces are shuffled on their route, without bytes. Routes that occur once end here (unless a piece may repeat itself).
   Equal pieces are told by a second hash; all but the first are covered whole.
3. The first of each group of equal pieces fetches its bytes. Pieces with one route
   meet in a task, in order of position, where a run-compressed Burrows-Wheeler index
   (``repeat_index``) gives matching statistics and the first place of each window.
4. Covered spans return to their documents, which cut them out.

A route that many different pieces have is never one task's work: of those of a task,
one stands for the route where routes are counted and the others go by their content;
where the pieces of a route have more than ``HOT_BYTES``, their windows meet by their
own hashes (128 bits) instead of in an index, equal ones of a task first.

Defined cases: null text is the empty text; texts under 100 bytes lose nothing; where
ids are null or repeat, rows count as documents of their own, null ids first, equal
ids in a fixed order; ``cut_repeats`` drops the halves of characters that a cut parted
and leaves null texts null; other columns are untouched; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zephyria.llm.common import importable_on_workers, stored, with_keys
from zephyria.llm.hashing import M1, M2, M3, mixed, prefix_sums, stretch_hash
from zephyria.llm.repeat_index import RepeatIndex

WIDTH = 100
#: Length of the hashed strings that routes are made of.
GRAM = 24
#: Bytes hashed at a time; windows of a longer text are dealt with in parts.
HASH_BYTES = 1 << 21
#: Windows of one piece at most (a periodic text has one route throughout).
PIECE_WINDOWS = 4096
#: Bytes that one index covers.
BLOCK_BYTES = 1 << 20

#: Pieces among which a task tells equal ones before it hands them on.
TOGETHER = 400_000

#: Different pieces of one route that a task sends the common way as they are.
ROUTE_PIECES = 8
#: Bytes of one route that go to one index, and hot routes at most that are broadcast.
HOT_BYTES = 1 << 18
BROADCAST_ROUTES = 1 << 16

PIECES = "route long, home long, content long, doc long, start long, windows long, inner boolean, copy boolean"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 24 bytes from each position on."""
    h = data.astype(np.uint64) * M1
    width = 1
    for m in (M2, M3, M1):
        n = len(h) - width
        h = h[:n] * m + h[width:]
        width *= 2
    h = mixed(h)
    n = len(h) - 16
    return mixed((h[:n] * M3 + h[8 : n + 8]) * M1 + h[16:])


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values, from minima of blocks' heads and tails."""
    n = len(h)
    size = -(-n // width) * width
    blocks = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = h
    blocks = blocks.reshape(-1, width)
    heads = np.minimum.accumulate(blocks, axis=1).ravel()
    tails = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tails[: n - width + 1], heads[width - 1 : n])


def pieces_of(data: bytes) -> tuple[np.ndarray, ...]:
    """Pieces of at most HASH_BYTES bytes: route, content hash, start, number of windows, and
    whether the route's string stands in the bytes again, so that windows may repeat inside."""
    h = gram_hashes(np.frombuffer(data, np.uint8))
    least = sliding_least(h, WIDTH - GRAM + 1)
    change = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    if len(least) > PIECE_WINDOWS:
        runs = np.diff(np.append(change, len(least)))
        more = [np.arange(c, c + r, PIECE_WINDOWS)[1:] for c, r in zip(change[runs > PIECE_WINDOWS], runs[runs > PIECE_WINDOWS])]
        change = np.sort(np.concatenate([change, *more]))
    windows = np.diff(np.append(change, len(least)))
    content = stretch_hash(prefix_sums(h), change, windows + (WIDTH - GRAM))
    ranked, routes = np.sort(h), least[change]
    doubled = ranked[1:][ranked[1:] == ranked[:-1]]
    inner = np.isin(routes, doubled) if len(doubled) else np.zeros(len(routes), bool)
    return routes, content, change, windows, inner


def text_parts(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Parts that share no window, each with its place; texts too short have none."""
    step = HASH_BYTES - WIDTH + 1
    for at in range(0, len(data) - WIDTH + 1, step):
        yield at, data[at : at + HASH_BYTES]


def routed_pieces(keyed: DataFrame) -> DataFrame:
    """All pieces of all texts, without their bytes.

    A piece that equals an earlier one of the same task is a ``copy``, whatever else
    there is. It needs no other piece, so it gets a route of its own; of a passage in
    very many documents, only one piece a task goes the common way. Likewise, of many
    different pieces with one route (``home``) all but one go by route and content: that
    the route repeats is known of them (``inner``), and the one tells it to other tasks.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for at, part in text_parts(text.as_py().encode()):
                    route, content, start, windows, inner = pieces_of(part)
                    found.append((route, content, np.full(len(route), doc), start + at, windows, inner))
                    size += len(route)
                if size > TOGETHER:
                    yield rows_of(found)
                    found, size = [], 0
        if found:
            yield rows_of(found)

    def rows_of(found: list) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*found)]
        order = np.lexsort((columns[3], columns[2], columns[1], columns[0]))
        route, content, doc, start, windows, inner = (c[order] for c in columns)
        copy = np.zeros(len(route), bool)
        copy[1:] = (route[1:] == route[:-1]) & (content[1:] == content[:-1])
        opens = np.flatnonzero(np.concatenate([[True], route[1:] != route[:-1]])[: len(route)])
        sizes = np.diff(np.append(opens, len(route)))
        different = np.add.reduceat((~copy).astype(np.int64), opens) if len(opens) else sizes
        moved = ~copy & np.repeat(different > ROUTE_PIECES, sizes)
        inner = inner | moved
        moved[opens] = False
        home = pa.array(route.view(np.int64), mask=~moved)
        route = np.where(copy, mixed(doc.astype(np.uint64) * M1 + start.astype(np.uint64)), route)
        route = np.where(moved, mixed(route * M3 ^ content), route)
        arrays = [pa.array(route.view(np.int64)), home, *map(pa.array, (content.view(np.int64), doc, start, windows, inner, copy))]
        return pa.RecordBatch.from_arrays(arrays, names=["route", "home", "content", "doc", "start", "windows", "inner", "copy"])

    return keyed.select("doc", "text").mapInArrow(cut, PIECES)


def repeated_pieces(pieces: DataFrame) -> DataFrame:
    """Pieces that may repeat something, with ``first``: no equal piece comes before."""
    by_route, by_content = Window.partitionBy("route"), Window.partitionBy("route", "content").orderBy("doc", "start")
    return (
        pieces.withColumn("place", F.row_number().over(by_content))
        .withColumn("n", F.count(F.lit(1)).over(by_route))
        .where("n > 1 or inner or copy")
        .select(F.coalesce("home", "route").alias("route"), "doc", "start", "windows", (~F.col("copy") & (F.col("place") == 1)).alias("first"))
    )


def hot_routes(firsts: DataFrame) -> DataFrame:
    """``firsts`` with ``hot``: whether the pieces of the route are more than one index takes."""
    sizes = firsts.groupBy("route").agg(F.sum(F.col("windows") + (WIDTH - 1)).alias("bytes"))
    hot = stored(sizes.where(F.col("bytes") > HOT_BYTES).select("route", F.lit(True).alias("hot")), "hot-routes")
    found = hot.count()
    if not found:
        return firsts.withColumn("hot", F.lit(False))
    joined = firsts.join(hot.hint("broadcast" if found <= BROADCAST_ROUTES else "merge"), "route", "left")
    return joined.withColumn("hot", F.coalesce("hot", F.lit(False)))


def window_prints(pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    """(two hashes, doc, start) of each window of (doc, start, bytes), equal ones together and in order."""
    lengths = np.fromiter((len(p[2]) for p in pieces), np.int64, len(pieces))
    windows = lengths - (WIDTH - 1)
    within = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    at = within + np.repeat(np.cumsum(lengths) - lengths, windows)
    h = gram_hashes(np.frombuffer(b"".join(p[2] for p in pieces), np.uint8))
    grams = np.full(len(at), WIDTH - GRAM + 1)
    one, two = (stretch_hash(prefix_sums(x), at, grams) for x in (h, mixed(h * M3 + M2)))
    doc = np.repeat(np.array([p[0] for p in pieces], np.int64), windows)
    start = within + np.repeat(np.array([p[1] for p in pieces], np.int64), windows)
    order = np.lexsort((start, doc, two, one))
    return tuple(x[order] for x in (one.view(np.int64), two.view(np.int64), doc, start))


def runs_of_windows(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end) of each stretch of covered windows that follow one another."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    opens = np.ones(len(doc), bool)
    opens[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(doc))[: len(first)] - 1
    return doc[first], start[first], start[last] + WIDTH


def repeated_before(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which members of sorted pairs equal the one before."""
    again = np.zeros(len(one), bool)
    again[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
    return again


PLACED = "route long, doc long, start long, data binary, print long, end long"


def with_bytes(firsts: DataFrame, keyed: DataFrame) -> DataFrame:
    """What is to meet by ``route``: pieces with their bytes, or windows of hot routes with a second hash.

    Windows that a task has seen before come with neither: they are covered, and a stretch of them is one row.
    """
    wanted = firsts.groupBy("doc").agg(F.collect_list(F.struct("route", "start", "windows", "hot")).alias("wanted"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, size = [], 0
        for batch in batches:
            rows = []
            for doc, text, pieces in zip(*(batch.column(i) for i in range(3))):
                data, doc = text.as_py().encode(), doc.as_py()
                for p in pieces.as_py():
                    own = data[p["start"] : p["start"] + p["windows"] + WIDTH - 1]
                    if p["hot"]:
                        hot.append((doc, p["start"], own))
                        size += len(own)
                    else:
                        rows.append((p["route"], doc, p["start"], own))
                if size >= BLOCK_BYTES:
                    yield prints_of(hot)
                    hot, size = [], 0
            route, doc, start, data = zip(*rows) if rows else ([],) * 4
            yield placed(pa.array(route, pa.int64()), pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(data, pa.binary()), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64()))
        if hot:
            yield prints_of(hot)

    def placed(*arrays: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(list(arrays), names=["route", "doc", "start", "data", "print", "end"])

    def prints_of(hot: list) -> pa.RecordBatch:
        one, two, doc, start = window_prints(hot)
        again = repeated_before(one, two)
        covered, begin, end = runs_of_windows(doc[again], start[again])
        apart = mixed(covered.view(np.uint64) * M1 + begin.view(np.uint64)).view(np.int64)
        one, two, doc, start = (x[~again] for x in (one, two, doc, start))
        none = pa.nulls(len(covered), pa.int64())
        return placed(
            pa.array(np.concatenate([one, apart])), pa.array(np.concatenate([doc, covered])), pa.array(np.concatenate([start, begin])),
            pa.nulls(len(one) + len(end), pa.binary()), pa.concat_arrays([pa.array(two), none]), pa.concat_arrays([pa.nulls(len(one), pa.int64()), pa.array(end)]),
        )

    return keyed.select("doc", "text").join(wanted, "doc").mapInArrow(fetch, PLACED)


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past last index of each run of true."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def covered_windows(pieces: list[bytes]) -> np.ndarray:
    """Positions in the joined pieces whose window came before."""
    index = RepeatIndex(pieces)
    at = np.arange(len(index.text))
    return (at + WIDTH <= index.ends) & (index.sources(WIDTH) < at)


def indexed_spans(pieces: DataFrame) -> DataFrame:
    """Spans (doc, start, end) of windows that came before, from pieces and windows that meet by route."""

    def out(doc, start, end) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["doc", "start", "end"])

    def spans(block: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        data = [p[2] for p in block]
        first, last = runs_of(covered_windows(data))
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        begins = np.cumsum(lengths) - lengths
        # a run never leaves its piece: a piece's last 99 bytes start no window
        owner = np.searchsorted(begins, first, "right") - 1
        doc = np.array([p[0] for p in block], np.int64)[owner]
        shift = np.array([p[1] for p in block], np.int64)[owner] - begins[owner]
        return out(doc, first + shift, last - 1 + shift + WIDTH)

    def windows(batch: pa.RecordBatch, known: set[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, set[tuple[int, int]]]:
        """Documents and places of covered windows, and the pairs of hashes that the next batch may go on with."""
        one, doc, start = (batch.column(i).to_numpy() for i in range(3))
        # two windows of one route with different second hashes may take turns
        order = np.lexsort((start, doc, batch.column("print").to_numpy(), one))
        one, two, doc, start = one[order], batch.column("print").to_numpy()[order], doc[order], start[order]
        again = repeated_before(one, two)
        for i in np.flatnonzero(one == one[0]) if known else ():
            again[i] |= (int(one[i]), int(two[i])) in known
        last = np.flatnonzero(one == one[-1])
        held = {(int(a), int(b)) for a, b in zip(one[last], np.unique(two[last]))}
        return doc[again], start[again], held | {k for k in known if k[0] == int(one[-1])}

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple[int, int, bytes]] = []
        size, route, known = 0, None, set()
        for batch in batches:
            whole, hashed = pc.is_valid(batch.column("data")), pc.is_valid(batch.column("print"))
            some = batch.filter(pc.invert(pc.or_(whole, hashed)))
            if some.num_rows:
                yield out(*(some.column(name) for name in ("doc", "start", "end")))
            some = batch.filter(hashed)
            if some.num_rows:
                doc, start, known = windows(some, known)
                yield out(*runs_of_windows(doc, start))
            for r, doc, start, data in zip(*(batch.filter(whole).column(i).to_pylist() for i in range(4))):
                if r != route and size >= BLOCK_BYTES:
                    yield spans(block)
                    block, size = [], 0
                route = r
                block.append((doc, start, data))
                size += len(data)
        if block:
            yield spans(block)

    placed = pieces.repartition("route").sortWithinPartitions("route", "doc", "start")
    return placed.mapInArrow(index, "doc long, start long, end long")


def repeat_spans(keyed: DataFrame) -> DataFrame:
    """(doc, spans): the covered stretches of each document that has any; they may overlap."""
    again = stored(repeated_pieces(routed_pieces(keyed)), "repeated-pieces")
    copies = again.where("not first").select("doc", "start", (F.col("start") + F.col("windows") + (WIDTH - 1)).alias("end"))
    found = indexed_spans(with_bytes(hot_routes(again.where("first").drop("first")), keyed))
    return copies.unionByName(found).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def merged_spans(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal stretches; those that touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def repeat_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the spans themselves."""
    importable_on_workers(docs.sparkSession)
    keyed = with_keys(docs.select("doc_id", "text"))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2)):
                data, cut = text.as_py().encode(), merged_spans(spans.as_py())
                kept = kept_bytes(data, cut)
                rows.append((len(data), len(data) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in cut]))
            n, removed, count, digest, cuts = zip(*rows) if rows else ([],) * 5
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(cuts, span)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>"
    joined = keyed.join(repeat_spans(keyed), "doc", "left")
    return joined.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans").mapInArrow(report, schema)


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the covered bytes cut out of ``text``; ``n_chars``, if there, is renewed."""
    importable_on_workers(docs.sparkSession)
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    # the text travels once; the rest of the row says whether there was one
    row = F.struct(*others, F.col("text").isNotNull().alias("text")).alias("row")
    keyed = with_keys(docs.select("doc_id", "text", row))

    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            yield pa.array([kept_bytes(t.as_py().encode(), merged_spans(s.as_py())).decode("utf-8", "ignore") for t, s in zip(texts, spans)], pa.string())

    joined = keyed.join(repeat_spans(keyed), "doc", "left")
    text = F.when(~F.col("row.text"), F.lit(None)).when(F.col("spans").isNull(), F.col("text")).otherwise(F.arrow_udf(cut, "string")("text", "spans"))
    out = joined.select("row", text.alias("text"))
    new = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
