"""Exact Jaccard links between word-shingle sets, by adaptive multi-match prefixes.

Of two sets of similarity t, each shares at least t of its own shingles. In any fixed
order of all shingles, the first n - ceil(t n) + l of one set therefore hold at least l
that are also in the other's first ones. The order is by document frequency, so that a
set's first shingles are those that no other set has, and only sets of which 80 % occurs
elsewhere get into the index at all.

1. Each set's shingles are cut to 32 bits and dealt to buckets in packed blocks; a
   bucket counts them and returns those that more than one set has. A shingle that
   several sets of a block have goes there once, with its count, whatever their number.
2. A set whose prefix reaches shared shingles indexes them. Its cost is the number of
   candidates that they promise; the prefix is longer, and l higher, the higher the cost.
3. Sets that share an index entry form clusters. A cluster's sets meet in blocks of
   bounded size, where pairs must share as many prefix shingles as the lower of both
   l before the whole sets are compared. No pair leaves a block, only which sets are
   connected.
4. Of a cluster with several blocks, all sets outside its largest component visit all
   its blocks. With that, every pair not yet connected was compared.

Equal sets are one set throughout. Block counts are exact, hashes have 64 bits; those
cut to 32 bits and a bucket only order and route.

Defined cases: null and empty texts and texts without words have no shingles and no
links; where ids are null or repeat, rows count as documents of their own, null ids
first; a component without any id has a null one; columns other than doc_id and text
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyria.llm.common import dropped, importable_on_workers, keyed_rows, stored, with_keys
from zephyria.llm.components import components
from zephyria.llm.shingles import set_print, shingle_set

#: Similarity in percent.
PERCENT = 80
#: Shingles, and sets, that a task packs before it hands blocks on.
PACK_SHINGLES = 1 << 20
PACK_SETS = 1 << 16
#: Bytes of text for each bucket of shingles, and the fewest buckets.
BUCKET_BYTES = 1 << 23
BUCKETS = 64
#: Sets that meet in one block.
BLOCK_SETS = 1024
#: Small clusters are compared together up to so many sets.
TOGETHER = 256
#: Shingles of so many sets of a block are counted by matrix product.
DENSE = 24
DENSE_COLUMNS = 8192

PASS = "kind int, bucket long, pack long, body binary, doc long, n long, print1 long, print2 long"
PACKED = "kind int, pack long, bucket long, body binary"
#: Kinds of rows: a document's set; shingles that one set of a pack has; the pack's sets;
#: shingles that several have, with counts; which sets those are.
SET, ONCE, HEAD, OFTEN, OWNERS = range(5)
ENTRY = "print1 long, print2 long, token long, matches int"


def overlap_needed(n: int | np.ndarray):
    """Fewest shingles that a set of n shares with any set it links with."""
    return -(-PERCENT * n // 100)


def matches_wanted(cost: float | np.ndarray, n: int | np.ndarray):
    """l of a set of n: one, and one more for each doubling of the candidates per prefix shingle.

    Never more than a linked pair is sure to share, or short sets would lose their links.
    """
    needed = overlap_needed(n)
    return np.minimum(1 + np.log2(1 + cost / np.maximum(n - needed + 1, 1)).astype(np.int64), needed)


# ------------------------------------------------------------------ shingles to index


def body_of(owner: np.ndarray, tokens: np.ndarray) -> bytes:
    """Six bytes for each shingle: how far its set is from the last one's, and its 32 bits.

    Nothing is stored for sets without a shingle in the bucket, so many small buckets
    cost no more than few large ones.
    """
    return np.diff(owner, prepend=0).astype("<u2").tobytes() + tokens.astype("<u4").tobytes()


def parts_of(body: bytes, width: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Sets, shingles and what follows them, of a body with ``width`` bytes a shingle."""
    n = len(body) // width
    owner = np.cumsum(np.frombuffer(body, "<u2", n).astype(np.int64))
    return owner, np.frombuffer(body, "<u4", n, 2 * n), body[6 * n :]


def same_bucket(token: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of tokens, in order, that have one bucket."""
    if not len(token):
        return []
    first = np.flatnonzero(np.diff(token >> 32, prepend=-1))
    return list(zip(first.tolist(), [*first[1:].tolist(), len(token)]))


def halves(token: np.ndarray) -> bytes:
    return (token & 0xFFFFFFFF).astype("<u4").tobytes()


def log_weight(df: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.log2(df) * 8).astype(np.uint8)


def packed_shingles(keyed: DataFrame, buckets: int) -> DataFrame:
    """Each row's set, packed shingles by bucket, and the sets of each pack, told by ``kind``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, packs = TaskContext.get().partitionId(), 0
        held: dict[tuple[int, int], np.ndarray] = {}
        size = 0
        for batch in batches:
            docs = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                shingles = shingle_set(text.as_py())
                prints = set_print(shingles)
                docs.append((doc, len(shingles), *prints))
                if len(shingles) and prints not in held:
                    held[prints] = shingles
                    size += len(shingles)
                if size >= PACK_SHINGLES or len(held) >= PACK_SETS:
                    yield packed(held, part << 32 | packs)
                    held, size, packs = {}, 0, packs + 1
            if docs:
                yield plain(docs)
        if held:
            yield packed(held, part << 32 | packs)

    names = ["kind", "bucket", "pack", "body", "doc", "n", "print1", "print2"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]

    def plain(docs: list[tuple]) -> pa.RecordBatch:
        own = [pa.array(c, pa.int64()) for c in zip(*docs)]
        none = [pa.nulls(len(docs), t) for t in types[1:4]]
        return pa.RecordBatch.from_arrays([pa.array([SET] * len(docs), pa.int32()), *none, *own], names=names)

    def packed(held: dict, pack: int) -> pa.RecordBatch:
        sizes = np.fromiter(map(len, held.values()), np.int64, len(held))
        shingles, owner = np.concatenate(list(held.values())), np.repeat(np.arange(len(held)), sizes)
        bucket = ((shingles >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        token = bucket << 32 | (shingles & np.uint64(0xFFFFFFFF)).astype(np.int64)
        names_of, place, counts = np.unique(token, return_inverse=True, return_counts=True)
        often = counts > 1
        shared = names_of[often]
        rows = []
        for a, b in same_bucket(shared):
            rows.append((OFTEN, int(shared[a] >> 32), pack, halves(shared[a:b]) + counts[often][a:b].astype("<u4").tobytes()))
        mine = often[place]
        by_token = np.argsort(place[mine], kind="stable")
        heads = np.array([len(shared)], "<i8").tobytes() + shared.astype("<i8").tobytes() + counts[often].astype("<u4").tobytes()
        rows.append((OWNERS, None, pack, heads + owner[mine][by_token].astype("<u2").tobytes()))
        token, owner = token[~mine], owner[~mine]
        order = np.argsort(token >> 32, kind="stable")
        token, owner = token[order], owner[order]
        for a, b in same_bucket(token):
            rows.append((ONCE, int(token[a] >> 32), pack, body_of(owner[a:b], token[a:b] & 0xFFFFFFFF)))
        head = np.array([[len(s), *p] for p, s in held.items()], "<i8")
        rows.append((HEAD, None, pack, head.tobytes()))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
        return pa.RecordBatch.from_arrays([*columns, *[pa.nulls(len(rows), t) for t in types[4:]]], names=names)

    return keyed.select("doc", "text").mapInArrow(scan, PASS)


def shared_shingles(packs: DataFrame) -> DataFrame:
    """The packed shingles of each bucket that occur in more than one set, with their weight."""

    def count(table: pa.Table) -> pa.Table:
        kinds, bodies, owners, tokens, counts = table.column("kind").to_pylist(), table.column("body").to_pylist(), [], [], []
        for kind, body in zip(kinds, bodies):
            if kind == ONCE:
                owner, short, _ = parts_of(body, 6)
                often = np.ones(len(short), np.uint32)
            else:
                owner, (short, often) = None, np.frombuffer(body, "<u4").reshape(2, -1)
            owners.append(owner)
            tokens.append(short)
            counts.append(often)
        _, place = np.unique(np.concatenate(tokens), return_inverse=True)
        found, out, at = np.bincount(place, np.concatenate(counts))[place], [], 0
        for owner, short in zip(owners, tokens):
            df = found[at : at + len(short)]
            at += len(short)
            again = df > 1
            body = short.tobytes() if owner is None else body_of(owner[again], short[again])
            out.append(body + log_weight(df[again]).tobytes())
        return pa.table({c: table.column(c) for c in ("kind", "pack", "bucket")} | {"body": pa.array(out, pa.binary())})

    return packs.groupBy("bucket").applyInArrow(count, PACKED)


def index_entries(shared: DataFrame, heads: DataFrame) -> DataFrame:
    """(print1, print2, token, matches): the shared shingles in each set's prefix."""

    def often_of(body: bytes, known: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
        """Sets, tokens and weights of the shingles that several sets of the pack have."""
        n = int(np.frombuffer(body, "<i8", 1)[0])
        token, counts = np.frombuffer(body, "<i8", n, 8), np.frombuffer(body, "<u4", n, 8 + 8 * n)
        owner = np.frombuffer(body, "<u2", -1, 8 + 12 * n).astype(np.int64)
        order = np.argsort(known)  # every one of the pack's tokens came back, by bucket
        return owner, np.repeat(token, counts), np.repeat(weight[order], counts)

    def gather(table: pa.Table) -> pa.Table:
        head, often, owners, tokens, weights = None, None, [], [], []
        known, known_weights = [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
        for kind, bucket, body in zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "body"))):
            if kind == HEAD:
                head = np.frombuffer(body, "<i8").reshape(-1, 3)
            elif kind == OWNERS:
                often = body
            elif kind == OFTEN:
                n = len(body) // 5
                known.append(np.frombuffer(body, "<u4", n).astype(np.int64) | bucket << 32)
                known_weights.append(np.frombuffer(body, np.uint8, n, 4 * n))
            else:
                own, short, weight = parts_of(body, 7)
                owners.append(own)
                tokens.append(short.astype(np.int64) | bucket << 32)
                weights.append(np.frombuffer(weight, np.uint8))
        for to, x in zip((owners, tokens, weights), often_of(often, np.concatenate(known), np.concatenate(known_weights))):
            to.append(x)
        owner, token, weight = (np.concatenate(x) for x in (owners, tokens, weights))
        m, n = len(head), head[:, 0]
        k = np.bincount(owner, minlength=m)
        reach = k - overlap_needed(n) + 1  # shared shingles in the shortest prefix
        owner, token, weight = (x[reach[owner] > 0] for x in (owner, token, weight))
        order = np.lexsort((token, weight, owner))
        owner, token, weight = owner[order], token[order], weight[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        base = place < reach[owner]
        cost = np.bincount(owner[base], 2.0 ** (weight[base] / 8) - 1, m)
        matches = matches_wanted(cost, n)
        used = place < (reach + matches - 1)[owner]
        owner, token = owner[used], token[used]
        return pa.table({"print1": head[owner, 1], "print2": head[owner, 2], "token": token, "matches": matches[owner].astype(np.int32)})

    parts = shared.unionByName(heads.select("kind", "pack", F.lit(None).cast("long").alias("bucket"), "body"))
    return parts.groupBy("pack").applyInArrow(gather, ENTRY)


# ------------------------------------------------------------------ blocks of sets


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two sets share."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((m, m), np.float32)
    keep = counts[column] > 1
    owner, column = owner[keep], column[keep]
    order = np.argsort(column, kind="stable")
    owner, size = owner[order], counts[column[order]]
    for n in range(2, min(DENSE, m + 1)):
        rows = owner[size == n].reshape(-1, n)
        if len(rows):
            i, j = np.triu_indices(n, 1)
            pairs = (rows[:, i].astype(np.int64) * m + rows[:, j]).ravel()
            out += np.bincount(pairs, minlength=m * m).reshape(m, m)
    out += out.T
    many = size >= DENSE
    owner, column = owner[many], column[order][many]
    if len(owner):
        column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]]))
        for a in range(0, int(column[-1]) + 1, DENSE_COLUMNS):
            mine = (column >= a) & (column < a + DENSE_COLUMNS)
            block = np.zeros((m, min(DENSE_COLUMNS, int(column[-1]) + 1 - a)), np.float32)
            block[owner[mine], column[mine] - a] = 1
            out += block @ block.T
    return out.astype(np.int64)


def prefixes(sets: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Each set's prefix in the block's own order of frequency, and its l."""
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out, matches, at = [], [], 0
    for s in sets:
        df = counts[column[at : at + len(s)]]
        at += len(s)
        order = np.argsort(df, kind="stable")
        base = len(s) - overlap_needed(len(s)) + 1
        wanted = int(matches_wanted(float(df[order[:base]].sum() - base), len(s)))
        out.append(s[order[: base + wanted - 1]])
        matches.append(wanted)
    return out, np.array(matches)


def linked(sets: list[np.ndarray]) -> np.ndarray:
    """Which two sets link: candidates by prefix matches, then exact overlap."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    first, matches = prefixes(sets)
    candidate = shared_counts(first) >= np.minimum(matches[:, None], matches[None, :])
    candidate &= 100 * np.minimum(n[:, None], n[None, :]) >= PERCENT * np.maximum(n[:, None], n[None, :])
    np.fill_diagonal(candidate, False)
    out = np.zeros_like(candidate)
    some = np.flatnonzero(candidate.any(axis=1))
    if len(some):
        both = shared_counts([sets[i] for i in some])
        union = n[some][:, None] + n[some][None, :] - both
        out[np.ix_(some, some)] = candidate[np.ix_(some, some)] & (100 * both >= PERCENT * union)
    return out


def least_labels(links: np.ndarray) -> np.ndarray:
    """The least index that each index is connected with."""
    label = np.arange(len(links))
    while True:
        new = np.minimum(label, np.where(links, label[None, :], len(links)).min(axis=1, initial=len(links)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compared_blocks(texts: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what links within each block.

    ``texts`` has cluster, block, visits, doc, text. Visitors are compared with the
    block's own sets and come after them.
    """

    def edges_of(docs: list[int], sets: list[np.ndarray], own: int | None = None) -> tuple[list[int], list[int]]:
        links = linked(sets)
        if own is not None:  # own sets were compared before
            links[:own, :own] = False
        label = least_labels(links)
        moved = np.flatnonzero(label != np.arange(len(label)))
        ids = np.array(docs, np.int64)
        return ids[moved].tolist(), ids[label[moved]].tolist()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, sets, guests, guest_sets, visited, key = [], [], [], [], False, None

        def done() -> pa.RecordBatch:
            if visited:
                a, b = edges_of(docs + guests, sets + guest_sets, len(docs)) if guests else ([], [])
            else:
                a, b = edges_of(docs, sets)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for cluster, block, visits, doc, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (cluster, block) != key:
                    if docs and (visited or visits is not None or len(docs) >= TOGETHER):
                        yield done()
                        docs, sets, guests, guest_sets = [], [], [], []
                    visited, key = visits is not None, (cluster, block)
                if visits:
                    if len(guests) >= TOGETHER:
                        yield done()
                        guests, guest_sets = [], []
                    guests.append(doc)
                    guest_sets.append(shingle_set(text))
                else:
                    docs.append(doc)
                    sets.append(shingle_set(text))
        if docs:
            yield done()

    dealt = texts.select("cluster", "block", "visits", "doc", "text").repartition("cluster", "block")
    return dealt.sortWithinPartitions("cluster", "block", "visits").mapInArrow(compare, "a long, b long")


# ------------------------------------------------------------------ the join


def set_links(sets: DataFrame, entries: DataFrame, keyed: DataFrame) -> DataFrame:
    """Edges (a, b) between first documents of linked sets, enough to connect all that link."""
    index = entries.join(sets, ["print1", "print2"]).select("token", "first").distinct()
    index = stored(index, "index")
    lists = index.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("least")).where("n > 1")
    near = index.join(lists, "token").where("first <> least").select(F.col("first").alias("a"), F.col("least").alias("b"))
    clusters = components(near)
    sizes = clusters.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    blocks = F.ceil(F.col("size") / BLOCK_SETS).cast("int")
    placed = clusters.join(sizes, "label").select(
        F.col("node").alias("doc"), F.col("label").alias("cluster"), blocks.alias("blocks"), F.pmod(F.hash("node"), blocks).alias("block")
    )
    # the list of candidates grows with the input, so it is never to be broadcast
    texts = stored(keyed.select("doc", "text").join(placed.hint("merge"), "doc"), "candidates")
    within = stored(compared_blocks(texts.withColumn("visits", F.lit(None).cast("boolean"))), "links")
    large = texts.where("blocks > 1")
    joined = components(within)
    member = large.select("doc", "cluster").join(joined, F.col("doc") == F.col("node"), "left").select("doc", "cluster", F.coalesce("label", "doc").alias("label"))
    counts = member.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.groupBy("cluster").agg(F.max(F.struct("n", "label"))["label"].alias("largest"))
    outside = member.join(largest, "cluster").where("label <> largest").select("doc")
    guests = large.join(outside, "doc").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("visits", F.lit(True))
    across = compared_blocks(large.withColumn("visits", F.lit(False)).unionByName(guests))
    return within.unionByName(stored(across.where("a <> b"), "links"))


def linked_documents(keyed: DataFrame) -> DataFrame:
    """(doc, n_shingles, component): the least row key that each row's set is linked with."""
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    scanned = stored(packed_shingles(keyed, max(BUCKETS, -(-total // BUCKET_BYTES))), "shingles")
    rows = stored(scanned.where(F.col("kind") == SET).select("doc", "n", "print1", "print2"), "rows")
    heads = scanned.where(F.col("kind").isin(HEAD, OWNERS)).select("kind", "pack", "body")
    shared = shared_shingles(scanned.where(F.col("kind").isin(ONCE, OFTEN)).select("kind", "pack", "bucket", "body"))
    entries = stored(index_entries(shared, heads), "entries")
    dropped(scanned)  # about as large as the input, and read for the last time
    sets = stored(rows.where("n > 0").groupBy("print1", "print2").agg(F.min("doc").alias("first")), "sets")
    linked_sets = components(set_links(sets, entries, keyed))
    place = sets.join(linked_sets, F.col("first") == F.col("node"), "left").select("print1", "print2", F.coalesce("label", "first").alias("component"))
    some = rows.where("n > 0").join(place, ["print1", "print2"]).select("doc", F.col("n").alias("n_shingles"), "component")
    return some.unionByName(rows.where("n = 0").select("doc", F.col("n").alias("n_shingles"), F.col("doc").alias("component")))


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each row of ``docs``."""
    importable_on_workers(docs.sparkSession)
    keyed, sound = keyed_rows(docs.select("doc_id", "text"))
    found = linked_documents(keyed)
    kind = docs.schema["doc_id"].dataType
    if sound and isinstance(kind, T.IntegralType):  # the row keys are the ids
        return found.select(F.col("doc").cast(kind).alias("doc_id"), "n_shingles", F.col("component").cast(kind).alias("component_id"))
    found = stored(found, "linked")
    ids = keyed.select("doc", "doc_id")
    named = found.join(ids, "doc")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "component").select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with the first document of each component, columns unchanged."""
    importable_on_workers(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = with_keys(docs.select("doc_id", "text", row))
    firsts = stored(linked_documents(keyed).where("doc = component").select("doc"), "kept")
    return keyed.join(firsts, "doc", "left_semi").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
