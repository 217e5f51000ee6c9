"""Best-fit packing of token sequences, certified by dual feasible functions.

Documents become pieces of at most ``seq_len`` tokens; full pieces are sequences of
their own. Each partition packs its pieces by best-fit decreasing and computes lower
bounds on its sequences from dual feasible functions (on its histogram of lengths).
A partition whose count meets its bound is certified and closed. Pieces of the others,
and of any sequence less than half full, are exchanged: dealt anew over partitions
and packed again, until all is certified or a round brings nothing.

Defined cases: null and empty texts are the end token alone; repeated rows are packed
once each; columns other than doc_id and text are ignored; an empty table gives no
rows. Lengths equal in size are placed in the order of their keys.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyria.llm.common import importable_on_workers, stored, text_of
from zephyria.llm.tokenizers_local import id_encoder

SEQ_LEN = 2048
END_ID = 0
#: Pieces that one partition packs (16 bytes each).
PART_PIECES = 100_000
ROUNDS = 6
#: Rounding functions u(k) for k up to this are tried for the bound.
ROUNDINGS = 24

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = "key long, length long, part long, bin long, offset long, certified boolean, fill long, bins long, bound long"


def cut(n: int, seq_len: int) -> list[tuple[int, int]]:
    """(start, end) of a document's pieces; only the first may be short."""
    first = n % seq_len or min(n, seq_len)
    return [(0, first), *((a, a + seq_len) for a in range(first, n, seq_len))]


def token_pieces(docs: DataFrame, path: str, seq_len: int = SEQ_LEN, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32, and ids if wanted."""
    importable_on_workers(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    schema = PIECE + (", ids array<long>" if with_ids else "")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = id_encoder(path), np.array([END_ID], "<u4")
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([encode(text.as_py()).astype("<u4", copy=False), end])
                for i, (a, b) in enumerate(cut(len(ids), seq_len)):
                    own = (ids[a:b].astype(np.int64),) if with_ids else ()
                    rows.append((doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes()), *own))
            kinds = [*types, *([pa.list_(pa.int64())] if with_ids else [])]
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[*names, *(["ids"] if with_ids else [])])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(pieces, schema)


def best_fit_decreasing(lengths: np.ndarray, seq_len: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length (already in falling order), and the number of bins.

    Bins wait in stacks by the room they have; a bit mask tells which rooms exist.
    """
    rooms: list[list[int]] = [[] for _ in range(seq_len + 1)]
    mask = count = 0
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, size in enumerate(lengths.tolist()):
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, at, count = seq_len, count, count + 1
        bins[i], offsets[i] = at, seq_len - room
        left = room - size
        if left:
            rooms[left].append(at)
            mask |= 1 << left
    return bins, offsets, count


def bin_bound(lengths: np.ndarray, seq_len: int, roundings: int = ROUNDINGS) -> int:
    """The best lower bound that the tried dual feasible functions give.

    f(t): lengths above seq_len - t count as full, those below t as nothing.
    u(k): lengths are rounded down to parts of 1/k, unless (k + 1) parts fit exactly.
    """
    histogram = np.bincount(lengths, minlength=seq_len + 1).astype(np.int64)
    size = np.arange(seq_len + 1, dtype=np.int64)
    count, total = np.cumsum(histogram), np.cumsum(histogram * size)
    t = np.arange(1, seq_len // 2 + 1)
    full = (count[-1] - count[seq_len - t]) * seq_len
    between = total[seq_len - t] - total[t - 1]
    best = max(-(-int(total[-1]) // seq_len), -(-int((full + between).max(initial=0)) // seq_len))
    for k in range(1, roundings + 1):
        scaled = np.where(size * (k + 1) % seq_len == 0, size * k, (size * (k + 1) // seq_len) * seq_len)
        best = max(best, -(-int((histogram * scaled).sum()) // (seq_len * k)))
    return best


def pack_round(pieces: DataFrame, parts: int, seq_len: int) -> DataFrame:
    """Pack (key, length) within each of ``parts`` partitions."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        keys = np.concatenate([b.column(0).to_numpy() for b in got])
        lengths = np.concatenate([b.column(1).to_numpy() for b in got])
        order = np.lexsort((keys, -lengths))
        keys, lengths = keys[order], lengths[order]
        bins, offsets, count = best_fit_decreasing(lengths, seq_len)
        bound = bin_bound(lengths, seq_len)
        n, same = len(keys), np.full
        fill = np.bincount(bins, lengths, count).astype(np.int64)[bins]
        columns = [keys, lengths, same(n, TaskContext.get().partitionId(), np.int64), bins, offsets, same(n, count == bound), fill, same(n, count, np.int64), same(n, bound, np.int64)]
        names = ["key", "length", "part", "bin", "offset", "certified", "fill", "bins", "bound"]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return pieces.repartition(parts).mapInArrow(pack, PLACED)


def assign(pieces: DataFrame, seq_len: int = SEQ_LEN, part_pieces: int = PART_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """(key, sequence_id, offset) of each (key, length) piece shorter than a sequence."""
    parts_for = lambda n: max(1, -(-n // part_pieces))
    waiting, closed = pieces, []
    n = pieces.count()
    for turn in range(rounds):
        parts = parts_for(n)
        placed = stored(pack_round(waiting, parts, seq_len), f"packed-{turn}")
        placed = placed.withColumn("sequence_id", F.lit(turn << 56) + F.col("part") * (1 << 24) + F.col("bin"))
        loose = ~F.col("certified") | (F.col("fill") * 2 < seq_len)
        n_loose = placed.where(loose).count()
        if parts == 1 or n_loose in (0, n) and turn or turn == rounds - 1:
            return _all([*closed, placed])
        closed.append(placed.where(~loose))
        waiting, n = placed.where(loose).select("key", "length"), n_loose
    return _all(closed)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("key", "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, seq_len: int = SEQ_LEN, with_ids: bool = False, part_pieces: int = PART_PIECES) -> DataFrame:
    """Pieces of all documents with the sequence and the place that each one gets."""
    pieces = token_pieces(docs, path, seq_len, with_ids).withColumn("key", F.monotonically_increasing_id())
    pieces = stored(pieces, "pieces")
    short = F.col("length") < seq_len
    placed = assign(pieces.where(short).select("key", "length"), seq_len, part_pieces)
    full = pieces.where(~short).withColumns({"sequence_id": -1 - F.col("key"), "offset": F.lit(0).cast("long")})
    return pieces.where(short).join(placed, "key").unionByName(full).drop("key")
