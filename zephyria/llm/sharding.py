"""Extendible hashing: shards are hash-prefix buckets that fit a byte limit.

The directory is indexed by the leading bits of a 60-bit hash. A bucket over the
limit splits on one more bit, others stay as they are, so a shard is the shortest
prefix whose rows fit. A histogram over prefixes somewhat longer than needed gives
the sizes of all shorter prefixes by summing; buckets still too large at its depth
go on to a further round with their own rows only.

Rows that share a hash to its last bit (rows with one id) and still exceed the limit
go on splitting on the hash of their place in the stored size table. A row that is
larger than the limit gets a shard of its own.

Defined cases: null text has 0 bytes; a null id hashes like the empty string; rows
without any bytes stay in the shard that their prefix names; an empty table gives no
rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zephyria.llm.common import stored, text_of

BITS = 60
#: 16 MiB, within what streaming loaders read as one shard.
SHARD_BYTES = 1 << 24
#: A round's histogram is this many bits finer than the average shard.
FINER = 4


def hash_bits(key: Column) -> Column:
    """The first 60 bits of a key's MD5, as a whole number."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def prefix(bits: Column, depth: Column) -> Column:
    """The first ``depth`` bits of a hash."""
    return F.call_function("shiftright", bits, (F.lit(BITS) - depth).cast("int"))


def split_buckets(rows: DataFrame, limit: int, low: int, high: int) -> DataFrame:
    """Directory over prefixes of ``high`` bits: (slot, depth, shard_bytes).

    ``rows`` has (bits, n_bytes). ``depth`` is the shortest prefix of at least ``low``
    bits that fits the limit, or null where even ``high`` bits do not.
    """
    slots = rows.groupBy(prefix(F.col("bits"), F.lit(high)).alias("slot")).agg(F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n_rows"))
    slots = stored(slots, "slots")
    sizes = (
        slots.select("n_bytes", "n_rows", "slot", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
        .select("n_bytes", "n_rows", "depth", F.call_function("shiftright", F.col("slot"), (F.lit(high) - F.col("depth")).cast("int")).alias("bucket"))
        .groupBy("depth", "bucket")
        .agg(F.sum("n_bytes").alias("bucket_bytes"), F.sum("n_rows").alias("bucket_rows"))
    )
    sizes = stored(sizes, "bucket-sizes").withColumn("fits", (F.col("bucket_bytes") <= limit) | (F.col("bucket_rows") == 1))
    above = sizes.select((F.col("depth") + 1).alias("depth"), F.col("bucket").alias("parent"), F.col("fits").alias("parent_fits"))
    leaves = (
        sizes.where("fits")
        .withColumn("parent", F.call_function("shiftright", F.col("bucket"), F.lit(1)))
        .join(above, ["depth", "parent"], "left")
        .where(~F.coalesce("parent_fits", F.lit(False)))
    )
    first = F.call_function("shiftleft", F.col("bucket"), (F.lit(high) - F.col("depth")).cast("int"))
    width = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(high) - F.col("depth")).cast("int"))
    covered = leaves.select(F.explode(F.sequence(first, first + width - 1)).alias("slot"), "depth", F.col("bucket_bytes").alias("shard_bytes"))
    return slots.select("slot").join(covered, "slot", "left")


def _rounds(rows: DataFrame, limit: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Settled rows of each round, and rows that no bit of the hash can part."""
    settled, low = [], 0
    while True:
        total = rows.agg(F.sum("n_bytes").alias("n")).first().n
        if total is None:
            return settled, None
        needed = max(0, math.ceil(math.log2(max(total, 1) / limit))) if low == 0 else low
        high = min(BITS, needed + FINER)
        directory = stored(split_buckets(rows, limit, low, high), "directory")
        placed = rows.withColumn("slot", prefix(F.col("bits"), F.lit(high))).join(directory, "slot").drop("slot")
        settled.append(placed.where("depth is not null"))
        if directory.where("depth is null").isEmpty():
            return settled, None
        rows = stored(placed.where("depth is null").drop("depth", "shard_bytes"), "open-rows")
        if high == BITS:
            return settled, rows
        low = high + 1


def bit_string(bits: Column, depth: Column) -> Column:
    """A prefix as text of 0 and 1; the empty prefix is empty."""
    return F.substring(F.lpad(F.bin(bits), BITS, "0"), F.lit(1), depth.cast("int"))


def shard_report(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, shard, depth, shard_bytes: a row for each row of ``docs``."""
    if limit < 1:
        raise ValueError("the limit must be at least one byte")
    sizes = docs.select("doc_id", hash_bits(F.col("doc_id")).alias("bits"), F.octet_length(text_of()).cast("long").alias("n_bytes"))
    sizes = stored(sizes.withColumn("place", F.monotonically_increasing_id()), "sizes")
    settled, same = _rounds(sizes, limit)
    parts = [s.select("place", "doc_id", "n_bytes", bit_string(F.col("bits"), F.col("depth")).alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes") for s in settled]
    if same is not None:
        parts += _by_place(same, limit)
    out = parts[0] if parts else sizes.select("place", "doc_id", "n_bytes", F.lit("").alias("shard"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("shard_bytes"))
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("place")


def _by_place(rows: DataFrame, limit: int) -> list[DataFrame]:
    """A second directory, over the hash of a row's place, for rows with equal hashes."""
    settled, left = _rounds(rows.withColumn("bits", hash_bits(F.concat_ws(":", "bits", "place"))), limit)
    if left is not None:
        raise RuntimeError("two rows share both hashes")
    shard = F.concat(F.lit("."), bit_string(F.col("bits"), F.col("depth")))
    return [s.select("place", "doc_id", "n_bytes", shard.alias("shard"), (F.col("depth") + BITS).cast("int").alias("depth"), "shard_bytes") for s in settled]
