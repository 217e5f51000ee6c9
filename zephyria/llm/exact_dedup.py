"""Exact duplicates: frequent digests leave on the map side, the rest is shuffled.

A Misra-Gries summary (Spark's ``approx_top_k``, a frequent-items sketch) names
the digests that may be frequent. Their exact counts and smallest ids are then
taken over all rows; those that really are frequent form a table of at most
``tracked`` rows, which is broadcast so that their copies are decided where they
are read. Every other digest is shuffled on its digest, where no group is large.

Defined cases: null text is the empty text; a null ``doc_id`` counts as larger
than any id; of equal texts with equal ids exactly one row is kept; result
columns replace input columns of the same name; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zephyria.llm.common import boxed, stored, text_of, unboxed

WHITE_SPACE = r"[\x20\x09-\x0D]+"
#: The summary holds this many digests in all; so many winners can be broadcast at most.
TRACKED = 4096
#: A digest with at least this many rows is decided on the map side.
FREQUENT = 64
#: Winner rows that repeat one id are thinned in this many parts first.
PARTS = 512


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with each run of white space made one space."""
    return F.sha2(F.regexp_replace(text, WHITE_SPACE, " "), 256)


def frequent_digests(digests: DataFrame, tracked: int = TRACKED, frequent: int = FREQUENT) -> DataFrame:
    """Digests with at least ``frequent`` rows among the summary's candidates.

    ``digests``: (doc_id, digest). Returns (digest, keep_id, group_size), at most
    ``tracked`` rows. Summaries merge in two levels, so that no task receives one
    from every input partition.
    """
    keys = digests.select("doc_id", "digest", F.xxhash64("digest").alias("key"))
    first = keys.groupBy(F.pmod(F.spark_partition_id(), F.lit(64)).alias("part")).agg(
        F.expr(f"approx_top_k_accumulate(key, {2 * tracked}) AS summary")
    )
    candidates = (
        # a keyed group, since the merge cannot start from a partition without summaries
        first.groupBy(F.lit("all")).agg(F.expr(f"approx_top_k_combine(summary, {2 * tracked}) AS summary"))
        .select(F.explode(F.expr(f"approx_top_k_estimate(summary, {tracked})")).alias("found"))
        .where(F.col("found.count") >= frequent)
        .select(F.col("found.item").alias("key"))
    )
    return (
        keys.join(F.broadcast(candidates), "key", "left_semi")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") >= frequent)
    )


def mark_duplicates(rows: DataFrame, winners: DataFrame) -> DataFrame:
    """Add ``keep_id``, ``group_size`` and ``kept`` to rows with doc_id and digest."""
    hot = F.broadcast(winners.select("digest", F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size")))
    known = rows.join(hot, "digest", "left")
    is_hot, is_first = F.col("hot_size").isNotNull(), F.col("doc_id").eqNullSafe(F.col("hot_id"))
    out = [F.col(c) for c in rows.columns]

    def decided(df: DataFrame) -> DataFrame:
        return df.select(*out, F.col("hot_id").alias("keep_id"), F.col("hot_size").alias("group_size"), F.lit(False).alias("kept"))

    by_id = F.col("doc_id").asc_nulls_last()
    part = F.pmod(F.monotonically_increasing_id(), F.lit(PARTS))
    firsts = (
        known.where(is_hot & is_first)
        .withColumn("part", part)
        .withColumn("place", F.row_number().over(Window.partitionBy("digest", "part").orderBy(by_id)))
    )
    group = Window.partitionBy("digest")
    rest = (
        known.where(~is_hot)
        .unionByName(firsts.where("place = 1").drop("part", "place"))
        .withColumn("place", F.row_number().over(group.orderBy(by_id)))
        .withColumn("n", F.count(F.lit(1)).over(group))
        .withColumn("least", F.min("doc_id").over(group))
        .select(
            *out,
            F.when(F.col("hot_size").isNull(), F.col("least")).otherwise(F.col("hot_id")).alias("keep_id"),
            F.coalesce("hot_size", "n").alias("group_size"),
            (F.col("place") == 1).alias("kept"),
        )
    )
    return decided(known.where(is_hot & ~is_first)).unionByName(decided(firsts.where("place > 1"))).unionByName(rest)


def digests_and_winners(docs: DataFrame, tracked: int, frequent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest) of every row, and the verified frequent digests; both stored."""
    digests = stored(docs.select("doc_id", text_digest(text_of()).alias("digest")), "digests")
    return digests, stored(frequent_digests(digests, tracked, frequent), "frequent")


def exact_dedup(docs: DataFrame, tracked: int = TRACKED, frequent: int = FREQUENT) -> DataFrame:
    """Every row of ``docs`` with keep_id, group_size, kept and text_sha256."""
    _, winners = digests_and_winners(docs, tracked, frequent)
    rows = boxed(docs, doc_id=F.col("doc_id"), digest=text_digest(text_of()))
    return unboxed(
        mark_duplicates(rows, winners),
        docs.columns,
        keep_id=F.col("keep_id"),
        group_size=F.col("group_size"),
        kept=F.col("kept"),
        text_sha256=F.col("digest"),
    )


def duplicate_report(docs: DataFrame, tracked: int = TRACKED, frequent: int = FREQUENT) -> DataFrame:
    """The same decisions without the texts: doc_id, keep_id, group_size, kept, text_sha256."""
    narrow, winners = digests_and_winners(docs, tracked, frequent)
    return mark_duplicates(narrow, winners).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def keep_first(docs: DataFrame, tracked: int = TRACKED, frequent: int = FREQUENT) -> DataFrame:
    """``docs`` with one row of each group of equal texts, columns unchanged.

    Where doc_id names a row, all is decided on stored digests, and texts are read once
    more and moved once, to leave without the rows that go.
    """
    digests, winners = digests_and_winners(docs, tracked, frequent)
    ids = digests.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known"), F.count_distinct("doc_id").alias("ids")).first()
    if ids.n == ids.known == ids.ids:
        gone = mark_duplicates(digests, winners).where(~F.col("kept")).select(F.col("doc_id").alias("gone"))
        rows = boxed(docs, doc_id=F.col("doc_id")).join(gone, F.col("doc_id") == F.col("gone"), "left_anti")
        return unboxed(rows, docs.columns)
    rows = boxed(docs, doc_id=F.col("doc_id"), digest=text_digest(text_of()))
    return unboxed(mark_duplicates(rows, winners).where("kept"), docs.columns)
