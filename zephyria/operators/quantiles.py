"""Exact interpolated quantiles without holding a group in one task.

Spark's own exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer. Here a mergeable sketch brackets each wanted rank in one pass, the
rows below the bracket are counted, and only the values inside it are ordered. The
sketch's error is relative to ranks, not to values, so outliers and heavy tails do not
widen a bracket; the result is exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks from the sketch are off by at most 1 / ACCURACY of a group's rows.
ACCURACY = 10_000


def quantiles(
    df: DataFrame,
    value: str,
    probs: Mapping[str, float],
    keys: Sequence[str] = (),
    accuracy: int = ACCURACY,
    few_groups: bool = False,
) -> DataFrame:
    """One row per key with ``{name: quantile}``; ranks interpolate linearly.

    Without ``keys`` the result is one row for the table. Missing values are
    ignored, and a group without values has no row. A bracket holds at most four
    rows in ``accuracy`` (ties aside, which are counted, not kept), or a group of
    fewer than ``4 * accuracy`` rows.

    ``few_groups`` is the caller's statement that the number of groups is fixed
    (such as seasons times variables). Only then are the per-group figures
    broadcast, which spares the counts a second shuffle on those hot keys.
    """
    ordered = brackets(df, value, probs, keys, accuracy, few_groups)
    group = [*keys, "_i", "_total"]
    rank = F.element_at(F.array(*[F.lit(float(p)) for p in probs.values()]), F.col("_i") + 1) * (F.col("_total") - 1)

    def at(edge) -> Column:
        r = edge(rank)
        return F.max(F.when((r >= F.col("_start")) & (r < F.col("_start") + F.col("_n")), F.col("_v")))

    ends = ordered.groupBy(*group).agg(at(F.floor).alias("_a"), at(F.ceil).alias("_b"))
    lost = F.raise_error(F.lit("a wanted rank lies outside its bracket"))
    a, b = (F.when(F.col(c).isNotNull(), F.col(c)).otherwise(lost.cast("double")) for c in ("_a", "_b"))
    found = ends.select(*keys, "_i", (a + (b - a) * (rank - F.floor(rank))).alias("_q"))
    picked = [F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(name) for i, name in enumerate(probs)]
    rows = found.groupBy(*keys).agg(*picked)
    return rows if keys else rows.where(F.coalesce(*probs).isNotNull())


def brackets(
    df: DataFrame, value: str, probs: Mapping[str, float], keys: Sequence[str], accuracy: int, few_groups: bool
) -> DataFrame:
    """Distinct values inside each bracket with their count and first rank.

    (keys, _i: place of the probability, _total, _v, _n, _start).
    """
    group = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("_v"))
    edges = [min(max(p + side * 2 / accuracy, 0.0), 1.0) for p in probs.values() for side in (-1, 1)]
    figures = rows.groupBy(*group).agg(
        F.count("*").alias("_total"),
        F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi"),
        F.percentile_approx("_v", edges, accuracy).alias("_edges"),
    )
    small = F.col("_total") < 4 * accuracy
    spans = F.array(
        *[
            F.struct(
                F.lit(i).alias("_i"),
                F.when(small, F.col("_lo")).otherwise(F.col("_edges")[2 * i]).alias("_from"),
                F.when(small, F.col("_hi")).otherwise(F.col("_edges")[2 * i + 1]).alias("_to"),
            )
            for i in range(len(probs))
        ]
    )
    figures = figures.select(*group, "_total", spans.alias("_spans"))
    if group and not few_groups:
        counted = rows.groupBy(*group, "_v").agg(F.count("*").alias("_n")).join(figures, group)
        kept = counted.withColumn("_under", under(len(probs)))
    else:
        # the few brackets go to the rows: values outside all of them leave a task as counts
        if group:
            spanned = rows.join(F.broadcast(figures), group)
        else:
            spanned = rows.withColumn("_row", figures.select(F.struct("_total", "_spans")).scalar()).select("_v", "_row.*")
        held = F.exists("_spans", lambda s: (F.col("_v") >= s["_from"]) & (F.col("_v") <= s["_to"]))
        marked = spanned.select(*group, F.when(held, F.col("_v")).alias("_v"), under(len(probs)).alias("_under"))
        counts = marked.groupBy(*group, "_v", "_under").agg(F.count("*").alias("_n"))
        if group:
            kept = counts.join(F.broadcast(figures), group)
        else:
            kept = counts.withColumn("_row", figures.select(F.struct("_total", "_spans")).scalar()).select("_v", "_under", "_n", "_row.*")
    placed = kept.select(*group, "_total", "_v", "_n", "_under", F.inline("_spans"))
    is_under = F.expr("shiftright(_under, _i) & 1L") == 1
    below = placed.groupBy(*group, "_i").agg(F.sum(F.when(is_under, F.col("_n")).otherwise(0)).alias("_below"))
    inside = placed.where((F.col("_v") >= F.col("_from")) & (F.col("_v") <= F.col("_to"))).drop("_from", "_to", "_under")
    running = Window.partitionBy(*group, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    # without keys there are as many figures as probabilities
    joined = inside.join(F.broadcast(below) if few_groups or not group else below, [*group, "_i"])
    return joined.withColumn("_start", F.col("_below") + F.sum("_n").over(running) - F.col("_n")).drop("_below")


def under(spans: int) -> Column:
    """A bit for each bracket that the value lies below."""
    bits = [F.when(F.col("_v") < F.col("_spans")[i]["_from"], F.lit(1 << i)).otherwise(F.lit(0)) for i in range(spans)]
    return sum(bits, F.lit(0)).cast("long")


def approximate_quantiles(
    df: DataFrame, value: str, probs: Mapping[str, float], keys: Sequence[str] = (), accuracy: int = 10000
) -> DataFrame:
    """Single-pass sketch alternative for exploratory use; not interpolated."""
    return df.groupBy(*keys).agg(*[F.percentile_approx(value, p, accuracy).alias(n) for n, p in probs.items()])
