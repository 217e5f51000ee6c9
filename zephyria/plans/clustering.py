"""Ward clustering by climate and pollution profile."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zephyria import config
from zephyria.operators.aggregates import mean_of, means
from zephyria.operators.columns import existing
from zephyria.operators.scaling import standardise

STARTS = 10
#: Lloyd rounds of one start at most; it ends earlier when the centres rest.
ITERATIONS = 300


def ward_profiles(wards: DataFrame, cols: Sequence[str] = config.WARD_FEATURES) -> DataFrame:
    """Mean features per ward, missing means as 0."""
    cols = existing(wards, cols)
    return means(wards, cols, ["ward"]).fillna(0.0, subset=cols)


def first_centres(points: DataFrame, k: int, starts: int, seed: int) -> np.ndarray:
    """(starts, k, columns): for each start ``k`` rows, each far from those before it.

    As in k-means++, a row is drawn in proportion to its squared distance to the
    centres so far; the draw is the least of exponential variates with that rate, so one
    aggregate draws for all starts at once.
    """
    chosen = np.zeros((starts, 0, len(points.schema["x"].dataType.names)))
    for turn in range(k):
        draws = []
        for s in range(starts):
            rate = nearest(chosen[s])["cost"] if turn else F.lit(1.0)
            uniform = (F.pmod(F.xxhash64("ward", F.lit(seed), F.lit(s), F.lit(turn)), F.lit(1 << 52)) + 1) / float(1 << 52)
            draws.append(F.min_by("x", F.try_divide(-F.log(uniform), rate)).alias(f"d{s}"))
        # rows at distance 0 have no rate, hence no draw; where all are, any row will do
        row = points.agg(*draws, F.min("x").alias("any")).first()
        picked = np.array([tuple(row[f"d{s}"] or row["any"]) for s in range(starts)])
        chosen = np.concatenate([chosen, picked[:, None, :]], axis=1)
    return chosen


def nearest(centres: np.ndarray) -> Column:
    """The place of the nearest centre and the squared distance to it, as a struct (cost, place)."""
    found = [
        F.struct(
            sum(((F.col(f"x.{n}") - float(v)) * (F.col(f"x.{n}") - float(v)) for n, v in zip(_names(len(c)), c)), F.lit(0.0)).alias("cost"),
            F.lit(i).alias("place"),
        )
        for i, c in enumerate(centres)
    ]
    return F.least(*found) if len(found) > 1 else found[0]


def _names(n: int) -> list[str]:
    return [f"x{i}" for i in range(n)]


def lloyd(points: DataFrame, k: int, starts: int, iterations: int, seed: int) -> np.ndarray:
    """The centres of the cheapest of ``starts`` k-means runs, all of them advanced in the same jobs.

    A round is one partial aggregate: each row goes to its nearest centre of every start,
    and sums by (start, centre) come back, a few rows whatever the table's size.
    """
    names = points.schema["x"].dataType.names
    centres = first_centres(points, k, starts, seed)
    costs = np.full(starts, np.inf)
    for _ in range(iterations + 1):
        each = F.array(*[F.struct(F.lit(s).alias("start"), nearest(c).alias("near")) for s, c in enumerate(centres)])
        sums = (
            points.select("x", F.explode(each).alias("e"))
            .groupBy("e.start", "e.near.place")
            .agg(F.count("*").alias("n"), F.sum("e.near.cost").alias("cost"), *[F.sum(f"x.{c}").alias(c) for c in names])
            .collect()
        )
        moved, costs = centres.copy(), np.zeros(starts)
        for r in sums:
            moved[r["start"], r["place"]] = [r[c] / r["n"] for c in names]
            costs[r["start"]] += r["cost"]
        rested = np.allclose(moved, centres, rtol=0, atol=1e-9)
        if rested:
            break
        centres = moved
    return centres[costs.argmin()]


def assign_clusters(profiles: DataFrame, k: int = 5, seed: int = config.SEED, starts: int = STARTS, iterations: int = ITERATIONS) -> DataFrame:
    """(ward, cluster) of the cheapest of ``starts`` seeded k-means runs; clusters are numbered by their centres."""
    cols = existing(profiles, config.WARD_FEATURES)
    x = F.struct(*[F.col(c).cast("double").alias(n) for c, n in zip(cols, _names(len(cols)))])
    points = standardise(profiles, cols).select("ward", x.alias("x")).persist()
    try:
        if points.isEmpty():
            return points.select("ward", F.lit(0).alias("cluster"))
        centres = lloyd(points, k, starts, iterations, seed)
        centres = centres[np.lexsort(centres.T[::-1])]
        return points.select("ward", nearest(centres)["place"].alias("cluster"))
    finally:
        points.unpersist()


def cluster_wards(wards: DataFrame, k: int = 5, seed: int = config.SEED) -> DataFrame:
    """Every ward row with its cluster."""
    return wards.join(assign_clusters(ward_profiles(wards), k, seed), "ward", "left")


def cluster_profile(clustered: DataFrame) -> DataFrame:
    """Mean features per cluster, each ward counted once."""
    cols = existing(clustered, config.WARD_FEATURES)
    per_ward = means(clustered, cols, ["ward", "cluster"])
    return per_ward.groupBy("cluster").agg(
        F.count("*").alias("n_wards"), *[mean_of(c, 2).alias(c) for c in cols]
    )
