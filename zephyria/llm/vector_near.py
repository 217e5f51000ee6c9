"""Near-duplicate vectors by collision-counting projections.

Equal vectors are one class. Each of ``tables`` sorts all classes by sign bits of a few
random projections and then by one more projection; two vectors collide where the bits
agree and the last projections differ by less than the window around either. Pairs
that collide in at least ``wanted`` tables are verified by their cosine. The number of
bits follows the number of classes (about ``CELL`` unrelated vectors share the bits),
and ``tables`` and ``wanted`` follow from the chance that two vectors at exactly the
wanted cosine collide, so that such a pair is missed with a chance of 1 - ``RECALL``.
Without bits, windows alone would hold a fixed share of all pairs.

A dense spot would still make the square of its vectors. Cells of ``DENSE`` and more
therefore offer a centre (the mean of a bounded sample). Vectors within half the link
angle of a centre form a ball: they are all linked with one another, without a look at
any pair. A ball then stands in the tables once a slot, and two balls, or a ball and a
vector, that collide are decided by the angle of their centres and their radii; only
where that leaves it open are members compared.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components
link with nothing, nor do vectors of different lengths; equal ids are rows of their own;
a null id counts as larger than any; other columns are not read; an empty table gives no
rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zephyria.llm.common import importable_on_workers, stored
from zephyria.llm.components import components

COSINE = 0.95
#: Least chance that a pair at exactly the wanted cosine is found.
RECALL = 0.999
#: Unrelated vectors that share the sign bits of a table, about.
CELL = 8
#: Cells with at least this many classes offer a centre.
DENSE = 64
#: Vectors of a dense cell that its centre is the mean of.
SAMPLE = 32
#: Tables whose dense cells offer centres.
CENTRE_TABLES = 8
#: Angles nearer than this to a bound are left to the cosine itself.
MARGIN = 1e-6
#: Slots of one window each, on either side of zero; the outer ones take what is beyond.
SLOTS = 31
WORD = 60


@dataclass(frozen=True)
class Plan:
    bits: int
    tables: int
    wanted: int
    window: float
    angle: float


def at_least(count: int, of: int, chance: float) -> float:
    return 1 - sum(math.comb(of, k) * chance**k * (1 - chance) ** (of - k) for k in range(count))


def calibrated(n: int, cosine: float = COSINE, recall: float = RECALL) -> Plan:
    """Bits, tables and collisions wanted for ``n`` classes.

    The window is two standard deviations of the difference of a linked pair's projections.
    """
    angle = math.acos(cosine)
    bits = min(32, max(1, math.ceil(math.log2(max(n, 2) / CELL))))
    chance = (1 - angle / math.pi) ** bits * math.erf(2 / math.sqrt(2))
    tables = 2
    while at_least(2, tables, chance) < recall:
        tables += 1
    wanted = 2
    while at_least(wanted + 1, tables, chance) >= recall:
        wanted += 1
    return Plan(bits, tables, wanted, 2 * math.sqrt(2 - 2 * cosine), angle)


def usable(vector: Column) -> Column:
    """Whether every component is a finite number and one is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def floats(name: str, df: DataFrame) -> Column:
    """The vectors as they are where they hold floats or doubles, else as doubles."""
    kind = df.schema[name].dataType.simpleString()
    return F.col(name) if kind in ("array<float>", "array<double>") else F.col(name).cast("array<double>")


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Components one after another, and the length of each vector."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)


def unit_vectors(classes: DataFrame) -> DataFrame:
    """(node, id, m, unit): vectors of length one."""

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, lengths = matrix(batch.column(3))
            if not len(lengths):
                continue
            flat = flat.astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            flat = flat / np.repeat(np.maximum.reduceat(np.abs(flat), starts), lengths)  # squares stay finite
            flat = flat / np.repeat(np.sqrt(np.add.reduceat(flat * flat, starts)), lengths)
            units = pa.ListArray.from_arrays(pa.array(np.append(starts, len(flat)), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], units], names=["node", "id", "m", "unit"])

    units = classes.select("node", "id", "m", "vector").mapInArrow(scaled, "node long, id long, m long, unit array<double>")
    return stored(units, "unit-vectors")


def entries(points: DataFrame, plan: Plan, tables: int | None = None) -> DataFrame:
    """(node, cell, slot, place): where each vector stands in each table."""
    tables = tables or plan.tables
    bits, window, width = plan.bits, plan.window, plan.bits + 1

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, np.ndarray] = {}
        weights = np.int64(1) << np.arange(bits, dtype=np.int64)
        for batch in batches:
            flat, lengths = matrix(batch.column(1))
            starts = np.concatenate([[0], np.cumsum(lengths)])
            nodes = batch.column(0).to_numpy()
            for size in np.unique(lengths).tolist():
                if size not in drawn:  # tables are drawn one after another, so fewer tables are the first ones
                    rng = np.random.default_rng([7, size])
                    drawn[size] = np.concatenate([rng.standard_normal((size, width)) for _ in range(tables)], axis=1)
                held = np.flatnonzero(lengths == size)
                for some in np.array_split(held, -(-len(held) // 1024)):
                    units = flat[(starts[some][:, None] + np.arange(size))]
                    values = (units @ drawn[size]).reshape(len(some), tables, width)
                    cell = (values[:, :, :bits] > 0) @ weights + (np.arange(tables, dtype=np.int64) << bits)
                    place = values[:, :, bits]
                    slot = np.clip(np.floor(place / window), -SLOTS, SLOTS)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "node": np.repeat(nodes[some], tables),
                            "cell": cell.ravel(),
                            "slot": slot.ravel().astype(np.int32),
                            "place": place.ravel().astype(np.float32),
                        }
                    )

    return points.select("node", "unit").mapInArrow(project, "node long, cell long, slot int, place float")


def with_cosines(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``cosine`` in place of the vectors ``unit_a`` and ``unit_b``; other lengths than equal ones go."""
    pairs = pairs.where(F.size("unit_a") == F.size("unit_b"))
    names = [c for c in pairs.columns if c not in ("unit_a", "unit_b")]

    def dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (a, lengths), (b, _) = matrix(batch.column(len(names))), matrix(batch.column(len(names) + 1))
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
            cosine = np.add.reduceat(a * b, starts) if len(lengths) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(cosine)], names=[*names, "cosine"])

    schema = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in names) + ", cosine double"
    return pairs.select(*names, "unit_a", "unit_b").mapInArrow(dots, schema)


def centres(points: DataFrame, spots: DataFrame, plan: Plan) -> DataFrame:
    """(cell, centre): the mean direction of a bounded sample of each cell of ``spots`` (node, cell)."""
    first = Window.partitionBy("cell").orderBy(F.xxhash64("node"), "node")
    sample = spots.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= SAMPLE).join(points.select("node", "unit"), "node")
    bound = math.cos(plan.angle)

    def middle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for vectors in batch.column(1).to_pylist():
                size = max(map(len, vectors))
                drawn = np.array([v for v in vectors if len(v) == size])
                for _ in range(3):  # leave out vectors that only share the cell
                    mean = drawn.mean(axis=0)
                    mean /= max(np.linalg.norm(mean), 1e-300)
                    near = drawn @ mean >= bound
                    if near.all() or not near.any():
                        break
                    drawn = drawn[near]
                found.append(mean)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["cell", "centre"])

    return sample.groupBy("cell").agg(F.collect_list("unit").alias("units")).mapInArrow(middle, "cell long, centre array<double>")


def balls(points: DataFrame, plan: Plan, dense: int) -> tuple[DataFrame, DataFrame]:
    """(node, ball) of the vectors within half the link angle of a centre, and (ball, unit, reach) of the balls.

    Of several centres the one of the fullest cell counts. A ball is named by its least
    node; ``unit`` is its centre and ``reach`` the angle of the member farthest from it.
    """
    spark = points.sparkSession
    spots = entries(points, plan, min(plan.tables, CENTRE_TABLES)).select("node", "cell")
    crowded = stored(spots.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= dense), "dense-cells")
    if crowded.isEmpty():
        return spark.createDataFrame([], "node long, ball long"), spark.createDataFrame([], "ball long, unit array<double>, reach double")
    there = spots.join(crowded, "cell")
    means = stored(centres(points, there.select("node", "cell"), plan), "centres")
    near = there.join(means, "cell").join(points.select("node", F.col("unit").alias("unit_a")), "node")
    cosines = with_cosines(near.select("node", "cell", "n", "unit_a", F.col("centre").alias("unit_b")))
    inside = cosines.where(F.col("cosine") >= math.cos(plan.angle / 2 - MARGIN))
    away = F.acos(F.least("cosine", F.lit(1.0))).alias("away")
    best = stored(inside.groupBy("node").agg(F.max(F.struct("n", "cell", away)).alias("best")), "ball-members")
    chosen = best.select("node", F.col("best.cell").alias("cell"), F.col("best.away").alias("away"))
    named = stored(chosen.groupBy("cell").agg(F.min("node").alias("ball"), F.max("away").alias("reach")), "balls")
    return chosen.join(named, "cell").select("node", "ball"), named.join(means, "cell").select("ball", F.col("centre").alias("unit"), "reach")


def candidates(stands: DataFrame, plan: Plan) -> DataFrame:
    """Pairs (a, b), a < b, that collide in enough tables.

    ``stands``: (ball, cell, slot, low, high). A window reaches into its own slot and the
    neighbours; every row is looked at in its slot and visits the next one.
    """
    packed = F.col("cell") * (2 * SLOTS + 2) + F.col("slot") + SLOTS
    at = stands.select(packed.alias("spot"), "ball", "low", "high")
    visits = F.array(F.struct(F.lit(0).alias("by"), F.col("ball").alias("b")), F.struct(F.lit(1).alias("by"), (-1 - F.col("ball")).alias("b")))
    guests = at.select("spot", "low", "high", F.explode(visits).alias("v")).select(
        (F.col("spot") + F.col("v.by")).alias("spot"), F.col("v.b").alias("guest"), F.col("low").alias("low2"), F.col("high").alias("high2")
    )
    other = F.when(F.col("guest") < 0, -1 - F.col("guest")).otherwise(F.col("guest"))
    once = F.when(F.col("guest") < 0, F.col("ball") != other).otherwise(F.col("ball") < F.col("guest"))
    close = (F.col("low2") - F.col("high") <= plan.window) & (F.col("low") - F.col("high2") <= plan.window)
    met = at.join(guests, "spot").where(once & close)
    table = F.shiftright(F.expr(f"spot div {2 * SLOTS + 2}"), plan.bits)
    words = range(-(-plan.tables // WORD))
    met = met.select(F.least("ball", other).alias("a"), F.greatest("ball", other).alias("b"), table.alias("t"))
    bits = [F.bit_or(F.expr(f"if(t div {WORD} = {w}, shiftleft(1L, cast(t % {WORD} as int)), 0L)")).alias(f"w{w}") for w in words]
    seen = met.groupBy("a", "b").agg(*bits)
    count = sum((F.bit_count(f"w{w}") for w in words), F.lit(0))
    return seen.where(count >= plan.wanted).select("a", "b")


def links(points: DataFrame, plan: Plan, cosine: float, dense: int = DENSE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, full, single): balls as (ball, node), pairs of balls linked throughout, and linked pairs of nodes."""
    inside, shapes = balls(points, plan, dense)
    home = points.join(inside, "node", "left")
    members = stored(home.select(F.coalesce("ball", "node").alias("ball"), "node", "m", F.col("ball").isNotNull().alias("shared")), "members")
    places = entries(points, plan).join(inside, "node", "left")
    alone = places.where("ball is null").select(F.col("node").alias("ball"), "cell", "slot", F.col("place").alias("low"), F.col("place").alias("high"))
    crowd = places.where("ball is not null").groupBy("ball", "cell", "slot").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    pairs = stored(candidates(alone.unionByName(crowd), plan), "candidates")

    lone = points.join(inside, "node", "left_anti").select(F.col("node").alias("ball"), "unit", F.lit(0.0).alias("reach"), F.lit(True).alias("lone"))
    shape = lone.unionByName(shapes.withColumn("lone", F.lit(False)))
    side = lambda x: shape.select(*[F.col(c).alias(x if c == "ball" else f"{c}_{x}") for c in shape.columns])
    measured = with_cosines(pairs.join(side("a"), "a").join(side("b"), "b"))
    angle = F.acos(F.least(F.greatest("cosine", F.lit(-1.0)), F.lit(1.0)))
    spread = F.col("reach_a") + F.col("reach_b")
    kind = (
        F.when(F.col("lone_a") & F.col("lone_b"), F.when(F.col("cosine") >= cosine, "full").otherwise("none"))
        .when(angle + spread <= plan.angle - MARGIN, "full")
        .when(angle - spread > plan.angle + MARGIN, "none")
        .otherwise("open")
    )
    decided = stored(measured.select("a", "b", kind.alias("kind")).where("kind <> 'none'"), "ball-pairs")
    of = lambda x: members.select(F.col("ball").alias(x), F.col("node").alias(f"node_{x}"))
    unit = lambda x: points.select(F.col("node").alias(f"node_{x}"), F.col("unit").alias(f"unit_{x}"))
    open_pairs = decided.where("kind = 'open'").join(of("a"), "a").join(of("b"), "b").select("node_a", "node_b")
    compared = with_cosines(open_pairs.join(unit("a"), "node_a").join(unit("b"), "node_b"))
    single = stored(compared.where(F.col("cosine") >= cosine).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), "node-links")
    return members, decided.where("kind = 'full'").select("a", "b"), single


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, dense: int = DENSE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding)."""
    importable_on_workers(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), floats("embedding", vectors).alias("vector"))
    rows = rows.withColumn("vector", F.when(usable(F.col("vector")), F.col("vector")))
    classes = rows.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("m"))
    ordered = classes.orderBy(F.col("id").asc_nulls_last(), F.xxhash64("vector")).withColumn("node", F.monotonically_increasing_id())
    classes = stored(ordered, "vector-classes")  # the least node of a group has its least id
    points = unit_vectors(classes)
    plan = calibrated(points.count(), cosine, recall)
    members, full, single = links(points, plan, cosine, dense)

    weight = members.groupBy("ball").agg(F.sum("m").alias("all"))
    beside = both_ways(full).join(weight.withColumnRenamed("ball", "b"), "b").groupBy("a").agg(F.sum("all").alias("ball_links"))
    weights = members.select(F.col("node").alias("b"), "m")
    alone = both_ways(single).join(weights, "b").groupBy("a").agg(F.sum("m").alias("own_links"))
    count = F.col("all") - 1 + F.coalesce("ball_links", F.lit(0)) + F.coalesce("own_links", F.lit(0))
    counted = (
        members.join(weight, "ball")
        .join(beside.withColumnRenamed("a", "ball"), "ball", "left")
        .join(alone.withColumnRenamed("a", "node"), "node", "left")
        .select("node", count.alias("n_links"))
    )
    edges = full.unionByName(single).unionByName(members.where("shared and ball <> node").select(F.col("ball").alias("a"), F.col("node").alias("b")))
    labels = components(edges)
    named = points.select("node", "id")
    roots = labels.join(named.withColumnRenamed("node", "label"), "label").select("node", F.col("id").alias("root"))
    result = named.join(counted, "node").join(roots, "node", "left")
    component = F.when(F.col("root").isNotNull(), F.col("root")).otherwise(F.col("id"))
    of_class = stored(result.select("node", "n_links", component.alias("component_id")), "class-results").join(classes.select("node", "vector"), "node")
    found = rows.join(of_class.drop("node"), "vector", "left")
    own = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    report = found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"))
    return report.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
