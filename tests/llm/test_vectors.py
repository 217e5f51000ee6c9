import math

import numpy as np
import pytest

from zephyria.llm.vector_near import at_least, calibrated, near_vectors

SCHEMA = "vec_id long, embedding array<double>"


def plain_links(rows, cosine=0.95):
    good = {}
    for i, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            a = np.array(v) / np.abs(v).max()
            good[i] = a / np.sqrt((a * a).sum())
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in good:
        for j in good:
            if i < j and len(good[i]) == len(good[j]) and float(good[i] @ good[j]) >= cosine:
                links[i] += 1
                links[j] += 1
                root[top(j)] = top(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = top(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return sorted(((d, links[i], least[top(i)], d == least[top(i)]) for i, (d, _) in enumerate(rows)), key=str)


def near(rng, v, cosine):
    """A vector at exactly this cosine from ``v``."""
    noise = rng.normal(size=len(v))
    noise -= (noise @ v) * v / (v @ v)
    noise /= np.linalg.norm(noise)
    return cosine * v / np.linalg.norm(v) + math.sqrt(1 - cosine**2) * noise


def test_the_count_is_calibrated():
    for n in (2, 500, 50_000, 10**9):
        plan = calibrated(n)
        chance = (1 - plan.angle / math.pi) ** plan.bits * math.erf(2 / math.sqrt(2))
        assert at_least(plan.wanted, plan.tables, chance) >= 0.999 > at_least(plan.wanted + 1, plan.tables, chance)


@pytest.mark.parametrize("dense", [4, 64])
def test_links_and_groups_equal_brute_force(spark, dense):
    """Chains, a dense spot with its edge, copies, multiples of one vector, and what links with nothing."""
    rng = np.random.default_rng(3)
    rows = [(1000 + i, rng.normal(size=24).tolist()) for i in range(150)]
    spot = rng.normal(size=24)
    rows += [(i, near(rng, spot, rng.choice([0.999, 0.99, 0.975, 0.955, 0.93])).tolist()) for i in range(120)]
    other = near(rng, spot, 0.9)
    rows += [(200 + i, near(rng, other, 0.99).tolist()) for i in range(40)]
    link = rng.normal(size=24)
    for i in range(12):
        link = near(rng, link, 0.96)
        rows.append((400 - i, link.tolist()))
    rows += [(500, rows[0][1]), (501, rows[0][1]), (499, [2 * x for x in rows[0][1]]), (None, rows[0][1]), (None, rows[5][1]), (None, rows[200][1])]
    rows += [(7, None), (8, []), (9, [0.0] * 24), (10, [math.nan] + [1.0] * 23), (11, [math.inf] + [1.0] * 23), (12, [None] + [1.0] * 23), (7, None)]
    rows += [(13, [1e300] * 24), (14, [1e-300] * 24), (15, [1.0, 2.0]), (16, [2.0, 4.0]), (15, [1.0, 2.0])]
    got = near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), recall=1 - 1e-9, dense=dense).collect()
    assert sorted(map(tuple, got), key=str) == plain_links(rows)


def test_recall_at_the_bound(spark):
    """2,000 pairs at a cosine just above the bound: nearly all are found, and nothing below it."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1000):
        v = rng.normal(size=48)
        rows += [(3 * i, v.tolist()), (3 * i + 1, near(rng, v, 0.9501).tolist()), (3 * i + 2, near(rng, v, 0.9499).tolist())]
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    found = sum(got[3 * i + 1].component_id == 3 * i for i in range(1000))
    assert found >= 990 and all(got[3 * i + 2].n_links == 0 for i in range(1000))


def test_no_vectors_and_other_columns(spark):
    schema = SCHEMA + ", node int, ball string"
    assert near_vectors(spark.createDataFrame([], schema)).count() == 0
    got = near_vectors(spark.createDataFrame([(1, [1.0], 5, "x"), (2, [3.0], 6, "y")], schema)).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, True), (2, 1, 1, False)]
