import random

import plain
import pytest
from pyspark.sql import types as T

from zephyria.llm import exact_dedup, sharding

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("frequent", [2, 64])
def test_exact_groups(spark, frequent):
    rng = random.Random(1)
    texts = ["a b", "a \t\n b", "a b", "", None, " ", "x" * 5000, "A b"]
    rows = [(i, rng.choice(texts)) for i in range(400)]
    got = exact_dedup.duplicate_report(frame(spark, rows), frequent=frequent).collect()
    want = plain.exact(rows)
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in got} == want
    assert sorted(r.doc_id for r in got if r.kept) == sorted({k for k, _, _ in want.values()})


@pytest.mark.parametrize("frequent", [2, 64])
def test_exact_repeated_and_null_ids(spark, frequent):
    rows = [(5, "t")] * 300 + [(None, "t")] * 3 + [(None, "only")] * 2
    got = exact_dedup.duplicate_report(frame(spark, rows), frequent=frequent).collect()
    assert len(got) == 305 and sum(r.kept for r in got) == 2
    assert {(r.keep_id, r.group_size) for r in got} == {(5, 303), (None, 2)}


def test_exact_clashing_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "a", 7, "x", True), (2, "a", 8, "y", False)], "doc_id long, text string, digest long, row string, kept boolean")
    out = exact_dedup.exact_dedup(df).orderBy("doc_id").collect()
    assert [(r["row"], r.digest, r.kept, r.keep_id) for r in out] == [("x", 7, True, 1), ("y", 8, False, 1)]
    assert [r["row"] for r in exact_dedup.keep_first(df).collect()] == ["x"]
    assert exact_dedup.duplicate_report(frame(spark, [])).count() == 0


def test_shards_fit_and_are_shortest(spark):
    rng = random.Random(2)
    rows = [(i, "é" * rng.randint(0, 300)) for i in range(500)] + [(1000, "x" * 9000), (1001, None)]
    out = sharding.shard_report(frame(spark, rows), 4000).collect()
    size, members = {}, {}
    for r in out:
        size[r.shard] = size.get(r.shard, 0) + r.n_bytes
        members.setdefault(r.shard, []).append(r.doc_id)
    assert len(out) == len(rows)
    assert all(r.shard_bytes == size[r.shard] and r.depth == len(r.shard) for r in out)
    assert all(n <= 4000 or len(members[s]) == 1 for s, n in size.items())
    for s in size:  # the bucket above did not fit
        if s:
            assert sum(n for t, n in size.items() if t.startswith(s[:-1])) > 4000
    assert not any(a != b and b.startswith(a) for a in size for b in size)


def test_shards_of_one_repeated_id(spark):
    rows = [(3, "y" * 100)] * 200 + [(None, "z" * 50)] * 20
    out = sharding.shard_report(frame(spark, rows), 1000).collect()
    size = {}
    for r in out:
        size[r.shard] = size.get(r.shard, 0) + r.n_bytes
    assert len(out) == 220 and max(size.values()) <= 1000
    assert all(r.shard_bytes == size[r.shard] for r in out)
    assert sharding.shard_report(frame(spark, []), 1000).count() == 0


@pytest.mark.parametrize("frequent", [2, 64])
def test_kept_rows_are_whole_and_texts_move_once(spark, frequent):
    rng = random.Random(2)
    texts = ["a b", "a \t\n b", "", None, "x" * 5000, "A b"]
    rows = [(i, rng.choice(texts), i * 2) for i in rng.sample(range(5000), 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone long")
    kept = exact_dedup.keep_first(docs, frequent=frequent)
    want = {k for k, _, _ in plain.exact([r[:2] for r in rows]).values()}
    assert sorted(map(tuple, kept.collect())) == sorted(r for r in rows if r[0] in want)
    plan = kept._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("Scan ExistingRDD") == 1
    repeated = docs.unionByName(docs.limit(50))
    again = exact_dedup.keep_first(repeated, frequent=frequent).collect()
    assert {r.doc_id for r in again} == want and len(again) == len(want)
