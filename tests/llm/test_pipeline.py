import plain
import zstandard

import corpus_pipeline
from zephyria.llm import queries, quality_rules  # noqa: F401  (importing queries registers them)
from zephyria.llm.common import table
from zephyria.llm.registry import ORACLES, QUERIES


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_pipeline_against_plain_stages(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    zstd = zstandard.ZstdCompressor(level=quality_rules.LEVEL)
    rows = [(d, t) for d, t in rows if quality_rules.assess(t, zstd)[6]]
    keep = plain.exact(rows)
    rows = [(d, t) for d, t in rows if keep[d][0] == d]
    group = plain.linked(rows)
    rows = [(d, t) for d, t in rows if group[d][1] == d]
    rows = [(d, plain.cut(*x).decode("utf-8", "ignore")) for d, x in plain.repeats(rows).items()]
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out} == plain.pieces(rows)


def test_stages_return_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, sf_dir).columns == docs.columns, name
