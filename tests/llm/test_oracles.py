import duckdb
import pytest

from zephyria.llm.registry import ORACLES, QUERIES
from zephyria.llm import queries  # noqa: F401


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    order = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).values))
    assert order(got) == order(want)
