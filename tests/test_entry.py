import __spark_entry__ as entry


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "health_risk_label" in df.columns


def test_contract_shapes():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert all(callable(q) for q in queries.values())
    assert all(isinstance(s, str) for s in sql.values())
    assert len(queries) >= 150
