import __spark_entry__ as entry


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 35
    df = entry.entry(spark)
    assert df.columns == ["event_id", "user_id", "session_id", "place", "session_value"] and df.count() > 0
