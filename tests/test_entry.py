import __spark_entry__ as e


def test_registry_and_flagship(spark):
    found, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(found) and len(found) > 90
    rows = e.entry(spark).collect()
    assert len(rows) == 10 and rows[0]["trace"] > rows[9]["trace"]
