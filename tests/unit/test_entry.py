import __spark_entry__ as entry_point


def test_entry_and_names(spark):
    assert entry_point.entry(spark).count() == 9
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
