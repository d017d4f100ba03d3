"""The entry point's contract."""

import __spark_entry__ as entry


def test_names_and_flagship(spark):
    names, sql = set(entry.queries()), set(entry.oracle_sql())
    assert sql <= names and len(names) > 50
    assert entry.entry(spark).columns == ["id", "score", "fields"]
