import __spark_entry__ as entry
from pyspark.sql import DataFrame


def test_names_agree():
    q = entry.queries()
    assert set(entry.oracle_sql()) <= set(q)
    assert "p2_found" in q


def test_smoke(spark):
    df = entry.entry(spark)
    assert isinstance(df, DataFrame) and df.columns == ["role", "name"] and df.count() > 0
