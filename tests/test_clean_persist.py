"""Cleaning keeps no input that the cores cannot hold, and leaves the caller's cache alone."""

from dsengine.functions import staging
from dsengine.plans.cleaning import clean


def sample(spark):
    rows = [(i % 90, float(i % 90 % 7) if i % 90 % 5 else None, ("a", "b ", "B")[i % 90 % 3]) for i in range(100)]
    return spark.createDataFrame(rows, "row long, x double, c string")


def result(df):
    out = clean(df, order_by="row")
    return sorted(map(str, out.df.collect())), sorted(map(str, out.report.collect()))


def test_cleaning_without_keeping_the_input_gives_the_same(spark, monkeypatch):
    want = result(sample(spark))
    monkeypatch.setattr(staging, "PERSIST_BYTES", 0)
    assert staging.is_kept(sample(spark))
    assert result(sample(spark)) == want


def test_the_callers_cache_survives(spark):
    df = sample(spark).cache()
    result(df)
    assert df.storageLevel.useMemory
    df.unpersist()
