"""Fill inside groups: as by a window a group, however groups lie across ranges."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from dsengine.operators.clean import ffill_bfill


def by_windows(df, cols, order, keys):
    ahead = Window.partitionBy(*keys).orderBy(F.col(order)).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    for c in cols:
        df = df.withColumn(c, F.last(F.col(c), True).over(ahead))
        df = df.withColumn(c, F.coalesce(F.col(c), F.last(F.col(c), True).over(back)))
    return df


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("keys", [["g"], ["g", "h"]])
@pytest.mark.parametrize("partitions", [1, 9, 40])
def test_equal_to_windows(spark, keys, partitions):
    """A group with half of the rows, groups of one row, a null group, groups without
    any value."""
    r = random.Random(partitions)
    data = []
    for i in range(900):
        g = "hot" if i % 2 else r.choice([None, "a", "b", f"one{i}", "none"])
        data.append((i, g, r.choice([1, None, 2]) if g != "hot" else 1, None if g == "none" or r.random() < 0.7 else float(i), r.choice([None, None, f"t{i}"]), 7))
    r.shuffle(data)
    df = spark.createDataFrame(data, "k int, g string, h int, x double, t string, __tb int").drop("__tb").repartition(partitions)
    spark.conf.set("spark.sql.shuffle.partitions", str(max(partitions, 2)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rows(ffill_bfill(df, ["x", "t"], "k", keys)) == rows(by_windows(df, ["x", "t"], "k", keys))
        assert rows(ffill_bfill(df, ["x"], "k")) == rows(by_windows(df.withColumn("z", F.lit(1)), ["x"], "k", ["z"]).drop("z"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_hot_group_spreads_over_ranges(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), "id", F.when(F.col("id") % 97 == 5, F.col("id")).alias("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ffill_bfill(df, ["x"], "id", ["g"])
        plan = out._jdf.queryExecution().toString()
        assert "__range" in plan and out.where("x IS NULL").count() == 0
        assert rows(out) == rows(by_windows(df, ["x"], "id", ["g"]))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table(spark):
    df = spark.createDataFrame([], "g string, k int, x double")
    assert ffill_bfill(df, ["x"], "k", ["g"]).collect() == []
