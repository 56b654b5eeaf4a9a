"""Distinct counts of every type, against sets of values."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from dsengine.functions import distinct
from dsengine.functions.distinct import distinct_counts

NAN = float("nan")
D, TS = datetime.date, datetime.datetime
ROWS = [(1, 1 << 62, -5, True, 0.0, 0.1, "a", b"\x00", decimal.Decimal("1.10"), D(2020, 1, 1), TS(2020, 1, 1, 1, 2, 3), [1, 2], {"k": 1}),
        (1, -(1 << 62), -5, False, -0.0, 0.1, "A", b"", decimal.Decimal("1.1"), D(1969, 12, 31), TS(2020, 1, 1, 1, 2, 4), [2, 1], {"k": 2}),
        (None, 0, 7, None, NAN, NAN, None, None, None, None, None, None, None),
        (-32768, 5, -32768, True, 1e300, float("inf"), "", b"\x00", decimal.Decimal("-3.00"), D(9999, 12, 31), TS(1900, 1, 1), [1, 2], {"k": 1}),
        (32769, 5, 32767, True, 1e-300, -0.1, "a ", b"\xff", None, D(2020, 1, 1), None, [], {})]
SCHEMA = "i int, l long, s int, b boolean, d double, f float, t string, x binary, c decimal(10,2), dt date, ts timestamp, arr array<int>, m map<string,int>"
WANT = {"i": (3, True), "l": (4, False), "s": (4, False), "b": (2, True), "d": (3, True), "f": (3, True), "t": (4, True), "x": (3, True), "c": (2, True), "dt": (3, True), "ts": (3, True), "arr": (3, True), "m": (3, True)}


@pytest.mark.parametrize("room", [0, 16, 1 << 20])
@pytest.mark.parametrize("parts", [1, 5])
def test_every_type(spark, monkeypatch, room, parts):
    """With any room for bitmaps, also none."""
    monkeypatch.setattr(distinct, "BYTES_A_ROW", room)
    df = spark.createDataFrame(ROWS * 3, SCHEMA).repartition(parts)
    assert distinct_counts(df, df.columns) == WANT
    for c in ("i", "d", "t"):
        assert distinct_counts(df, [c]) == {c: WANT[c]}


def test_empty_and_all_missing(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "a int, b string")
    assert distinct_counts(df, ["a", "b"]) == {"a": (0, True), "b": (0, True)}
    assert distinct_counts(df.where("false"), ["a", "b"]) == {"a": (0, False), "b": (0, False)} and distinct_counts(df, []) == {}


def test_many_values_and_a_hot_one(spark):
    df = spark.range(300_000).select((F.col("id") % 70_000).alias("dense"), (F.col("id") * 1_000_003).alias("sparse"), F.concat(F.lit("v"), F.col("id") % 50_021).alias("text"),
                                     F.when(F.col("id") % 3 == 0, 1.5).otherwise(F.sqrt("id")).alias("number"))
    seen = df.select("number").distinct().count()
    assert distinct_counts(df, df.columns) == {"dense": (70_000, False), "sparse": (300_000, False), "text": (50_021, False), "number": (seen, False)}
