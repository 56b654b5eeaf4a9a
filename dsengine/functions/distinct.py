"""Exact distinct counts that do not shuffle the values.

A value crosses the network as numbers, whatever its type: whole numbers, dates and
booleans of a narrow range as bits of a bitmap (32,768 values in 4 KB, combined
map-side); other values of at most 64 bits by ``xxhash64``, which maps those one to
one; the rest (texts, decimals, binaries, nested values) by a 128-bit fingerprint, of
which two equal ones for different values are not to be expected (n^2 / 2^129 for n
values). One path for one column and for many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dsengine.functions.exprs import col, is_missing
from dsengine.functions.staging import SPLIT_BYTES, plan_bytes

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.BooleanType)
_SHORT = _WHOLE + (T.FloatType, T.DoubleType, T.TimestampType, T.TimestampNTZType)
#: A task's bitmaps may take so many bytes for each of its rows.
BYTES_A_ROW = 16


def _present(df: DataFrame, name: str) -> Column:
    """The value, null if missing; -0.0 and 0.0 are one value."""
    kind = df.schema[name].dataType
    v = F.when(~is_missing(name, kind), col(name))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        v = v + F.lit(0.0).cast(kind)
    return v


def _whole(df: DataFrame, name: str) -> Column:
    v = col(name)
    if isinstance(df.schema[name].dataType, T.DateType):
        v = F.unix_date(v)
    return v.cast("int").cast("long") if isinstance(df.schema[name].dataType, T.BooleanType) else v.cast("long")


def _hashed(df: DataFrame, name: str) -> Column:
    """``a`` and ``b``: a number that stands for the value."""
    v, kind = _present(df, name), df.schema[name].dataType
    if isinstance(kind, _SHORT):
        return F.struct(F.xxhash64(v).alias("a"), F.lit(None).cast("long").alias("b"))
    if not isinstance(kind, (T.StringType, T.BinaryType, T.DecimalType)):
        v = v.cast("string")
    return F.struct(F.xxhash64(v).alias("a"), F.xxhash64(F.lit(1), v).alias("b"))


def distinct_counts(df: DataFrame, cols: list[str]) -> dict[str, tuple[int, bool]]:
    """{column: (distinct present values, has missing ones)}: one aggregate for ranges
    and missing values, one job for the counts. The driver gets a row a column."""
    if not cols:
        return {}
    whole = [i for i, c in enumerate(cols) if isinstance(df.schema[c].dataType, _WHOLE)]
    aggs = [F.count("*").alias("rows")]
    aggs += [F.count(_present(df, c)).alias(f"n{i}") for i, c in enumerate(cols)]
    for i in whole:
        aggs += [F.min(_whole(df, cols[i])).alias(f"lo{i}"), F.max(_whole(df, cols[i])).alias(f"hi{i}")]
    r = df.agg(*aggs).first()
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, plan_bytes(df) // SPLIT_BYTES)
    room = 8 * BYTES_A_ROW * max(1, r["rows"] // tasks)
    narrow = [i for i in whole if r[f"n{i}"] and r[f"hi{i}"] - r[f"lo{i}"] < room]
    rest = [i for i, c in enumerate(cols) if i not in narrow and r[f"n{i}"]]
    found = None
    if narrow:
        items = [F.struct(F.lit(i).alias("i"), (_whole(df, cols[i]) - F.lit(r[f"lo{i}"]) + 1).alias("v")) for i in narrow]
        bits = df.select(F.explode(F.array(*items)).alias("s")).select("s.*").where("v IS NOT NULL")
        bits = bits.groupBy("i", F.bitmap_bucket_number("v").alias("range")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bits"))
        found = bits.groupBy("i").agg(F.sum(F.bitmap_count("bits")).alias("n"))
    if rest:
        items = [F.struct(F.lit(i).alias("i"), _present(df, cols[i]).isNotNull().alias("there"), _hashed(df, cols[i]).alias("h")) for i in rest]
        keys = df.select(F.explode(F.array(*items)).alias("s")).where("s.there").select("s.i", "s.h.a", "s.h.b")
        keys = keys.distinct().groupBy("i").agg(F.count("*").alias("n"))
        found = keys if found is None else found.union(keys)
    counts = {x["i"]: x["n"] for x in found.collect()} if found is not None else {}
    return {c: (int(counts.get(i, 0)), r[f"n{i}"] < r["rows"]) for i, c in enumerate(cols)}
