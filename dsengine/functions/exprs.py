"""Column-expression helpers shared by all operators (JVM-side only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dsengine import rules

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)
_FLOATING = (T.FloatType, T.DoubleType)
_DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)


def qname(name: str) -> str:
    """Back-quoted column reference, safe for any column name."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(qname(name))


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, _NUMERIC)


def is_text_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def is_boolean_type(dt: T.DataType) -> bool:
    return isinstance(dt, T.BooleanType)


def is_datetime_type(dt: T.DataType) -> bool:
    return isinstance(dt, _DATETIME)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text_type(f.dataType)]


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_missing(name: str, dt: T.DataType | None = None) -> Column:
    """One notion of missing: null, or NaN for floating columns."""
    c = col(name)
    if dt is not None and isinstance(dt, _FLOATING):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def nan_to_null(df: DataFrame) -> DataFrame:
    """Unify NaN with null for floating columns; other columns untouched."""
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, _FLOATING):
            out.append(F.when(F.isnan(c), F.lit(None).cast(f.dataType))
                       .otherwise(c).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def as_double(name: str) -> Column:
    return col(name).cast("double")


def isclose_to_rint(c: Column) -> Column:
    """|y - rint(y)| <= atol + rtol*|rint(y)|, the default closeness test."""
    r = F.rint(c)
    return F.abs(c - r) <= F.lit(rules.ISCLOSE_ATOL) + F.lit(rules.ISCLOSE_RTOL) * F.abs(r)


def pair_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over pair-complete rows, null when undefined.

    Expressed with covariance and standard deviations so a constant column
    yields null instead of raising under ANSI mode (``corr`` raises).
    """
    both = x.isNotNull() & y.isNotNull()
    xx = F.when(both, x)
    yy = F.when(both, y)
    denom = F.stddev_samp(xx) * F.stddev_samp(yy)
    varies = (F.min(xx) < F.max(xx)) & (F.min(yy) < F.max(yy)) & (denom != 0)
    return F.try_divide(F.covar_samp(xx, yy), F.when(varies, denom))


def mean_expr(v: Column) -> Column:
    """Mean, held between the smallest and the largest value: a constant
    column's mean is exactly that constant for any partitioning, and no
    range of values overflows or is cut."""
    return F.least(F.greatest(F.avg(v), F.min(v)), F.max(v))


def std_pop_expr(v: Column) -> Column:
    """Population standard deviation, exactly 0 for a constant column."""
    return F.when(F.min(v) == F.max(v), F.lit(0.0)).otherwise(F.stddev_pop(v))


def _balanced(items: list[Column], op) -> Column:
    """Combine with a balanced tree so wide tables do not build expression
    chains deep enough to overflow the analyser's stack."""
    items = list(items)
    while len(items) > 1:
        nxt = [op(items[i], items[i + 1]) for i in range(0, len(items) - 1, 2)]
        if len(items) % 2:
            nxt.append(items[-1])
        items = nxt
    return items[0]


def all_of(conds: list[Column]) -> Column:
    return F.lit(True) if not conds else _balanced(conds, lambda a, b: a & b)


def any_of(conds: list[Column]) -> Column:
    return F.lit(False) if not conds else _balanced(conds, lambda a, b: a | b)


def sum_of(terms: list[Column]) -> Column:
    return F.lit(0) if not terms else _balanced(terms, lambda a, b: a + b)
