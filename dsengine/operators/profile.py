"""Profiling and understanding (shape, roles, cardinality, missing values,
duplicates, target inference, semantic and input types).

Scale notes: all per-column statistics come from at most two jobs: one wide
aggregate (map-side partial, one row out) and the value-count backbone
(``unpivot`` -> ``groupBy(column, value)``), which is the one shuffle whose
size grows with column cardinality. Results are small long-format frames
``(column, ordinal, ...)`` built lazily from those aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dsengine import rules
from dsengine.functions.distinct import distinct_counts
from dsengine.functions.exprs import (col, is_boolean_type, is_datetime_type, is_missing,
                                      is_numeric_type, is_text_type)


def _columns_frame(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, ordinal) for the schema - metadata only, a handful of rows."""
    cols = list(df.columns) if cols is None else cols
    spark = df.sparkSession
    return spark.createDataFrame([(c, i) for i, c in enumerate(cols)],
                                 "column_name string, ordinal int")


def _stack_row(one_row: DataFrame, cols: list[str], fields: list[str]) -> DataFrame:
    """Turn a one-row aggregate with columns ``{field}__{i}`` into long form."""
    items = [F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("ordinal"),
                      *[F.col(f"{f}__{i}").alias(f) for f in fields])
             for i, c in enumerate(cols)]
    return one_row.select(F.explode(F.array(*items)).alias("s")).select("s.*")


# --------------------------------------------------------------------------- P1/P2
def shape(df: DataFrame) -> DataFrame:
    """rows, columns."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(df.columns)).cast("bigint").alias("columns"))


def column_roles(df: DataFrame) -> DataFrame:
    """Storage role per column (P2): numeric / categorical / other, and how
    many values are present."""
    present = df.agg(*[F.count_if(~is_missing(f.name, f.dataType)).alias(f"p{i}") for i, f in enumerate(df.schema.fields)]).first() if df.columns else None
    rows = []
    for i, f in enumerate(df.schema.fields):
        if isinstance(f.dataType, (T.LongType, T.DoubleType)):
            role = "numeric"
        elif is_text_type(f.dataType):
            role = "categorical"
        else:
            role = "other"
        rows.append((f.name, i, role, present[f"p{i}"]))
    return df.sparkSession.createDataFrame(rows, "column_name string, ordinal int, role string, present bigint")


# --------------------------------------------------------------------------- backbone
def value_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column_name, value, count) for every column, null kept as a value.

    Values are compared as text; NaN counts as null. One Expand + one
    partial/final hash aggregate keyed by (column index, value) - a hot value
    is combined map-side; the column name is attached after the shuffle.
    """
    cols = list(df.columns) if cols is None else list(cols)
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, value string, count bigint")
    texts = []
    for i, c in enumerate(cols):
        dt = df.schema[c].dataType
        v = F.when(~is_missing(c, dt), col(c))
        if isinstance(dt, (T.FloatType, T.DoubleType)):
            v = v + F.lit(0.0).cast(dt)  # -0.0 and 0.0 are one value
        v = v.cast("string")
        texts.append(F.struct(F.lit(i).alias("i"), v.alias("value")))
    names = F.array(*[F.lit(c) for c in cols])
    return (df.select(F.explode(F.array(*texts)).alias("s"))
            .select("s.i", "s.value")
            .groupBy("i", "value").agg(F.count(F.lit(1)).alias("count"))
            .select(names[F.col("i")].alias("column_name"), "value", "count"))


def column_cardinality(df: DataFrame, cols: list[str] | None = None,
                       counts: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """(column, ordinal, n_distinct, n_distinct_with_null).

    ``exact=False`` uses HyperLogLog++ (``approx_count_distinct``) in one
    map-side aggregate; else values are counted as bits and fingerprints
    (``functions/distinct.py``), or from ``counts`` if those are there."""
    cols = list(df.columns) if cols is None else list(cols)
    if not exact:
        aggs = []
        for i, c in enumerate(cols):
            v = F.when(~is_missing(c, df.schema[c].dataType), col(c))
            aggs += [F.approx_count_distinct(v, 0.01).alias(f"n_distinct__{i}"),
                     (F.approx_count_distinct(v, 0.01) + F.max(F.when(v.isNull(), 1).otherwise(0)))
                     .alias(f"n_distinct_with_null__{i}")]
        return _stack_row(df.agg(*aggs), cols, ["n_distinct", "n_distinct_with_null"])
    if counts is None:
        n = distinct_counts(df, cols)
        rows = [(c, i, n[c][0], n[c][0] + n[c][1]) for i, c in enumerate(cols)]
        return df.sparkSession.createDataFrame(rows, "column_name string, ordinal int, n_distinct bigint, n_distinct_with_null bigint")
    card = counts.groupBy("column_name").agg(
        F.count("value").alias("n_distinct"),
        F.count(F.lit(1)).alias("n_distinct_with_null"))
    return (F.broadcast(_columns_frame(df, cols)).join(card, "column_name", "left")
            .select("column_name", "ordinal",
                    F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"),
                    F.coalesce("n_distinct_with_null", F.lit(0)).alias("n_distinct_with_null")))


def bounded_cardinality(df: DataFrame, cols: list[str] | None = None, limit: int = 50
                        ) -> tuple[DataFrame, DataFrame]:
    """(cardinality, counts) where ``n_distinct`` is exact for every column
    with at most ``limit`` distinct values and a HyperLogLog estimate (flag
    ``is_exact`` false) above 4 x limit - enough for every rule that only
    compares cardinality with small thresholds (boolean <= 2, classes <= 10).

    One map-side HLL aggregate, then value counts only for the columns that
    may be small, so high-cardinality columns are never shuffled."""
    cols = list(df.columns) if cols is None else list(cols)
    spark = df.sparkSession
    row = df.agg(*[F.approx_count_distinct(F.when(~is_missing(c, df.schema[c].dataType), col(c)))
                   .alias(f"a{i}") for i, c in enumerate(cols)]).first() if cols else None
    small = [c for i, c in enumerate(cols) if row[f"a{i}"] <= 4 * limit]
    counts = value_counts(df, small) if small else spark.createDataFrame(
        [], "column_name string, value string, count bigint")
    exact = {r["column_name"]: r["n"] for r in
             counts.groupBy("column_name").agg(F.count("value").alias("n")).collect()}
    rows = [(c, i, int(exact.get(c, 0)) if c in small else int(row[f"a{i}"]), c in small)
            for i, c in enumerate(cols)]
    card = spark.createDataFrame(rows, "column_name string, ordinal int, n_distinct bigint, "
                                       "is_exact boolean")
    return card, counts


# --------------------------------------------------------------------------- P4/P5
def infer_target(df: DataFrame, target: str | None = None,
                 cardinality: DataFrame | None = None) -> DataFrame:
    """inferred_target, target_column, target_confirmed, problem_type."""
    # only compared with small limits: no count of many distinct values
    card = cardinality if cardinality is not None else bounded_cardinality(df, limit=rules.INFER_TARGET_MAX_DISTINCT)[0]
    inferred = card.where(F.col("n_distinct") <= rules.INFER_TARGET_MAX_DISTINCT).agg(
        F.min_by("column_name", "ordinal").alias("inferred_target"))
    confirmed = bool(target) and target in df.columns
    chosen = F.lit(target) if confirmed else F.col("inferred_target")
    base = inferred.select("inferred_target", chosen.alias("target_column"),
                           F.lit(confirmed).alias("target_confirmed"))
    joined = base.join(card.select(F.col("column_name").alias("target_column"), "n_distinct"),
                       "target_column", "left")
    n = F.col("n_distinct")
    binary, multi, regression, unknown = rules.PROBLEM_TYPES
    ptype = (F.when(F.col("target_column").isNull(), unknown)
             .when(n == 2, binary)
             .when(n > 2, multi)
             .otherwise(regression))
    return joined.select("inferred_target", "target_column", "target_confirmed",
                         ptype.alias("problem_type"))


# --------------------------------------------------------------------------- P6/P7
def missing_counts(df: DataFrame) -> DataFrame:
    """(column, ordinal, missing) in one aggregate."""
    cols = df.columns
    one = df.agg(*[F.count_if(is_missing(c, df.schema[c].dataType)).alias(f"missing__{i}")
                   for i, c in enumerate(cols)])
    return _stack_row(one, cols, ["missing"])


def row_fingerprint(df: DataFrame) -> list:
    """Two independent 64-bit hashes of the whole row (nulls hash alike)."""
    cols = [col(c) for c in df.columns]
    return [F.xxhash64(*cols).alias("__h1"), F.xxhash64(F.lit("#"), *cols[::-1]).alias("__h2")]


def duplicate_count(df: DataFrame, exact: bool = True) -> DataFrame:
    """Rows minus distinct rows, null equal to null.

    ``exact=False`` groups by a 128-bit row fingerprint instead of the full
    row, so the shuffle carries 16 bytes per distinct row (collision odds
    ~n^2 / 2^129)."""
    keys = [col(c) for c in df.columns] if exact else row_fingerprint(df)
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint")
                      .alias("duplicates"))


# --------------------------------------------------------------------------- P8
# numbers equal to a listed value (True/False compare as 1/0) and listed texts
_BOOL_NUMBERS = sorted({float(v) for v in rules.BOOLEAN_VALUES if not isinstance(v, str)})
_BOOL_TEXTS = [v for v in rules.BOOLEAN_VALUES if isinstance(v, str)]

def semantic_types(df: DataFrame, cardinality: DataFrame | None = None) -> DataFrame:
    """(column, ordinal, semantic_type) over non-missing values.

    Rules in order: nothing left -> unknown; at most 2 distinct, all in the
    boolean set -> boolean; datetime storage -> datetime; text with more than
    80% date-like values -> datetime; numeric storage or all values castable
    to a number -> numeric; else categorical.
    """
    if cardinality is None:
        from dsengine.functions.staging import multi_pass
        with multi_pass(df) as staged:
            rows = _semantic_types(staged, bounded_cardinality(staged)[0]).collect()
        return df.sparkSession.createDataFrame(
            rows, "column_name string, ordinal int, semantic_type string")
    return _semantic_types(df, cardinality)


#: Starts of trimmed texts that no number has: letters but those of NaN and infinity,
#: digits before a dash, slash or colon.
NO_NUMBER = r"^([A-HJ-MO-Za-hj-mo-z]|[iI][^nN]|[nN][^aA]|\d+[-/:])"


def _semantic_types(df: DataFrame, card: DataFrame) -> DataFrame:
    cols = df.columns
    aggs, kinds = [], {}
    for i, f in enumerate(df.schema.fields):
        c, dt = col(f.name), f.dataType
        present = ~is_missing(f.name, dt)
        if is_boolean_type(dt):
            in_bool = present
            kinds[f.name] = "bool"
        elif is_numeric_type(dt):
            in_bool = present & c.cast("double").isin(*_BOOL_NUMBERS)
            kinds[f.name] = "numeric"
        elif is_text_type(dt):
            in_bool = present & c.isin(*_BOOL_TEXTS)
            kinds[f.name] = "text"
        elif is_datetime_type(dt):
            in_bool = F.lit(False)
            kinds[f.name] = "datetime"
        else:
            in_bool = F.lit(False)
            kinds[f.name] = "other"
        if kinds[f.name] == "text":
            trimmed = F.trim(c)
            datelike = F.lit(False)
            for pat in rules.DATE_TEXT_PATTERNS:
                datelike = datelike | trimmed.rlike(pat)
            # a failed cast costs an exception: texts that cannot be numbers are not tried
            castable = F.when(~trimmed.rlike(NO_NUMBER), c.try_cast("double").isNotNull()).otherwise(F.lit(False))
        else:
            datelike, castable = F.lit(False), F.lit(False)
        aggs += [F.count_if(present).alias(f"present__{i}"),
                 F.count_if(in_bool).alias(f"in_bool__{i}"),
                 F.count_if(present & datelike).alias(f"datelike__{i}"),
                 F.count_if(present & castable).alias(f"castable__{i}")]
    one = df.agg(*aggs)
    long = _stack_row(one, cols, ["present", "in_bool", "datelike", "castable"])
    kind_map = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(kinds[c]))])
    long = long.withColumn("kind", kind_map[F.col("column_name")])
    long = long.join(card.select("column_name", "n_distinct"), "column_name")
    p = F.col("present")
    stype = (F.when(p == 0, "unknown")
             .when((F.col("in_bool") == p) & (F.col("n_distinct") <= 2), "boolean")
             .when(F.col("kind") == "datetime", "datetime")
             .when((F.col("kind") == "text") & (F.col("datelike") / p > rules.DATE_TEXT_SHARE),
                   "datetime")
             .when(F.col("kind").isin("numeric", "bool"), "numeric")
             .when((F.col("kind") == "text") & (F.col("castable") == p), "numeric")
             .otherwise("categorical"))
    return long.select("column_name", "ordinal", stype.alias("semantic_type"))


def semantic_type_map(df: DataFrame, counts: DataFrame | None = None) -> dict[str, str]:
    """Driver-side dict of P8 (bounded by the number of columns)."""
    card = column_cardinality(df, counts=counts) if counts is not None else None
    return {r["column_name"]: r["semantic_type"] for r in semantic_types(df, card).collect()}


# --------------------------------------------------------------------------- P9
def input_types(df: DataFrame) -> DataFrame:
    """Scoring-form input type per column over the whole table (P9):
    date / datetime-local / number / text."""
    cols = df.columns
    aggs = []
    for i, f in enumerate(df.schema.fields):
        s = F.trim(col(f.name).cast("string"))
        present = s.isNotNull() & (s != "")
        num = s.try_cast("double").isNotNull()
        short_number = num & (F.length(s) < rules.INPUT_SHORT_NUMBER_LEN)
        parsed = F.coalesce(F.try_to_timestamp(s),
                            F.try_to_timestamp(s, F.lit("MM/dd/yyyy")),
                            F.try_to_timestamp(s, F.lit("M/d/yyyy")),
                            F.try_to_timestamp(s, F.lit("yyyy/MM/dd")))
        if is_datetime_type(f.dataType):
            datelike = present
        elif is_numeric_type(f.dataType) or is_boolean_type(f.dataType):
            datelike = F.lit(False)
        else:
            datelike = present & ~short_number & parsed.isNotNull()
        has_time = datelike & s.rlike(rules.INPUT_TIME_PATTERN)
        aggs += [F.count_if(present).alias(f"n__{i}"),
                 F.count_if(present & num).alias(f"num__{i}"),
                 F.count_if(datelike).alias(f"date__{i}"),
                 F.count_if(has_time).alias(f"time__{i}")]
    long = _stack_row(df.agg(*aggs), cols, ["n", "num", "date", "time"])
    named = F.lower(F.col("column_name")).rlike(rules.INPUT_DATE_NAME_PATTERN)
    date_ratio = F.col("date") / F.col("n")
    is_date = (date_ratio >= rules.INPUT_DATE_SHARE) | (named & (date_ratio >= rules.INPUT_DATE_SHARE_NAMED))
    itype = (F.when(F.col("n") == 0, "text")
             .when(is_date & (F.col("time") > 0), "datetime-local")
             .when(is_date, "date")
             .when(F.col("num") / F.col("n") >= rules.INPUT_NUMBER_SHARE, "number")
             .otherwise("text"))
    return long.select("column_name", "ordinal", itype.alias("input_type"))


# --------------------------------------------------------------------------- P10
def target_suitability(df: DataFrame, cardinality: DataFrame | None = None) -> DataFrame:
    """Per column: invalid / classification / regression / too_many_categories
    (P10), with every value checked instead of a 50-row sample."""
    cols = df.columns
    card = cardinality if cardinality is not None else column_cardinality(df)
    aggs = []
    for i, f in enumerate(df.schema.fields):
        if is_numeric_type(f.dataType) or is_boolean_type(f.dataType):
            non_num = F.lit(0)
            aggs.append(F.lit(0).cast("bigint").alias(f"non_numeric__{i}"))
            continue
        s = col(f.name).cast("string")
        non_num = s.isNotNull() & (s.try_cast("double").isNull() | (F.trim(s) == ""))
        aggs.append(F.count_if(non_num).alias(f"non_numeric__{i}"))
    long = _stack_row(df.agg(*aggs), cols, ["non_numeric"]).join(
        card.select("column_name", "n_distinct"), "column_name")
    n = F.col("n_distinct")
    numeric = F.col("non_numeric") == 0
    lo, hi = rules.SUITABILITY_TEXT_RANGE
    verdict = (F.when(n == 1, "invalid")
               .when(numeric & (n <= rules.SUITABILITY_NUMERIC_CLASSES), "classification")
               .when(numeric, "regression")
               .when((n >= lo) & (n <= hi), "classification")
               .otherwise("too_many_categories"))
    return long.select("column_name", "ordinal", "n_distinct", verdict.alias("suitability"))
