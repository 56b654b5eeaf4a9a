"""Categorical handling: classify text columns, detect binary pairs, encode
and decode (K1-K6).

Scale notes: classification reads the value-count backbone once. Distinct
values are gathered only for columns with at most ``CLUSTERED_MAX`` values
(a broadcast semi-join on the small cardinality frame), so a high-cardinality
column never becomes one collected group. The pair dictionary is a literal
map expression (12 entries), not a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dsengine import rules
from dsengine.functions.exprs import col, text_columns
from dsengine.operators.profile import _columns_frame, value_counts


def _pair_map() -> Column:
    kv = []
    for k, (pos, neg) in rules.BINARY_PAIRS.items():
        kv += [F.lit(k), F.struct(F.lit(pos).alias("pos"), F.lit(neg).alias("neg"))]
    return F.create_map(*kv)


def classify_categoricals(df: DataFrame, cols: list[str] | None = None,
                          counts: DataFrame | None = None,
                          cardinality: DataFrame | None = None) -> DataFrame:
    """(column_name, ordinal, n_distinct, category_class, positive, negative,
    values) for every text column (K1, K2).

    category_class: binary | clustered | fully | none. ``values`` holds the
    sorted distinct values joined by '|' for columns with <= 10 values.
    """
    cols = text_columns(df) if cols is None else list(cols)
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame(
            [], "column_name string, ordinal int, n_distinct bigint, category_class string, "
                "positive string, negative string, values string")
    vc = (counts.where(F.col("column_name").isin(*cols)) if counts is not None
          else value_counts(df, cols)).where(F.col("value").isNotNull())
    if cardinality is not None:
        # n_distinct given (exact up to the small thresholds that matter here)
        card = cardinality.where(F.col("column_name").isin(*cols)).select("column_name", "n_distinct")
    else:
        card = vc.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))
    small = card.where(F.col("n_distinct") <= rules.CLUSTERED_MAX).select("column_name")
    vals = (vc.join(F.broadcast(small), "column_name", "left_semi")
            .groupBy("column_name").agg(F.sort_array(F.collect_list("value")).alias("vals")))
    base = (F.broadcast(_columns_frame(df, cols)).join(card, "column_name", "left")
            .join(vals, "column_name", "left")
            .withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0))))
    low = F.transform("vals", lambda v: F.lower(F.trim(v)))
    pmap = _pair_map()
    first, second = F.try_element_at(low, F.lit(1)), F.try_element_at(low, F.lit(2))
    mapping = F.coalesce(F.try_element_at(pmap, first), F.try_element_at(pmap, second))
    pos_idx = F.array_position(low, mapping["pos"])
    is_pair = (F.col("n_distinct") == 2) & mapping.isNotNull()
    positive = F.when(is_pair, F.when(pos_idx > 0, F.try_element_at("vals", pos_idx.cast("int")))
                      .otherwise(F.try_element_at("vals", F.lit(1))))
    negative = F.when(is_pair, F.when(pos_idx > 0,
                                      F.try_element_at("vals", (F.lit(3) - pos_idx).cast("int")))
                      .otherwise(F.try_element_at("vals", F.lit(2))))
    n = F.col("n_distinct")
    klass = (F.when(is_pair, "binary")
             .when(n == 2, "clustered")
             .when((n >= rules.CLUSTERED_MIN) & (n <= rules.CLUSTERED_MAX), "clustered")
             .when(n > rules.FULLY_CATEGORICAL_MIN, "fully")
             .otherwise("none"))
    return base.select("column_name", "ordinal", "n_distinct", klass.alias("category_class"),
                       positive.alias("positive"), negative.alias("negative"),
                       F.array_join("vals", "|").alias("values"))


def binary_pairs(classes: DataFrame) -> dict[str, tuple[str, str]]:
    """Driver dict column -> (positive, negative), bounded by #columns."""
    return {r["column_name"]: (r["positive"], r["negative"]) for r in
            classes.where(F.col("category_class") == "binary")
            .select("column_name", "positive", "negative").collect()}


def binary_encode(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """positive -> 1, negative -> 0, anything else (incl. null) -> null (K3)."""
    out = []
    for c in df.columns:
        if c in pairs:
            pos, neg = pairs[c]
            t = F.lower(F.trim(F.coalesce(col(c), F.lit(""))))
            out.append(F.when(t == F.lit(pos.lower()), F.lit(1))
                       .when(t == F.lit(neg.lower()), F.lit(0)).alias(c))
        else:
            out.append(col(c))
    return df.select(*out)


def binary_decode(score: Column, positive: str, negative: str) -> Column:
    """null -> null; >= 0.5 -> positive; else negative (K4)."""
    return (F.when(score.isNull(), F.lit(None).cast("string"))
            .when(score >= rules.DECODE_THRESHOLD, F.lit(positive))
            .otherwise(F.lit(negative)))


def categorical_info(classes: DataFrame) -> DataFrame:
    """(column_name, category_class, values, encoding) rows (K5)."""
    enc = F.when(F.col("category_class") == "binary",
                 F.concat(F.lit("1="), F.col("positive"), F.lit(",0="), F.col("negative")))
    vals = F.when(F.col("category_class") == "clustered", F.col("values"))
    return (classes.where(F.col("category_class").isin("binary", "clustered", "fully"))
            .select("column_name", "category_class", vals.alias("values"), enc.alias("encoding")))


def fully_categorical_columns(classes: DataFrame, keep: list[str] | None = None) -> list[str]:
    keep = set(keep or [])
    return [r["column_name"] for r in
            classes.where(F.col("category_class") == "fully").orderBy("ordinal").collect()
            if r["column_name"] not in keep]


def drop_fully_categorical(df: DataFrame, classes: DataFrame | None = None,
                           keep: list[str] | None = None,
                           semantic: dict[str, str] | None = None) -> tuple[DataFrame, list[str]]:
    """Remove every column classed ``fully`` (K6). Columns in ``keep`` (the
    target) and, when ``semantic`` is given, text columns typed datetime or
    numeric are protected."""
    classes = classes if classes is not None else classify_categoricals(df)
    drop = fully_categorical_columns(classes, keep)
    if semantic is not None:
        drop = [c for c in drop if semantic.get(c) not in ("datetime", "numeric")]
    return df.drop(*drop), drop
