"""Dashboard data (D1-D15): the datasets behind each chart and KPI.

Everything is an aggregate or a bounded top-k over the whole table: samples
are ``orderBy(hash of the row key).limit(n)`` (per-partition top-k, then a
merge of n rows per partition), never a collect of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dsengine import rules
from dsengine.functions.exprs import (col, is_boolean_type, is_missing, is_text_type, mean_expr,
                                      numeric_columns, sum_of)
from dsengine.functions.quantiles import exact_quantiles
from dsengine.operators import eda
from dsengine.operators.profile import bounded_cardinality, column_cardinality


def _has(name: str, words) -> bool:
    low = name.lower()
    return any(w in low for w in words)


def _identifier_like(name: str) -> bool:
    return _has(name, rules.DASHBOARD_IDENTIFIER_KEYWORDS)


# --------------------------------------------------------------------------- D1/D6/D13
def dataset_summary(df: DataFrame, exact: bool = True) -> DataFrame:
    """rows, columns, missing_values (cells), duplicates.

    One grouping by the full row gives both duplicates and missing cells:
    each group's missing-cell count is a function of its key.
    ``exact=False`` groups by a 128-bit row fingerprint (see P7)."""
    from dsengine.operators.profile import row_fingerprint
    miss = sum_of([F.when(is_missing(f.name, f.dataType), 1).otherwise(0) for f in df.schema.fields])
    if exact:
        groups = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("n"))
    else:
        groups = (df.select(*row_fingerprint(df), miss.alias("__m"))
                  .groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("n"), F.first("__m").alias("__m")))
        miss = F.col("__m")
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.coalesce(F.sum(F.col("n") * miss), F.lit(0)).cast("bigint").alias("missing_values"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def quality_overview(df: DataFrame) -> DataFrame:
    """missing % of cells and duplicate % of rows, 2 decimals."""
    s = dataset_summary(df)
    cells = F.greatest(F.col("rows") * F.col("columns"), F.lit(1))
    return s.select(F.round(F.col("missing_values") / cells * 100, 2).alias("missing_pct"),
                    F.round(F.col("duplicates") / F.greatest(F.col("rows"), F.lit(1)) * 100, 2)
                    .alias("duplicate_pct"))


def completeness(df: DataFrame) -> DataFrame:
    """present and missing cells."""
    miss = sum_of([F.when(is_missing(f.name, f.dataType), 1).otherwise(0) for f in df.schema.fields])
    missing = F.coalesce(F.sum(miss), F.lit(0)).cast("bigint")
    return df.agg((F.count(F.lit(1)) * len(df.columns) - missing).alias("present"), missing.alias("missing"))


# --------------------------------------------------------------------------- D2
def _text_counts(df: DataFrame, column: str, k: int) -> DataFrame:
    """Top-k counts of a column as text, null counted as the value 'nan'."""
    v = F.coalesce(col(column).cast("string"), F.lit("nan"))
    w = Window.orderBy(F.col("count").desc(), F.col("label").asc())
    return (df.groupBy(v.alias("label")).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col("label").asc()).limit(k)
            .withColumn("rank", F.row_number().over(w)))


def distribution_series(df: DataFrame) -> DataFrame:
    """First numeric column as 30 histogram bins, else top-10 of the first
    column as text (D2). Columns: (column_name, bin, bin_lo, label, count)."""
    nums = numeric_columns(df)
    if nums:
        h = eda.histogram(df, [nums[0]])
        return h.select("column_name", "bin", "bin_lo", F.lit(None).cast("string").alias("label"),
                        "count")
    first = df.columns[0]
    return _text_counts(df, first, rules.BAR_TOP).select(
        F.lit(first).alias("column_name"), (F.col("rank") - 1).cast("int").alias("bin"),
        F.lit(None).cast("double").alias("bin_lo"), "label", "count")


# --------------------------------------------------------------------------- D3/D4
def category_share_column(df: DataFrame) -> str | None:
    """Column for the category-share pie (D3): text/bool, not identifier-like,
    keyword name with 2-20 distinct (null counted); else any such column;
    else a non-identifier numeric column with 2-10 distinct."""
    cats = [f.name for f in df.schema.fields
            if (is_text_type(f.dataType) or is_boolean_type(f.dataType))
            and not _identifier_like(f.name)]
    nums = [c for c in numeric_columns(df) if not _identifier_like(c)]
    cols = cats + nums
    if not cols:
        return None
    lo, hi = rules.CATEGORY_SHARE_TEXT_RANGE
    # limits are small: exact counts only for columns that may be within them
    rough, vc = bounded_cardinality(df, cols, limit=hi)
    card = {r["column_name"]: (r["n_distinct"], r["n_distinct"]) for r in rough.collect()}
    card |= {r["column_name"]: (r["n_all"], r["n"]) for r in
             vc.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_all"), F.count("value").alias("n")).collect()}
    for c in cats:
        if _has(c, rules.CATEGORY_SHARE_KEYWORDS) and lo <= card[c][0] <= hi:
            return c
    for c in cats:
        if lo <= card[c][0] <= hi:
            return c
    nlo, nhi = rules.CATEGORY_SHARE_NUMERIC_RANGE
    for c in nums:
        if nlo <= card[c][1] <= nhi:
            return c
    return None


def category_share(df: DataFrame, column: str | None = None) -> DataFrame:
    """(chart, label, value) rows: top-8 counts of the D3 column (null as a
    value); fallbacks: five-number spread of the first non-identifier
    numeric column, else top-10 of the first column (D4)."""
    column = column or category_share_column(df)
    if column:
        t = _text_counts(df, column, rules.PIE_TOP)
        return t.select(F.lit("pie").alias("chart"), "label", F.col("count").cast("double").alias("value"))
    nums = [c for c in numeric_columns(df) if not _identifier_like(c)]
    if nums:
        c = nums[0]
        q = exact_quantiles(df, [c], [0.0, 0.25, 0.5, 0.75, 1.0])
        rows = [("box", name, q[(c, p)]) for name, p in
                [("min", 0.0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("max", 1.0)]]
        return df.sparkSession.createDataFrame(rows, "chart string, label string, value double")
    t = _text_counts(df, df.columns[0], rules.BAR_TOP)
    return t.select(F.lit("bar").alias("chart"), "label", F.col("count").cast("double").alias("value"))


# --------------------------------------------------------------------------- D5
def correlation_top8(df: DataFrame) -> DataFrame:
    """Correlation of the first 8 numeric columns, undefined -> 0."""
    cols = numeric_columns(df)[:rules.HEATMAP_COLUMNS]
    cm = eda.correlation_matrix(df, cols)
    return cm.select("column_a", "column_b", F.coalesce("corr", F.lit(0.0)).alias("corr"))


# --------------------------------------------------------------------------- D8/D9
def variance_proxy(df: DataFrame) -> DataFrame:
    """Top 10 numeric columns by sample variance."""
    cols = numeric_columns(df)
    one = df.agg(*[F.var_samp(col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(cols)])
    items = [F.struct(F.lit(c).alias("column_name"), F.col(f"v{i}").alias("variance"))
             for i, c in enumerate(cols)]
    return (one.select(F.explode(F.array(*items)).alias("s")).select("s.*")
            .orderBy(F.col("variance").desc_nulls_last(), "column_name").limit(rules.BAR_TOP))


def cardinality_proxy(df: DataFrame) -> DataFrame:
    """Top 10 columns by distinct values, null counted."""
    card = column_cardinality(df).select("column_name", F.col("n_distinct_with_null").alias("distinct_values"))
    return card.where("distinct_values > 0").orderBy(F.col("distinct_values").desc(), "column_name").limit(rules.BAR_TOP)


# --------------------------------------------------------------------------- D11/D12
def relation_columns(df: DataFrame, target: str | None) -> tuple[str, str] | None:
    nums = numeric_columns(df)
    if len(nums) < 2:
        return None
    x = nums[0]
    y = target if (target in nums and target != x) else nums[1]
    return x, y


def relation_sample(df: DataFrame, target: str | None, key: list[str],
                    n: int = rules.RELATION_SAMPLE_ROWS) -> DataFrame:
    """(x, y) for n complete rows chosen by md5 of the row key (D11): a
    deterministic sample independent of partitioning; planned as a
    per-partition top-n (TakeOrderedAndProject)."""
    xy = relation_columns(df, target)
    if xy is None:
        return df.sparkSession.createDataFrame([], "x double, y double")
    x, y = xy
    h = F.md5(F.concat_ws("|", *[col(k).cast("string") for k in key]))
    return (df.where(col(x).isNotNull() & col(y).isNotNull())
            .select(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"), h.alias("h"))
            .orderBy("h").limit(n).select("x", "y"))


def relation_fallback(df: DataFrame, order_by: list[str],
                      n: int = rules.RELATION_SAMPLE_ROWS) -> DataFrame:
    """Index vs value line of the first numeric column (first n non-null
    values in key order), else value frequency of the first column (D12)."""
    nums = numeric_columns(df)
    if nums:
        c = nums[0]
        first = (df.where(col(c).isNotNull())
                 .select(*[col(k) for k in order_by], col(c).cast("double").alias("value"))
                 .orderBy(*order_by).limit(n))
        w = Window.orderBy(*order_by)
        return first.select((F.row_number().over(w) - 1).alias("index"), "value")
    t = _text_counts(df, df.columns[0], rules.BAR_TOP)
    return t.select((F.col("rank") - 1).alias("index"), F.col("count").cast("double").alias("value"))


# --------------------------------------------------------------------------- D14
def numeric_summary_card(df: DataFrame) -> DataFrame:
    """Summary of the numeric column with the most non-nulls (first on
    ties): count, mean, median, std, min, max, q1, q3, 6 decimals (D14)."""
    cols = numeric_columns(df)
    schema = ("column_name string, numeric_columns bigint, count bigint, mean double, "
              "median double, std double, min double, max double, q1 double, q3 double")
    if not cols:
        return df.sparkSession.createDataFrame([], schema)
    counts = df.agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    best = max(range(len(cols)), key=lambda i: (counts[f"n{i}"], -i))
    c = cols[best]
    v = col(c).cast("double")
    q = exact_quantiles(df, [c], [0.25, 0.5, 0.75])
    r = df.agg(F.count(v).alias("n"), mean_expr(v).alias("mean"), F.stddev_samp(v).alias("std"),
               F.min(v).alias("mn"), F.max(v).alias("mx")).first()
    if not r["n"]:
        return df.sparkSession.createDataFrame([], schema)

    row = (c, len(cols), r["n"], r["mean"], q[(c, 0.5)], r["std"], r["mn"], r["mx"],
           q[(c, 0.25)], q[(c, 0.75)])
    out = df.sparkSession.createDataFrame([row], schema)
    return out.select(*[F.round(x, 6).alias(x) if x not in ("column_name", "numeric_columns", "count")
                        else F.col(x) for x in out.columns])


# --------------------------------------------------------------------------- D15
def kpis(df: DataFrame, leaderboard: DataFrame | None, task_type: str) -> DataFrame:
    """(label, value) KPI rows: rows, columns, missing, best model and its
    headline metrics (D15)."""
    s = dataset_summary(df).first()
    rows = [("Rows", str(s["rows"])), ("Columns", str(s["columns"])),
            ("Missing", str(s["missing_values"]))]
    if leaderboard is not None:
        best = leaderboard.orderBy("rank").limit(1).collect()
        if best:
            b = best[0].asDict()
            rows.append(("Best Model", b["model"]))
            if task_type == "classification":
                rows.append(("Accuracy", str(round((b.get("accuracy") or 0.0) * 100, 2))))
                rows.append(("F1", str(round(b.get("f1_score") or 0.0, 4))))
            else:
                rows.append(("R2", str(round(b.get("r2_score") or 0.0, 4))))
                rows.append(("RMSE", str(round(b.get("rmse") or 0.0, 4))))
    return df.sparkSession.createDataFrame(rows, "label string, value string")


def dashboard(df: DataFrame, target: str | None, key: list[str],
              leaderboard: DataFrame | None = None, task_type: str = "classification") -> dict:
    """All dashboard datasets (D15 bundle)."""
    out = {"dataset_summary": dataset_summary(df), "numeric_summary": numeric_summary_card(df),
           "distribution": distribution_series(df), "category_share": category_share(df),
           "completeness": completeness(df), "kpis": kpis(df, leaderboard, task_type)}
    if len(numeric_columns(df)) >= 2:
        out["correlation"] = correlation_top8(df)
        out["relation"] = relation_sample(df, target, key)
    else:
        out["correlation"] = quality_overview(df)
        out["relation"] = relation_fallback(df, key)
    out["feature_importance_fallback"] = (variance_proxy(df) if numeric_columns(df)
                                          else cardinality_proxy(df))
    return out
