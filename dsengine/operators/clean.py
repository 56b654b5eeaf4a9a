"""Cleaning operators (C1-C27), each a DataFrame -> DataFrame step plus a
small report frame/dict.

Statistics that decide a step (missing shares, uniqueness, quantiles, modes,
rare values) come from aggregate jobs; they reach the rows as literals in
one projection. Order-dependent filling (C10) never sorts the whole table
into one task: rows are range-partitioned on the order key, filled inside each
range by a partitioned window, and the last value of every range is carried
forward through a frame of one row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dsengine import rules
from dsengine.functions.exprs import any_of, col, is_missing, is_numeric_type, is_text_type, mean_expr, std_pop_expr
from dsengine.functions.quantiles import exact_quantiles
from dsengine.functions.staging import multi_pass
from dsengine.operators.profile import value_counts
from dsengine.session import work_path


def _name_has(name: str, words) -> bool:
    low = name.lower()
    return any(w in low for w in words)


# --------------------------------------------------------------------------- C1
def dedup_exact(df: DataFrame) -> tuple[DataFrame, int]:
    """Drop repeated full rows (nulls equal). Returns (df, removed)."""
    before = df.count()
    out = df.dropDuplicates()
    return out, before - out.count()


# --------------------------------------------------------------------------- C2
def drop_null_identifiers(df: DataFrame, keywords=None, uniqueness=None) -> tuple[DataFrame, list[dict]]:
    """Identifier-like names with nunique/rows > 0.8: drop rows null there.
    Candidates are taken in column order on the shrinking table."""
    keywords = rules.IDENTIFIER_ROW_KEYWORDS if keywords is None else keywords
    uniqueness = rules.IDENTIFIER_ROW_UNIQUENESS if uniqueness is None else uniqueness
    details = []
    for c in df.columns:
        if not _name_has(c, keywords):
            continue
        dt = df.schema[c].dataType
        row = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(col(c)).alias("d"),
                     F.count_if(is_missing(c, dt)).alias("m")).first()
        if row["n"] and row["d"] / row["n"] > uniqueness and row["m"] > 0:
            details.append({"column": c, "missing_count": int(row["m"])})
            df = df.where(~is_missing(c, dt))
    return df, details


# --------------------------------------------------------------------------- C3/C4
def missing_shares(df: DataFrame) -> tuple[int, dict[str, int]]:
    aggs = [F.count(F.lit(1)).alias("__n")]
    aggs += [F.count_if(is_missing(c, df.schema[c].dataType)).alias(f"m{i}")
             for i, c in enumerate(df.columns)]
    row = df.agg(*aggs).first()
    return row["__n"], {c: row[f"m{i}"] for i, c in enumerate(df.columns)}


def high_missing_columns(df: DataFrame, threshold: float | None = None) -> list[tuple[str, int, float]]:
    """(column, missing, ratio) with missing ratio >= threshold."""
    threshold = rules.HIGH_MISSING_SHARE if threshold is None else threshold
    n, miss = missing_shares(df)
    out = []
    for c in df.columns:
        ratio = miss[c] / max(1, n)
        if ratio >= threshold:
            out.append((c, miss[c], ratio))
    return out


def missing_profile(df: DataFrame) -> tuple[int, dict[str, int], int]:
    """(rows, {column: missing}, rows with any missing) in one aggregate."""
    aggs = [F.count(F.lit(1)).alias("__n"), F.count_if(any_missing(df)).alias("__rm")]
    aggs += [F.count_if(is_missing(c, df.schema[c].dataType)).alias(f"m{i}")
             for i, c in enumerate(df.columns)]
    row = df.agg(*aggs).first()
    return row["__n"], {c: row[f"m{i}"] for i, c in enumerate(df.columns)}, row["__rm"]


def any_missing(df: DataFrame) -> Column:
    return any_of([is_missing(f.name, f.dataType) for f in df.schema.fields])


def row_missing_ratio(df: DataFrame) -> tuple[int, int, float]:
    """(rows, rows_with_missing, ratio) (C4)."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(any_missing(df)).alias("m")).first()
    return row["n"], row["m"], row["m"] / max(1, row["n"])


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows with any missing value (C27); NaN counts as missing."""
    return df.where(~any_missing(df))


# --------------------------------------------------------------------------- C5/C6/C7
def rows_first_rule(df: DataFrame, high_missing: float | None = None,
                    rows_limit: float | None = None) -> tuple[DataFrame, dict]:
    """If some column is >= high_missing missing and rows with missing are
    < rows_limit, drop incomplete rows first (C5)."""
    high_missing = rules.HIGH_MISSING_SHARE if high_missing is None else high_missing
    rows_limit = rules.ROWS_FIRST_LIMIT if rows_limit is None else rows_limit
    cols = high_missing_columns(df, high_missing)
    n, m, ratio = row_missing_ratio(df)
    if cols and ratio < rows_limit:
        out = drop_incomplete(df)
        return out, {"applied": True, "ratio": ratio, "removed": m}
    return df, {"applied": False, "ratio": ratio, "removed": 0}


def drop_high_missing(df: DataFrame, threshold: float | None = None,
                      keep: list[str] | None = None) -> tuple[DataFrame, list[tuple]]:
    """Drop columns with missing ratio >= threshold."""
    keep = set(keep or [])
    cols = [x for x in high_missing_columns(df, threshold) if x[0] not in keep]
    return df.drop(*[x[0] for x in cols]), cols


def drop_low_missing_rows(df: DataFrame, threshold: float | None = None) -> tuple[DataFrame, int, float]:
    """If rows with missing are < threshold of all rows, drop them."""
    threshold = rules.LOW_MISSING_ROWS_LIMIT if threshold is None else threshold
    n, m, ratio = row_missing_ratio(df)
    if ratio < threshold:
        return drop_incomplete(df), m, ratio
    return df, 0, ratio


# --------------------------------------------------------------------------- C8/C9
def iqr_fences(df: DataFrame, cols: list[str], exact: bool = True) -> dict[str, tuple]:
    """{column: (q1, q3, lower, upper)} over non-missing values."""
    q = exact_quantiles(df, cols, [0.25, 0.75], exact=exact)
    out = {}
    for c in cols:
        q1, q3 = q[(c, 0.25)], q[(c, 0.75)]
        if q1 is None:
            out[c] = (None, None, None, None)
            continue
        iqr = q3 - q1
        out[c] = (q1, q3, q1 - rules.IQR_FACTOR * iqr, q3 + rules.IQR_FACTOR * iqr)
    return out


def _num(c: str) -> Column:
    v = col(c).cast("double")
    return F.when(~F.isnan(v), v)


def high_variation(df: DataFrame, cols: list[str], fences: dict | None = None) -> dict[str, dict]:
    """{column: {q1, q3, outlier_share, high_variation}} (C8): share of
    non-missing values outside the fences > 0.1; IQR 0 -> False."""
    fences = fences or iqr_fences(df, cols)
    aggs = []
    for i, c in enumerate(cols):
        q1, q3, lo, hi = fences[c]
        v = _num(c)
        aggs.append(F.count(v).alias(f"n{i}"))
        if lo is None:
            aggs.append(F.lit(0).alias(f"o{i}"))
        else:
            aggs.append(F.count_if((v < F.lit(lo)) | (v > F.lit(hi))).alias(f"o{i}"))
    row = df.agg(*aggs).first() if cols else None
    out = {}
    for i, c in enumerate(cols):
        q1, q3, lo, hi = fences[c]
        n = row[f"n{i}"]
        share = (row[f"o{i}"] / n) if n else None
        hv = bool(q1 is not None and (q3 - q1) != 0 and share is not None
                  and share > rules.HIGH_VARIATION_SHARE)
        out[c] = {"q1": q1, "q3": q3, "outlier_share": share, "high_variation": hv}
    return out


def numeric_fill_values(df: DataFrame, cols: list[str]) -> dict[str, tuple]:
    """{column: (method, fill_value, missing)} for C9 (quantiles, outlier
    shares and means: several passes over a staged copy of the columns)."""
    if not cols:
        return {}
    with multi_pass(df, cols) as staged:
        return _numeric_fill_values(staged, cols)


def _numeric_fill_values(df: DataFrame, cols: list[str]) -> dict[str, tuple]:
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    fences = {}
    for c in cols:
        q1, q3 = q[(c, 0.25)], q[(c, 0.75)]
        fences[c] = ((None,) * 4 if q1 is None else
                     (q1, q3, q1 - rules.IQR_FACTOR * (q3 - q1), q3 + rules.IQR_FACTOR * (q3 - q1)))
    hv = high_variation(df, cols, fences)
    med = q
    row = df.agg(*[mean_expr(_num(c)).alias(f"a{i}") for i, c in enumerate(cols)],
                 *[F.count_if(is_missing(c, df.schema[c].dataType)).alias(f"m{i}")
                   for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        miss = row[f"m{i}"]
        if hv[c]["high_variation"]:
            method, value = rules.IMPUTE_MEDIAN_HIGH_VARIATION, med[(c, 0.5)]
        else:
            method, value = rules.IMPUTE_MEAN, row[f"a{i}"]
        if value is None:
            method, value = rules.IMPUTE_MEDIAN, med[(c, 0.5)]
        out[c] = (method if miss else "none", value, miss)
    return out


def impute_numeric(df: DataFrame, cols: list[str]) -> tuple[DataFrame, dict]:
    """Median if high variation else mean."""
    fills = numeric_fill_values(df, cols)
    out = []
    for f in df.schema.fields:
        c = f.name
        if c in fills and fills[c][2] and fills[c][1] is not None:
            v = F.when(~is_missing(c, f.dataType), col(c).cast("double"))
            out.append(F.coalesce(v, F.lit(float(fills[c][1]))).alias(c))
        else:
            out.append(col(c))
    return df.select(*out), fills


# --------------------------------------------------------------------------- C10
def ffill_bfill(df: DataFrame, cols: list[str], order_by: str,
                partition_by: list[str] | None = None) -> DataFrame:
    """Forward fill, then backward fill, of ``cols`` in ``order_by`` order
    (nulls first; ties by a hash of the row). The key may be of any type that
    sorts: number, text, date, timestamp.

    Rows are range-partitioned and sorted on (key, hash) and written under the
    shared folder with their place; as many ranges as the data needs, and a key
    value that repeats often is cut by the hash. A window inside each range
    fills; the last value of every range is carried to later ones through a
    frame of one row per range. Backward fill only touches rows before the
    first non-null value, which all take that value. ``partition_by`` fills
    within groups: ranges are of (group, key), windows run inside (range, group),
    and only groups that cross ranges, two a range at most, need a carry, so a
    group with most of the rows is filled by as many tasks as it has ranges.
    """
    if not cols:
        return df
    order, keys = col(order_by), list(partition_by or [])
    sort = [*[col(k) for k in keys], order, F.col("__tb")]
    placed = (df.withColumn("__tb", F.xxhash64(*[col(c) for c in df.columns]))
              .repartitionByRange(*sort).sortWithinPartitions(*sort)
              .withColumn("__at", F.monotonically_increasing_id()))
    path = work_path(df.sparkSession, "fill")
    placed.drop("__tb").write.parquet(path)
    group = [f"__key_{i}" for i in range(len(keys))]
    tagged = df.sparkSession.read.parquet(path).withColumn("__range", F.shiftright("__at", 33))
    tagged = tagged.withColumns({g: col(k) for g, k in zip(group, keys)})
    w = Window.partitionBy("__range", *group).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("__range", *group)
    per_range = tagged.groupBy("__range", *group).agg(
        *[F.max_by(col(c), F.when(col(c).isNotNull(), F.col("__at"))).alias(f"__last_{c}") for c in cols],
        *[F.min_by(col(c), F.when(col(c).isNotNull(), F.col("__at"))).alias(f"__first_{c}") for c in cols])
    # one row a range and group that crosses ranges
    several = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    wb = several.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    wf = several.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if group:
        spans = per_range.groupBy(*group).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")
        on = [per_range[g].eqNullSafe(spans[g]) for g in group]
        per_range = per_range.join(spans, on, "left_semi")
    carry = per_range.select(
        F.col("__range").alias("__r"), *[F.col(g).alias(f"{g}_c") for g in group],
        *[F.last(f"__last_{c}", True).over(wb).alias(f"__carry_{c}") for c in cols],
        *[F.first(f"__first_{c}", True).over(wf).alias(f"__head_{c}") for c in cols])
    for c in cols:
        tagged = tagged.withColumn(f"__ff_{c}", F.last(col(c), True).over(w))
        if group:
            tagged = tagged.withColumn(f"__own_{c}", F.min_by(col(c), F.when(col(c).isNotNull(), F.col("__at"))).over(whole))
    on = [F.col("__range") == F.col("__r"), *[F.col(g).eqNullSafe(F.col(f"{g}_c")) for g in group]]
    joined = tagged.join(F.broadcast(carry), on, "left")
    return joined.select(*[F.coalesce(F.col(f"__ff_{c}"), F.col(f"__carry_{c}"), F.col(f"__head_{c}"), *([F.col(f"__own_{c}")] if group else [])).alias(c)
                           if c in cols else col(c) for c in df.columns])


# --------------------------------------------------------------------------- C11/C12
def mode_values(df: DataFrame, cols: list[str]) -> dict[str, tuple]:
    """{column: (mode or None, missing)}: most frequent non-missing value,
    smallest on ties, from the value-count backbone (no group collected)."""
    if not cols:
        return {}
    vc = value_counts(df, cols)
    rank_key = F.struct((-F.col("count")).alias("neg_count"), F.col("value").alias("value"))
    stats = (vc.groupBy("column_name")
             .agg(F.min_by(F.when(F.col("value").isNotNull(), F.col("value")),
                           F.when(F.col("value").isNotNull(), rank_key)).alias("mode"),
                  F.sum(F.when(F.col("value").isNull(), F.col("count"))).alias("missing"))
             .collect())
    found = {r["column_name"]: (r["mode"], int(r["missing"] or 0)) for r in stats}
    return {c: found.get(c, (None, 0)) for c in cols}


def impute_mode(df: DataFrame, cols: list[str], default: str | None = None,
                boolean: bool = False, modes: dict | None = None) -> tuple[DataFrame, dict]:
    """Categorical (C11, default 'Unknown') / boolean (C12, default False)
    mode imputation. ``modes`` may be passed from a shared ``mode_values``."""
    default = (False if boolean else rules.UNKNOWN_CATEGORY) if default is None else default
    modes = {c: modes[c] for c in cols} if modes is not None else mode_values(df, cols)
    out, info = [], {}
    for f in df.schema.fields:
        c = f.name
        if c in modes and modes[c][1]:
            m = modes[c][0]
            if m is None:
                fill = F.lit(default)
            else:
                fill = F.lit(m)
            out.append(F.coalesce(col(c), fill.cast(f.dataType)).alias(c))
            info[c] = (f"mode: {m if m is not None else default}", m, modes[c][1])
        else:
            out.append(col(c))
            if c in modes:
                info[c] = ("none", modes[c][0], 0)
    return df.select(*out), info


# --------------------------------------------------------------------------- C13/C14
DATETIME_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd",
                    "MM/dd/yyyy", "M/d/yyyy", "M-d-yyyy", "dd-MM-yyyy", "yyyy/MM/dd"]


def coerce_numeric(c: Column) -> Column:
    """Uncastable -> null."""
    return c.cast("string").try_cast("double")


def coerce_datetime(c: Column, formats: list[str] | None = None) -> Column:
    """Text -> timestamp through a format list; unparsable -> null (C14)."""
    s = F.trim(c.cast("string"))
    found = F.coalesce(*[F.try_to_timestamp(s, F.lit(fmt)) for fmt in formats or DATETIME_FORMATS])
    if formats is None:
        # only one format has this shape, and each failed one costs an exception
        found = F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_timestamp(s, F.lit("yyyy-MM-dd"))).otherwise(found)
    return found


# --------------------------------------------------------------------------- C15-C17
def standardize_text(c: Column) -> Column:
    return F.lower(F.trim(c))


def standardize_date(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def canonical_map() -> Column:
    kv = []
    for canon, variants in rules.CANONICAL_VALUES.items():
        for v in variants:
            kv += [F.lit(v), F.lit(canon)]
    return F.create_map(*kv)


def canonical_values(c: Column) -> Column:
    """Exact-spelling synonyms -> canonical (C17)."""
    return F.coalesce(F.try_element_at(canonical_map(), c), c)


# --------------------------------------------------------------------------- C18/C19
def winsorize(df: DataFrame, cols: list[str], exact: bool = True) -> tuple[DataFrame, dict]:
    """Clip to the IQR fences when a column has outliers."""
    if not cols:
        return df, {}
    with multi_pass(df, cols) as staged:
        fences = iqr_fences(staged, cols, exact=exact)
        aggs = []
        for i, c in enumerate(cols):
            _, _, lo, hi = fences[c]
            v = _num(c)
            aggs.append(F.count_if((v < F.lit(lo)) | (v > F.lit(hi))).alias(f"o{i}")
                        if lo is not None else F.lit(0).alias(f"o{i}"))
        row = staged.agg(*aggs).first()
    info = {}
    out = []
    for f in df.schema.fields:
        c = f.name
        if c in fences and fences[c][2] is not None and row[f"o{cols.index(c)}"] > 0:
            _, _, lo, hi = fences[c]
            v = col(c).cast("double")
            out.append(F.when(v.isNull() | F.isnan(v), v)
                       .otherwise(F.least(F.greatest(v, F.lit(lo)), F.lit(hi))).alias(c))
            info[c] = {"outliers": int(row[f"o{cols.index(c)}"]), "lower": lo, "upper": hi}
        else:
            out.append(col(c))
    return df.select(*out), info


def domain_rule(name: str):
    for words, lo, hi in rules.DOMAIN_RULES:
        if _name_has(name, words):
            return words[0], lo, hi
    return None


def domain_rules(df: DataFrame, cols: list[str]) -> tuple[DataFrame, dict]:
    """Out-of-domain numeric values become missing (C19); counts reported."""
    ruled = {c: domain_rule(c) for c in cols}
    ruled = {c: r for c, r in ruled.items() if r is not None}
    if not ruled:
        return df, {}

    def bad(c, lo, hi):
        v = col(c).cast("double")
        cond = v < F.lit(lo)
        if hi is not None:
            cond = cond | (v > F.lit(hi))
        return v.isNotNull() & ~F.isnan(v) & cond

    row = df.agg(*[F.count_if(bad(c, lo, hi)).alias(c) for c, (_, lo, hi) in ruled.items()]).first()
    out = []
    for f in df.schema.fields:
        c = f.name
        if c in ruled:
            _, lo, hi = ruled[c]
            out.append(F.when(~bad(c, lo, hi), col(c)).alias(c))
        else:
            out.append(col(c))
    info = {c: {"rule": ruled[c][0], "invalid_removed": int(row[c])} for c in ruled if row[c]}
    return df.select(*out), info


# --------------------------------------------------------------------------- C20
def rare_values(df: DataFrame, cols: list[str], threshold: float | None = None) -> DataFrame:
    """(column_name, value, count) with share < threshold of all rows (nulls
    excluded from the values, included in the total)."""
    threshold = rules.RARE_CATEGORY_SHARE if threshold is None else threshold
    vc = value_counts(df, cols)
    tot = vc.groupBy("column_name").agg(F.sum("count").alias("total"),
                                        F.sum(F.when(F.col("value").isNotNull(), F.col("count")))
                                        .alias("present"))
    return (vc.where(F.col("value").isNotNull()).join(F.broadcast(tot), "column_name")
            .where(F.col("count") / F.col("present") < F.lit(threshold))
            .select("column_name", "value", "count"))


def group_rare(df: DataFrame, cols: list[str], threshold: float | None = None,
               label: str | None = None) -> tuple[DataFrame, dict]:
    """Values with share < threshold -> 'Other' (C20). Fewer than 1/threshold
    values of a column can be frequent, so the frequent ones are a list of
    bounded length whatever the number of rare ones."""
    label = rules.RARE_CATEGORY_LABEL if label is None else label
    share = rules.RARE_CATEGORY_SHARE if threshold is None else threshold
    if not cols:
        return df, {}
    vc = value_counts(df, cols).where(F.col("value").isNotNull())
    total = vc.groupBy("column_name").agg(F.sum("count").alias("present"))
    marked = vc.join(F.broadcast(total), "column_name").withColumn("rare", F.col("count") / F.col("present") < F.lit(share))
    # a row per frequent value, and one per column for all rare ones (null)
    kept = F.when(~F.col("rare"), F.col("value")).alias("value")
    often: dict[str, list] = {c: [] for c in cols}
    gone: dict[str, int] = {}
    for r in marked.groupBy("column_name", kept).agg(F.sum("count").alias("rows")).collect():
        if r["value"] is None:
            gone[r["column_name"]] = int(r["rows"])
        else:
            often[r["column_name"]].append(r["value"])
    out = []
    for c in df.columns:
        if c in gone:
            text = col(c).cast("string")
            stays = text.isNull() | text.isin(*often[c]) if often[c] else text.isNull()
            out.append(F.when(stays, col(c)).otherwise(F.lit(label)).alias(c))
        else:
            out.append(col(c))
    return df.select(*out), {c: {"rare_replaced": n, "threshold": share} for c, n in gone.items()}


# --------------------------------------------------------------------------- C21-C23
def distinct_and_rows(df: DataFrame, cols: list[str]) -> tuple[int, dict[str, int]]:
    vc = value_counts(df, cols)
    card = {r["column_name"]: r["n"] for r in
            vc.groupBy("column_name").agg(F.count("value").alias("n")).collect()}
    return df.count(), {c: int(card.get(c, 0)) for c in cols}


def constant_columns(df: DataFrame, distinct: dict[str, int] | None = None) -> list[str]:
    """nunique (non-null) <= 1."""
    distinct = distinct if distinct is not None else distinct_and_rows(df, df.columns)[1]
    return [c for c in df.columns if distinct[c] <= 1]


def constant_columns_minmax(df: DataFrame) -> list[str]:
    """nunique (non-null) <= 1 without counting distinct values: a column
    is constant when its non-missing min equals its max, or it has none
    (C21, one aggregate, no shuffle of values)."""
    if not df.columns:
        return []
    aggs = []
    for i, f in enumerate(df.schema.fields):
        v = F.when(~is_missing(f.name, f.dataType), col(f.name))
        if isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType)):
            aggs += [F.lit(1).alias(f"mn{i}"), F.lit(2).alias(f"mx{i}")]
            continue
        aggs += [F.min(v).alias(f"mn{i}"), F.max(v).alias(f"mx{i}")]
    row = df.agg(*aggs).first()
    return [c for i, c in enumerate(df.columns)
            if row[f"mn{i}"] is None or row[f"mn{i}"] == row[f"mx{i}"]]


def identifier_columns(df: DataFrame, rows: int | None = None,
                       distinct: dict[str, int] | None = None) -> list[str]:
    """id/uuid/guid/pk in the name and nunique/rows > 0.95."""
    cands = [c for c in df.columns if _name_has(c, rules.IDENTIFIER_DROP_KEYWORDS)]
    if not cands:
        return []
    if distinct is None or rows is None:
        row = df.agg(F.count(F.lit(1)).alias("__n"),
                     *[F.count_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(cands)]).first()
        rows, distinct = row["__n"], {c: row[f"d{i}"] for i, c in enumerate(cands)}
    return [c for c in cands if rows and distinct[c] / rows > rules.IDENTIFIER_DROP_UNIQUENESS]


def low_impact_columns(df: DataFrame) -> list[str]:
    """name/description/notes/... in the name."""
    return [c for c in df.columns if _name_has(c, rules.LOW_IMPACT_KEYWORDS)]


def drop_low_impact(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The table without its low-impact columns."""
    names = low_impact_columns(df)
    return df.drop(*names), names


# --------------------------------------------------------------------------- C24/C25
def date_order_pairs(columns: list[str]) -> list[tuple[str, str]]:
    dates = [c for c in columns if _name_has(c, rules.DATE_ORDER_KEYWORDS)
             and rules.DATE_KEYWORD in c.lower()]
    return [(dates[i], dates[i + 1]) for i in range(len(dates) - 1)]


def check_date_order(df: DataFrame) -> list[tuple[str, str, int]]:
    """Rows where the first date column is after the next."""
    pairs = date_order_pairs(df.columns)
    if not pairs:
        return []

    def ts(c):
        dt = df.schema[c].dataType
        if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return col(c).cast("timestamp")
        return coerce_datetime(col(c))

    row = df.agg(*[F.count_if(ts(a) > ts(b)).alias(f"p{i}")
                   for i, (a, b) in enumerate(pairs)]).first()
    return [(a, b, int(row[f"p{i}"])) for i, (a, b) in enumerate(pairs)]


def check_non_negative(df: DataFrame) -> list[tuple[str, int]]:
    """quantity/count columns (numeric): rows below zero."""
    cols = [f.name for f in df.schema.fields
            if _name_has(f.name, rules.NON_NEGATIVE_KEYWORDS) and is_numeric_type(f.dataType)]
    if not cols:
        return []
    row = df.agg(*[F.count_if(col(c) < 0).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return [(c, int(row[f"c{i}"])) for i, c in enumerate(cols)]


# --------------------------------------------------------------------------- C26
def standard_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / population std; a constant column becomes 0."""
    if not cols:
        return df
    row = df.agg(*[mean_expr(_num(c)).alias(f"a{i}") for i, c in enumerate(cols)],
                 *[std_pop_expr(_num(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    out = []
    for f in df.schema.fields:
        c = f.name
        if c in cols:
            i = cols.index(c)
            mean, sd = row[f"a{i}"], row[f"s{i}"]
            if mean is None:
                out.append(col(c).cast("double").alias(c))
            elif not sd:
                out.append((col(c).cast("double") - F.lit(mean)).alias(c))
            else:
                out.append(((col(c).cast("double") - F.lit(mean)) / F.lit(sd)).alias(c))
        else:
            out.append(col(c))
    return df.select(*out)


def text_like(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text_type(f.dataType)]
