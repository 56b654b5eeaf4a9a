"""Exploratory statistics: the data behind each plot.

Scale notes:
* moments, min/max, counts: one wide aggregate, map-side partial;
* quantiles: ``exact_quantiles`` (histogram refinement, bounded driver data);
* histograms / 2-D densities: ``width_bucket`` + ``groupBy`` - output is
  bins x columns, independent of rows;
* KDE: rows are first binned into fine bins, then bins x grid points
  (both bounded) are summed - the rows x grid product is never formed;
* value counts share the ``profile.value_counts`` backbone.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dsengine import rules
from dsengine.functions.exprs import col, is_missing, mean_expr, numeric_columns, sum_of, text_columns
from dsengine.functions.distinct import distinct_counts
from dsengine.functions.gram import correlations
from dsengine.functions.quantiles import exact_quantiles
from dsengine.functions.staging import multi_pass
from dsengine.operators.profile import value_counts


def _num(df: DataFrame, name: str):
    """Numeric value with NaN as null, as double."""
    c = col(name).cast("double")
    return F.when(~F.isnan(c), c)


def _finite(df: DataFrame, name: str):
    """Numeric value with NaN and infinities as null: ranges and bins are of
    finite values only."""
    v = _num(df, name)
    return F.when(F.abs(v) < F.lit(float("inf")), v)


# --------------------------------------------------------------------------- E12
def moments(df: DataFrame, cols: list[str]) -> dict:
    """One-pass moments per column (driver dict bounded by #columns)."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(cols):
        v = _num(df, c)
        aggs += [F.count(v).alias(f"n{i}"), mean_expr(v).alias(f"mean{i}"),
                 F.stddev_samp(v).alias(f"std{i}"), F.var_samp(v).alias(f"var{i}"),
                 F.var_pop(v).alias(f"varp{i}"),
                 F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}"),
                 F.skewness(v).alias(f"g1{i}"), F.kurtosis(v).alias(f"g2{i}")]
    row = df.agg(*aggs).first()
    out = {"rows": row["rows"]}
    for i, c in enumerate(cols):
        out[c] = m = {k: row[f"{k}{i}"] for k in
                      ("n", "mean", "std", "var", "varp", "min", "max", "g1", "g2")}
        if m["min"] is not None and m["min"] == m["max"]:
            # constant: merged variances may leave a rounding residue
            m["varp"] = 0.0
            m["std"] = m["var"] = None if m["n"] < 2 else 0.0
    return out


def _skew_unbiased(n, g1, varp):
    if n is None or n < 3 or g1 is None or not varp:
        return None
    return g1 * math.sqrt(n * (n - 1)) / (n - 2)


def _kurt_unbiased(n, g2, varp):
    if n is None or n < 4 or g2 is None or not varp:
        return None
    return ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3))


def statistical_summary(df: DataFrame, cols: list[str] | None = None,
                        exact: bool = True) -> DataFrame:
    """Per numeric column: mean, median, std_dev, variance, min, max,
    bias-corrected skewness and excess kurtosis, IQR outlier count and
    percent of all rows, unique ratio, is_constant (E12).

    Jobs: one moments aggregate, the quantile refinement, one aggregate for
    outlier counts, and typed distinct counts (``functions/distinct.py``).
    """
    cols = numeric_columns(df) if cols is None else list(cols)
    spark = df.sparkSession
    schema = ("column_name string, ordinal int, mean double, median double, std_dev double, "
              "variance double, min double, max double, skewness double, kurtosis double, "
              "outlier_count bigint, outlier_percentage double, n_distinct bigint, "
              "unique_ratio double, is_constant boolean")
    if not cols:
        return spark.createDataFrame([], schema)
    with multi_pass(df, cols) as staged:
        return _statistical_summary(staged, cols, exact, schema)


def _statistical_summary(df, cols, exact, schema):
    spark = df.sparkSession
    m = moments(df, cols)
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75], exact=exact)
    aggs = []
    for i, c in enumerate(cols):
        q1, q3 = q[(c, 0.25)], q[(c, 0.75)]
        if q1 is None:
            aggs.append(F.lit(0).cast("bigint").alias(f"o{i}"))
            continue
        iqr = q3 - q1
        lo, hi = q1 - rules.IQR_FACTOR * iqr, q3 + rules.IQR_FACTOR * iqr
        v = _num(df, c)
        aggs.append(F.count_if((v < F.lit(lo)) | (v > F.lit(hi))).alias(f"o{i}"))
    if not exact:
        # approximate mode: HyperLogLog distinct counts, no value shuffle
        aggs += [F.approx_count_distinct(_num(df, c), 0.01).alias(f"d{i}") for i, c in enumerate(cols)]
    orow = df.agg(*aggs).first()
    if not exact:
        distinct = {c: orow[f"d{i}"] for i, c in enumerate(cols)}
    else:
        distinct = {c: n for c, (n, _) in distinct_counts(df, cols).items()}
    rows = m["rows"]
    out = []
    for i, c in enumerate(cols):
        s = m[c]
        d = int(distinct.get(c, 0) or 0)
        ratio = d / rows if rows else None
        oc = int(orow[f"o{i}"] or 0)
        out.append((c, i, s["mean"], q[(c, 0.5)], s["std"], s["var"],
                    None if s["min"] is None else float(s["min"]),
                    None if s["max"] is None else float(s["max"]),
                    _skew_unbiased(s["n"], s["g1"], s["varp"]),
                    _kurt_unbiased(s["n"], s["g2"], s["varp"]),
                    oc, (oc / rows * 100.0) if rows else None, d, ratio,
                    None if ratio is None else ratio < rules.NEAR_CONSTANT_RATIO))
    return spark.createDataFrame(out, schema)


# --------------------------------------------------------------------------- E1
def _ranges(df: DataFrame, cols: list[str]) -> dict:
    row = df.agg(*[F.min(_finite(df, c)).alias(f"lo{i}") for i, c in enumerate(cols)],
                 *[F.max(_finite(df, c)).alias(f"hi{i}") for i, c in enumerate(cols)],
                 *[F.count(_finite(df, c)).alias(f"n{i}") for i, c in enumerate(cols)],
                 *[F.stddev_samp(_finite(df, c)).alias(f"sd{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"lo{i}"], row[f"hi{i}"], row[f"n{i}"], row[f"sd{i}"])
            for i, c in enumerate(cols)}


def bin_index(v, lo: float, hi: float, bins: int):
    """Equal-width bin 0..bins-1, the maximum falls in the last bin."""
    if hi == lo:
        return F.lit(0)
    return F.least(F.floor((v - F.lit(lo)) / F.lit(hi - lo) * F.lit(bins)).cast("int"),
                   F.lit(bins - 1))


def histogram(df: DataFrame, cols: list[str] | None = None,
              bins: int = rules.HISTOGRAM_BINS) -> DataFrame:
    """(column_name, bin, bin_lo, count) with ``bins`` equal-width bins per
    numeric column (E1): one min/max aggregate, then one grouped count of
    (column, bin) - output size is columns x bins whatever the row count."""
    cols = numeric_columns(df) if cols is None else list(cols)
    rng = _ranges(df, cols)
    items, meta = [], []
    for c in cols:
        lo, hi, n, _ = rng[c]
        if lo is None:
            continue
        v = _finite(df, c)
        items.append(F.when(v.isNotNull(), F.struct(F.lit(len(meta)).alias("i"),
                                                    bin_index(v, lo, hi, bins).alias("bin"))))
        meta.append((c, float(lo), float(hi)))
    if not items:
        return df.sparkSession.createDataFrame([], "column_name string, bin int, bin_lo double, count bigint")
    e = F.explode(F.array(*items)).alias("e")
    names = F.array(*[F.lit(m[0]) for m in meta])
    los = F.array(*[F.lit(m[1]) for m in meta])
    his = F.array(*[F.lit(m[2]) for m in meta])
    lo_c, hi_c = los[F.col("i")], his[F.col("i")]
    return (df.select(e).where("e is not null").select("e.*")
            .groupBy("i", "bin").agg(F.count(F.lit(1)).alias("count"))
            .select(names[F.col("i")].alias("column_name"), "bin",
                    (lo_c + F.col("bin") * (hi_c - lo_c) / F.lit(bins)).alias("bin_lo"), "count"))


# --------------------------------------------------------------------------- E2
def kde_curve(df: DataFrame, cols: list[str] | None = None, grid: int = 200,
              fine_bins: int = 2048) -> DataFrame:
    """Gaussian KDE with Scott's bandwidth (sd * n^-1/5) on ``grid`` points
    over [min - range/2, max + range/2] (E2).

    One scan reduces every column to ``fine_bins`` bin centres with counts;
    each (column, bin) row then emits its contribution to every grid point
    (explode of a fixed-size grid) and contributions are summed per grid
    point - the work is columns x fine_bins x grid, independent of rows."""
    cols = numeric_columns(df) if cols is None else list(cols)
    rng = _ranges(df, cols)
    params, items = [], []
    for c in cols:
        lo, hi, n, sd = rng[c]
        if lo is None or not sd or hi == lo or n < 2:
            continue
        bw = sd * n ** (-0.2)
        g_lo, g_hi = lo - 0.5 * (hi - lo), hi + 0.5 * (hi - lo)
        params.append((c, float(lo), (hi - lo) / fine_bins, g_lo, (g_hi - g_lo) / (grid - 1),
                       bw, n * bw * math.sqrt(2 * math.pi)))
        v = _finite(df, c)
        items.append(F.when(v.isNotNull(), F.struct(F.lit(c).alias("column_name"),
                                                    bin_index(v, lo, hi, fine_bins).alias("b"))))
    schema = "column_name string, point int, x double, density double"
    if not items:
        return df.sparkSession.createDataFrame([], schema)
    prm = df.sparkSession.createDataFrame(
        params, "column_name string, lo double, width double, g_lo double, step double, "
                "bw double, norm double")
    e = F.explode(F.array(*items)).alias("e")
    binned = df.select(e).where("e is not null").select("e.*").groupBy("column_name", "b").agg(F.count(F.lit(1)).alias("cnt"))
    centre = F.col("lo") + (F.col("b") + F.lit(0.5)) * F.col("width")
    gx = F.col("g_lo") + F.col("point") * F.col("step")
    contrib = (binned.join(F.broadcast(prm), "column_name")
               .select("column_name", "g_lo", "step", "norm", centre.alias("centre"), "cnt", "bw",
                       F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point"))
               .select("column_name", "point", gx.alias("x"), "norm",
                       (F.col("cnt") * F.exp(F.lit(-0.5) * F.pow((gx - F.col("centre")) / F.col("bw"), 2)))
                       .alias("w")))
    return (contrib.groupBy("column_name", "point", "x", "norm").agg(F.sum("w").alias("s"))
            .select("column_name", "point", "x", (F.col("s") / F.col("norm")).alias("density")))


# --------------------------------------------------------------------------- E3
def box_stats(df: DataFrame, cols: list[str] | None = None, exact: bool = True) -> DataFrame:
    """(column_name, q1, median, q3, whisker_low, whisker_high, outliers)."""
    cols = numeric_columns(df) if cols is None else list(cols)
    with multi_pass(df, cols) as staged:
        return _box_stats(staged, cols, exact)


def _box_stats(df, cols, exact):
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75], exact=exact)
    aggs, live = [], []
    for i, c in enumerate(cols):
        q1, q3 = q[(c, 0.25)], q[(c, 0.75)]
        if q1 is None:
            continue
        lo, hi = q1 - rules.IQR_FACTOR * (q3 - q1), q3 + rules.IQR_FACTOR * (q3 - q1)
        v = _num(df, c)
        inside = (v >= F.lit(lo)) & (v <= F.lit(hi))
        aggs += [F.min(F.when(inside, v)).alias(f"wl{i}"), F.max(F.when(inside, v)).alias(f"wh{i}"),
                 F.count_if((v < F.lit(lo)) | (v > F.lit(hi))).alias(f"o{i}")]
        live.append((i, c))
    rows = []
    if aggs:
        r = df.agg(*aggs).first()
        for i, c in live:
            rows.append((c, q[(c, 0.25)], q[(c, 0.5)], q[(c, 0.75)], r[f"wl{i}"], r[f"wh{i}"],
                         int(r[f"o{i}"])))
    return df.sparkSession.createDataFrame(
        rows, "column_name string, q1 double, median double, q3 double, whisker_low double, "
              "whisker_high double, outliers bigint")


# --------------------------------------------------------------------------- E4/E8
def top_values(df: DataFrame, cols: list[str] | None = None, k: int = rules.TOP_VALUES,
               counts: DataFrame | None = None) -> DataFrame:
    """(column_name, rank, value, count): k most frequent non-null values per
    column, ties by value (E4). ``row_number <= k`` is planned as a
    WindowGroupLimit, so each map task ships at most k rows per column."""
    cols = text_columns(df) if cols is None else list(cols)
    vc = counts if counts is not None else value_counts(df, cols)
    w = Window.partitionBy("column_name").orderBy(F.col("count").desc(), F.col("value").asc())
    return (vc.where(F.col("value").isNotNull())
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("column_name", "rank", "value", "count"))


def category_value_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column_name, value, count) for categorical columns, nulls excluded."""
    cols = text_columns(df) if cols is None else list(cols)
    return value_counts(df, cols).where(F.col("value").isNotNull())


# --------------------------------------------------------------------------- E5-E7
def missing_summary(df: DataFrame) -> DataFrame:
    """(column_name, missing_count, missing_percentage, total_missing_cells,
    total_cells) (E5)."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("__rows")]
    aggs += [F.count_if(is_missing(c, df.schema[c].dataType)).alias(f"missing_count__{i}")
             for i, c in enumerate(cols)]
    one = df.agg(*aggs)
    total = sum_of([F.col(f"missing_count__{i}") for i in range(len(cols))])
    one = one.withColumn("__total", total)
    items = [F.struct(F.lit(c).alias("column_name"),
                      F.col(f"missing_count__{i}").alias("missing_count"),
                      (F.col(f"missing_count__{i}") / F.col("__rows") * 100).alias("missing_percentage"),
                      F.col("__total").alias("total_missing_cells"),
                      (F.col("__rows") * F.lit(len(cols))).alias("total_cells"))
             for i, c in enumerate(cols)]
    return one.select(F.explode(F.array(*items)).alias("s")).select("s.*")


def missing_patterns(df: DataFrame) -> DataFrame:
    """(pattern, rows): one row per distinct null pattern, '1' = missing, in
    column order (E6, the missing matrix re-aimed as pattern counts)."""
    flags = [F.when(is_missing(f.name, f.dataType), F.lit("1")).otherwise(F.lit("0"))
             for f in df.schema.fields]
    return df.groupBy(F.concat(*flags).alias("pattern")).agg(F.count(F.lit(1)).alias("rows"))


def missing_correlation(df: DataFrame) -> DataFrame:
    """(column_a, column_b, corr) Pearson between null flags; null when a
    column has no or only missing values (E7)."""
    cols = df.columns
    flags = {c: F.when(is_missing(c, df.schema[c].dataType), 1.0).otherwise(0.0) for c in cols}
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    r = corr_pairs(df, flags, pairs)
    rows = []
    for a, b in pairs:
        v = r[(a, b)]
        if a == b and v is not None:
            v = 1.0
        rows.append((a, b, v))
        if a != b:
            rows.append((b, a, v))
    return df.sparkSession.createDataFrame(rows, "column_a string, column_b string, corr double")


# --------------------------------------------------------------------------- E9-E11
def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """(value, count) per target class, nulls excluded."""
    return (df.where(col(target).isNotNull())
            .groupBy(col(target).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count")))


def imbalance_ratio(df: DataFrame, target: str) -> DataFrame:
    """max class count / min class count."""
    return target_distribution(df, target).agg(
        (F.max("count") / F.min("count")).alias("imbalance_ratio"))


def contingency(df: DataFrame, target: str, cols: list[str] | None = None) -> DataFrame:
    """(column_name, value, target_value, count) for every categorical column
    against the target, rows with a missing side excluded (E11, long form)."""
    cols = [c for c in (text_columns(df) if cols is None else cols) if c != target]
    t = col(target).cast("string")
    items = [F.struct(F.lit(c).alias("column_name"), col(c).cast("string").alias("value"))
             for c in cols]
    return (df.where(t.isNotNull())
            .select(F.explode(F.array(*items)).alias("s"), t.alias("target_value"))
            .where(F.col("s.value").isNotNull())
            .groupBy(F.col("s.column_name").alias("column_name"), F.col("s.value").alias("value"),
                     "target_value")
            .agg(F.count(F.lit(1)).alias("count")))


def contingency_wide(df: DataFrame, column: str, target: str) -> DataFrame:
    """Cross table of one column x target classes (E11, wide form): one
    output column per class of the target, so the classes are the schema.
    ``contingency`` is the long form, without a column per class."""
    classes = sorted(r[0] for r in df.where(col(target).isNotNull())
                     .select(col(target).cast("string")).distinct().collect())
    return (df.where(col(column).isNotNull() & col(target).isNotNull())
            .groupBy(col(column).cast("string").alias("value"))
            .pivot(target, classes).agg(F.count(F.lit(1))).na.fill(0))


# --------------------------------------------------------------------------- E13
def corr_pairs(df: DataFrame, vals: dict, pairs: list[tuple[str, str]]) -> dict:
    """Pearson correlation for each (a, b) over pair-complete rows, null when
    undefined: one job over partial Gram matrices (``functions/gram.py``)."""
    cols = sorted({c for p in pairs for c in p})
    at = {c: i for i, c in enumerate(cols)}
    return dict(zip(pairs, correlations(df, [vals[c] for c in cols], [(at[a], at[b]) for a, b in pairs])))


def correlation_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column_a, column_b, corr) for all numeric pairs, pair-complete rows,
    null when undefined (E13)."""
    cols = numeric_columns(df) if cols is None else list(cols)
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column_a string, column_b string, corr double")
    vals = {c: _num(df, c) for c in cols}
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    r = corr_pairs(df, vals, pairs)
    rows = []
    for a, b in pairs:
        v = r[(a, b)]
        if a == b and v is not None:
            v = 1.0
        rows.append((a, b, v))
        if a != b:
            rows.append((b, a, v))
    return spark.createDataFrame(rows, "column_a string, column_b string, corr double")


# --------------------------------------------------------------------------- E14/E15
def pair_density(df: DataFrame, pairs: list[tuple[str, str]], bins: int = 10,
                 joint_limit: int = 1_000_000) -> DataFrame:
    """(column_x, column_y, bin_x, bin_y, count) 2-D bin counts over
    pair-complete rows (E14/E15: pair plots re-aimed as densities).

    When (bins + 1) ** columns <= ``joint_limit`` the rows are grouped once
    by all binned columns (a small frame whatever the row count) and every
    pair is summed from it; otherwise each row emits one entry per pair."""
    cols = sorted({c for p in pairs for c in p})
    rng = _ranges(df, cols)
    live = [(a, b) for a, b in pairs if rng[a][0] is not None and rng[b][0] is not None]
    empty = "column_x string, column_y string, bin_x int, bin_y int, count bigint"
    if not live:
        return df.sparkSession.createDataFrame([], empty)
    used = sorted({c for p in live for c in p})
    bincol = {c: F.when(_num(df, c).isNotNull(),
                        bin_index(_num(df, c), rng[c][0], rng[c][1], bins)) for c in used}
    xs = F.array(*[F.lit(a) for a, _ in live])
    ys = F.array(*[F.lit(b) for _, b in live])
    if (bins + 1) ** len(used) <= joint_limit:
        idx = {c: i for i, c in enumerate(used)}
        joint = (df.select(*[bincol[c].alias(f"b{idx[c]}") for c in used])
                 .groupBy(*[f"b{idx[c]}" for c in used]).agg(F.count(F.lit(1)).alias("n")))
        items = [F.when(F.col(f"b{idx[a]}").isNotNull() & F.col(f"b{idx[b]}").isNotNull(),
                        F.struct(F.lit(i).alias("i"), F.col(f"b{idx[a]}").alias("bin_x"),
                                 F.col(f"b{idx[b]}").alias("bin_y"), F.col("n").alias("n")))
                 for i, (a, b) in enumerate(live)]
        e = F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("e")
        return (joint.select(e).select("e.*").groupBy("i", "bin_x", "bin_y")
                .agg(F.sum("n").alias("count"))
                .select(xs[F.col("i")].alias("column_x"), ys[F.col("i")].alias("column_y"),
                        "bin_x", "bin_y", "count"))
    items = [F.when(bincol[a].isNotNull() & bincol[b].isNotNull(),
                    F.struct(F.lit(i).alias("i"), bincol[a].alias("bin_x"), bincol[b].alias("bin_y")))
             for i, (a, b) in enumerate(live)]
    e = F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("e")
    return (df.select(e).select("e.*").groupBy("i", "bin_x", "bin_y")
            .agg(F.count(F.lit(1)).alias("count"))
            .select(xs[F.col("i")].alias("column_x"), ys[F.col("i")].alias("column_y"),
                    "bin_x", "bin_y", "count"))


def pair_plot_density(df: DataFrame, bins: int = 10) -> DataFrame:
    """First five numeric columns, every ordered pair."""
    cols = numeric_columns(df)[:rules.PAIR_PLOT_COLUMNS]
    return pair_density(df, [(a, b) for a in cols for b in cols if a != b], bins)


def target_density(df: DataFrame, target: str, bins: int = 10) -> DataFrame:
    """Each numeric feature against a numeric target."""
    cols = [c for c in numeric_columns(df) if c != target]
    return pair_density(df, [(c, target) for c in cols], bins)


# --------------------------------------------------------------------------- E16
def explore(df: DataFrame, target: str | None = None) -> dict[str, DataFrame]:
    """The EDA bundle (E16): every section as a DataFrame."""
    texts = text_columns(df)
    vc = value_counts(df, texts) if texts else None
    out = {
        "statistical_summary": statistical_summary(df),
        "histogram": histogram(df),
        "box_stats": box_stats(df),
        "correlation_matrix": correlation_matrix(df),
        "missing_summary": missing_summary(df),
        "missing_patterns": missing_patterns(df),
        "pair_density": pair_plot_density(df),
        "kde_curve": kde_curve(df),
        "missing_correlation": missing_correlation(df),
    }
    if texts:
        out["top_values"] = top_values(df, texts, counts=vc)
        out["value_counts"] = vc.where(F.col("value").isNotNull())
    if target and target in df.columns:
        out["target_distribution"] = target_distribution(df, target)
        out["imbalance_ratio"] = imbalance_ratio(df, target)
        out["contingency"] = contingency(df, target)
        if target in numeric_columns(df):
            out["target_density"] = target_density(df, target)
    return out
