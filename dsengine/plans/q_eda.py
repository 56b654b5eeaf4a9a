"""Driver keys for the EDA statistics."""

from __future__ import annotations

from dsengine.operators import eda
from dsengine.plans.fixtures import DIRTY_COLUMNS, DIRTY_TEXT, dirty, table, with_dirty
from dsengine.plans.oracles import per_column
from dsengine.plans.queries import LINEITEM_NUMERIC, register, rounded

PART_TEXT = ["p_name", "p_brand", "p_type"]
PAIR5 = LINEITEM_NUMERIC[:5]

_R = "(SELECT min(CAST({c} AS DOUBLE)) AS lo, max(CAST({c} AS DOUBLE)) AS hi, count({c}) AS n, stddev_samp(CAST({c} AS DOUBLE)) AS sd FROM lineitem)"


@register("histogram_30", per_column(LINEITEM_NUMERIC, f"""
SELECT {{name}} AS column_name, b AS bin, round(lo + b * (hi - lo) / 30, 6) AS bin_lo, count(*) AS count
FROM (SELECT CAST(least(floor((x - r.lo) / (r.hi - r.lo) * 30), 29) AS INTEGER) AS b, r.lo, r.hi
      FROM (SELECT CAST({{c}} AS DOUBLE) AS x FROM lineitem) t, {_R} r WHERE x IS NOT NULL)
GROUP BY b, lo, hi"""))
def q_histogram(spark, sf):
    return rounded(eda.histogram(table(spark, sf, "lineitem")))


@register("kde_curve", per_column(LINEITEM_NUMERIC, f"""
SELECT {{name}} AS column_name, CAST(g.range AS INTEGER) AS point,
  round(r.lo - 0.5 * (r.hi - r.lo) + g.range * ((r.hi + 0.5 * (r.hi - r.lo)) - (r.lo - 0.5 * (r.hi - r.lo))) / 199, 6) AS x,
  round(sum(b.cnt * exp(-0.5 * pow(((r.lo - 0.5 * (r.hi - r.lo)) + g.range * (((r.hi + 0.5 * (r.hi - r.lo)) - (r.lo - 0.5 * (r.hi - r.lo))) / 199)
        - (r.lo + (b.b + 0.5) * ((r.hi - r.lo) / 2048))) / (r.sd * pow(r.n, -0.2)), 2)))
        / (r.n * (r.sd * pow(r.n, -0.2)) * sqrt(2 * pi())), 12) AS density
FROM (SELECT CAST(least(floor((x - r.lo) / (r.hi - r.lo) * 2048), 2047) AS INTEGER) AS b, count(*) AS cnt
      FROM (SELECT CAST({{c}} AS DOUBLE) AS x FROM lineitem) t, {_R} r WHERE x IS NOT NULL GROUP BY 1) b,
     {_R} r, range(200) g
GROUP BY g.range, r.lo, r.hi, r.n, r.sd"""))
def q_kde(spark, sf):
    return rounded(eda.kde_curve(table(spark, sf, "lineitem")), {"density": 12})


@register("box_stats", per_column(LINEITEM_NUMERIC, """
SELECT {name} AS column_name, round(q.q1, 6) AS q1, round(q.med, 6) AS median, round(q.q3, 6) AS q3,
  round(min(x) FILTER (WHERE x >= q.q1 - 1.5 * (q.q3 - q.q1) AND x <= q.q3 + 1.5 * (q.q3 - q.q1)), 6) AS whisker_low,
  round(max(x) FILTER (WHERE x >= q.q1 - 1.5 * (q.q3 - q.q1) AND x <= q.q3 + 1.5 * (q.q3 - q.q1)), 6) AS whisker_high,
  count(*) FILTER (WHERE x < q.q1 - 1.5 * (q.q3 - q.q1) OR x > q.q3 + 1.5 * (q.q3 - q.q1)) AS outliers
FROM (SELECT CAST({c} AS DOUBLE) AS x FROM lineitem) t,
     (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS med,
             quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM lineitem) q
GROUP BY q.q1, q.med, q.q3"""))
def q_box_stats(spark, sf):
    return rounded(eda.box_stats(table(spark, sf, "lineitem")))


@register("top_values", f"""
SELECT column_name, CAST(rank AS INTEGER) AS rank, value, count FROM (
  SELECT column_name, value, count, row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value) AS rank
  FROM ({per_column(PART_TEXT, "SELECT {name} AS column_name, {c} AS value, count(*) AS count FROM part WHERE {c} IS NOT NULL GROUP BY 2")}))
WHERE rank <= 10""")
def q_top_values(spark, sf):
    return eda.top_values(table(spark, sf, "part"), PART_TEXT)


@register("value_counts", per_column(PART_TEXT, """
SELECT {name} AS column_name, {c} AS value, count(*) AS count FROM part WHERE {c} IS NOT NULL GROUP BY 2"""))
def q_value_counts(spark, sf):
    return eda.category_value_counts(table(spark, sf, "part"), PART_TEXT)


@register("missing_summary", with_dirty(per_column(DIRTY_COLUMNS, f"""
SELECT {{name}} AS column_name, count(*) FILTER (WHERE {{c}} IS NULL) AS missing_count,
  round(100.0 * count(*) FILTER (WHERE {{c}} IS NULL) / count(*), 6) AS missing_percentage,
  (SELECT CAST({' + '.join(f'count(*) FILTER (WHERE {c} IS NULL)' for c in DIRTY_COLUMNS)} AS BIGINT) FROM dirty) AS total_missing_cells,
  count(*) * {len(DIRTY_COLUMNS)} AS total_cells
FROM dirty""")))
def q_missing_summary(spark, sf):
    return rounded(eda.missing_summary(dirty(spark, sf)))


@register("missing_patterns", with_dirty(f"""
SELECT concat({', '.join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in DIRTY_COLUMNS)}) AS pattern,
  count(*) AS rows FROM dirty GROUP BY 1"""))
def q_missing_patterns(spark, sf):
    return eda.missing_patterns(dirty(spark, sf))


_MC = " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, "
    f"round(CASE WHEN isnan(corr(CASE WHEN {a} IS NULL THEN 1.0 ELSE 0.0 END, CASE WHEN {b} IS NULL THEN 1.0 ELSE 0.0 END)) THEN NULL "
    f"ELSE corr(CASE WHEN {a} IS NULL THEN 1.0 ELSE 0.0 END, CASE WHEN {b} IS NULL THEN 1.0 ELSE 0.0 END) END, 6) AS corr FROM dirty"
    for a in DIRTY_COLUMNS for b in DIRTY_COLUMNS)


@register("missing_correlation", with_dirty(_MC))
def q_missing_correlation(spark, sf):
    return rounded(eda.missing_correlation(dirty(spark, sf)))


@register("target_distribution", """
SELECT l_returnflag AS value, count(*) AS count FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1""")
def q_target_distribution(spark, sf):
    return eda.target_distribution(table(spark, sf, "lineitem"), "l_returnflag")


@register("imbalance_ratio", """
SELECT round(max(n) / min(n), 6) AS imbalance_ratio FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag)""")
def q_imbalance_ratio(spark, sf):
    return rounded(eda.imbalance_ratio(table(spark, sf, "lineitem"), "l_returnflag"))


@register("contingency", with_dirty(per_column([c for c in DIRTY_TEXT if c != "is_large"], """
SELECT {name} AS column_name, {c} AS value, is_large AS target_value, count(*) AS count
FROM dirty WHERE {c} IS NOT NULL AND is_large IS NOT NULL GROUP BY 2, 3""")))
def q_contingency(spark, sf):
    return eda.contingency(dirty(spark, sf), "is_large")


@register("contingency_wide", """
SELECT l_returnflag AS value, count(*) FILTER (WHERE l_linestatus = 'F') AS "F",
  count(*) FILTER (WHERE l_linestatus = 'O') AS "O" FROM lineitem GROUP BY 1""")
def q_contingency_wide(spark, sf):
    return eda.contingency_wide(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


_CM = " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(CASE WHEN isnan(corr({a}, {b})) THEN NULL "
    f"ELSE corr({a}, {b}) END, 6) AS corr FROM lineitem"
    for a in LINEITEM_NUMERIC for b in LINEITEM_NUMERIC)


@register("correlation_matrix", _CM)
def q_correlation_matrix(spark, sf):
    return rounded(eda.correlation_matrix(table(spark, sf, "lineitem")))


def _density_sql(pairs):
    parts = []
    for a, b in pairs:
        parts.append(f"""
SELECT '{a}' AS column_x, '{b}' AS column_y,
  CAST(CASE WHEN ra.hi = ra.lo THEN 0 ELSE least(floor((CAST({a} AS DOUBLE) - ra.lo) / (ra.hi - ra.lo) * 10), 9) END AS INTEGER) AS bin_x,
  CAST(CASE WHEN rb.hi = rb.lo THEN 0 ELSE least(floor((CAST({b} AS DOUBLE) - rb.lo) / (rb.hi - rb.lo) * 10), 9) END AS INTEGER) AS bin_y,
  count(*) AS count
FROM lineitem, {_R.format(c=a)} ra, {_R.format(c=b)} rb
WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 3, 4""")
    return "\nUNION ALL\n".join(parts)


@register("pair_density", _density_sql([(a, b) for a in PAIR5 for b in PAIR5 if a != b]))
def q_pair_density(spark, sf):
    return eda.pair_plot_density(table(spark, sf, "lineitem"))


@register("target_density", _density_sql([(c, "l_extendedprice") for c in LINEITEM_NUMERIC
                                          if c != "l_extendedprice"]))
def q_target_density(spark, sf):
    return eda.target_density(table(spark, sf, "lineitem"), "l_extendedprice")


def _bundle_sql() -> str:
    from dsengine.plans.queries import LINEITEM_COLUMNS, ORACLES
    text = ["l_returnflag", "l_linestatus"]
    flags = ", ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in LINEITEM_COLUMNS)
    parts = [f"SELECT '{name}' AS section, CAST(count(*) AS BIGINT) AS rows FROM ({ORACLES[key]})"
             for name, key in [("statistical_summary", "statistical_summary"),
                               ("histogram", "histogram_30"), ("box_stats", "box_stats"),
                               ("correlation_matrix", "correlation_matrix"),
                               ("pair_density", "pair_density")]]
    parts += [
        f"SELECT 'missing_summary', CAST({len(LINEITEM_COLUMNS)} AS BIGINT)",
        f"SELECT 'missing_patterns', CAST(count(DISTINCT concat({flags})) AS BIGINT) FROM lineitem",
        "SELECT 'top_values', CAST(" + " + ".join(f"least(10, count(DISTINCT {c}))" for c in text)
        + " AS BIGINT) FROM lineitem",
        "SELECT 'value_counts', CAST(" + " + ".join(f"count(DISTINCT {c})" for c in text)
        + " AS BIGINT) FROM lineitem",
        "SELECT 'target_distribution', CAST(count(DISTINCT l_returnflag) AS BIGINT) FROM lineitem",
        "SELECT 'imbalance_ratio', CAST(1 AS BIGINT)",
        f"SELECT 'kde_curve', CAST({len(LINEITEM_NUMERIC) * 200} AS BIGINT)",
        f"SELECT 'missing_correlation', CAST({len(LINEITEM_COLUMNS) ** 2} AS BIGINT)",
        "SELECT 'contingency', CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT l_linestatus, l_returnflag "
        "FROM lineitem WHERE l_linestatus IS NOT NULL AND l_returnflag IS NOT NULL)",
    ]
    return "\nUNION ALL\n".join(parts)


@register("eda_bundle", _bundle_sql())
def q_eda_bundle(spark, sf):
    parts = eda.explore(table(spark, sf, "lineitem"), target="l_returnflag")
    rows = [(k, v.count()) for k, v in parts.items()]
    return spark.createDataFrame(rows, "section string, rows bigint")
