"""Edge tables (FIXTURES.md section 5)."""

import math

import pytest
from pyspark.sql import functions as F

from dsengine.functions.quantiles import exact_quantiles
from dsengine.operators import categorical as K
from dsengine.operators import clean as C
from dsengine.operators import eda, profile
from dsengine.operators import prepare as P
from dsengine.operators.select import target_correlation
from dsengine.sources.io import nonfinite_to_null, sanitize_nonfinite


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, b string")
    assert profile.shape(df).first()["rows"] == 0
    assert {r["column_name"]: r["missing"] for r in profile.missing_counts(df).collect()} == {"a": 0, "b": 0}
    assert profile.duplicate_count(df).first()["duplicates"] == 0
    types = {r["column_name"]: r["semantic_type"] for r in profile.semantic_types(df).collect()}
    assert types == {"a": "unknown", "b": "unknown"}
    assert exact_quantiles(df, ["a"], [0.5])[("a", 0.5)] is None


def test_one_row_undefined_moments(spark):
    df = spark.createDataFrame([(1.5, "x")], "a double, b string")
    s = eda.statistical_summary(df).first()
    assert s["mean"] == 1.5 and s["median"] == 1.5
    assert s["std_dev"] is None and s["skewness"] is None and s["kurtosis"] is None


def test_all_null_columns(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "a double, b string")
    types = {r["column_name"]: r["semantic_type"] for r in profile.semantic_types(df).collect()}
    assert types == {"a": "unknown", "b": "unknown"}
    out, info = C.impute_mode(df, ["b"])
    assert [r["b"] for r in out.collect()] == ["Unknown", "Unknown"]
    out, fills = C.impute_numeric(df, ["a"])
    assert fills["a"][1] is None


def test_nan_null_unified(spark):
    rows = [(float("nan"),), (None,), (float("inf"),), (float("-inf"),), (2.0,)]
    df = spark.createDataFrame(rows, "a double")
    assert profile.missing_counts(df).first()["missing"] == 2
    vals = [r[0] for r in df.select(sanitize_nonfinite("a")).collect()]
    assert vals[0] == 0.0 and vals[2] == 0.0 and vals[3] == 0.0 and vals[4] == 2.0
    assert sum(1 for r in nonfinite_to_null(df).collect() if r["a"] is None) == 4


def test_constant_column_correlation_is_null(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 2.0), (2.0, 3.0)], "a double, b double")
    corr = {r["column_name"]: r["abs_corr"] for r in target_correlation(df, "b").collect()}
    assert corr == {"a": None}
    cm = {(r["column_a"], r["column_b"]): r["corr"] for r in eda.correlation_matrix(df).collect()}
    assert cm[("a", "b")] is None and abs(cm[("b", "b")] - 1.0) < 1e-12


def test_mode_tie_smallest_wins(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,)], "c string")
    assert C.mode_values(df, ["c"])["c"] == ("a", 1)


def test_null_duplicates_equal(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (1, None), (1, None), (1, 2)], "a int, b int")
    out, removed = C.dedup_exact(df)
    assert removed == 2 and out.count() == 3
    assert profile.duplicate_count(df).first()["duplicates"] == 2


def test_text_types(spark):
    rows = [("1",), ("2.5",), ("3",)]
    t = {r["column_name"]: r["semantic_type"] for r in
         profile.semantic_types(spark.createDataFrame(rows, "c string")).collect()}
    assert t["c"] == "numeric"
    dates79 = [("2020-01-%02d" % (i + 1),) for i in range(79)] + [("word",)] * 21
    dates81 = [("2020-01-%02d" % (i % 28 + 1),) for i in range(81)] + [("word",)] * 19
    for rows, want in [(dates79, "categorical"), (dates81, "datetime")]:
        t = {r["column_name"]: r["semantic_type"] for r in
             profile.semantic_types(spark.createDataFrame(rows, "c string")).collect()}
        assert t["c"] == want
    t = {r["column_name"]: r["semantic_type"] for r in profile.semantic_types(
        spark.createDataFrame([("yes",), ("no",), (None,)], "c string")).collect()}
    assert t["c"] == "boolean"


@pytest.mark.parametrize("values,pos,neg", [
    (["available", "not available"], "available", "not available"),
    (["present", "absent"], "present", "absent"),
    # 'y'/'n' map to (yes, no); 'yes' is not a value, so order decides and
    # our order is the sorted one
    (["Y", "N"], "N", "Y"),
    (["TRUE", "false"], "TRUE", "false"),
])
def test_binary_pairs(spark, values, pos, neg):
    df = spark.createDataFrame([(v,) for v in values * 3], "c string")
    cls = K.classify_categoricals(df).first()
    assert cls["category_class"] == "binary"
    assert (cls["positive"], cls["negative"]) == (pos, neg)
    enc = K.binary_encode(df, {"c": (pos, neg)})
    assert sorted({r["c"] for r in enc.collect()}) == [0, 1]


def test_unseen_category_all_zero(spark):
    train = spark.createDataFrame([("a",), ("b",), ("c",)], "c string")
    model = P.fit_one_hot(train)
    assert model.feature_names() == ["c_b", "c_c"]
    score = spark.createDataFrame([("z",), ("a",), ("c",)], "c string")
    rows = model.transform(score).collect()
    assert [tuple(r) for r in rows] == [(0.0, 0.0), (0.0, 0.0), (0.0, 1.0)]
    missing_col = spark.createDataFrame([(1,)], "x int")
    assert tuple(model.transform(missing_col).first()) == (1, 0.0, 0.0)


def test_bad_rows_flagged(spark):
    from dsengine.plans.train import validity
    df = spark.createDataFrame([("1.5",), ("x",), (None,)], "a string")
    errs = [r[0] for r in df.select(validity(df, ["a"])).collect()]
    assert errs == [None, "invalid value for a", "invalid value for a"]


def test_one_class_split_falls_back(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(20)], "id long, label double")
    out = P.split(df, "label", ["id"], "classification")
    assert out.where("is_test").count() == 20 and out.where("not is_test").count() == 20


def test_zero_iqr_not_high_variation(spark):
    df = spark.createDataFrame([(1.0,)] * 10 + [(50.0,)], "a double")
    assert C.high_variation(df, ["a"])["a"]["high_variation"] is False


def test_keyword_rules_first_match(spark):
    assert C.domain_rule("age_rate")[0] == "age"
    assert C.domain_rule("revenue_ratio")[0] == "salary"
    assert C.domain_rule("page_percent")[0] == "age"   # substring rule, as specified
    assert C.domain_rule("price") is None


def test_ffill_bfill_across_buckets(spark):
    rows = [(i, None if i % 7 and i % 11 else f"v{i}") for i in range(1, 400)]
    rows = [(0, None)] + rows
    df = spark.createDataFrame(rows, "k long, v string")
    got = {r["k"]: r["v"] for r in C.ffill_bfill(df, ["v"], "k").collect()}
    last, want = None, {}
    for k, v in rows:
        last = v if v is not None else last
        want[k] = last
    first = next(v for _, v in rows if v is not None)
    want = {k: (v if v is not None else first) for k, v in want.items()}
    assert got == want


def test_kde_integrates_to_one(spark):
    df = spark.createDataFrame([(float(i % 17) + (i % 3) * 0.1,) for i in range(500)], "a double")
    pts = sorted((r["x"], r["density"]) for r in eda.kde_curve(df, ["a"]).collect())
    area = sum((pts[i + 1][0] - pts[i][0]) * (pts[i][1] + pts[i + 1][1]) / 2 for i in range(len(pts) - 1))
    assert abs(area - 1.0) < 0.02


def test_auc_with_ties(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.8), (0, 0.1), (1, 0.5), (0, 0.5)]
    df = spark.createDataFrame(rows, "label int, score double")
    from dsengine.operators.metrics import roc_auc
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert math.isclose(roc_auc(df).first()[0], want)


def test_ffill_hot_key_is_split_and_exact(spark):
    """A key holding half of the rows: its ties are filled in row-hash
    order inside sub-buckets; values outside the hot key are exact."""
    rows = [(i, f"v{i}" if i % 5 == 0 else None) for i in range(1, 200)]
    rows += [(100, None)] * 150 + [(100, "hot")] * 50
    df = spark.createDataFrame(rows, "k long, v string")
    out = C.ffill_bfill(df, ["v"], "k")
    assert out.count() == len(rows)
    got = out.collect()
    assert all(r["v"] is not None for r in got)
    # after the hot key, the fill continues from the last non-null at or before it
    after = {r["k"]: r["v"] for r in got if r["k"] in (101, 102, 103, 104)}
    assert after[101] in ("hot", "v100") and after[101] == after[104]
    assert {r["v"] for r in got if r["k"] == 99} == {"v95"}


def test_fingerprint_duplicates_equal_exact(spark):
    from dsengine.operators import dashboard as D
    rows = [(i % 7, None if i % 5 == 0 else f"s{i % 3}", float(i % 4)) for i in range(300)]
    df = spark.createDataFrame(rows, "a int, b string, c double")
    assert profile.duplicate_count(df, exact=False).first()[0] == profile.duplicate_count(df).first()[0]
    assert tuple(D.dataset_summary(df, exact=False).first()) == tuple(D.dataset_summary(df).first())


def test_bounded_cardinality_exact_below_limit(spark):
    rows = [(i % 3, f"s{i % 7}", i) for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, b string, c long")
    card, counts = profile.bounded_cardinality(df, limit=10)
    got = {r["column_name"]: (r["n_distinct"], r["is_exact"]) for r in card.collect()}
    assert got["a"] == (3, True) and got["b"] == (7, True)
    assert got["c"][1] is False and got["c"][0] > 40          # only compared with small limits
    assert {r["column_name"] for r in counts.collect()} == {"a", "b"}


def test_approximate_quantiles_close(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10001)], "a double")
    q = exact_quantiles(df, ["a"], [0.25, 0.5], exact=False)
    assert abs(q[("a", 0.5)] - 5000.0) <= 10 and abs(q[("a", 0.25)] - 2500.0) <= 10
