"""End-to-end through the public API on the dirty fixture (sf0.001)."""

from pyspark.sql import functions as F

from dsengine import api
from dsengine.plans.fixtures import dirty


def test_end_to_end(spark, sf):
    raw = dirty(spark, sf)
    prof = api.profile(raw, order_by=["k"])
    assert prof["shape"].first()["rows"] == raw.count()
    assert prof["preview"].count() == 10
    cleaned = api.clean(raw, target="total_price", order_by="k")
    df = cleaned.df
    assert "total_price" in df.columns and "source_flag" not in df.columns
    assert df.where(F.col("total_price").isNull()).count() == 0
    parts = api.explore(df, target="total_price")
    assert parts["statistical_summary"].count() > 0
    # feature selection may drop the row key, so the split hashes whole rows
    res = api.train(df, "total_price", models=["Linear Regression", "Decision Tree Regressor"])
    assert res.task_type == "regression"
    dash = api.dashboard(df, "total_price", df.columns, res)
    assert dash["kpis"].count() >= 5
    scored = api.score(res, raw.limit(50), cleaned)
    assert scored.count() == 50 and "prediction" in scored.columns
