"""Model metrics (M25-M29) from (label, prediction[, score]) columns.

Classification metrics come from the confusion counts ``groupBy(label,
prediction)`` - a frame of classes^2 rows - so every metric is exact and the
table is scanned once. ROC AUC uses the rank form with ties: counts per
distinct score, running sums per score range, and range offsets from a
one-row-per-range frame, so no window ever spans all distinct scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dsengine.session import work_path

EPS = 2.220446049250313e-16   # float64 machine epsilon (MAPE denominator floor)


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction",
              group: list[str] | None = None) -> DataFrame:
    g = list(group or [])
    return (df.groupBy(*g, F.col(label).cast("string").alias("y"),
                       F.col(prediction).cast("string").alias("p"))
            .agg(F.count(F.lit(1)).alias("n")))


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                           group: list[str] | None = None) -> DataFrame:
    """accuracy and support-weighted precision, recall, F1; zero division
    gives 0 (M25). ``group`` computes one row per model."""
    g = list(group or [])
    cm = confusion(df, label, prediction, g)
    support = cm.groupBy(*g, F.col("y").alias("c")).agg(F.sum("n").alias("support"))
    predicted = cm.groupBy(*g, F.col("p").alias("c")).agg(F.sum("n").alias("pred"))
    tp = cm.where(F.col("y") == F.col("p")).select(*g, F.col("y").alias("c"), F.col("n").alias("tp"))
    per = (support.join(predicted, g + ["c"], "left").join(tp, g + ["c"], "left")
           .na.fill(0, ["pred", "tp"]))
    prec = F.when(F.col("pred") > 0, F.col("tp") / F.col("pred")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    per = per.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
                ).otherwise(0.0)
    per = per.withColumn("f1", f1)
    tot = F.sum("support")
    return per.groupBy(*g).agg(
        (F.sum("tp") / tot).alias("accuracy"),
        (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1_score"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Binary ROC AUC with tied scores counted half (M26); 0 when the labels
    are not binary 0/1 with both classes present.

    Counts per distinct score are range-partitioned, sorted and written with
    their range; running sums stay inside a range (as many as the scores need)
    and a frame of one row per range gives the offsets."""
    y = F.col(label).cast("double")
    per_score = (df.where(F.col(score).isNotNull() & y.isNotNull())
                 .groupBy(F.col(score).cast("double").alias("s"))
                 .agg(F.sum(F.when(y == 1.0, 1).otherwise(0)).alias("pos"),
                      F.sum(F.when(y == 0.0, 1).otherwise(0)).alias("neg")))
    placed = (per_score.repartitionByRange("s").sortWithinPartitions("s")
              .select("pos", "neg", F.monotonically_increasing_id().alias("at")))
    path = work_path(df.sparkSession, "auc")
    placed.write.parquet(path)
    tagged = df.sparkSession.read.parquet(path).withColumn("rng", F.shiftright("at", 33))
    totals = tagged.groupBy("rng").agg(F.sum("neg").alias("rneg"))
    wb = Window.orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("rng", F.coalesce(F.sum("rneg").over(wb), F.lit(0)).alias("off"))
    wi = Window.partitionBy("rng").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    below = (tagged.join(F.broadcast(offsets), "rng")
             .withColumn("neg_below", F.col("off") + F.coalesce(F.sum("neg").over(wi), F.lit(0))))
    return below.agg(
        F.when((F.sum("pos") > 0) & (F.sum("neg") > 0),
               F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg")))
               / (F.sum("pos") * F.sum("neg"))).otherwise(0.0).alias("roc_auc"))


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                       group: list[str] | None = None) -> DataFrame:
    """R2, MAE, RMSE, MAPE with denominator max(|y|, eps)."""
    g = list(group or [])
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    err = y - p
    stats = df.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"), F.sum(err * err).alias("sse"),
        F.var_pop(y).alias("vy"), F.avg(F.abs(err)).alias("mae"),
        F.avg(F.abs(err) / F.greatest(F.abs(y), F.lit(EPS))).alias("mape"))
    sst = F.col("vy") * F.col("n")
    return stats.select(*g,
                        F.when(sst > 0, 1 - F.col("sse") / sst).otherwise(
                            F.when(F.col("sse") == 0, 1.0).otherwise(0.0)).alias("r2_score"),
                        "mae", F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), "mape")


def leaderboard(metrics: DataFrame, task_type: str, metric: str | None = None) -> DataFrame:
    """All models sorted by the primary metric (F1 or R2, or ``metric``),
    failures (null metric) scored 0, first model wins ties (M29); rank 1 is
    the best model (M28)."""
    metric = metric or ("f1_score" if task_type == "classification" else "r2_score")
    w = Window.orderBy(F.col("__m").desc(), F.col("ordinal").asc())
    return (metrics.withColumn("__m", F.coalesce(F.col(metric), F.lit(0.0)))
            .withColumn("rank", F.row_number().over(w)).drop("__m"))


def best_model(metrics: DataFrame, task_type: str, metric: str | None = None) -> DataFrame:
    return leaderboard(metrics, task_type, metric).where(F.col("rank") == 1)
