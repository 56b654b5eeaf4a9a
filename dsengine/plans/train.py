"""Train-and-evaluate (M32) and the scoring bundle.

Flow: detect task (M1) -> one-hot + numeric assembly + valid rows (M2, M3)
-> label normalisation and indexing (M4) -> hash split (M5/M6) -> scaler
fit on train (M7) -> preparation statistics (M8) -> each model fitted on
the written train table, scored on the written test table, metrics from
one aggregate each (M25-M27) -> leaderboard and best model (M28, M29),
importances (M30), report (M31). A failing model is recorded with its error
and scored 0; all failing raises.
"""

from __future__ import annotations

import traceback
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dsengine import rules
from dsengine.functions.exprs import col
from dsengine.operators import categorical as K
from dsengine.operators import clean as C
from dsengine.operators import metrics as MT
from dsengine.operators import models as MD
from dsengine.operators import prepare as P
from dsengine.operators.onehot import VECTOR
from dsengine.plans.cleaning import discard, materialize

ROW_ID = "__rowid"


@dataclass
class TrainResult:
    task_type: str
    target: str
    features: list[str]
    classes: list
    prep: DataFrame
    metrics: DataFrame
    leaderboard: DataFrame
    fitted: dict
    errors: dict
    one_hot: P.OneHotModel
    scaler: dict
    predictions: dict = field(default_factory=dict)
    date_columns: list = field(default_factory=list)

    def best(self) -> MD.Fitted:
        name = self.leaderboard.orderBy("rank").first()["model"]
        return self.fitted[name]


def prepare(df: DataFrame, target: str, key: list[str] | None = None,
            key_is_feature: bool = False):
    """Steps M1-M7; returns (train, test, features, classes, task, one_hot, scaler, prep).

    ``key`` names the row identifier used for the deterministic split (all
    columns when not given); key columns are not features unless
    ``key_is_feature``."""
    if target not in df.columns:
        raise ValueError(f"no column named {target} to predict")
    given = bool(key)
    key = key or [c for c in df.columns if c != target]
    base = df.withColumn(ROW_ID, P.row_hash(key))
    base, dated = dates_as_days(base, exclude=[target, ROW_ID])
    if given and not key_is_feature:
        base = base.drop(*[k for k in key if k != target])
    assembled, features, one_hot = P.assemble_numeric(base, target, passthrough=[ROW_ID])
    # the one table that task detection, classes, counts and split read
    valid = stage = materialize(assembled, "valid")
    n_valid = valid.count()
    if n_valid < 2:
        raise ValueError("fewer than two complete rows to train on")
    task = P.detect_task(valid, target)["task_type"]
    classes = []
    if task == "classification":
        valid, kind = P.normalize_labels(valid, target)
        classes = sorted(r[0] for r in valid.select(col(target)).distinct().collect())
        if len(classes) < 2:
            raise ValueError("the target has a single class")
        mapping = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))])
        valid = valid.withColumn("label", mapping[col(target)])
    else:
        valid = valid.withColumn("label", col(target).cast("double"))
    split = P.split(valid, "label", [ROW_ID], task)
    split = materialize(split, "split")
    discard(stage)
    train = split.where(~F.col("is_test"))
    test = split.where(F.col("is_test"))
    scaler = P.fit_scaler(train, features)
    # the scaled table is written once; every fit and metric reads it
    scaled = materialize(P.apply_scaler(split, scaler), "scaled")
    train, test = scaled.where(~F.col("is_test")), scaled.where(F.col("is_test"))
    prep = P.prep_stats(split, target, features, task, one_hot.n_features(features))
    return train, test, features, classes, task, one_hot, scaler, prep, dated


def dates_as_days(df: DataFrame, exclude: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Datetime columns (typed, or text typed ``datetime`` by P8) become
    days since 1970-01-01 as doubles, so dates are modelled as numbers
    instead of one-hot text."""
    from pyspark.sql import types as T

    from dsengine import rules
    from dsengine.operators.clean import coerce_datetime
    exclude = set(exclude or [])
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)
            and f.name not in exclude]
    typed = [f.name for f in df.schema.fields
             if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
             and f.name not in exclude]
    dated = set(typed)
    if text:
        # the P8 datetime rule for text in one aggregate: > 80% of present
        # values look like dates (a date-like column is never boolean)
        aggs = []
        for i, c in enumerate(text):
            t = F.trim(col(c))
            like = F.lit(False)
            for pat in rules.DATE_TEXT_PATTERNS:
                like = like | t.rlike(pat)
            aggs += [F.count(col(c)).alias(f"n{i}"), F.count_if(col(c).isNotNull() & like).alias(f"d{i}")]
        r = df.agg(*aggs).first()
        dated |= {c for i, c in enumerate(text)
                  if r[f"n{i}"] and r[f"d{i}"] / r[f"n{i}"] > rules.DATE_TEXT_SHARE}
    if not dated:
        return df, []
    out = []
    for f in df.schema.fields:
        if f.name in dated:
            d = (col(f.name) if f.name in typed else coerce_datetime(col(f.name))).cast("date")
            out.append(F.datediff(d, F.lit("1970-01-01").cast("date")).cast("double").alias(f.name))
        else:
            out.append(col(f.name))
    return df.select(*out), sorted(dated)


def days_since_epoch(c):
    from dsengine.operators.clean import coerce_datetime
    return F.datediff(coerce_datetime(c).cast("date"), F.lit("1970-01-01").cast("date")).cast("double")


def train_all(df: DataFrame, target: str, key: list[str] | None = None,
              models: list[str] | None = None, model_params: dict | None = None) -> TrainResult:
    spark = df.sparkSession
    train, test, features, classes, task, one_hot, scaler, prep, dated = prepare(df, target, key)
    train, test = train.drop("is_test"), test.drop("is_test")
    names = models or (MD.CLASSIFIERS if task == "classification" else MD.REGRESSORS)
    params = model_params or {}
    binary = task == "classification" and len(classes) == 2

    def one(name: str):
        """The fitted model, its predictions and its metrics, or why it failed."""
        try:
            kw = dict(params.get(name, {}))
            if name.startswith("K-Nearest"):
                kw.setdefault("id_col", ROW_ID)
            m = MD.fit(name, task, train, features, len(classes), **kw)
            # written once: the metrics read the predictions several times
            out = materialize(m.transform(test), "predicted")
            if task == "classification":
                met = MT.classification_metrics(out, "label", "prediction").first()
                auc = 0.0
                if binary and "probability" in out.columns:
                    sc = out.select(F.col("label"), F.col("probability")[1].alias("score"))
                    auc = MT.roc_auc(sc, "label", "score").first()[0]
                return m, out, (met["accuracy"], met["precision"], met["recall"], met["f1_score"], float(auc), None, None, None, None), None
            met = MT.regression_metrics(out, "label", "prediction").first()
            return m, out, (None, None, None, None, None, met["r2_score"], met["mae"], met["rmse"], met["mape"]), None
        except Exception as e:  # a failing model is recorded, not fatal
            traceback.print_exc(limit=2)
            return None, None, (None,) * 9, f"{type(e).__name__}: {e}"

    # small fits mostly wait for their next job: a few run side by side
    with ThreadPoolExecutor(max_workers=rules.FITS_AT_ONCE) as pool:
        # in the order of the line-up, a model of many rounds would be alone at the end
        begun = sorted(dict.fromkeys(names), key=lambda n: n not in rules.FIT_FIRST)
        work = {name: pool.submit(inheritable_thread_target(spark)(one), name) for name in begun}
        results = [work[name].result() for name in names]
    fitted, errors, rows, preds = {}, {}, [], {}
    for i, (name, (m, out, metrics, error)) in enumerate(zip(names, results)):
        rows.append((name, i, *metrics, error[:500] if error else None))
        if error:
            errors[name] = error
        else:
            fitted[name], preds[name] = m, out
    if not fitted:
        raise RuntimeError(f"all models failed: {errors}")
    metrics = spark.createDataFrame(
        rows, "model string, ordinal int, accuracy double, precision double, recall double, "
              "f1_score double, roc_auc double, r2_score double, mae double, rmse double, "
              "mape double, error string")
    lb = MT.leaderboard(metrics, task)
    return TrainResult(task, target, features, classes, prep, metrics, lb, fitted, errors,
                       one_hot, scaler, preds, dated)


def feature_importance(res: TrainResult, model: str | None = None) -> DataFrame:
    """(model, feature, importance) descending."""
    spark = res.metrics.sparkSession
    names = [model] if model else list(res.fitted)
    rows = []
    for n in names:
        for f, v in res.fitted[n].importances():
            rows.append((n, f, v))
    return spark.createDataFrame(rows, "model string, feature string, importance double")


def model_report(res: TrainResult) -> DataFrame:
    """Totals, best model and every model's metrics in one frame."""
    best = res.leaderboard.where(F.col("rank") == 1).select("model").first()["model"]
    return (res.leaderboard.withColumn("is_best", F.col("model") == F.lit(best))
            .withColumn("task_type", F.lit(res.task_type))
            .withColumn("models_trained", F.lit(len(res.fitted)))
            .withColumn("models_failed", F.lit(len(res.errors))))


# --------------------------------------------------------------------------- scoring
@dataclass
class ScoringBundle:
    """Everything needed to score new rows with the best model."""
    target: str
    task_type: str
    features: list[str]
    classes: list
    one_hot: P.OneHotModel
    scaler: dict
    model: MD.Fitted
    removed_columns: list = field(default_factory=list)
    pairs: dict = field(default_factory=dict)
    date_columns: list = field(default_factory=list)
    text_columns: list = field(default_factory=list)

    @classmethod
    def from_result(cls, res: TrainResult, removed=None, pairs=None, model: str | None = None, text_columns=None):
        """``text_columns``: columns whose text cleaning trimmed, lowered and
        mapped to canonical words; scoring does the same to new rows."""
        m = res.fitted[model] if model else res.best()
        return cls(res.target, res.task_type, res.features, res.classes, res.one_hot,
                   res.scaler, m, list(removed or []), dict(pairs or {}), list(res.date_columns), list(text_columns or []))


def align_features(df: DataFrame, features: list[str], keep: list[str] | None = None) -> DataFrame:
    """Absent features = 0.0, training order, extra columns ignored but those
    in ``keep`` (X3)."""
    have = set(df.columns)
    return df.select(*[col(c) for c in keep or []], *[(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) if c in have
                        else F.lit(0.0)).alias(c) for c in features])


def validity(df: DataFrame, raw_numeric: list[str]) -> F.Column:
    """Error text for a row whose numeric input is missing or not a number,
    else null (X5)."""
    err = F.lit(None).cast("string")
    for c in reversed(raw_numeric):
        if c not in df.columns:
            continue
        v = F.col(f"`{c}`").cast("string").try_cast("double")
        err = F.when(v.isNull(), F.lit(f"invalid value for {c}")).otherwise(err)
    return err


def score(bundle: ScoringBundle, df: DataFrame, id_col: str | None = None) -> DataFrame:
    """Input columns + prediction (+ probability) + error for every row
    (X1, X3-X5): drop removed columns and the target, encode binary pairs
    case-insensitively, one-hot with the fitted vocabulary, align to the
    training features (absent = 0), scale with the train statistics, predict
    and decode. One narrow projection chain; no shuffle except for kNN."""
    inputs = df.columns
    rid = P.row_hash([id_col] if id_col else inputs)
    base = df.select(F.struct(*[col(c) for c in inputs]).alias("__input"), rid.alias(ROW_ID),
                     *[(days_since_epoch(col(c)) if c in bundle.date_columns else
                        C.canonical_values(C.standardize_text(col(c).cast("string"))) if c in bundle.text_columns else col(c)).alias(c)
                       for c in inputs])
    drop = [c for c in bundle.removed_columns + [bundle.target] if c in inputs]
    work = K.binary_encode(base.drop(*drop),
                           {c: p for c, p in bundle.pairs.items() if c in inputs})
    raw_numeric = [c for c in work.columns if c in bundle.features and c != VECTOR]
    work = work.withColumn("error", validity(work, raw_numeric))
    enc = bundle.one_hot.transform(work)
    fcols = []
    for c in bundle.features:
        if c == VECTOR:
            fcols.append(col(c))
            continue
        m, s = bundle.scaler.get(c, (0.0, 1.0))
        m = 0.0 if m is None else m
        s = 1.0 if not s else s
        src = (F.coalesce(F.col(f"`{c}`").cast("string").try_cast("double"), F.lit(0.0))
               if c in enc.columns else F.lit(0.0))
        fcols.append(((src - F.lit(m)) / F.lit(s)).alias(c))
    ready = enc.select("__input", "error", ROW_ID, *fcols)
    out = bundle.model.transform(ready)
    pred = F.col("prediction")
    if bundle.task_type == "classification":
        mapping = F.create_map(*[x for i, c in enumerate(bundle.classes)
                                 for x in (F.lit(float(i)), F.lit(str(c)))])
        pred = mapping[F.col("prediction")]
        if bundle.target in bundle.pairs:
            # an encoded binary target goes back to its two words
            pred = K.binary_decode(pred.try_cast("double"), *bundle.pairs[bundle.target])
    else:
        pred = pred.cast("string")
    sel = ["__input.*", F.when(F.col("error").isNull(), pred).alias("prediction")]
    if "probability" in out.columns:
        sel.append(F.when(F.col("error").isNull(), F.col("probability")).alias("probability"))
    sel.append(F.col("error"))
    return out.select(*sel)


def score_summary(scored: DataFrame) -> DataFrame:
    """predicted_rows and error_rows."""
    return scored.agg(F.count_if(F.col("error").isNull()).alias("predicted_rows"),
                      F.count_if(F.col("error").isNotNull()).alias("error_rows"))
