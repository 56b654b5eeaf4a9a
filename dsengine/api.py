"""User-facing entry points, one per step of an analysis:
upload/profile, clean, explore, train, dashboard and scoring. Each returns
DataFrames (or a dict of them); nothing here collects a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dsengine.operators import categorical as K
from dsengine.operators import dashboard as D
from dsengine.operators import eda as E
from dsengine.operators import profile as P
from dsengine.operators import select as S
from dsengine.plans import cleaning
from dsengine.plans import train as TR
from dsengine.sources import io


def load(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Delimited or columnar file(s) to a DataFrame."""
    return io.read_table(spark, path, fmt)


def profile(df: DataFrame, target: str | None = None, order_by: list[str] | None = None,
            sample_rows: int = 10) -> dict[str, DataFrame]:
    """Shape, roles, cardinality, missing values, duplicates, semantic types,
    target inference, categorical classes and a bounded preview (upload)."""
    counts = P.value_counts(df)
    card = P.column_cardinality(df, counts=counts)
    classes = K.classify_categoricals(df, counts=counts)
    return {
        "shape": P.shape(df),
        "roles": P.column_roles(df),
        "cardinality": card,
        "target": P.infer_target(df, target, cardinality=card),
        "missing": P.missing_counts(df),
        "duplicates": P.duplicate_count(df),
        "semantic_types": P.semantic_types(df),
        "input_types": P.input_types(df),
        "target_suitability": P.target_suitability(df, cardinality=card),
        "categorical_info": K.categorical_info(classes),
        "preview": io.preview(df, order_by or df.columns[:1], sample_rows),
    }


def clean(df: DataFrame, target: str | None = None, order_by: str | None = None,
          select_features: bool = True, **options) -> cleaning.CleanResult:
    """The cleaning pipeline (C28) followed by correlation feature selection
    when the target survives and is numeric (F1-F3)."""
    res = cleaning.clean(df, target=target, order_by=order_by, **options)
    if select_features and target and target in res.df.columns:
        out, dropped = S.select_features(res.df, target)
        res.df = out
        res.removed_columns += [(c, "low_correlation") for c in dropped]
    return res


def explore(df: DataFrame, target: str | None = None) -> dict[str, DataFrame]:
    """All EDA statistics."""
    return E.explore(df, target)


def train(df: DataFrame, target: str, key: list[str] | None = None,
          models: list[str] | None = None) -> TR.TrainResult:
    """Task detection, preparation, 8 models, metrics and leaderboard."""
    return TR.train_all(df, target, key, models)


def dashboard(df: DataFrame, target: str | None, key: list[str],
              result: TR.TrainResult | None = None) -> dict[str, DataFrame]:
    """Chart datasets and KPIs."""
    lb = result.leaderboard if result is not None else None
    task = result.task_type if result is not None else "classification"
    return D.dashboard(df, target, key, lb, task)


def score(result: TR.TrainResult, df: DataFrame, clean_result: cleaning.CleanResult | None = None,
          model: str | None = None) -> DataFrame:
    """Batch scoring with the best (or named) model."""
    removed = [c for c, _ in clean_result.removed_columns] if clean_result else []
    pairs = clean_result.pairs if clean_result else {}
    texts = [c for c, t in clean_result.types.items() if t == "categorical" and c != result.target] if clean_result else []
    bundle = TR.ScoringBundle.from_result(result, removed, pairs, model, texts)
    return TR.score(bundle, df)
