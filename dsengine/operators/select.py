"""Feature selection by absolute Pearson correlation with the target.

One job of partial Gram matrices gives every column's pair-complete correlation
with the target; a column that does not vary gives null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dsengine import rules
from dsengine.functions.exprs import col, numeric_columns
from dsengine.functions.gram import correlations


def target_correlation(df: DataFrame, target: str) -> DataFrame:
    """(column_name, abs_corr) for every numeric column but the target (F1)."""
    cols = [c for c in numeric_columns(df) if c != target]
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, abs_corr double")
    values = []
    for c in [target, *cols]:
        x = col(c).cast("double")
        values.append(F.when(~F.isnan(x), x))
    r = correlations(df, values, [(i + 1, 0) for i in range(len(cols))])
    return df.sparkSession.createDataFrame([(c, None if v is None else abs(v)) for c, v in zip(cols, r)], "column_name string, abs_corr double")


def low_correlation(corr: DataFrame, threshold: float | None = None) -> DataFrame:
    """Rows with abs_corr < threshold; undefined correlation is kept (F2)."""
    threshold = rules.LOW_CORRELATION if threshold is None else threshold
    return corr.where(F.col("abs_corr") < F.lit(threshold))


def select_features(df: DataFrame, target: str, threshold: float | None = None
                    ) -> tuple[DataFrame, list[str]]:
    """Drop low-correlation columns when the target is present and numeric."""
    if target not in df.columns or target not in numeric_columns(df):
        return df, []
    low = [r["column_name"] for r in low_correlation(target_correlation(df, target), threshold)
           .collect()]
    return df.drop(*low), low
