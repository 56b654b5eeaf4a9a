"""Sources and sinks (S1-S7): delimited/columnar readers, CSV export, bounded
preview, non-finite sanitiser and the persisted scoring bundle."""

from __future__ import annotations

import importlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dsengine.functions.exprs import col
from dsengine.session import work_path
from dsengine.sources.quoted import read_quoted

#: Texts that stand for a missing value when a table is read.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
               "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(inf|Infinity)\s*$"
INTEGER = r"^\s*[+-]?\d+\s*$"


def read_table(spark: SparkSession, path: str, fmt: str | None = None,
               schema: T.StructType | str | None = None, infer: bool = True,
               quoted_line_breaks: bool = True) -> DataFrame:
    """Header + inferred types; format from the extension, CSV when the
    extension is unknown (S1, S2).

    Quoted fields may hold separators, doubled quotes and line breaks. Input of
    more than one split is read by several tasks all the same (``quoted.py``),
    unless its quoting is ill-formed; without ``quoted_line_breaks`` that needs
    no pass over the quotes. Texts of
    ``NULL_TOKENS`` are missing in every column before types are inferred, so a
    number column with ``NA`` stays one. Inferred types: bigint, double,
    boolean, timestamp (ISO dates and times), else text."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")
    fmt = fmt or {"parquet": "parquet", "json": "json", "jsonl": "json", "orc": "orc",
                  "csv": "csv", "tsv": "csv", "txt": "csv"}.get(ext, "csv")
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "json":
        return spark.read.json(path) if schema is None else spark.read.schema(schema).json(path)
    if fmt == "orc":
        return spark.read.orc(path)
    reader = (spark.read.option("header", True).option("mode", "PERMISSIVE").option("quote", '"').option("escape", '"')
              .option("multiLine", quoted_line_breaks).option("sep", "\t" if ext == "tsv" else ",").option("inferSchema", False))
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    text = reader.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in wanted.fields])).csv(path) if wanted else reader.csv(path)
    if quoted_line_breaks and _splits(spark, text) and spark.read.text(path).columns == ["value"]:
        cut = read_quoted(spark, path, text.schema, "\t" if ext == "tsv" else ",")
        text = text if cut is None else cut
    text = text.select(*[F.when(~F.trim(col(c)).isin(*NULL_TOKENS), col(c)).alias(c) for c in text.columns])
    if wanted:
        return text.select(*[col(f.name).try_cast(f.dataType).alias(f.name) for f in wanted.fields])
    return _typed(text) if infer else text


def _splits(spark: SparkSession, files: DataFrame) -> bool:
    """Whether the files together are larger than one split."""
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > most


def _typed(text: DataFrame) -> DataFrame:
    """Cast each text column to the narrowest type that all its values have."""
    if not text.columns:
        return text
    tests = []
    for i, c in enumerate(text.columns):
        v = col(c)
        date = v.rlike(r"^\d{4}-\d\d-\d\d([ T]\d\d:\d\d.*)?$") & v.try_cast("timestamp_ntz").isNotNull()
        tests += [F.count(v).alias(f"n{i}"), F.count_if(v.rlike(INTEGER) & v.try_cast("bigint").isNotNull()).alias(f"i{i}"),
                  F.count_if(v.rlike(NUMBER)).alias(f"d{i}"), F.count_if(F.lower(F.trim(v)).isin("true", "false")).alias(f"b{i}"),
                  F.count_if(date).alias(f"t{i}")]
    row, out = text.agg(*tests).first(), []
    for i, c in enumerate(text.columns):
        kind = next((k for k, short in (("bigint", "i"), ("double", "d"), ("boolean", "b"), ("timestamp_ntz", "t"))
                     if row[f"n{i}"] and row[f"{short}{i}"] == row[f"n{i}"]), None)
        out.append(col(c).try_cast(kind).alias(c) if kind else col(c))
    return text.select(*out)


def export_csv(df: DataFrame, path: str, single_file: bool = False) -> str:
    """Full table as CSV with a header (S3, S5): null -> empty field, quotes
    only where a value holds the separator or a quote, inner quotes doubled.
    One file per partition unless ``single_file`` (coalesce on request)."""
    out = df.coalesce(1) if single_file else df
    (out.write.mode("overwrite").option("header", True).option("quote", '"')
     .option("escape", '"').option("nullValue", "").option("emptyValue", '""')
     .option("quoteAll", False).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def read_exported_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return (spark.read.option("header", True).option("quote", '"').option("escape", '"')
            .option("multiLine", True).option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False).schema(schema).csv(path))


def preview(df: DataFrame, order_by: list[str], n: int = 10) -> DataFrame:
    """First n rows in key order (S4): per-partition top-n, then merge."""
    return df.orderBy(*order_by).limit(n)


def sanitize_nonfinite(c, replacement: float = 0.0):
    """NaN / +inf / -inf -> replacement."""
    v = col(c) if isinstance(c, str) else c
    bad = F.isnan(v) | v.isin(float("inf"), float("-inf"))
    return F.when(bad, F.lit(replacement)).otherwise(v)


def nonfinite_to_null(df: DataFrame) -> DataFrame:
    """NaN / inf -> null on every floating column (profile side of S6)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            v = col(f.name)
            out.append(F.when(F.isnan(v) | v.isin(float("inf"), float("-inf")), F.lit(None))
                       .otherwise(v).alias(f.name))
        else:
            out.append(col(f.name))
    return df.select(*out)


# --------------------------------------------------------------------------- S7
def save_bundle(bundle, spark: SparkSession, path: str | None = None) -> str:
    """Persist a ScoringBundle of any of the 16 models under the shared folder:
    Spark ML models with their own writer, the train rows of a lazy learner as
    a table, the rest (features, vocabularies, scaler, classes, stumps) as one
    JSON text row."""
    from dsengine.operators.models import TRANSFORMS
    path = path or work_path(spark, "bundle")
    m = bundle.model
    extra = dict(m.extra)
    meta = {"target": bundle.target, "task_type": bundle.task_type, "features": bundle.features,
            "classes": [str(c) for c in bundle.classes],
            "class_kind": "int" if bundle.classes and isinstance(bundle.classes[0], int) else "text",
            "vocab": bundle.one_hot.vocab,
            "scaler": {k: list(v) for k, v in bundle.scaler.items()},
            "removed": bundle.removed_columns, "pairs": {k: list(v) for k, v in bundle.pairs.items()},
            "model_name": m.name, "model_task": m.task, "n_classes": m.n_classes,
            "date_columns": list(bundle.date_columns), "text_columns": list(bundle.text_columns),
            "kind": next(k for k, fn in TRANSFORMS.items() if fn is m.transform_fn)}
    models = extra.pop("models", None) or ([m.model] if m.model is not None else [])
    for i, model in enumerate(models):
        model.write().overwrite().save(f"{path}/model-{i}")
    meta["model_classes"] = [f"{type(x).__module__}.{type(x).__name__}" for x in models]
    wide = bundle.one_hot.wide
    meta["wide"] = {"columns": wide.columns, "sizes": wide.sizes} if wide else None
    if wide:
        wide.table.write.mode("overwrite").parquet(f"{path}/vocabulary")
    train = extra.pop("train", None)
    if train is not None:
        train.write.mode("overwrite").parquet(f"{path}/train")
    meta["extra"], meta["has_train"] = extra, train is not None
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(f"{path}/meta")
    return path


def load_bundle(spark: SparkSession, path: str):
    from dsengine.operators import models as MD
    from dsengine.operators.onehot import SparseOneHot
    from dsengine.operators.prepare import OneHotModel
    from dsengine.plans.train import ScoringBundle
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    wide = meta.get("wide")
    if wide:
        wide = SparseOneHot(wide["columns"], wide["sizes"], spark.read.parquet(f"{path}/vocabulary"))
    models = []
    for i, name in enumerate(meta["model_classes"]):
        mod, cls = name.rsplit(".", 1)
        models.append(getattr(importlib.import_module(mod), cls).load(f"{path}/model-{i}"))
    extra = meta["extra"]
    if "stumps" in extra:
        extra["stumps"] = [tuple(s) for s in extra["stumps"]]
    if meta["kind"] == "trees":
        extra["models"], models = models, []
    if meta["has_train"]:
        extra["train"] = spark.read.parquet(f"{path}/train")
    fitted = MD.Fitted(meta["model_name"], meta["model_task"], meta["features"], meta["n_classes"],
                       models[0] if models else None, extra, MD.TRANSFORMS[meta["kind"]])
    classes = [int(c) for c in meta["classes"]] if meta["class_kind"] == "int" else meta["classes"]
    return ScoringBundle(meta["target"], meta["task_type"], meta["features"], classes,
                         OneHotModel(meta["vocab"], wide), {k: tuple(v) for k, v in meta["scaler"].items()},
                         fitted, meta["removed"], {k: tuple(v) for k, v in meta["pairs"].items()},
                         meta.get("date_columns", []), meta.get("text_columns", []))
