"""From raw documents to token batches, in five stages.

Every stage takes (spark, docs, sf_dir), calls one operator of ``dsengine.llm``
on all that the stage before kept, and its decisions take effect: rejected
documents go; one document of each group of near duplicates stays, the one with
the smallest id; contaminated documents go, and benchmark passages are cut from
the others; owner-specific secrets are masked; what is left is packed. All but
the last return the columns of ``documents``. Between two stages the documents
are written as Parquet under spark.checkpoint.dir and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dsengine.llm.common import release, staged, table
from dsengine.llm.decontaminate import decontaminate
from dsengine.llm.minhash import keep_one
from dsengine.llm.packing import pack
from dsengine.llm.quality import drop_rejected
from dsengine.llm.secrets import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_rejected(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontamination),
          ("secret scans", secrets), ("packing", packing)]

#: Trained models and sketches have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, old = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        docs = staged(out, name.replace(" ", "-"))
        if old is not None:
            release(old)
        old = docs
