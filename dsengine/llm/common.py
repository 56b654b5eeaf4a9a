"""Tables, stages and sizes shared by the operators of this subpackage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dsengine.session import work_path

#: Largest table that an operator sends whole to every executor.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written under spark.checkpoint.dir and read again: what follows
    neither recomputes it nor loses it with an executor."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a stage that nothing reads any more."""
    path = getattr(df, "_stage_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        hpath = sc._jvm.org.apache.hadoop.fs.Path(path)
        hpath.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hpath, True)


#: Texts that reach a Python worker at once.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_BYTES``: the workers hold
    several copies of a batch, and texts are long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return int(df.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0)


def parts(amount: float, each: float, least: int = 64) -> int:
    """How many parts of about ``each`` the amount makes."""
    return max(least, math.ceil(amount / each))


def key_of(doc_id: Column, text: Column) -> Column:
    """The document id, or for a null id one above 2**62 taken from the text."""
    return F.coalesce(doc_id.cast("long"), F.xxhash64(text).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62)))


def id_of(key: Column) -> Column:
    """The document id behind ``key_of``; null where it had none."""
    return F.when(key < F.lit(1 << 62), key)


def boxed(docs: DataFrame, *more: Column) -> DataFrame:
    """``row``, the columns of ``docs`` but text in one struct, so that no name
    clashes with those an operator adds, and ``text``."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"] or [F.lit(None).cast("int").alias("none")]
    return docs.select(F.struct(*rest).alias("row"), F.col("text").cast("string").alias("text"), *more)


def unboxed(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in names])


#: Equal rows that are written out together.
STEP = 1 << 16


def number_rows(df: DataFrame, by: list[str], within: str | None = None) -> DataFrame:
    """The columns ``by`` of ``df`` and ``row_number``, from 0 in their order; if
    ``within`` (the first of them) is given, from 0 for each of its values.

    Equal rows are one row with a count until the end, so a row that fills a
    third of the table meets in no task. Rows are sorted by range; a table of a
    row per range gives the offsets."""
    group = [within] if within else []
    runs = df.groupBy(*by).agg(F.count("*").alias("copies"))
    placed = runs.repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.monotonically_increasing_id().alias("m"))
    placed = staged(placed.select(*by, "copies", F.shiftright("m", 33).alias("part"), F.expr("m & 8589934591").alias("at")), "numbers")
    heads = placed.groupBy("part", *group).agg(F.sum("copies").alias("total"))
    heads = heads.select("part", *group, (F.sum("total").over(W.partitionBy(*group).orderBy("part")) - F.col("total")).alias("before"))
    inside = F.sum("copies").over(W.partitionBy("part", *group).orderBy("at")) - F.col("copies")
    runs = placed.join(heads, ["part", *group])
    first = F.col("before") + inside
    rows = runs.select(*by, "copies", first.alias("first"))
    last = F.col("first") + F.col("copies") - 1
    rows = rows.select(*by, last.alias("last"), F.explode(F.sequence("first", last, F.lit(STEP).cast("long"))).alias("x"))
    return rows.select(*by, F.explode(F.sequence(F.col("x"), F.least(F.col("x") + STEP - 1, "last"))).alias("row_number"))
