"""One-hot encoding of text columns with many values (M2): sparse vectors over a
vocabulary that stays a table.

The distinct values are sorted by range and numbered inside their ranges, so no task
and no driver holds a vocabulary; of it the driver knows one count a column. Rows meet
the vocabulary in joins: values that fill a thousandth of the column or more (at most
1,000 of them) come by broadcast, so that a hot value is not shuffled; the rest by a
shuffled join. The first value of each column is the baseline: it, missing and unseen
values have no slot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dsengine.functions.exprs import col
from dsengine.functions.staging import write_stage

#: Name of the vector column in assembled tables.
VECTOR = "__text"
#: A value is frequent if it fills one in so many rows of its column.
FREQUENT = 1000


@dataclass
class SparseOneHot:
    """Fitted vocabulary: ``table`` (column int, value string, slot int, frequent
    boolean) without baselines, and the number of slots of each column."""
    columns: list[str]
    sizes: list[int]
    table: DataFrame

    @property
    def n_slots(self) -> int:
        return sum(self.sizes)

    def slots(self, df: DataFrame) -> DataFrame:
        """``df`` with ``__slot{i}``, the slot of each encoded column's value; null
        for the baseline, missing and unseen values and an absent column."""
        for i, c in enumerate(self.columns):
            name = f"__slot{i}"
            if c not in df.columns:
                df = df.withColumn(name, F.lit(None).cast("int"))
                continue
            words = self.table.where(F.col("column") == i)
            often = words.where("frequent").select(F.col("value").alias("__often"), F.col("slot").alias("__a"))
            rare = words.where("NOT frequent").select(F.col("value").alias("__rare"), F.col("slot").alias("__b"))
            value = col(c).cast("string")
            df = df.join(F.broadcast(often), value == F.col("__often"), "left").drop("__often")
            # rows that need no second look-up must not meet in one partition: each has a key of its own
            other = F.concat(F.lit("\u0000"), F.monotonically_increasing_id().cast("string"))
            df = df.withColumn("__key", F.when(F.col("__a").isNull() & value.isNotNull(), value).otherwise(other))
            df = df.join(rare, F.col("__key") == F.col("__rare"), "left").withColumn(name, F.coalesce("__a", "__b")).drop("__key", "__rare", "__a", "__b")
        return df

    def transform(self, df: DataFrame, out: str = VECTOR) -> DataFrame:
        """``df`` without the encoded columns and with the sparse vector ``out``."""
        spark, names = df.sparkSession, [f"__slot{i}" for i in range(len(self.columns))]
        sets = [f"__set{i}" for i in range(len(self.columns))]
        coded = self.slots(df)
        for name, size in zip(names, self.sizes):  # the last, dropped, category stands for no slot
            coded = coded.withColumn(name, F.coalesce(F.col(name), F.lit(size)).cast("double"))
        kept = [c for c, size in zip(sets, self.sizes) if size]
        if kept:
            some = [(n, s) for n, s, size in zip(names, sets, self.sizes) if size]
            sizes = spark.createDataFrame([tuple(float(x) for x in self.sizes if x)], ", ".join(f"`{n}` double" for n, _ in some))
            coder = OneHotEncoder(inputCols=[n for n, _ in some], outputCols=[s for _, s in some], dropLast=True).fit(sizes)
            coded = coder.transform(coded)
        coded = VectorAssembler(inputCols=kept, outputCol=out).transform(coded)
        return coded.select(*[col(c) for c in df.columns if c not in self.columns], out)


def fit_sparse(df: DataFrame, cols: list[str]) -> SparseOneHot:
    """Learn the vocabulary of ``cols``: distinct values, sorted within their column."""
    items = [F.struct(F.lit(i).alias("column"), col(c).cast("string").alias("value")) for i, c in enumerate(cols)]
    counts = df.select(F.explode(F.array(*items)).alias("x")).select("x.*").where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
    by = ["column", "value"]
    placed = counts.repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.monotonically_increasing_id().alias("m"))
    placed = write_stage(placed.select(*by, "n", F.shiftright("m", 33).alias("part"), "m"), "values")
    # one row per range and column
    heads = placed.groupBy("part", "column").agg(F.min("m").alias("first"), F.count("*").alias("many"), F.sum("n").alias("rows"))
    total = heads.groupBy("column").agg(F.sum("rows").alias("total"), F.sum("many").alias("distinct"))
    heads = heads.withColumn("before", F.sum("many").over(W.partitionBy("column").orderBy("part")) - F.col("many")).drop("many", "rows")
    ranked = placed.join(F.broadcast(heads), ["part", "column"]).join(F.broadcast(total.drop("distinct")), "column")
    ranked = ranked.withColumn("slot", (F.col("before") + F.col("m") - F.col("first") - 1).cast("int"))
    table = write_stage(ranked.where("slot >= 0").select("column", "value", "slot", (F.col("n") * FREQUENT >= F.col("total")).alias("frequent")), "vocabulary")
    distinct = {r["column"]: r["distinct"] for r in total.collect()}
    return SparseOneHot(list(cols), [max(0, distinct.get(i, 0) - 1) for i in range(len(cols))], table)
