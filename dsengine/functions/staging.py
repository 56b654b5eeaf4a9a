"""Staging for operators that read their input several times.

``multi_pass(df, cols)`` prunes to the columns the operator needs, spreads an
under-partitioned input (fewer partitions than the default parallelism,
e.g. one large row group) over all cores with one round-robin shuffle, and
persists it (memory, spilling to disk) for the operator's passes; it is
unpersisted when the block ends. Inputs that already have enough splits -
the normal case on a cluster - are not shuffled. Cached blocks lost with an
executor are recomputed from the lineage.
"""

from __future__ import annotations

import math
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from dsengine.functions.exprs import col
from dsengine.session import work_path

#: about one split of a columnar scan
SPLIT_BYTES = 128 << 20
#: input a core may keep for the passes of one operator
PERSIST_BYTES = 1 << 30
#: rows that a task holds in memory for the rounds of a fit
TASK_BYTES = 32 << 20


def plan_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of a table's size; nothing is run for it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """Spread an input of few files and few splits over all cores. Judged from
    the plan's size and files alone: nothing is run for it."""
    spark = df.sparkSession
    target = spark.sparkContext.defaultParallelism
    if plan_bytes(df) >= target * SPLIT_BYTES or len(df.inputFiles()) >= target:
        return df
    return df.repartition(target)


def spread_rows(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` in tasks of bounded size when it is to be held in memory at ``row_bytes``
    a row: columnar files may be far smaller than their rows, so splits by file size say
    nothing of them. A table of one task's size, or in enough tasks, is left as it is."""
    size = rows * row_bytes
    if size <= TASK_BYTES:
        return df
    parts = max(math.ceil(size / TASK_BYTES), df.sparkSession.sparkContext.defaultParallelism)
    return df if df.rdd.getNumPartitions() >= parts else df.repartition(parts)


def is_kept(df: DataFrame) -> bool:
    """Whether ``df`` is to be read as it is by an operator of several passes: its
    caller has cached it, or it is more than the cores hold and reading it again is
    cheaper than spilling it."""
    cached = df.storageLevel != StorageLevel(False, False, False, False, 1)
    return cached or plan_bytes(df) > PERSIST_BYTES * df.sparkSession.sparkContext.defaultParallelism


@contextmanager
def multi_pass(df: DataFrame, cols: list[str] | None = None, enabled: bool = True):
    if not enabled:
        yield df
        return
    if df.storageLevel != StorageLevel(False, False, False, False, 1):
        # already cached by the caller: read it as is
        yield df.select(*[col(c) for c in cols]) if cols is not None else df
        return
    src = df.select(*[col(c) for c in cols]) if cols is not None else df
    if plan_bytes(src) > PERSIST_BYTES * df.sparkSession.sparkContext.defaultParallelism:
        # more than the cores hold: reading it again is cheaper than spilling it
        yield src
        return
    staged = spread(src).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield staged
    finally:
        staged.unpersist()


def write_stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written under the shared checkpoint folder and read again: what follows
    neither recomputes it nor loses it with an executor."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def drop_stage(df: DataFrame) -> None:
    """Delete a written stage that nothing reads any more."""
    path = getattr(df, "_stage_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        there = sc._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(sc._jsc.hadoopConfiguration()).delete(there, True)
