"""Reproducible shuffle into shards by a Feistel permutation [native].

Documents get global row numbers in the order of doc_id; a keyed permutation
of 0..n-1 maps the number to a place, place modulo shards is the shard and
place div shards the slot. So shard and slot of any row can be computed from
its number alone, and shard sizes differ by one at most.

Row numbers come from a range-partitioned sort of small rows (no text): rows
are numbered inside their partition, and a table of one row per partition
gives the offsets. Rows that agree in id and text are numbered as one run, so
a document that fills a third of the table is one row here.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dsengine.llm.common import number_rows

ROUNDS = 6
WALK = 64


def feistel(x: Column, n: int, seed: int, rounds: int = ROUNDS) -> Column:
    """A permutation of the ``a * b`` >= n cells of a grid: halves l and r take
    turns to be shifted by a hash of the other."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    wide, high = F.lit(b).cast("long"), F.lit(a).cast("long")

    def turn(acc, i):
        left = F.pmod(i, F.lit(2)) == 0
        drawn = F.xxhash64(F.when(left, acc.r).otherwise(acc.l), i, F.lit(seed))
        return F.struct(F.when(left, F.pmod(acc.l + F.pmod(drawn, high), high)).otherwise(acc.l).alias("l"),
                        F.when(left, acc.r).otherwise(F.pmod(acc.r + F.pmod(drawn, wide), wide)).alias("r"))

    start = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, wide).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, turn, lambda acc: acc.l * wide + acc.r)


def permuted(number: Column, n: int, seed: int) -> Column:
    """Place of a row number in 0..n-1: the grid has fewer than sqrt(n) + 1
    cells beyond n, and a place out there walks on along its cycle."""
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), feistel(number, n, seed),
                         lambda acc, _: F.when(acc < n, acc).otherwise(feistel(acc, n, seed)))
    return F.transform(F.array(walked), lambda p: F.when(p < n, p).otherwise(F.raise_error(F.lit("the cycle walk did not end"))))[0].cast("long")


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 20240229) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot,
    grown_shard, row_number.

    Law ``rows``: shard sizes differ by one at most. Order of row numbers: by
    doc_id (null first), then size, checksum and hash of the text; equal rows
    are interchangeable. Null text counts as empty. Other columns are not read;
    an empty table gives no rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                      F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"))
    n = docs.count()
    rows = number_rows(src, ["doc_id", "size", "text_crc32", "h"])
    place = rows.withColumn("place", permuted(F.col("row_number"), n, seed))
    return place.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
                        F.floor(F.col("place") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number")
