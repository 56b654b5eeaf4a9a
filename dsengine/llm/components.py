"""Connected components of a link table by alternating large and small stars.

Every round is two joins and two aggregates over the links and is written to
the shared folder; links of one node are never gathered in one place. Rounds
grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dsengine.llm.common import release, staged


def _mark(links: DataFrame):
    return links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a long, b long): root is the
    smallest node reachable. Self links and repeated links are allowed."""
    now = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    own = now.where("a = b").select(F.col("a").alias("node"))
    start, now = now, now.where("a <> b")
    mark, old = None, None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        done = staged(small.select("x.a", "x.b").where("a <> b").distinct(), "stars")
        if old is not None:
            release(old)
        now, old, before, mark = done, done, mark, _mark(done)
        if mark == before or not mark[0]:
            break
    own = own.union(now.select("b")).distinct().join(now.select(F.col("a").alias("node")), "node", "left_anti")
    own._stage_path = getattr(start, "_stage_path", None)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(own.select("node", F.col("node").alias("root")))
