"""Hard negatives by slot-decomposed selection.

An anchor's positives are its best rows of the same label. Each positive asks for
the best rows of other labels whose score lies in a window below its own; the
windows overlap. Their upper limits, in descending order, split the scores into
disjoint slots, and ``TOP`` rows kept per slot answer every window: its rows are
the first ones of its own slot and all lower slots, in descending order, down to
its lower limit.

Anchors meet all rows in tiles: a block of rows times a block of anchors, dealt by
hash, so neither a hot label nor repeated vectors make a large group and nothing
passes through the driver. A tile (numpy) is a combiner: it answers with the first
rows of each (anchor, slot), never with scores of pairs. Spark merges those by a
ranked window and reads the suffixes off arrays of at most positives x top entries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dsengine.llm.common import staged

#: Most rows and anchors of a tile; least rows of one, so that small tables still spread.
BLOCK, LEAST = 1 << 17, 1 << 10
#: Rows and anchors that are scored at once inside a tile.
ROWS, ANCHORS = 1 << 14, 1 << 7
NONE = np.iinfo(np.int64).min
BEST = "anchor long, mark long, slot int, id long, score long"
EMPTY = pa.schema([("anchor", pa.int64()), ("mark", pa.int64()), ("slot", pa.int32()), ("id", pa.int64()), ("score", pa.int64())]).empty_table()


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _scores(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Exact integer inner products; ``most`` bounds their size."""
    if most < 2 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2 ** 63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)  # raises where a score has no 64 bits


def _limits(p: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """floor or ceiling of percent/100 of p, without overflow."""
    if up:
        return -_limits(-p, percent, False)
    return percent * (p // 100) + percent * (p % 100) // 100


class _Top:
    """The ``k`` largest scores of every anchor so far, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, s: np.ndarray, ok: np.ndarray, ids: np.ndarray) -> None:
        n, k = self.score.shape
        ok &= s >= self.score[:, -1:]
        if s.shape[1] > k and np.count_nonzero(ok) > 8 * k * n:
            ok &= s >= np.partition(np.where(ok, s, NONE), -k, axis=1)[:, -k, None]
        a, r = np.nonzero(ok)
        if not len(a):
            return
        have = self.score > NONE
        a2 = np.nonzero(have)[0]
        a, score, ident = np.concatenate([a, a2]), np.concatenate([s[a, r], self.score[have]]), np.concatenate([ids[r], self.id[have]])
        order = np.lexsort((ident, -score, a))
        a, score, ident = a[order], score[order], ident[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        keep = rank < k
        self.score[a[keep], rank[keep]], self.id[a[keep], rank[keep]] = score[keep], ident[keep]

    def rows(self, anchors, marks, slot):
        a, k = np.nonzero(self.score > NONE)
        return anchors[a], marks[a], np.full(len(a), slot, np.int32), self.id[a, k], self.score[a, k]


def _tile(k: int, slots: int, low: int, high: int):
    """Scores a tile; with no slots the best rows of the anchor's label, else the
    best rows of other labels per slot of the anchor's positives."""
    def run(key, rows, anchors):
        out = []
        if not rows.num_rows or not anchors.num_rows:  # a missing side has no columns
            return EMPTY
        b, ids, marks, labels = _matrix(rows["q"]), rows["id"].to_numpy(), rows["mark"].to_numpy(), rows["label"].to_numpy()
        q, own, omark, olabel = _matrix(anchors["own_q"]), anchors["own_id"].to_numpy(), anchors["own_mark"].to_numpy(), anchors["own_label"].to_numpy()
        most = float(b.shape[1]) * max(1.0, float(np.abs(b.astype(np.float64)).max(initial=0))) * max(1.0, float(np.abs(q.astype(np.float64)).max(initial=0)))
        for lo in range(0, len(q), ANCHORS):
            part = slice(lo, lo + ANCHORS)
            n = len(own[part])
            tops = [_Top(n, k) for _ in range(max(slots, 1))]
            if slots:
                p = np.full((n, slots + 1), NONE)
                for i, x in enumerate(anchors["own_scores"].slice(lo, ANCHORS).to_pylist()):
                    p[i, :len(x)] = x
                there = p > NONE
                least, upper = _limits(np.where(there, p, 0), low, True), _limits(np.where(there, p, 0), high, False)
                upper[~there] = NONE
            for at in range(0, len(b), ROWS):
                some = slice(at, at + ROWS)
                s = _scores(q[part], b[some], most)
                same = olabel[part, None] == labels[None, some]
                if not slots:
                    other = (own[part, None] != ids[None, some]) | (omark[part, None] != marks[None, some])
                    tops[0].add(s, same & other, ids[some])
                for j in range(slots):
                    if there[:, j].any():
                        tops[j].add(s, ~same & there[:, j, None] & (s <= upper[:, j, None]) & (s > upper[:, j + 1, None]) & (s >= least[:, j, None]), ids[some])
            out += [top.rows(own[part], omark[part], j) for j, top in enumerate(tops)]
        return pa.table([pa.array(np.concatenate([x[i] for x in out])) for i in range(5)], schema=EMPTY.schema)

    return run


def _met(rows: DataFrame, anchors: DataFrame, n: int, n_anchors: int, run) -> DataFrame:
    """All rows against all anchors, tile by tile."""
    r = -(-n // max(LEAST, min(BLOCK, n // 64)))
    a = -(-n_anchors // BLOCK)
    left = rows.select("*", F.pmod(F.xxhash64("id", "mark"), F.lit(r)).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(a - 1).cast("long"))).alias("j"))
    right = anchors.select(*[F.col(c).alias(f"own_{c}") for c in anchors.columns], F.pmod(F.xxhash64("id", "mark"), F.lit(a)).alias("j"),
                           F.explode(F.sequence(F.lit(0).cast("long"), F.lit(r - 1).cast("long"))).alias("i")).withColumnRenamed("own_dim", "dim")
    by = ["dim", "i", "j"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, BEST)


def hard_negatives(rows: DataFrame, label: Column, q: Column, anchor: Column, positives: int = 5, top: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for
    every row of ``rows`` (vec_id) where ``anchor`` holds; ``q`` is an array of whole
    numbers (any numeric type), a score the inner product.

    Rows without vec_id, label or q, or whose q is empty, holds null or is not
    finite, take no part. Rows equal in vec_id, label and q count once; rows that
    share a vec_id and differ are rows of their own. Only vectors of equal length
    meet. Scores that do not fit 64 bits raise an error. Ties go to the smaller
    vec_id. Other columns are not read."""
    q = q.cast("array<double>")
    good = (F.size(q) > 0) & ~F.exists(q, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    src = rows.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), q.alias("q"), anchor.alias("anchor"), F.coalesce(good, F.lit(False)).alias("good"))
    src = src.where(F.col("good") & F.col("id").isNotNull() & F.col("label").isNotNull()).drop("good")
    most = src.agg(F.max(F.array_max(F.transform("q", lambda x: F.abs(x))))).first()[0] or 0.0
    if most >= 2 ** 63:
        raise OverflowError("a component does not fit 64 bits")
    kind = "smallint" if most < 2 ** 15 else "int" if most < 2 ** 31 else "bigint"
    src = src.withColumn("q", F.col("q").cast(f"array<{kind}>"))
    src = src.groupBy("id", "label", "q").agg(F.max("anchor").alias("anchor")).withColumns({"mark": F.xxhash64("label", "q"), "dim": F.size("q")})
    src = staged(src, "negatives")
    size = src.agg(F.count("*").alias("n"), F.count_if("anchor").alias("a")).first()
    n, a = size["n"], size["a"]
    columns = ["dim", "id", "mark", "label", "q"]
    every, own = src.select(*columns), src.where("anchor").select(*columns)
    if not a:
        return src.where("false").select(F.col("id").alias("anchor_id"), F.col("id").alias("positive_id"), F.lit(0).alias("rank"), F.col("id").alias("negative_id"),
                                         F.col("id").alias("positive_score"), F.col("id").alias("negative_score"))
    best = [F.col("score").desc(), "id"]
    near = _met(every, own, n, a, _tile(positives, 0, low, high))
    near = near.withColumn("place", F.row_number().over(W.partitionBy("anchor", "mark").orderBy(*best)) - 1).where(F.col("place") < positives)
    near = staged(near.groupBy("anchor", "mark").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("near")), "positives")
    asked = own.join(near.select(F.col("anchor").alias("id"), "mark", F.transform("near", lambda x: x.score).alias("scores")), ["id", "mark"])
    far = _met(every, asked.select(*columns, "scores"), n, a, _tile(top, positives, low, high))
    far = far.withColumn("place", F.row_number().over(W.partitionBy("anchor", "mark", "slot").orderBy(*best))).where(F.col("place") <= top)
    far = far.groupBy("anchor", "mark").agg(F.array_sort(F.collect_list(F.struct("slot", "place", "id", "score"))).alias("far"))
    pairs = near.join(far, ["anchor", "mark"]).select("anchor", "far", F.explode("near").alias("p"))
    window = F.filter("far", lambda x: (x.slot >= F.col("p.place")) & (x.score * F.lit(100).cast("decimal(20,0)") >= F.col("p.score") * F.lit(low).cast("decimal(20,0)")))
    found = pairs.select("anchor", "p", F.posexplode(F.slice(window, 1, top)).alias("at", "x"))
    return found.select(F.col("anchor").alias("anchor_id"), F.col("p.id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"),
                        F.col("x.id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("x.score").alias("negative_score"))
