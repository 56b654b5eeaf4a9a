"""Exact k nearest rows by metric partitions.

Train rows are assigned to the nearest of some pivots; each cell keeps its size and
radius. A test row first searches the cell of its own pivot. Its k-th distance there
bounds all others: a cell takes part only if neither its ball nor the plane between
the two pivots is farther away than that bound. Only rows whose bound crosses another
cell take a second pass, and only into those cells.

Cells are put together into blocks of bounded size (a crowded cell is cut into several),
so that a test row travels once a block, not once a cell; a block with many test rows is
searched by several tasks. Rows meet in cogroups; pivots, sizes and radii are the only
values on the driver, at most ``PIVOTS`` of them. With one cell there is one pass.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dsengine.functions.staging import drop_stage, write_stage

#: Most pivots, most values of all pivots, test rows of a task.
PIVOTS, PIVOT_VALUES, QUERIES = 4096, 1 << 21, 1 << 14
#: Most train rows of a block, and of a cell for each feature: every part of a block's
#: test rows meets the block's train rows, and every test row those of its cell.
BLOCK, CELL = 1 << 16, 1 << 10
#: Values that the exact distances of tied candidates are worked out from at once.
PAIRS = 1 << 19
#: Rounding that bounds allow for, relative to the size of the vectors.
SLACK = 1e-6
FOUND = "__qid long, __d double, __nid long, __ny double"
NOTHING = pa.schema([("__qid", pa.int64()), ("__d", pa.float64()), ("__nid", pa.int64()), ("__ny", pa.float64())]).empty_table()


def _matrix(column, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), d)


def _squares(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.maximum(np.sum(q * q, axis=1)[:, None] - 2.0 * (q @ x.T) + np.sum(x * x, axis=1)[None, :], 0.0)


def _keep(row, at, dist, ids, k):
    """The first k of every row in the order (distance, train id)."""
    order = np.lexsort((ids[at], dist, row))
    row, at, dist = row[order], at[order], dist[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    some = place < k
    return row[some], at[some], dist[some], place[some]


def _scan(q, last, x, ids, k, tile):
    """The first k rows of ``x`` for each of ``q`` within the squared distance ``last``:
    tiles of the expanded squared distance; every row within rounding of the k-th gets
    its exact distance, so however many rows tie, none is left out before."""
    qn, xn, d = np.sum(q * q, axis=1), np.sum(x * x, axis=1), x.shape[1]
    row, at, dist, last = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), last.copy()
    for lo in range(0, len(x), tile):
        norm = xn[lo:lo + tile]
        approx = norm[None, :] - 2.0 * (q @ x[lo:lo + tile].T)
        error = 16 * (d + 4) * np.finfo(float).eps * (qn + norm.max())
        limit = last - qn
        if len(norm) > k:
            limit = np.fmin(limit, np.partition(approx, k - 1, axis=1)[:, k - 1])
        r, c = np.nonzero(~(approx > (limit + 2 * error)[:, None]))
        exact, step = np.empty(len(r)), max(1, PAIRS // max(d, 1))
        for i in range(0, len(r), step):
            diff = q[r[i:i + step]] - x[c[i:i + step] + lo]
            exact[i:i + step] = np.einsum("ij,ij->i", diff, diff)
        row, at, dist, place = _keep(np.append(row, r), np.append(at, c + lo), np.append(dist, exact), ids, k)
        full = place == k - 1
        last[row[full]] = np.fmin(last[row[full]], dist[full])
    return row, at, dist


def _rows(pivots: int) -> int:
    """Rows whose distances to all pivots are held at once."""
    return max(16, (1 << 20) // pivots)


class Cells:
    """Pivots with the size and radius of their cells, and the blocks they are dealt in."""

    def __init__(self, pivots: np.ndarray, size: np.ndarray, radius: np.ndarray, k: int, block: int):
        self.origin = pivots.mean(0)
        self.at, self.size, self.radius, self.k = pivots - self.origin, size, radius, k
        self.norm = np.sqrt(np.sum(self.at * self.at, axis=1))
        heads = self.at[:max(1, int(size.sum() // block))]
        near = _squares(self.at, heads)
        order = np.lexsort((near.min(1), near.argmin(1)))
        self.parts, self.block, used, filled = np.ones(len(size), np.int64), np.zeros(len(size), np.int64), 0, 0
        for c in order:  # neighbouring cells share a block; a cell above it has several
            if size[c] > block:
                used += filled > 0
                self.parts[c], self.block[c], filled = -(-size[c] // block), used, 0
                used += self.parts[c]
                continue
            if filled + size[c] > block:
                used, filled = used + 1, 0
            self.block[c], filled = used, filled + size[c]

    def own(self, q: np.ndarray) -> np.ndarray:
        """The nearest cell that holds k rows, or any row if none holds k."""
        least = self.k if (self.size >= self.k).any() else 1
        return np.where(self.size[None] >= least, _squares(q - self.origin, self.at), np.inf).argmin(1)

    def crossed(self, q: np.ndarray, own: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Which other cells may hold a row within the squared distance ``bound``."""
        q = q - self.origin
        to = np.sqrt(_squares(q, self.at))
        scale = np.sqrt(np.sum(q * q, axis=1))[:, None] + (self.norm + self.radius)[None]
        apart = np.sqrt(_squares(self.at[own], self.at))
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (to * to - to[np.arange(len(q)), own][:, None] ** 2) / (2 * apart)
        plane[apart < 1e-3 * scale] = -np.inf
        far = np.maximum(to - self.radius[None], plane) > np.sqrt(bound)[:, None] + SLACK * scale
        far |= self.size[None] == 0
        far[np.arange(len(q)), own] = True
        return ~far


def _assign(pivots: np.ndarray, d: int):
    origin = pivots.mean(0)

    def run(batches):
        for batch in batches:
            x = _matrix(batch["__x"], d) - origin
            cell, step = np.zeros(len(x), np.int64), _rows(len(pivots))
            for lo in range(0, len(x), step):
                cell[lo:lo + step] = _squares(x[lo:lo + step], pivots - origin).argmin(1)
            diff = x - (pivots - origin)[cell]
            yield pa.RecordBatch.from_arrays([batch["__id"], batch["__x"], batch["__y"], pa.array(cell.astype(np.int32)), pa.array(np.sqrt(np.einsum("ij,ij->i", diff, diff)))],
                                             names=["__id", "__x", "__y", "cell", "far"])

    return run


def _start(cells: Cells, d: int):
    """Own cell of every test row, and the blocks that hold it."""
    def run(batches):
        for batch in batches:
            x, step = _matrix(batch["__x"], d), _rows(len(cells.size))
            own = np.concatenate([cells.own(x[lo:lo + step]) for lo in range(0, len(x), step)] or [np.zeros(0, np.int64)])
            blocks = [list(range(cells.block[c], cells.block[c] + cells.parts[c])) for c in own]
            yield pa.RecordBatch.from_arrays([batch["__qid"], batch["__x"], pa.array(own.astype(np.int32)), pa.array(np.full(len(own), np.inf)), pa.array(blocks, pa.list_(pa.int32()))],
                                             names=["__qid", "__x", "own", "bound", "blocks"])

    return run


def _cross(cells: Cells, d: int):
    """Blocks of the cells that a test row's bound crosses."""
    def run(batches):
        for batch in batches:
            x, own, bound = _matrix(batch["__x"], d), batch["own"].to_numpy(), batch["bound"].to_numpy()
            blocks: list[list[int]] = []
            for lo in range(0, len(x), _rows(len(cells.size))):
                part = slice(lo, lo + _rows(len(cells.size)))
                for row in cells.crossed(x[part], own[part], bound[part]):
                    blocks.append(sorted({b for c in np.flatnonzero(row) for b in range(cells.block[c], cells.block[c] + cells.parts[c])}))
            yield pa.RecordBatch.from_arrays([batch["__qid"], batch["__x"], batch["own"], batch["bound"], pa.array(blocks, pa.list_(pa.int32()))],
                                             names=["__qid", "__x", "own", "bound", "blocks"])

    return run


def _search(cells: Cells, first: bool, d: int, k: int, tile: tuple[int, int]):
    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        if not asked.num_rows or not rows.num_rows:  # a missing side has no columns
            return NOTHING
        q, qid, own, bound = _matrix(asked["__x"], d), asked["__qid"].to_numpy(), asked["own"].to_numpy(), asked["bound"].to_numpy()
        x, ids, y, cell = _matrix(rows["__x"], d), rows["__id"].to_numpy(), rows["__y"].to_numpy(), rows["cell"].to_numpy()
        order = np.argsort(cell, kind="stable")
        x, ids, y, cell = x[order], ids[order], y[order], cell[order]
        order = np.argsort(own, kind="stable")  # a tile of test rows needs few cells
        q, qid, own, bound = q[order], qid[order], own[order], bound[order]
        held, out = np.unique(cell), []
        for lo in range(0, len(q), tile[0]):
            part = slice(lo, lo + tile[0])
            p, last = q[part], bound[part].copy()
            needs = None if first else cells.crossed(p, own[part], last)
            row, at, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for c in np.intersect1d(held, own[part]) if first else held[needs[:, held].any(0)]:
                a, b = np.searchsorted(cell, [c, c + 1])
                who = np.flatnonzero(own[part] == c if first else needs[:, c])
                r, i, s = _scan(p[who], last[who], x[a:b], ids[a:b], k, tile[1])
                row, at, dist, place = _keep(np.append(row, who[r]), np.append(at, i + a), np.append(dist, s), ids, k)
                full = place == k - 1
                last[row[full]] = np.fmin(last[row[full]], dist[full])
            out.append((qid[part][row], dist, ids[at], y[at]))
        return pa.table([pa.array(np.concatenate([o[i] for o in out])) for i in range(4)], schema=NOTHING.schema)

    return run


def _met(asked: DataFrame, rows: DataFrame, run) -> DataFrame:
    """Test rows (block) against train rows (block); blocks with many test rows are
    searched in parts. There are at most PIVOTS + rows / block size of them."""
    many = asked.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("s")).where("s > 1")
    asked = asked.join(F.broadcast(many), "block", "left").withColumn("part", F.pmod(F.xxhash64("__qid"), F.coalesce("s", F.lit(1))))
    rows = rows.join(F.broadcast(many), "block", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("s", F.lit(1)).cast("long") - 1)))
    return _cogroup(asked.drop("s"), rows.drop("s"), ["block", "part"], run)


def _cogroup(asked: DataFrame, rows: DataFrame, by: list[str], run) -> DataFrame:
    return asked.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(run, FOUND)


def _first_k(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("__qid").orderBy("__d", "__nid")
    return found.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= k)


def nearest_rows(train: DataFrame, test: DataFrame, features: list[str], k: int, id_col: str, block_values: int, tile: tuple[int, int], n_train: int | None = None) -> DataFrame:
    """Exact k nearest train rows for every test row: (__qid, __d squared distance,
    __nid, __ny, __rank). Ties in distance go by train id: of equal train vectors only
    the k smallest ids can be chosen, so no others are kept. Test rows with one id are
    one query. ``block_values`` bounds the values (rows x features) of a block."""
    d = len(features)
    arr = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    q = test.select(F.col(id_col).cast("long").alias("__qid"), arr.alias("__x")).dropDuplicates(["__qid"])
    tr = train.select(F.col(id_col).cast("long").alias("__id"), arr.alias("__x"), F.col("label").cast("double").alias("__y"))
    copies = tr.withColumn("__copy", F.row_number().over(Window.partitionBy("__x").orderBy("__id", "__y")))
    tr = copies.where(F.col("__copy") <= k).drop("__copy")
    block = max(1, min(block_values // max(d, 1), BLOCK))
    n = train.count() if n_train is None else n_train
    m = 1 if n <= block // 8 else min(math.ceil(n / max(k, min(block // 8, CELL * d))), PIVOTS, max(1, PIVOT_VALUES // max(d, 1)))
    if m <= 1:
        one = Cells(np.zeros((1, d)), np.array([n]), np.array([np.inf]), k, max(n, 1))
        parts = max(1, math.ceil(test.count() / QUERIES))
        asked = q.select("*", F.lit(0).alias("own"), F.lit(float("inf")).alias("bound"), F.pmod(F.xxhash64("__qid"), F.lit(parts)).alias("part"))
        rows = tr.select("*", F.lit(0).alias("cell"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
        return _first_k(_cogroup(asked, rows, ["part"], _search(one, True, d, k, tile)), k)
    firsts = copies.where(F.col("__copy") == 1).select("__x", "__id")  # a second pivot in one place has an empty cell
    pivots = np.array([r["__x"] for r in firsts.orderBy(F.xxhash64("__x"), "__id").limit(m).collect()], np.float64)
    stage = write_stage(tr.mapInArrow(_assign(pivots, d), "__id long, __x array<double>, __y double, cell int, far double"), "knn-cells")
    size, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for r in stage.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("r")).collect():
        size[r["cell"]], radius[r["cell"]] = r["n"], r["r"]
    cells = Cells(pivots, size, radius, k, block)
    spark = train.sparkSession
    where = spark.createDataFrame([(c, int(cells.block[c]), int(cells.parts[c])) for c in range(len(size))], "cell int, base int, parts int")
    rows = stage.drop("far").join(F.broadcast(where), "cell").withColumn("block", (F.col("base") + F.pmod(F.xxhash64("__id"), F.col("parts"))).cast("int")).drop("base", "parts")
    kind = "__qid long, __x array<double>, own int, bound double, blocks array<int>"
    asked = write_stage(q.mapInArrow(_start(cells, d), kind), "knn-asked")
    near = write_stage(_first_k(_met(asked.withColumn("block", F.explode("blocks")).drop("blocks"), rows, _search(cells, True, d, k, tile)), k), "knn-near")
    kth = near.groupBy("__qid").agg(F.when(F.count("*") == k, F.max("__d")).otherwise(float("inf")).alias("kth"))
    again = asked.drop("bound", "blocks").join(kth, "__qid", "left").select("__qid", "__x", "own", F.coalesce("kth", F.lit(float("inf"))).alias("bound"))
    again = write_stage(again.mapInArrow(_cross(cells, d), kind).where(F.size("blocks") > 0), "knn-again")
    drop_stage(asked)
    far = _met(again.withColumn("block", F.explode("blocks")).drop("blocks"), rows, _search(cells, False, d, k, tile))
    out = _first_k(near.drop("__rank").union(far), k)
    return out
