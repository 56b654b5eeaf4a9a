"""Moments of column pairs by partial Gram matrices.

Arrow batches give, by matrix products of the centred values and of their presence
masks, the count, means, second moments and co-moment of every asked pair over the
rows where both are present. A task merges its batches and answers with the cells in
stripes; partial stripes are added up in two levels, so no group grows with the number
of tasks beyond a 64th of them. One job over the table, and a plan whose size is that
of the columns, not of their pairs. Merging uses differences of means, so large values
with small spread do not cancel, and a constant column comes out as exactly constant
however the rows are dealt.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Planes of a cell: pairs present, means of a and b, second moments of a and b about
#: them, co-moment, and the second moments that a and b had inside their batches.
N, MEAN_A, MEAN_B, VAR_A, VAR_B, COV, RAW_A, RAW_B = range(8)
#: Cells of a stripe; first-level groups of a stripe.
STRIPE, FAN = 1024, 64


def merge(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Both sides' cells as one."""
    n = x[N] + y[N]
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.where(n > 0, y[N] / n, 0.0)
    both = x[N] * share
    da, db = y[MEAN_A] - x[MEAN_A], y[MEAN_B] - x[MEAN_B]
    da, db = np.where(both > 0, da, 0.0), np.where(both > 0, db, 0.0)
    out = np.empty_like(x)
    out[N] = n
    out[MEAN_A] = np.where(x[N] > 0, x[MEAN_A] + da * share, y[MEAN_A])
    out[MEAN_B] = np.where(x[N] > 0, x[MEAN_B] + db * share, y[MEAN_B])
    out[VAR_A], out[VAR_B] = x[VAR_A] + y[VAR_A] + da * da * both, x[VAR_B] + y[VAR_B] + db * db * both
    out[COV] = x[COV] + y[COV] + da * db * both
    out[RAW_A], out[RAW_B] = x[RAW_A] + y[RAW_A], x[RAW_B] + y[RAW_B]
    return out


def batch_cells(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cells of the pairs (a[i], b[i]) over the rows of ``x`` (NaN = missing)."""
    there = ~np.isnan(x)
    full = there.all()
    n = there.sum(0)
    some = np.maximum(n, 1)
    low, high = np.where(there, x, np.inf).min(0), np.where(there, x, -np.inf).max(0)
    filled = np.where(there, x, 0.0)
    centre = filled.sum(0) / some
    centre = np.where(n == 0, 0.0, np.where(low == high, low, np.clip(centre, low, high)))
    x = np.where(there, x - centre, 0.0)
    left, right = np.unique(a), np.unique(b)
    i, j = np.searchsorted(left, a), np.searchsorted(right, b)
    out = np.empty((8, len(a)))
    cross = x[:, left].T @ x[:, right]
    if full:
        sums, squares = x.sum(0), (x * x).sum(0)
        out[N], sa, sb, qa, qb = len(x), sums[a], sums[b], squares[a], squares[b]
    else:
        m = there.astype(np.float64)
        out[N] = (m[:, left].T @ m[:, right])[i, j]
        sa, sb = (x[:, left].T @ m[:, right])[i, j], (m[:, left].T @ x[:, right])[i, j]
        qa, qb = ((x * x)[:, left].T @ m[:, right])[i, j], (m[:, left].T @ (x * x)[:, right])[i, j]
    n = np.maximum(out[N], 1)
    out[MEAN_A], out[MEAN_B] = centre[a] + sa / n, centre[b] + sb / n
    out[VAR_A], out[VAR_B] = np.maximum(qa - sa * sa / n, 0), np.maximum(qb - sb * sb / n, 0)
    out[COV] = cross[i, j] - sa * sb / n
    out[RAW_A], out[RAW_B] = qa, qb
    out[:, out[N] == 0] = 0
    return out


def _table(stripe: list[int], cells: list[np.ndarray]) -> pa.Table:
    return pa.table([pa.array(stripe, pa.int32()), pa.array([c.ravel() for c in cells], pa.list_(pa.float64()))], names=["stripe", "cells"])


def _count(a: np.ndarray, b: np.ndarray):
    def run(batches):
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])
            with np.errstate(over="ignore", invalid="ignore"):
                cells = batch_cells(x, a, b)
                total = cells if total is None else merge(total, cells)
        if total is not None:
            starts = list(range(0, len(a), STRIPE))
            yield from _table([s // STRIPE for s in starts], [total[:, s:s + STRIPE] for s in starts]).to_batches()

    return run


def _add(key, rows):
    total = None
    with np.errstate(over="ignore", invalid="ignore"):
        for cells in rows["cells"].combine_chunks() if isinstance(rows["cells"], pa.ChunkedArray) else rows["cells"]:
            cells = cells.values.to_numpy(zero_copy_only=False).reshape(8, -1)
            total = cells if total is None else merge(total, cells)
    return _table([key[0].as_py()], [total])


def pair_moments(df: DataFrame, values: list[Column], pairs: list[tuple[int, int]]) -> np.ndarray:
    """Cells (8 x pairs) of the pairs of ``values`` (double columns, null = missing)."""
    a, b = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
    schema = "stripe int, cells array<double>"
    cells = df.select(*[v.cast("double").alias(f"v{i}") for i, v in enumerate(values)]).mapInArrow(_count(a, b), schema)
    some = cells.groupBy("stripe", F.pmod(F.spark_partition_id(), F.lit(FAN)).alias("fan")).applyInArrow(_add, schema)
    out = np.zeros((8, len(pairs)))
    for r in some.groupBy("stripe").applyInArrow(_add, schema).collect():
        part = np.array(r["cells"]).reshape(8, -1)
        out[:, r["stripe"] * STRIPE:r["stripe"] * STRIPE + part.shape[1]] = part
    return out


def correlations(df: DataFrame, values: list[Column], pairs: list[tuple[int, int]]) -> list[float | None]:
    """Pearson correlation of each pair over its complete rows; null where fewer than
    two rows are complete or a side does not vary over them."""
    if not pairs:
        return []
    c = pair_moments(df, values, pairs)
    with np.errstate(all="ignore"):
        # a side that is constant over the pair's rows leaves a rounding residue
        varies = [(v > 1e-12 * raw) & (v > c[N] * (1e-15 * m) ** 2) for v, raw, m in ((c[VAR_A], c[RAW_A], c[MEAN_A]), (c[VAR_B], c[RAW_B], c[MEAN_B]))]
        r = c[COV] / np.sqrt(c[VAR_A]) / np.sqrt(c[VAR_B])
    ok = varies[0] & varies[1] & (c[N] >= 2) & np.isfinite(r)
    return [float(min(1.0, max(-1.0, v))) if good else None for v, good in zip(r, ok)]
