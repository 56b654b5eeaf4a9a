"""Metric partitions: pruning, blocks and exactness."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dsengine.operators import neighbours as N


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), float(i % 4), *[float(v) for v in row]) for i, row in zip(ids, x)], "id long, label double, " + ", ".join(f"f{j} double" for j in range(x.shape[1])))


def brute(x, ids, q, k):
    out = {}
    for i, p in enumerate(q):
        d = np.einsum("ij,ij->i", x - p, x - p)
        out[i] = [(ids[j], d[j]) for j in np.lexsort((ids, d))[:k]]
    return out


def ours(train, test, d, k, block, tile=(256, 8192)):
    got = {}
    for r in N.nearest_rows(train, test, [f"f{j}" for j in range(d)], k, "id", block, tile).orderBy("__qid", "__rank").collect():
        got.setdefault(r["__qid"], []).append((r["__nid"], r["__d"]))
    return got


@pytest.mark.parametrize("kind", ["clusters", "line", "far", "high", "crowd"])
def test_equal_to_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(N, "QUERIES", 37)
    r = np.random.Generator(np.random.PCG64(3))
    d = {"line": 1, "high": 24}.get(kind, 3)
    x = r.standard_normal((700, d))
    if kind == "clusters":
        x = x * 0.02 + r.integers(0, 4, (700, d)) * 5.0
    if kind == "far":
        x = x + 1.7e9
    if kind == "crowd":  # a third of the rows at one place, more in its cell than a block holds
        x[:240] = np.round(x[:240] * 0.01, 3)
        x[240:300] = x[0]
    q = np.vstack([x[::9] + r.standard_normal(x[::9].shape) * 0.01, x[5:8], x.max(0) * 30 + np.zeros((2, d)), x.mean(0)[None]])
    ids = r.permutation(700) + 5
    got = ours(frame(spark, x, ids).repartition(5), frame(spark, q).repartition(3), d, 5, 64 * d, (11, 17))
    want = brute(x, ids, q, 5)
    assert got.keys() == want.keys()
    for i in want:
        assert [j for j, _ in got[i]] == [j for j, _ in want[i]]
        assert np.allclose([v for _, v in got[i]], [v for _, v in want[i]], rtol=1e-12)


def test_fewer_rows_than_k_and_none(spark):
    x = np.arange(6.0).reshape(3, 2)
    assert {i: [j for j, _ in v] for i, v in ours(frame(spark, x), frame(spark, x[:2]), 2, 5, 1 << 20).items()} == {0: [0, 1, 2], 1: [1, 0, 2]}
    assert ours(frame(spark, x).where("false"), frame(spark, x), 2, 5, 1 << 20) == {}
    assert ours(frame(spark, x), frame(spark, x).where("false"), 2, 2, 4) == {}


def test_repeated_test_ids_are_one_query(spark):
    x = np.arange(40.0).reshape(20, 2)
    test = frame(spark, x[:3]).union(frame(spark, x[:3]))
    assert len(ours(frame(spark, x), test, 2, 2, 8)) == 3


def test_few_cells_are_crossed(spark):
    """20,000 train and 4,000 test rows in the plane: with 200 cells a test row travels
    to under a twentieth of them."""
    r = np.random.Generator(np.random.PCG64(4))
    x, q = r.random((20_000, 2)), r.random((4_000, 2))
    pivots = x[r.permutation(20_000)[:200]]
    cell = N._squares(x, pivots).argmin(1)
    far = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
    size, radius = np.bincount(cell, minlength=200), np.zeros(200)
    np.maximum.at(radius, cell, far)
    cells = N.Cells(pivots, size, radius, 5, 500)
    own = cells.own(q)
    bound = np.array([np.sort(((x[cell == c] - p) ** 2).sum(1))[4] for p, c in zip(q, own)])
    visits = np.concatenate([cells.crossed(q[i:i + 500], own[i:i + 500], bound[i:i + 500]).sum(1) for i in range(0, 4000, 500)])
    assert visits.sum() + 4000 < 4000 * 200 / 20
    filled = np.bincount(cells.block[cells.parts == 1], size[cells.parts == 1])
    assert filled.max() <= 500 and (size[cells.parts > 1] > 500).all()


def test_nothing_of_the_tables_reaches_the_driver(spark):
    x = frame(spark, np.random.Generator(np.random.PCG64(5)).random((300, 2)))
    plan = N.nearest_rows(x, x, ["f0", "f1"], 3, "id", 60, (256, 8192))._jdf.queryExecution().toString()
    assert "CoGroup" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_cells_stay_small_with_few_features(spark, monkeypatch):
    """A test row meets the rows of a small cell, not most of the table."""
    sizes = []

    class Seen(N.Cells):
        def __init__(self, pivots, size, *rest):
            sizes.append(size)
            super().__init__(pivots, size, *rest)
            assert max(self.size.sum() // max(1, len(np.unique(self.block))), 1) <= N.BLOCK

    monkeypatch.setattr(N, "Cells", Seen)
    x = np.random.default_rng(4).integers(0, 10_000_000, (20_000, 1)).astype(float)
    asked = x[::100] + 0.25
    got = ours(frame(spark, x), frame(spark, asked), 1, 5, 5_000_000)
    assert len(sizes[0]) > 1 and sizes[0].max() <= 16 * N.CELL
    want = brute(x, np.arange(len(x)), asked, 5)
    assert {q: [n for n, _ in v] for q, v in got.items()} == {q: [n for n, _ in v] for q, v in want.items()}


def test_tied_candidates_are_measured_in_small_parts():
    import tracemalloc
    x, q = np.ones((8192, 256)), np.zeros((4, 256))
    tracemalloc.start()
    row, at, dist = N._scan(q, np.full(4, np.inf), x, np.arange(8192), 5, 8192)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 << 20
    assert at.tolist() == [0, 1, 2, 3, 4] * 4 and set(dist) == {256.0}
