"""Neighbours at one distance are taken by train id, however many there are."""

import itertools
import random

import pytest

from dsengine.operators import models as MD


@pytest.mark.parametrize("cells", [5_000_000, 90])
@pytest.mark.parametrize("tile", [(256, 8192), (7, 11)])
def test_knn_ties_go_by_train_id(spark, monkeypatch, cells, tile):
    monkeypatch.setattr(MD, "KNN_TILE", tile)
    r = random.Random(2)
    corners = [tuple(s * x for s, x in zip(signs, p)) for p in itertools.permutations((1.0, 2.0, 3.0)) for signs in itertools.product((1, -1), repeat=3)]
    points = corners + [(4.0, 4.0, 4.0)] * 70 + [(0.0, 9.0, 0.0)] * 3
    ids = r.sample(range(1000), len(points))
    train = spark.createDataFrame([(i, float(i % 3), *p) for i, p in zip(ids, points)], "id long, label double, a double, b double, c double")
    asked = [(0.0, 0.0, 0.0), (4.0, 4.0, 4.0), (5.0, 4.0, 4.5), (0.0, 8.0, 0.0), (2.0, 2.0, 2.0)]
    test = spark.createDataFrame([(i, *p) for i, p in enumerate(asked)], "id long, a double, b double, c double")
    got = {}
    for x in sorted(MD.knn_neighbours(train, test, ["a", "b", "c"], 5, "id", chunk_cells=cells).collect(), key=lambda x: x["__rank"]):
        got.setdefault(x["__qid"], []).append(x["__nid"])
    for i, q in enumerate(asked):
        near = sorted((sum((u - v) ** 2 for u, v in zip(p, q)), j) for j, p in zip(ids, points))
        assert got[i] == [j for _, j in near[:5]]
