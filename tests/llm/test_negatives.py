"""Hard negatives against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from dsengine.llm import negatives
from dsengine.llm.negatives import hard_negatives

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, every=100, positives=5, top=10):
    rows = [r for r in dict.fromkeys((i, k, tuple(q)) for i, k, q in rows if i is not None and k is not None and q and None not in q and all(abs(x) < float("inf") for x in q))]
    out = []
    for a in rows:
        if a[0] % every:
            continue
        met = sorted((-sum(int(x) * int(y) for x, y in zip(a[2], r[2])), r[0], r[1] == a[1]) for r in rows if r != a and len(r[2]) == len(a[2]))
        for s, i, _ in [m for m in met if m[2]][:positives]:
            fit = [m for m in met if not m[2] and 30 * -s <= 100 * -m[0] <= 90 * -s][:top]
            out += [(a[0], i, k + 1, m[1], -s, -m[0]) for k, m in enumerate(fit)]
    return sorted(out)


def ours(df, **more):
    found = hard_negatives(df, F.col("label"), F.col("q"), F.col("vec_id") % 100 == 0, **more)
    assert found.columns == COLUMNS
    return sorted(tuple(r) for r in found.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, label int, q array<double>, slot string, id int").repartition(5)


@pytest.mark.parametrize("seed,reach", [(1, 3), (2, 40), (3, 1 << 29), (4, 1 << 20)])
def test_equal_to_all_pairs(spark, monkeypatch, seed, reach):
    """Small values tie often; large ones need whole numbers beyond doubles. Tiny
    tiles and chunks exercise the merging."""
    monkeypatch.setattr(negatives, "BLOCK", 64)
    monkeypatch.setattr(negatives, "LEAST", 16)
    monkeypatch.setattr(negatives, "ROWS", 7)
    monkeypatch.setattr(negatives, "ANCHORS", 2)
    r = random.Random(seed)
    ids = r.sample(range(0, 1200, 4), 200)
    rows = [(i, r.randint(0, 2), [float(r.randint(-reach // 4, reach)) for _ in range(6)]) for i in ids]
    rows += [(300 + k, 1, rows[0][2]) for k in range(1, 30)]
    want = brute(rows)
    assert len(want) > 20
    assert ours(frame(spark, rows)) == want


def test_rows_of_any_kind(spark):
    r = random.Random(9)
    rows = [(i, i % 3, [float(r.randint(-2, 9)) for _ in range(4)]) for i in range(0, 400, 5)]
    rows += rows[:7]  # repeated rows count once
    rows += [(None, 1, [1.0] * 4), (500, None, [1.0] * 4), (600, 1, None), (700, 1, []), (800, 1, [1.0, None, 1.0, 1.0]), (900, 1, [float("nan")] * 4), (1000, 1, [float("inf")] + [1.0] * 3),
             (1100, 1, [3.0, 4.0]), (1101, 1, [3.0, 4.0]), (1103, 2, [2.0, 2.0]), (-100, 1, [1.0] * 4)]
    assert ours(frame(spark, rows)) == brute(rows)
    assert ours(frame(spark, rows).where("vec_id % 100 > 0")) == [] and ours(frame(spark, rows).where("false")) == []
    assert ours(frame(spark, rows[:80]).where("label = 1")) == []  # nothing of another label


def test_scores_beyond_64_bits_are_an_error(spark):
    with pytest.raises(OverflowError):
        ours(frame(spark, [(0, 1, [1e300]), (1, 1, [1.0])]))


def test_key_equals_all_pairs(spark, sf):
    from dsengine.llm.queries import QUERIES
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], [float(256 * x // 1) for x in r["embedding"]]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in QUERIES["op13_hard_negatives"](spark, sf).collect()) == brute(rows)
