"""Near-duplicate embeddings by collision counting on sorted projections.

Vectors are projected on many random lines. On each line a query's window holds
the vectors within ``REACH`` standard deviations of what two vectors at the
wanted cosine differ by; a pair that collides in enough windows is verified by
its cosine in double precision. The number of windows required is calibrated so
that a pair exactly at the threshold passes with probability 1 - ``MISS``.

Windows on one line alone hold a constant share of all vectors, so the search
is done in strips: every round cuts the space by the signs of fresh projections
into cells of about ``CELL`` vectors, sorts each cell along one line, and slides
the window there. The number of rounds follows from the cosine: all rounds miss
a pair at the threshold with probability ``MISS``. Equal vectors are one class.
Cells are cut by counted size into sides of at most ``SIDE`` vectors and dealt
as pairs of sides, so a crowd of near copies spreads over many tasks; each
answers with link counts and a star per local component, never with pairs.
A link found in several rounds is counted in the first.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dsengine.llm.common import id_of, key_of, staged
from dsengine.llm.components import components

LINES, REACH, MISS = 64, 2.5, 1e-4
CELL, SIDE = 256, 1024
FOUND = "node long, n long, root long"


def _plan(n: int, cosine: float) -> tuple[int, int, float, int]:
    """Sign projections a round, rounds, half window, windows required."""
    bits = max(0, round(math.log2(max(n, 1) / CELL))) if n > 2 * CELL else 0
    apart = math.sqrt(2 - 2 * cosine)
    inside = math.erf(REACH / math.sqrt(2))
    once = (1 - math.acos(cosine) / math.pi) ** bits * inside
    rounds = max(1, math.ceil(math.log(MISS) / math.log(1 - once))) if bits else math.ceil(math.log(MISS) / math.log(1 - inside))
    need, tail = 0, 0.0
    while True:
        tail += math.comb(LINES, need) * inside ** need * (1 - inside) ** (LINES - need)
        if tail > MISS:
            break
        need += 1
    return bits, rounds, REACH * apart, need


def _lines(dim: int, bits: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    lines = np.random.Generator(np.random.PCG64(1)).standard_normal((dim, LINES))
    signs = np.random.Generator(np.random.PCG64(2)).standard_normal((dim, rounds * bits)) if bits else np.zeros((dim, 0))
    return lines, signs


def _matrix(column, dim: int) -> np.ndarray:
    """Rows times the power of two that brings the largest component under 1:
    the cosine stays the same to the bit, and no product leaves the range."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(1, initial=0))[1][:, None])


def _cells(unit: np.ndarray, signs: np.ndarray, bits: int, rounds: int) -> np.ndarray:
    out = np.zeros((len(unit), rounds), np.int64)
    if bits:
        up = (unit @ signs > 0).reshape(len(unit), rounds, bits)
        out += (up * (1 << np.arange(bits, dtype=np.int64))).sum(2)
    return out


def _deal(dim: int, bits: int, rounds: int, count_only: bool):
    def run(batches):
        _, signs = _lines(dim, bits, rounds)
        for batch in batches:
            v = _matrix(batch["v"], dim)
            cells = _cells(v / np.linalg.norm(v, axis=1, keepdims=True), signs, bits, rounds)
            for r in range(rounds):
                number = pa.array(np.full(len(v), r, np.int32))
                if count_only:
                    cell, n = np.unique(cells[:, r], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"round": pa.array(np.full(len(cell), r, np.int32)), "cell": pa.array(cell), "c": pa.array(n.astype(np.int64))})
                else:
                    yield pa.RecordBatch.from_pydict({"round": number, "cell": pa.array(cells[:, r]), "node": batch["node"], "m": batch["m"], "v": batch["v"]})

    return run


def _search(dim: int, bits: int, rounds: int, half: float, need: int, cosine: float):
    def search(key, rows):
        rnd, across = key[0].as_py(), key[2].as_py() != key[3].as_py()
        lines, signs = _lines(dim, bits, rounds)
        v, node, m, side = _matrix(rows["v"], dim), rows["node"].to_numpy(), rows["m"].to_numpy(), rows["side"].to_numpy()
        norm = np.linalg.norm(v, axis=1)
        unit = v / norm[:, None]
        at = (unit @ lines).astype(np.float32)
        order = np.argsort(at[:, rnd % LINES], kind="stable")
        v, node, m, side, norm, unit, at = v[order], node[order], m[order], side[order], norm[order], unit[order], at[order]
        line = at[:, rnd % LINES]
        until = np.searchsorted(line, line + np.float32(half), "right")
        firsts, seconds = [], []
        for lo in range(0, len(v), 256):  # query-centred windows, a block of queries at a time
            hi = min(lo + 256, len(v))
            end = int(until[lo:hi].max())
            met = np.zeros((hi - lo, end - lo), np.uint8)
            for k in range(LINES):
                met += np.abs(at[lo:hi, k, None] - at[None, lo:end, k]) <= half
            ok = met >= need
            ok &= np.arange(lo, end)[None] > np.arange(lo, hi)[:, None]
            ok &= np.arange(lo, end)[None] < until[lo:hi, None]
            if across:
                ok &= side[lo:hi, None] != side[None, lo:end]
            a, b = np.nonzero(ok)
            if len(a):
                true = (v[lo:hi] @ v[lo:end].T)[a, b] / (norm[lo + a] * norm[lo + b]) >= cosine
                firsts.append(a[true] + lo)
                seconds.append(b[true] + lo)
        a = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
        b = np.concatenate(seconds) if seconds else np.zeros(0, np.int64)
        if rnd and len(a):
            cells = _cells(unit, signs, bits, rounds)
            fresh = np.ones(len(a), bool)
            for r in range(rnd):
                k = r % LINES
                fresh &= (cells[a, r] != cells[b, r]) | (np.abs(at[a, k] - at[b, k]) > half)
            a, b = a[fresh], b[fresh]
        n = np.bincount(a, m[b], len(v)).astype(np.int64) + np.bincount(b, m[a], len(v)).astype(np.int64)
        root = node.copy()
        while len(a):
            before = root.copy()
            np.minimum.at(root, a, root[b])
            np.minimum.at(root, b, root[a])
            if (root == before).all():
                break
        some = n > 0
        return pa.table([pa.array(node[some]), pa.array(n[some]), pa.array(root[some])], names=["node", "n", "root"])

    return search


def near_vectors(embeddings: DataFrame, cosine: float = 0.95, vector: str = "embedding") -> DataFrame:
    """One row per input row: vec_id, n_links (other rows linked directly),
    component_id (smallest vec_id reachable, itself included), kept.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing; finite ones of any magnitude are compared. Vectors of
    different length are never compared. Repeated rows are vectors of their own
    and link with each other; rows that share a vec_id and differ in the vector
    have each their own links and component. A row with a null
    vec_id takes part; its component_id is the smallest id there is, or null.
    Other columns are not read."""
    v = F.col(f"`{vector}`").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x != 0)
    key = key_of(F.col("vec_id"), F.col(f"`{vector}`").cast("string"))
    src = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), key.alias("key"), v.alias("v"), F.coalesce(~bad, F.lit(False)).alias("good"))
    src = src.select("vec_id", "key", "good", F.when(F.col("good"), F.col("v")).alias("v")).withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(1), "v")})
    good = src.where("good")
    classes = good.groupBy("h", "g").agg(F.min("key").alias("key"), F.count("*").alias("m"), F.min("v").alias("v"))
    # a class is a node of its own: classes may share their smallest id
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    links = []
    for row in classes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").collect():
        links.append(_linked(classes.where(F.size("v") == row["dim"]), row["dim"], row["n"], cosine))
    named = classes.select("h", "g", "m", F.lit(0).cast("long").alias("n"), F.col("key").alias("root"))
    if links:
        found = links[0]
        for more in links[1:]:
            found = found.union(more)
        found = staged(found, "found")
        total = found.groupBy("node").agg(F.sum("n").alias("n"))
        comp = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
        comp = staged(comp.join(classes.select("node", "key"), "node"), "components")
        least = comp.groupBy("root").agg(F.min("key").alias("least"))
        comp = comp.join(least, "root").select("node", "least")
        named = classes.join(total, "node", "left").join(comp, "node", "left").select("h", "g", "m", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("least", "key").alias("root"))
    linked = good.join(named, ["h", "g"]).select("vec_id", (F.col("n") + F.col("m") - 1).alias("n_links"), id_of(F.col("root")).alias("component_id"), (F.col("key") == F.col("root")).alias("kept"))
    return linked.union(src.where(~F.col("good")).select("vec_id", F.lit(0).cast("long"), F.col("vec_id"), F.lit(True)))


def _linked(classes: DataFrame, dim: int, n: int, cosine: float) -> DataFrame:
    bits, rounds, half, need = _plan(n, cosine)
    src = classes.select("node", "m", "v")
    sizes = src.mapInArrow(_deal(dim, bits, rounds, True), "round int, cell long, c long").groupBy("round", "cell").agg(F.sum("c").alias("c"))
    big = sizes.where(F.col("c") > SIDE).select("round", "cell", F.ceil(F.col("c") / SIDE).cast("int").alias("s"))
    dealt = src.mapInArrow(_deal(dim, bits, rounds, False), "round int, cell long, node long, m long, v array<double>")
    dealt = dealt.join(big, ["round", "cell"], "left").withColumn("s", F.coalesce("s", F.lit(1)))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("node"), "s").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    dealt = dealt.select("round", "cell", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", "m", "v")
    return dealt.groupBy("round", "cell", "i", "j").applyInArrow(_search(dim, bits, rounds, half, need, cosine), FOUND)
