"""Optimal length buckets and token-budget batches.

The global histogram of encoded lengths goes into a dynamic program that puts
the upper bounds of the buckets where the total padding is least. Texts longer
than ``max_length`` are cut into pieces of that length, so the histogram has at
most ``max_length`` rows and the program a fixed size. Inside each bucket pieces
are numbered in a reproducible random order and every batch takes as many as
its token budget holds at the bucket's bound.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dsengine.llm.common import number_rows, staged
from dsengine.llm.tokens import token_lengths

MAX_LENGTH, BUCKETS, BUDGET = 8192, 16, 65536


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` ranges of the sorted ``lengths`` that
    minimise the padding sum(bound - length). The best split of a longer prefix
    never lies further left, so each layer is filled by halving."""
    n = len(lengths)
    if n <= buckets:
        return [int(x) for x in lengths]
    docs, tokens = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(counts * lengths))

    def cost(i: np.ndarray, j: int) -> np.ndarray:  # lengths[i:j] padded to lengths[j - 1]
        return lengths[j - 1] * (docs[j] - docs[i]) - (tokens[j] - tokens[i])

    best = np.array([0, *(int(cost(np.array([0]), j)[0]) for j in range(1, n + 1))], dtype=np.int64)
    cuts = []
    for layer in range(2, buckets + 1):
        now, cut = np.full(n + 1, np.iinfo(np.int64).max // 4), np.zeros(n + 1, np.int64)
        todo = [(layer, n, layer - 1, n - 1)]
        while todo:
            lo, hi, left, right = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(left, min(right, j - 1) + 1)
            total = best[i] + cost(i, j)
            k = int(total.argmin())
            now[j], cut[j] = total[k], i[k]
            todo += [(lo, j - 1, left, int(i[k])), (j + 1, hi, int(i[k]), right)]
        best = now
        cuts.append(cut)
    bounds, j = [], n
    for cut in reversed(cuts):
        bounds.append(int(lengths[j - 1]))
        j = int(cut[j])
    return [int(lengths[j - 1]), *bounds[::-1]]


def pack(docs: DataFrame, max_length: int = MAX_LENGTH, buckets: int = BUCKETS, budget: int = BUDGET, **how) -> DataFrame:
    """One row per piece: doc_id, piece, n_tokens, bucket_length, padding, batch
    (number inside the bucket) and slot.

    Every text makes pieces of ``max_length`` tokens and one with the rest. A
    text without tokens makes one row with n_tokens 0 and no place (null bucket,
    batch, slot, padding 0). Every batch holds ``budget`` div bucket_length
    pieces (one at least), the last of a bucket maybe fewer. Rows with a null
    doc_id and repeated rows are packed like any other."""
    long = F.col("n_tokens")
    sized = token_lengths(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), carry=["doc_id"], **how)
    last = F.greatest(F.ceil(long / max_length).cast("long") - 1, F.lit(0))
    pieces = staged(sized.select("doc_id", "n_tokens", last.alias("last"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")).select(
        "doc_id", "piece", F.least(long - F.col("piece") * max_length, F.lit(max_length)).cast("long").alias("n_tokens")), "pieces")
    rows = pieces.where("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").collect()
    bounds = bucket_bounds(np.array([r["n_tokens"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64), buckets)
    bound = F.lit(None).cast("long")
    for b in reversed(bounds):
        bound = F.when(F.col("n_tokens") <= b, F.lit(b).cast("long")).otherwise(bound)
    placed = pieces.where("n_tokens > 0").select(bound.alias("bucket_length"), F.xxhash64("doc_id", "piece").alias("h"), "doc_id", "piece", "n_tokens")
    numbered = number_rows(placed, ["bucket_length", "h", "doc_id", "piece", "n_tokens"], "bucket_length")
    room = F.greatest(F.floor(F.lit(budget) / F.col("bucket_length")), F.lit(1)).cast("long")
    out = numbered.select("doc_id", "piece", "n_tokens", "bucket_length", (F.col("bucket_length") - F.col("n_tokens")).alias("padding"),
                          F.floor(F.col("row_number") / room).cast("long").alias("batch"), F.pmod(F.col("row_number"), room).cast("long").alias("slot"))
    none = F.lit(None).cast("long")
    return out.union(pieces.where("n_tokens = 0").select("doc_id", "piece", "n_tokens", none, F.lit(0).cast("long"), none, none))
