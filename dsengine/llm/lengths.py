"""Exact length histogram of a corpus and what follows from it.

Documents are aggregated by encoded length; suffix sums over the histogram give
for every context limit the documents and tokens at or above it and the total
of tokens when texts are truncated there, and prefix counts give quantiles.
The histogram has a row per distinct length. Sums over it are done in bands of
lengths, with a small table of band totals, so no task holds all lengths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dsengine.llm.common import staged
from dsengine.llm.tokens import token_lengths

BAND = 4096


def length_histogram(docs: DataFrame, **how) -> DataFrame:
    """n_tokens, n_docs: how many whole texts have each encoded length."""
    return token_lengths(docs, carry=[], **how).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def length_report(histogram: DataFrame) -> DataFrame:
    """One row per distinct length L: n_docs, tokens, docs_from and tokens_from
    (documents of length >= L and their tokens), truncated_total (tokens when
    every text is cut to L), docs_to (documents of length <= L) and quantile
    (their share). Totals stand in the row of the smallest length. No documents,
    no rows."""
    h = staged(histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / BAND).alias("band")), "lengths")
    bands = h.groupBy("band").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    above, whole = W.orderBy(F.desc("band")).rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    bands = bands.select("band", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t"),
                         F.sum("d").over(whole).alias("all_d"), F.sum("t").over(whole).alias("all_t"))
    here = W.partitionBy("band").orderBy(F.desc("n_tokens"))
    out = h.join(bands, "band").select("n_tokens", "n_docs", "tokens", "all_d", "all_t", (F.col("d") + F.sum("n_docs").over(here)).alias("docs_from"),
                                       (F.col("t") + F.sum("tokens").over(here)).alias("tokens_from"))
    shorter = F.col("all_t") - F.col("tokens_from")
    docs_to = F.col("all_d") - F.col("docs_from") + F.col("n_docs")
    return out.select("n_tokens", "n_docs", "tokens", "docs_from", "tokens_from", (shorter + F.col("n_tokens") * F.col("docs_from")).alias("truncated_total"),
                      docs_to.alias("docs_to"), (docs_to / F.col("all_d")).alias("quantile"))


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """One row: for any context limits the tokens left when texts are cut there
    (``total_<limit>``) and the number of texts cut (``cut_<limit>``)."""
    one = []
    for n in limits:
        one += [F.coalesce(F.sum(F.least("n_tokens", F.lit(n)) * F.col("n_docs")), F.lit(0)).alias(f"total_{n}"),
                F.coalesce(F.sum(F.when(F.col("n_tokens") > n, F.col("n_docs"))), F.lit(0)).alias(f"cut_{n}")]
    return histogram.agg(*one)


def quantiles(report: DataFrame, shares: list[float]) -> DataFrame:
    """One row: the smallest length that at least each share of texts has at most."""
    return report.agg(*[F.min(F.when(F.col("quantile") >= q, F.col("n_tokens"))).alias(f"q_{q:g}".replace(".", "_")) for q in shares])
