"""URL filter by the ratio of two character language models.

Rules decide the urls they fit. The urls that rules accept and reject train two
variable-order Markov models over the characters of host and path: counts of
all grams up to ``ORDER`` characters, interpolated from short to long contexts,
so a context that was never seen falls back to the longest known one. The
verdict on other urls is the difference of log-likelihoods per character
against a threshold fitted on a held-out fifth of the rule-judged urls by models
of the others; after that the held-out urls count too.

Counts cover every rule-judged url. They are exact and stay in a Spark table of
all grams of the urls, which grows with the input; the likelihood of a gram's
last character follows from joins with its context and its suffix, a length at
a time. Urls are scored in blocks: each block asks for its distinct grams once,
so that a gram of all urls is met by as many rows as there are blocks.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dsengine.llm import textkernel as K
from dsengine.llm.common import release, small_batches, staged

#: fixed values of the contract: verdict, host, path
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
ORDER = 6
END = 0xFF  # no byte of UTF-8
MODELS = ("fit", "full")  # counts without the held-out urls, for the threshold, and with them, for the table
BLOCK = 1 << 20  # characters of the urls that are scored together
STRENGTH = 4.0  # of the shorter context, in observations
HELD_OUT = 5  # one labelled url in so many calibrates
BINS = 200  # thresholds a unit of log-likelihood
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none."""
    out = F.lit(None)
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _grams(column) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Bytes of the grams of 1..ORDER characters that end at each byte (an end
    mark follows each url), -1 where the url is too short; row of each byte."""
    data, bounds = K.buffers(column)
    n = np.diff(bounds) + 1
    first = np.append(0, np.cumsum(n))
    marked = np.full(int(first[-1]), END, np.int64)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(marked)) - first[row]
    marked[at < n[row] - 1] = data
    gram, grams = np.zeros(len(marked), np.int64), []
    for k in range(ORDER):
        gram[k:] |= marked[:len(marked) - k] << (8 * k)
        grams.append(np.where(at >= k, gram, -1))
    return grams, row, n


def _longest(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code (length and bytes) of the longest gram that ends at each byte."""
    grams, row, n = _grams(column)
    code = grams[0].copy()
    for k in range(1, ORDER):
        code = np.where(grams[k] >= 0, k << 48 | grams[k], code)
    return code, row, n


def _placed(names: list[str]):
    """Adds the block: batches of one task, up to ``BLOCK`` characters and more."""
    def run(batches):
        from pyspark import TaskContext

        block, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            if size >= BLOCK:
                block, size = block + 1, 0
            size += max(int(K.buffers(batch["url_chars"])[1][-1]), batch.nbytes // 16)
            yield pa.RecordBatch.from_pydict({c: batch[c] for c in names} | {"url_block": pa.array(np.full(batch.num_rows, block, np.int64))})

    return run


def _count(batches):
    for batch in batches:
        grams, row, _ = _grams(batch["url_chars"])
        good, held = (pc.fill_null(batch[c], False).to_numpy(zero_copy_only=False)[row] for c in ("url_good", "url_held"))
        ruled = batch["rule"].is_valid().to_numpy(zero_copy_only=False)[row]
        for k, gram in enumerate(grams):
            ok = gram >= 0
            code, at = np.unique(gram[ok], return_inverse=True)
            counts = {}
            for model in MODELS:
                taken = ruled & ~held if model == "fit" else ruled
                for side, told in (("good", good), ("bad", ~good)):
                    counts[f"{model}_{side}"] = pa.array(np.bincount(at[(taken & told)[ok]], minlength=len(code)).astype(np.int64))
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(code), k, np.int32)), "gram": pa.array(code)} | counts)


def _distinct(batches):
    """The codes of each block, every one once as long as the block lasts."""
    block, codes = None, np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        blocks = batch["url_block"].to_numpy()
        cuts = np.flatnonzero(np.diff(blocks)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)]):
            if block is not None and block != blocks[lo]:
                yield pa.RecordBatch.from_pydict({"url_block": pa.array(np.full(len(codes), block, np.int64)), "code": pa.array(codes)})
                codes = np.zeros(0, np.int64)
            block = blocks[lo]
            codes = np.union1d(codes, _longest(batch["url_chars"].slice(lo, hi - lo))[0])
    if block is not None:
        yield pa.RecordBatch.from_pydict({"url_block": pa.array(np.full(len(codes), block, np.int64)), "code": pa.array(codes)})


def _score(names: list[str]):
    def run(urls: pa.Table, told: pa.Table) -> pa.Table:
        code, row, n = _longest(urls["url_chars"])
        have = told["code"].to_numpy()
        order = np.argsort(have, kind="stable")
        at = order[np.searchsorted(have, code, sorter=order)]
        scores = {m: pa.array(np.bincount(row, told[m].to_numpy()[at], len(n)) / n) for m in MODELS}
        return pa.table({c: urls[c] for c in names} | scores)

    return run


def _differences(counts: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Code and, for each model, the log-likelihood difference of the last
    character of each gram after those before it; and the stages read.

    A gram's likelihood is that of its suffix, moved by its count within the
    count of its context. At most 256 grams share a suffix or a context, so the
    joins have no hot keys; every suffix and context of a gram is a gram."""
    names = [f"{m}_{side}" for m in MODELS for side in ("good", "bad")]
    total = counts.where("k = 0").agg(*[F.sum(c).alias(c) for c in names]).first()
    levels = []
    for k in range(ORDER):
        level = counts.where(F.col("k") == k)
        if k:
            context = counts.where(F.col("k") == k - 1).select(F.col("gram").alias("context"), *[F.col(c).alias(f"seen_{c}") for c in names])
            suffix = levels[-1].select(F.col("gram").alias("suffix"), *[F.col(f"p_{c}").alias(f"less_{c}") for c in names])
            level = level.join(context, F.shiftright("gram", 8) == F.col("context")).join(suffix, F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)) == F.col("suffix"))
        seen = {c: F.col(f"seen_{c}") if k else F.lit(total[c]) for c in names}
        less = {c: F.col(f"less_{c}") if k else F.lit(1 / 256) for c in names}
        levels.append(staged(level.select("gram", *[((F.col(c) + STRENGTH * less[c]) / (seen[c] + STRENGTH)).alias(f"p_{c}") for c in names]), "urls-level"))
    out = [level.select(F.col("gram").bitwiseOR(F.lit(k << 48)).alias("code"), *[(F.log(f"p_{m}_good") - F.log(f"p_{m}_bad")).alias(m) for m in MODELS]) for k, level in enumerate(levels)]
    return reduce(DataFrame.union, out), levels


def judge_urls(pages: DataFrame, rules=RULES, url: str = "url", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``pages`` (all, if None), host, path, rule,
    verdict, and score: the log-likelihood difference a character.

    A rule's verdict stands; else the models' does: allow from the threshold
    on. Null or malformed urls have empty host and path and go by their score
    as an empty text. If rules accept or reject no url there is no model: score
    0 and allow. Repeated urls count as often as they occur. Input columns named
    like a new one are replaced."""
    new = ("host", "path", "rule", "verdict", "score")
    carry = [c for c in (pages.columns if carry is None else carry) if c not in new]
    host, path = split_url(F.col(f"`{url}`").cast("string"))
    src = pages.select(*[F.col(f"`{c}`") for c in carry], host.alias("host"), path.alias("path"))
    src = src.withColumn("url_ruled", rule_of(F.col("host"), F.col("path"), rules)).select(*[F.col(f"`{c}`") for c in carry], "host", "path",
                         F.col("url_ruled.rule").alias("rule"), F.col("url_ruled.verdict").alias("verdict"), F.concat("host", "path").alias("url_chars"))
    src = src.withColumn("url_good", F.col("verdict") == "allow").withColumn("url_held", F.pmod(F.xxhash64("url_chars"), F.lit(HELD_OUT)) == 0)
    small_batches(pages.sparkSession)
    keep = [*carry, "host", "path", "rule", "verdict"]
    types = dict(src.dtypes)
    placed = staged(src.mapInArrow(_placed(src.columns), ", ".join(f"`{c}` {t}" for c, t in [*types.items(), ("url_block", "long")])), "urls")
    free = ~F.col("url_held") & F.col("rule").isNotNull()
    size = placed.agg(F.sum((F.col("url_good") & free).cast("long")), F.sum((~F.col("url_good") & free).cast("long"))).first()
    if not size[0] or not size[1]:
        return placed.select(*[F.col(f"`{c}`") for c in carry], "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    names = [f"{m}_{side}" for m in MODELS for side in ("good", "bad")]
    chars = placed.select("url_block", "url_chars", "rule", "url_good", "url_held")
    counts = staged(chars.mapInArrow(_count, ", ".join(["k int, gram long", *(f"{c} long" for c in names)])).groupBy("k", "gram").agg(*[F.sum(c).alias(c) for c in names]), "urls-counts")
    differences, levels = _differences(counts)
    told = chars.mapInArrow(_distinct, "url_block long, code long").join(differences, "code")
    kept = [*keep, "url_good", "url_held"]
    schema = ", ".join([f"`{c}` {types[c]}" for c in kept] + [f"{m} double" for m in MODELS])
    scored = staged(placed.groupBy("url_block").cogroup(told.groupBy("url_block")).applyInArrow(_score(kept), schema), "urls-scored")
    for stage in (placed, counts, *levels):
        release(stage)

    held = scored.where(F.col("url_held") & F.col("rule").isNotNull())
    bins = held.groupBy(F.floor(F.col("fit") * BINS).alias("bin")).agg(F.sum(F.col("url_good").cast("long")).alias("g"), F.count("*").alias("n")).orderBy("bin").collect()
    best, threshold = -1.0, 0.0
    good, bad = sum(r["g"] for r in bins), sum(r["n"] - r["g"] for r in bins)
    below, before = [0, 0], bins[0]["bin"] if bins else 0
    for r in bins:  # from the middle of the gap below this bin on urls are allowed
        mean = (1 - below[0] / good if good else 0) + (below[1] / bad if bad else 0)
        if mean > best:
            best, threshold = mean, (before + r["bin"]) / 2 / BINS
        before = r["bin"]
        below = [below[0] + r["g"], below[1] + r["n"] - r["g"]]
    out = scored.select(*[F.col(f"`{c}`") for c in keep], F.col(MODELS[-1]).alias("score"))
    return out.withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") >= threshold, "allow").otherwise("block")))
