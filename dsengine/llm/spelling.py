"""Spelling variants of the corpus vocabulary by FM-index search schemes.

Two words at one edit share a half: an edit lies left or right of the middle of a
word, so the other half is matched exactly. Words are dealt by their halves (as
queries by their own, as targets by those that a query of their length or one more
or less would have), a shuffle of six short rows a word. Each bucket builds a
suffix-rank index of its delimited words, reversed where the left half is shared,
so that both schemes run the same way: match the shared half exactly, then extend
across the other, allowing one insertion, deletion or replacement, as intervals of
suffix ranks, for all queries of the bucket at once (numpy). One index for each
direction makes the search bidirectional; with one error no single search turns.

A pair that shares both halves is found on both sides and counted on the left one.
Buckets answer with a count and the most frequent partner of each word, never with
pairs. A half that very many words share gets buckets of its own: its targets are
split, its queries go to each part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dsengine.llm.common import parts, release, staged

#: Targets that one index holds, about.
INDEX = 1 << 14
#: Queries that are extended at once.
QUERIES = 1 << 13
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def corpus_words(docs: DataFrame) -> Column:
    """The runs of letters of ``text``, A-Z in lower case."""
    return F.regexp_extract_all(F.translate(F.col("text"), UPPER, LOWER), F.lit("([a-z\\u00C0-\\u00FF]+)"), 1)


def misspell(doc_id: Column, run: Column, every: int = 199) -> Column:
    """``run``, without one code point where ``every`` divides the crc32 of
    ``<doc_id>:<run>``; a null doc_id counts as an empty one."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


class Index:
    """Suffix ranks of delimited words; intervals extend to the left."""

    def __init__(self, words: list[np.ndarray]):
        text = np.concatenate([np.concatenate([[0], w]) for w in words] + [[0]]).astype(np.int64)
        self.starts = np.cumsum([0] + [len(w) + 1 for w in words])
        n = len(text)
        rank = text.copy()
        step = 1
        while True:
            after = np.zeros(n, np.int64)
            after[:n - step] = rank[step:] + 1
            order = np.lexsort((after, rank))
            a, b = rank[order], after[order]
            fresh = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            if fresh[-1] == n - 1 or step >= n:
                break
            step *= 2
        self.order, self.n = order, n
        self.before = text[order - 1]  # the symbol left of each suffix; the first suffix wraps to the last delimiter
        self.key = np.sort(self.before * n + np.arange(n))
        self.symbols = np.unique(text)[1:]

    def extend(self, c, lo, hi):
        """Interval of the suffixes that ``c`` before those of [lo, hi) makes."""
        return np.searchsorted(self.key, c * self.n + lo), np.searchsorted(self.key, c * self.n + hi)

    def word(self, rank):
        """Number of the word whose delimiter starts the suffix."""
        return np.searchsorted(self.starts, self.order[rank])

    def branches(self, lo, hi):
        """(row, symbol) for the symbols left of the suffixes of each interval."""
        size = np.minimum(hi - lo, len(self.symbols))
        row = np.repeat(np.arange(len(lo)), size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        wide = (hi - lo >= len(self.symbols))[row]
        c = np.where(wide, self.symbols[np.minimum(at, len(self.symbols) - 1)], self.before[np.minimum(lo[row] + at, self.n - 1)])
        row, c = row[c > 0], c[c > 0]
        one = np.unique(row * (1 << 21) + c)
        return one >> 21, one & ((1 << 21) - 1)


def search(index: Index, queries: list[np.ndarray], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) for every word of ``index`` that ends like the query in its
    last ``exact`` symbols and differs by one edit before them."""
    length = np.array([len(q) for q in queries])
    width = int(length.max())
    flip = np.zeros((len(queries), width), np.int64)
    for i, q in enumerate(queries):
        flip[i, :len(q)] = q[::-1]
    none = np.zeros(0, np.int64)
    lo0, hi0 = index.extend(np.int64(0), np.int64(0), np.int64(index.n))
    q, lo, hi = np.arange(len(queries)), np.full(len(queries), lo0), np.full(len(queries), hi0)
    eq, elo, ehi = none, none, none  # one error made, next symbol t
    found_q, found_w = [], []
    for t in range(width + 1):
        free = t >= exact[q]
        fq, flo, fhi = q[free], lo[free], hi[free]
        row, c = index.branches(flo, fhi) if len(fq) else (none, none)
        nlo, nhi = index.extend(c, flo[row], fhi[row])
        nq = fq[row]
        eq, elo, ehi = np.concatenate([eq, nq]), np.concatenate([elo, nlo]), np.concatenate([ehi, nhi])  # one symbol more
        live = ehi > elo
        eq, elo, ehi = eq[live], elo[live], ehi[live]
        done = length[eq] == t
        if done.any():
            dlo, dhi = index.extend(np.int64(0), elo[done], ehi[done])
            ok = dhi > dlo
            found_q.append(eq[done][ok])
            found_w.append(index.word(dlo[ok]))
        if t == width:
            break
        eq, elo, ehi = eq[~done], elo[~done], ehi[~done]
        nlo2, nhi2 = index.extend(flip[eq, t], elo, ehi)
        other = (length[nq] > t) & (c != flip[nq, t])  # replaced
        left = length[fq] > t  # left out
        eq = np.concatenate([eq, nq[other], fq[left]])
        elo, ehi = np.concatenate([nlo2, nlo[other], flo[left]]), np.concatenate([nhi2, nhi[other], fhi[left]])
        more = length[q] > t
        q, lo, hi = q[more], lo[more], hi[more]
        lo, hi = index.extend(flip[q, t], lo, hi)
        live = hi > lo
        q, lo, hi = q[live], lo[live], hi[live]
    if not found_q:
        return none, none
    pair = np.unique(np.concatenate(found_q) * len(index.starts) + np.concatenate(found_w))
    return pair // len(index.starts), pair % len(index.starts)


PARTNERS = "word string, near long, best_n long, best string"


def _codes(words: list[str]) -> list[np.ndarray]:
    return [np.frombuffer(w.encode("utf-32-le"), np.uint32).astype(np.int64) for w in words]


def _bucket(key, rows):
    left, query = key[0].as_py(), rows["query"].to_numpy(zero_copy_only=False)
    words, n = rows["word"].to_pylist(), rows["n"].to_numpy()
    targets: dict[str, int] = {w: int(k) for w, k, is_query in zip(words, n, query) if not is_query}
    asked = sorted({w for w, is_query in zip(words, query) if is_query})
    out = []
    if targets and asked:
        names = sorted(targets)
        index = Index([c[::-1] if left else c for c in _codes(names)])
        counts = np.array([targets[w] for w in names], np.int64)
        for at in range(0, len(asked), QUERIES):
            some = asked[at:at + QUERIES]
            size = np.array([len(w) for w in some])
            q, w = search(index, [c[::-1] if left else c for c in _codes(some)], size // 2 if left else size - size // 2)
            if not left:  # the left side has it too
                new = np.fromiter((not names[y].startswith(some[x][:len(some[x]) // 2]) for x, y in zip(q, w)), bool, len(q))
                q, w = q[new], w[new]
            order = np.lexsort((w, -counts[w], q))
            q, w = q[order], w[order]
            first = np.flatnonzero(np.diff(q, prepend=-1))
            near = np.diff(np.append(first, len(q)))
            out += zip((some[x] for x in q[first]), near.tolist(), counts[w[first]].tolist(), (names[x] for x in w[first]))
    columns = list(zip(*out)) or [[], [], [], []]
    return pa.table([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], names=["word", "near", "best_n", "best"])


def near_words(words: DataFrame) -> DataFrame:
    """word, near (words at one edit), best_n and best (the most frequent of them,
    ties to the smallest) for the words of ``words`` (word, n) that have any. Words
    are distinct and of two code points at least."""
    m = F.length("word")

    def half(left, k):
        return F.substring("word", F.lit(1), k) if left else F.substring("word", m - k + 1, k)

    def sides(query, sizes):
        return [F.struct(F.lit(left).alias("left"), F.lit(query).alias("query"), half(left, k).alias("half")) for left, k in sizes]
    own = sides(True, [(True, F.floor(m / 2).cast("int")), (False, F.ceil(m / 2).cast("int"))])
    # halves of queries with a code point less or more: floor and ceiling of (m - 1) / 2 .. (m + 1) / 2
    lower, upper = F.floor((m - 1) / 2).cast("int"), F.floor((m + 1) / 2).cast("int")
    asked = sides(False, [(True, lower), (True, upper), (False, F.ceil((m - 1) / 2).cast("int")), (False, F.ceil((m + 1) / 2).cast("int"))])
    rows = words.select("word", "n", F.explode(F.array(*own, *asked)).alias("x")).select("word", "n", "x.*").where("half <> ''")
    size = rows.where("NOT query").groupBy("left", "half").agg(F.count("*").alias("c"))
    hot = size.where(F.col("c") > INDEX).select("left", "half", F.ceil(F.col("c") / INDEX).cast("int").alias("s"))
    buckets = parts(words.count(), INDEX / 2, 8)
    rows = rows.join(hot, ["left", "half"], "left")
    one = F.array(F.pmod(F.xxhash64("word"), F.col("s")).cast("int"))
    rows = rows.withColumn("part", F.explode(F.when(F.col("s").isNull(), F.array(F.lit(-1))).when(F.col("query"), F.sequence(F.lit(0), F.col("s") - 1)).otherwise(one)))
    rows = rows.select("left", F.when(F.col("s").isNull(), F.pmod(F.xxhash64("half"), F.lit(buckets))).otherwise(F.lit(-1)).alias("bucket"),
                       F.when(F.col("s").isNotNull(), F.col("half")).alias("half"), "part", "query", "word", "n")
    found = rows.groupBy("left", "bucket", "half", "part").applyInArrow(_bucket, PARTNERS)
    found = found.groupBy("word", "best_n").agg(F.sum("near").alias("near"), F.min("best").alias("best"))
    found = found.groupBy("word").agg(F.sum("near").alias("near"), F.max_by("best", "best_n").alias("best"), F.max("best_n").alias("best_n"))
    return found.select("word", "near", "best_n", "best")


def vocabulary(docs: DataFrame, length: int = 6, least: int = 5) -> DataFrame:
    """word, n: what the runs of letters of all documents come to (``misspell``),
    of ``length`` code points and ``least`` occurrences at least. A null text has no
    words, repeated documents count each."""
    runs = docs.select(F.col("doc_id").alias("doc_id"), F.explode(corpus_words(docs)).alias("run")).where(F.length("run") >= length)
    words = runs.select(misspell(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def variants(docs: DataFrame, times: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n and root for the whole vocabulary of ``docs``
    (doc_id, text). The form of a word is its most frequent near word, ties to the
    smallest, if that occurs ``times`` as often; root is where forms lead. Counts
    grow along forms, so they never turn back. Other columns are not read."""
    words = staged(vocabulary(docs), "vocabulary")
    near = near_words(words)
    has = F.col("best_n") >= times * F.col("n")
    named = words.join(near, "word", "left").select("word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"),
                                                    F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n"))
    named = staged(named, "forms")
    release(words)
    links, old = named.where("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), None
    while True:  # each round doubles the steps taken
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = staged(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if old is not None:
            release(old)
        old = links
        if not links.where("moved").limit(1).count():
            break
    return named.join(links.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
