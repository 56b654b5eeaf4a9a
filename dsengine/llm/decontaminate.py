"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all benchmark items form one automaton; document words
stream through it and the longest match that ends at each word tells which
spans lie in an item. The automaton of up to ``max_words`` words (a checked
bound) is sent to every task; a larger benchmark is cut into parts by item and
the documents pass them one after the other, each pass written down. There is
no shuffle: every document is judged where it is read, whole.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dsengine.llm import textkernel as K
from dsengine.llm.common import boxed, small_batches, staged, unboxed

WINDOW = 13
COVER = 20  # contaminated from one word in so many
MAX_WORDS = 300_000
FOUND = "n_words long, n_hit long, spans array<struct<start:long,end:long>>, items array<string>"
ADDED = ("n_words", "n_hit", "spans", "items", "contaminated")
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        paths = []
        for _, seq in items:
            last, path = 0, []
            for w in seq:
                last = self._extend(last, w)
                path.append(last)
            paths.append(path)
        # a clone may have taken over a prefix: read the paths again
        holds: list[set[int]] = [set() for _ in self.next]
        self.whole: dict[int, list[tuple[int, int]]] = {}
        for i, (_, seq) in enumerate(items):
            s = 0
            for w in seq:
                s = self.next[s][w]
                p = s
                while p > 0 and i not in holds[p]:
                    holds[p].add(i)
                    p = self.link[p]
            if 0 < len(seq) < window:
                self.whole.setdefault(s, []).append((len(seq), i))
        self.names = [name or "" for name, _ in items]
        #: items that hold a full window, at the state whose lengths include it
        self.items = [sorted(h) if self.length[s] >= window > self.length[self.link[s]] else () for s, h in enumerate(holds)]
        self.shortest = min([window, *(len(seq) for _, seq in items if seq)], default=window)
        self.vocab = np.array(sorted({w for _, seq in items for w in seq}), np.uint64)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def scan(self, seq: list[int], hit: np.ndarray, at: int, found: set[int]) -> None:
        """Mark in ``hit`` (from ``at``) the words that lie in a window."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        s = got = 0
        for i, w in enumerate(seq, at + 1):
            while s and w not in nxt[s]:
                s = link[s]
                got = length[s]
            s = nxt[s].get(w, 0)
            got = got + 1 if s else 0
            p = s
            if got >= window:
                hit[i - got:i] = True
                while length[link[p]] >= window:
                    p = link[p]
                found.update(self.items[p])
                p = link[p]
            while p > 0:  # items shorter than a window that end here
                for n, item in self.whole.get(p, ()):
                    if n <= got:
                        hit[i - n:i] = True
                        found.add(item)
                p = link[p]
                if not self.whole:
                    break


def normalised(column) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a text column and each row's first word."""
    data, bounds = K.buffers(column)
    data = K.LOWER[data]
    start, end, first = K.words(data, bounds, K.ALNUM)
    return K.hash_words(data, start, end), first


def _known(vocab: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(vocab):
        return np.zeros(len(hashes), bool)
    return vocab[np.minimum(np.searchsorted(vocab, hashes), len(vocab) - 1)] == hashes


def _runs(known: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each stretch of known words within one row."""
    first, last = known.copy(), known.copy()
    turn = row[1:] != row[:-1]
    first[1:] &= ~known[:-1] | turn
    last[:-1] &= ~known[1:] | turn
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _without(text: str, spans: list[dict[str, int]]) -> str:
    """The text without the words of ``spans``, of which there is one at least."""
    raw = text.encode()
    data = K.LOWER[np.frombuffer(raw, np.uint8)]
    start, end, _ = K.words(data, np.array([0, len(raw)]), K.ALNUM)
    edge = [0, *(y for x in spans for y in (int(start[x["start"]]), int(end[x["end"] - 1]))), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edge[::2], edge[1::2])).decode()


def _match(payload, carry: list[str], cut: bool):
    """``cut``: cut the spans from the carried text."""

    def run(batches):
        auto = pickle.loads(payload.value)
        for batch in batches:
            before = "spans" in batch.schema.names  # of an earlier part of the benchmark
            _, bounds = K.buffers(batch["text"])
            for lo, hi in K.slices(bounds):
                part = batch.slice(lo, hi - lo)
                hashes, first = normalised(part["text"])
                hit = np.zeros(len(hashes), bool)
                row = np.repeat(np.arange(hi - lo), np.diff(first))
                items: dict[int, set[int]] = {}
                # only a run of known words as long as the shortest window can match
                begin, until = _runs(_known(auto.vocab, hashes), row)
                for a, b in zip(begin.tolist(), until.tolist()):
                    if b - a >= auto.shortest:
                        auto.scan(hashes[a:b].tolist(), hit, a, items.setdefault(int(row[a]), set()))
                names = [{auto.names[x] for x in items.get(i, ())} for i in range(hi - lo)]
                if before:
                    for i, (spans, more) in enumerate(zip(part["spans"].to_pylist(), part["items"].to_pylist())):
                        names[i] |= set(more)
                        for x in spans:
                            hit[first[i] + x["start"]:first[i] + x["end"]] = True
                spans: list[list[dict[str, int]]] = [[] for _ in range(hi - lo)]
                n_hit = np.zeros(hi - lo, np.int64)
                for a, b in zip(*(x.tolist() for x in _runs(hit, row))):
                    i = row[a]
                    spans[i].append({"start": a - int(first[i]), "end": b - int(first[i])})
                    n_hit[i] += b - a
                out = {k: part[k] for k in carry}
                if cut and n_hit.any():
                    text = [_without(part["text"][i].as_py(), x) if x else None for i, x in enumerate(spans)]
                    out["text"] = pc.coalesce(pa.array(text, pa.string()), part["text"])
                out |= {"n_words": pa.array(np.diff(first), pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "spans": pa.array(spans, SPANS),
                        "items": pa.array([sorted(x) for x in names], pa.list_(pa.string()))}
                yield pa.RecordBatch.from_pydict(out)

    return run


def automata(benchmark: DataFrame, window: int, max_words: int):
    """Automata of parts of the benchmark of about ``max_words`` words."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = int(items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)
    cuts = max(1, -(-size // (2 * max_words)))  # a word has two bytes at least, with its separator
    for i in range(cuts):
        got = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(cuts)) == i).collect() if cuts > 1 else items.collect()
        hashes, first = normalised(pa.array([r["text"] for r in got], pa.string()))
        yield Automaton([(r["item_id"], hashes[first[k]:first[k + 1]].tolist()) for k, r in enumerate(got)], window)


def match_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: int = COVER,
                    max_words: int = MAX_WORDS, carry: list[str] | None = None, cut: bool = False) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all, if None), and n_words, n_hit,
    spans (runs of hit words, in word numbers, end exclusive), items (sorted
    ids, as strings, of items with an occurring window) and contaminated (hit
    words make one word in ``cover`` or more).

    A window is ``window`` consecutive item words, or all words of a shorter
    item. Null or wordless text has no words and is not contaminated; an item
    without words matches nothing; an item without an id marks words but is not
    listed; equal items are all listed. Input columns named like a new one are
    replaced. An empty benchmark contaminates nothing. With ``cut`` the carried
    text loses all spans; each is made of whole windows, short items included."""
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ADDED]
    out = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*carry, "text"])]).withColumn("text", F.col("text").cast("string"))
    parts = automata(benchmark, window, max_words)
    auto = next(parts)
    while auto is not None:
        later = next(parts, None)
        kept = carry if later is None else list(dict.fromkeys([*carry, "text"]))
        types = dict(out.dtypes)
        schema = ", ".join([f"`{c}` {types[c]}" for c in kept] + [FOUND])
        out = out.mapInArrow(_match(sc.broadcast(pickle.dumps(auto)), kept, cut and later is None), schema)
        out, auto = (out if later is None else staged(out, "decontaminate")), later
    return out.withColumn("items", F.array_remove("items", "")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * cover >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: int = COVER, max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` without documents over the coverage limit, and with all
    matched spans, also of whole shorter items, cut from the texts of the others."""
    found = match_benchmark(boxed(docs), benchmark, window, cover, max_words, cut=True)
    return unboxed(found.where(~F.col("contaminated")), docs.columns)
