"""Spelling variants against all pairs, and the suffix-rank search alone."""

import binascii
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dsengine.llm import spelling
from dsengine.llm.spelling import near_words, variants, vocabulary

LOW = str.maketrans(spelling.UPPER, spelling.LOWER)


def words_of(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = binascii.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += len(run) >= 6
    return {w: k for w, k in n.items() if k >= 5}


def at_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[i + 1:] == b[i + 1:] if len(a) == len(b) else len(a) + 1 == len(b) and a[i:] == b[i + 1:])


def brute(n):
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and at_one(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def rows_of(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


def random_docs(seed, letters="abcÀé", docs=60, size=220):
    r = random.Random(seed)
    base = ["".join(r.choices(letters, k=r.randint(5, 11))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "abababab", "babababa"]
    out = []
    for i in range(docs):
        ws = []
        for _ in range(size):
            w = r.choice(base[:r.randint(1, len(base))])
            at = r.randrange(len(w))
            kind = r.random()
            w = w if kind < 0.7 else w[:at] + w[at + 1:] if kind < 0.8 else w[:at] + r.choice(letters) + w[at:] if kind < 0.9 else w[:at] + r.choice(letters) + w[at + 1:]
            ws.append(w)
        out.append((i, " ".join(ws)))
    return out


@pytest.mark.parametrize("seed,index", [(1, 1 << 14), (2, 16), (3, 3)])
def test_variants_equal_all_pairs(spark, monkeypatch, seed, index):
    """Small indexes split hot halves over buckets of their own."""
    monkeypatch.setattr(spelling, "INDEX", index)
    monkeypatch.setattr(spelling, "QUERIES", 50)
    rows = random_docs(seed) + [(900, None), (901, ""), (None, "Aaaaaa " * 7), (902, "aaaaaa×÷ÿ" * 9)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, word string").repartition(5)
    want = brute(words_of(rows))
    assert len(want) > 100 and sum(1 for x in want if x[1]) > 10
    assert rows_of(variants(df)) == want


def test_chains_of_forms_reach_their_root(spark):
    n = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 700, "zzzzzz": 6, "zzzzzy": 29}
    df = spark.createDataFrame([(1, " ".join(w + " " for w in n for _ in range(n[w])))], "doc_id long, text string")
    got = {r["word"]: r for r in variants(df).collect()}
    assert {w: got[w]["root"] for w in got} == {r[0]: r[2] for r in brute({w: r["n"] for w, r in got.items()})}
    assert got["aaaaaa"]["root"] == "aaabbb" and got["zzzzzz"]["form"] is None and got["zzzzzz"]["n_near"] == 1


def test_words_of_any_length_and_repeats(spark):
    long = "ab" * 3000 + "cde"
    words = [long, long[:-1], "x" + long, long[:2000] + "é" + long[2000:], "ab", "abc", "b", "a", "ba"]
    df = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    got = {r["word"]: (r["near"], r["best"]) for r in near_words(df.where("length(word) > 1")).collect()}
    kept = [w for w in words if len(w) > 1]
    want = {w: sum(at_one(w, v) for v in kept) for w in kept}
    assert {w: x[0] for w, x in got.items()} == {w: k for w, k in want.items() if k}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert variants(df).collect() == [] and vocabulary(df).collect() == []


def test_planted_table_equals_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    n = words_of(rows)
    assert rows_of(variants(docs)) == brute(n)
    assert vocabulary(docs).agg(F.sum("n")).first()[0] == sum(n.values())
