"""Operators on texts against brute force, with nulls, empty and very long
texts, ties, repeated rows, empty tables and clashing column names."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from dsengine.llm.decontaminate import decontaminate, match_benchmark
from dsengine.llm.minhash import keep_one, near_duplicates
from dsengine.llm.secrets import find_secrets, redact, span_text
from dsengine.llm.sharding import shard_documents
from dsengine.llm.substrings import dedup_substrings
from tests.llm import brute

SCHEMA = "doc_id long, text string"
DOCS = SCHEMA + ", source string, spans string, items int, key string, findings int"


def words(seed, n, vocabulary=3000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}é" if r.random() < 0.1 else f"w{r.randrange(vocabulary)}" for _ in range(n)]


def corpus():
    long, passage = words(1, 60000), words(2, 70)
    docs = [(5, " ".join(long)), (3, " ".join(words(3, 300))), (9, " ".join(words(3, 300))), (4, None), (6, ""), (7, " \t\n\x0b\x0c\r "), (8, "One Two"), (2, "one  two"), (10, "a b c d"), (11, "A B c d"), (12, "a b c d e")]
    for i in range(20, 32):
        w = words(i, 120)
        docs.append((i, " ".join(w[:30] + passage + w[30:])))
    near = words(40, 200)
    for i in range(40, 60):  # near copies: i words of the base changed
        w = list(near)
        for k in range(0, (i - 40) * 2, 2):
            w[(k * 7) % 200] = f"x{i}_{k}"
        docs.append((i, "\n".join(w)))
    docs.append((60, "u " * 200))  # one word over and over
    docs.append((61, "u " * 49))
    docs.append((62, "\u00a0x " * 60 + "\u2003"))  # other spaces are parts of words
    return docs


def frame(spark, docs, schema=SCHEMA):
    return spark.createDataFrame(docs, schema).repartition(5)


def clashing(spark, docs):
    return frame(spark, [(d, t, f"src{(d or 0) % 4}", "s", 1, "k", 2) for d, t in docs], DOCS)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_substrings_equal_brute_force(spark):
    docs = corpus()
    out = dedup_substrings(clashing(spark, docs), block_bytes=20000, range_windows=500)
    got = rows(out, "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256))
    assert got == sorted(brute.substrings(docs))


def test_substring_spans_and_ids(spark):
    text = " ".join(words(1, 80))
    out = dedup_substrings(frame(spark, [(1, text), (2, "z " + text + " q"), (2, text), (None, text), (None, text)])).collect()
    got = sorted(((r["doc_id"], r["n_removed"], [tuple(s) for s in r["spans"]], r["kept_text"]) for r in out), key=str)
    gone = (80, [(0, 80)], "")
    assert got == sorted([(1, 0, [], text), (2, 80, [(1, 81)], "z q"), (2, *gone), (None, *gone), (None, *gone)], key=str)


def test_near_duplicates_equal_brute_force(spark):
    docs = corpus()
    assert rows(near_duplicates(clashing(spark, docs), width=4), "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near(docs))


def test_near_duplicates_of_crowded_buckets(spark, monkeypatch):
    from dsengine.llm import minhash
    monkeypatch.setattr(minhash, "GROUP", 4)
    base = words(7, 300)
    docs = []
    for i in range(60):  # copies drift: each is near its neighbours, not near all
        w = list(base)
        for k in range(i):
            w[(k * 5) % 300] = f"y{k}"
        docs.append((i, " ".join(w)))
    assert rows(near_duplicates(frame(spark, docs), width=4), "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near(docs))


@pytest.mark.parametrize("tile,weight", [(8, 1 << 20), (1 << 20, 300), (1 << 20, 1 << 20)])
def test_near_duplicates_of_a_crowd_about_the_threshold(spark, monkeypatch, tile, weight):
    """Members of one crowd, some linked and many just not, in tiles of both kinds."""
    from dsengine.llm import minhash
    for name, value in (("GROUP", 8), ("TILE", tile), ("WEIGHT", weight), ("COLUMNS", 16)):
        monkeypatch.setattr(minhash, name, value)
    rng = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for d in range(90):
        w = list(base)
        for p in rng.sample(range(60), rng.choice([1, 2, 3])):
            w[p] = f"x{rng.randrange(40)}"
        docs.append((d, " ".join(w)))
    got = rows(near_duplicates(frame(spark, docs), width=4), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute.near(docs))
    assert len({r[2] for r in got}) > 2


def test_near_duplicates_nulls_and_repeated_ids(spark):
    text = " ".join(words(1, 90))
    got = near_duplicates(frame(spark, [(3, text), (None, text), (5, text), (5, "other words of that id here"), (8, "other words of that id here"), (None, None), (1, None), (2, None)])).collect()
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in got), key=str)
    assert got == sorted([(3, 3, True), (None, 3, False), (5, 3, False), (5, 3, False), (8, 3, False), (None, None, True), (1, 1, True), (2, 2, True)], key=str)
    kept = keep_one(frame(spark, [(3, text), (3, text), (7, text), (None, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == [(0, ""), (3, text)]


def test_benchmark_equals_brute_force(spark):
    docs = corpus()
    w = words(2, 70)
    items = [(1, " ".join(w[:40])), (2, " ".join(w[20:33])), (3, "w1 w2"), (4, None), (5, "..."), (6, "ONE two"), (7, "One two"), (10, " ".join(x.upper() for x in w[30:60])), (11, "u u u")]
    out = match_benchmark(clashing(spark, docs), frame(spark, items, "item_id long, text string"), carry=["doc_id", "text"])
    digest = ["doc_id", "n_words", "n_hit", F.size("items").cast("long"), F.sha2(F.array_join("items", ",").cast("binary"), 256), "contaminated"]
    want = sorted(brute.contamination(docs, items))
    assert rows(out, *digest) == want
    parts = match_benchmark(frame(spark, docs), frame(spark, items, "item_id long, text string"), max_words=60)
    assert rows(parts, *digest) == want


def test_decontaminate_cuts_and_drops(spark):
    w, item = words(3, 400), words(4, 15)
    docs = [(1, " ".join(w)), (2, " ".join(item)), (3, "Äh, " + " ".join(w[:200]) + "! " + " ".join(item) + " ? " + " ".join(w[200:])), (4, None)]
    out = decontaminate(clashing(spark, docs), frame(spark, [(1, " ".join(item))], "item_id long, text string"))
    assert out.columns == clashing(spark, docs).columns
    assert rows(out.where("text is not null"), "doc_id", "text") == [(1, docs[0][1]), (3, docs[2][1].replace(" ".join(item), ""))]
    assert rows(out, "spans", "items") == [("s", 1)] * 3


def secret_docs():
    key = "Zk3Qp9Xw7Lm2Vb8Nc4Rt6Yh1"
    docs = [(1, f"é password = 'abc{key}' and AKIA" + "A1B2C3D4E5F6 0123456789abcdef0123456789ABCDEF0123456789abcdef0123456789abcdef"),
            (2, "secret: token: abcdefgh12"), (3, "API_KEY=\"short\" api_key:longenough1 APIKEY  :  longenough2"), (4, None), (5, ""),
            (6, "to\u212aen = abcdefghij \u017fecret=abcdefghij token=ABCDEFGHIJ"), (7, "AKIAAKIAABCD AKIA" + "Z" * 12), (8, f"found {key} here"), (9, "passwd:" + "x" * 5000)]
    docs += [(20 + i, "hex " + "deadbeef" * 5 + " copied example") for i in range(8)]
    return docs


def test_secrets_equal_brute_force(spark):
    docs = secret_docs() + [(1, secret_docs()[0][1])]
    out = find_secrets(clashing(spark, docs), carry=["doc_id"])
    base = F.filter("findings", lambda x: x.kind != "live")
    n = [F.size(F.filter("findings", lambda x, k=None, kind=kind: x.kind == kind)).cast("long") if False else F.size(F.expr(f"filter(findings, x -> x.kind = '{kind}')")).cast("long") for kind in ("assign", "access", "hex")]
    assert rows(out, "doc_id", *n, F.sha2(span_text(base).cast("binary"), 256)) == sorted(brute.secrets(docs))
    told = {r["doc_id"]: [(f["kind"], f["n_owners"], f["live"]) for f in r["findings"]] for r in out.collect()}
    assert told[8] == [("live", 1, True)]
    assert told[20] == [("hex", 4, False)]


def test_redaction_masks_what_few_owners_hold(spark):
    docs = secret_docs()
    out = {r["doc_id"]: r["text"] for r in redact(clashing(spark, docs)).collect()}
    assert out[20] == docs[-1][1] and out[4] is None and out[5] == ""
    assert out[8] == "found [SECRET] here" and out[9] == "[SECRET]"
    assert out[1].startswith("é [SECRET]' and [SECRET] ")
    assert out[3] == "API_KEY=\"short\" [SECRET] [SECRET]"


def test_shards(spark):
    docs = corpus() + [(None, "x"), (None, None), (3, "again"), (10, "a b c d"), (10, "a b c d")]
    out = shard_documents(clashing(spark, docs), shards=16).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in out) == sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    places = sorted(r["slot"] * 16 + r["shard"] for r in out)
    assert places == list(range(len(docs)))
    again = shard_documents(frame(spark, docs).repartition(3), shards=16).collect()
    assert sorted((r["row_number"], r["shard"], r["slot"]) for r in out) == sorted((r["row_number"], r["shard"], r["slot"]) for r in again)
    assert {r["law"] for r in out} == {"rows"} and {r["grown_shard"] for r in out} == {None}


def test_permutation_is_one_to_one(spark):
    from dsengine.llm.sharding import permuted
    for n in (1, 2, 3, 5, 97, 1000, 4097):
        got = [r[0] for r in spark.range(n).select(permuted(F.col("id"), n, 7)).collect()]
        assert sorted(got) == list(range(n))
        assert n < 90 or got != sorted(got)


@pytest.mark.parametrize("operator", [dedup_substrings, near_duplicates, keep_one, redact, shard_documents])
def test_empty_tables(spark, operator):
    docs = clashing(spark, [(1, "a")]).where("false")
    assert operator(docs).count() == 0


def test_empty_benchmark(spark):
    docs, items = frame(spark, [(1, "a b"), (2, None)]), frame(spark, [(1, "a")], "item_id long, text string")
    assert rows(match_benchmark(docs, items.where("false")), "doc_id", "n_hit", "contaminated") == [(1, 0, False), (2, 0, False)]
    assert match_benchmark(docs.where("false"), items).count() == 0
