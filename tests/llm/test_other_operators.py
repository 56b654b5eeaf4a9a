"""Vectors, urls, token lengths, packing, quality and the pipeline."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dsengine.llm import quality, vectors
from dsengine.llm.lengths import at_limits, length_histogram, length_report, quantiles
from dsengine.llm.packing import bucket_bounds, pack
from dsengine.llm.tokens import PATTERN, VOCABULARY, token_lengths
from dsengine.llm.urls import judge_urls
from dsengine.llm.vectors import near_vectors
from tests.llm import brute


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 16)
    monkeypatch.setattr(vectors, "SIDE", 24)
    r = np.random.Generator(np.random.PCG64(5))
    base = r.standard_normal((120, 24))
    near = [base[i % 3] + r.standard_normal(24) * s for i, s in enumerate(np.linspace(0.01, 0.4, 150))]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([*base, *near, base[0] * 7, base[1]])]
    rows += [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] * 24), (904, [float("inf")] + [1.0] * 23), (905, [None] + [1.0] * 23), (906, [1.0, 2.0]), (907, [2.0, 4.0])]
    df = spark.createDataFrame([(i, v, "n", 1) for i, v in rows], "vec_id long, embedding array<double>, node string, m int").repartition(4)
    got = sorted(tuple(r) for r in near_vectors(df).collect())
    assert got == sorted(brute.vectors(rows))


def test_vectors_that_share_an_id_and_of_any_magnitude(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [1e200, 1e198]), (4, [1e-200, 0.0]), (5, [0.0, -5e-324]),
            (6, [0.0, -1e308]), (6, [0.0, -1.7e308]), (7, [-1.0, 0.0]), (0, [0.02, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in near_vectors(df).collect())
    assert got == sorted([(1, 3, 1, True), (1, 1, 0, False), (2, 3, 1, False), (3, 3, 1, False), (4, 3, 1, False), (5, 2, 5, True),
                          (6, 2, 5, False), (6, 2, 5, False), (7, 0, 7, True), (0, 1, 0, True)])


def test_vector_rows_that_repeat(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (4, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((tuple(r) for r in near_vectors(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (4, 0, 4, True)], key=str)
    assert near_vectors(df.where("false")).count() == 0


def test_search_plan_reaches_its_recall():
    for n in (10, 10_000, 10_000_000):
        bits, rounds, half, need = vectors._plan(n, 0.95)
        assert rounds < 200 and 0 < need <= vectors.LINES and (bits == 0 or n / 2 ** bits < 600)


URLS = ["http://a.example.org/es/1", "https://EXAMPLE.ORG/es", "http://example.org/en/12", "http://x.org", "http://org/", "ftp://b.com/fr/1?x#y", "http://b.com/de/?q", "http://b.com", "no scheme", "", None,
        "http://h.net/en/1", "http://borg/x", "a://b://c.org/z", "http://x.org?y=/", "http://X.Com/FR/1", "http://com/fr/#x"]


def test_urls_follow_rules(spark):
    df = spark.createDataFrame([(i, u, "h", 3) for i, u in enumerate(URLS * 3)], "page_id long, url string, host string, score int")
    for r in judge_urls(df).collect():
        host, path, rule, verdict = brute.url(URLS[r["page_id"] % len(URLS)])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert judge_urls(df.where("false")).count() == 0
    assert {r["verdict"] for r in judge_urls(df.where("page_id = 11")).collect()} == {"allow"}


def test_url_models_tell_their_classes(spark):
    r = random.Random(3)
    good = [f"http://site{r.randrange(99)}.org/story/{r.choice('abc') * 3}-{r.randrange(9999)}" for _ in range(600)]
    bad = [f"http://site{r.randrange(99)}.com/de/casino-win-{r.randrange(9999)}" for _ in range(600)]
    fresh = [(f"http://other{i}.net/story/aaa-{i}", "allow") for i in range(50)] + [(f"http://other{i}.net/de/casino-win-{i}", "block") for i in range(50)]
    df = spark.createDataFrame([(u,) for u in good + bad + [u for u, _ in fresh]], "url string")
    got = {r["url"]: r["verdict"] for r in judge_urls(df).where("rule is null").collect()}
    assert sum(got[u] == v for u, v in fresh) >= 95


TEXTS = ["Hello world, it's 12345 tests!", "  two  spaces\n\nand é日本語 — dash", "", None, "x" * 5000, "The quick brown fox " * 300, "😀 emoji 😀\t\ttab "]


def lengths_of():
    import base64

    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    e = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [len(e.encode_ordinary(t)) if t else 0 for t in TEXTS]


def test_token_lengths_and_report(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS + TEXTS[:2])], "doc_id long, text string, n_tokens int")
    n = lengths_of()
    n += n[:2]
    assert [r["n_tokens"] for r in token_lengths(df).orderBy("doc_id").collect()] == n
    histogram = length_histogram(df)
    report = length_report(histogram)
    for r in report.collect():
        size = r["n_tokens"]
        assert r["n_docs"] == n.count(size) and r["docs_from"] == sum(x >= size for x in n) and r["tokens_from"] == sum(x for x in n if x >= size)
        assert r["truncated_total"] == sum(min(x, size) for x in n) and r["docs_to"] == sum(x <= size for x in n)
    assert report.count() == len(set(n))
    one = at_limits(histogram, [8, 1000]).first()
    assert (one["total_8"], one["cut_8"], one["total_1000"]) == (sum(min(x, 8) for x in n), sum(x > 8 for x in n), sum(min(x, 1000) for x in n))
    half = quantiles(report, [0.5])
    assert half.columns == ["q_0_5"] and half.first()[0] == sorted(n)[(len(n) + 1) // 2 - 1]
    assert length_report(length_histogram(df.where("false"))).count() == 0


def test_bucket_bounds_are_optimal():
    r = random.Random(1)
    for _ in range(30):
        lengths = np.array(sorted(r.sample(range(1, 60), r.randrange(1, 11))))
        counts = np.array([r.randrange(1, 9) for _ in lengths])

        def cost(bounds):
            return sum(int(c) * (min(b for b in bounds if b >= x) - int(x)) for x, c in zip(lengths, counts))
        for k in (1, 2, 3, 4):
            best = min(cost(set(c) | {int(lengths[-1])}) for c in itertools.combinations([int(x) for x in lengths], min(k, len(lengths)) - 1))
            got = bucket_bounds(lengths, counts, k)
            assert len(got) <= max(k, 1) and got[-1] == lengths[-1] and cost(got) == best


def test_packing(spark):
    r = random.Random(2)
    texts = TEXTS + ["word " * r.randrange(1, 400) for _ in range(80)]
    df = spark.createDataFrame([(None if i == 3 else i, t, 1) for i, t in enumerate(texts + texts[:1])], "doc_id long, text string, piece int").repartition(3)
    out = pack(df, max_length=200, buckets=4, budget=500).collect()
    size = {r["doc_id"]: r["n_tokens"] for r in token_lengths(df).where("doc_id > 0").collect()}
    for doc, n in size.items():
        pieces = sorted((r["piece"], r["n_tokens"]) for r in out if r["doc_id"] == doc)
        assert sum(x for _, x in pieces) == n and [p for p, _ in pieces] == list(range(max(1, -(-n // 200))))
        assert all(x == 200 for _, x in pieces[:-1])
    placed = [r for r in out if r["n_tokens"]]
    assert all(r["padding"] == r["bucket_length"] - r["n_tokens"] >= 0 for r in placed) and len({r["bucket_length"] for r in placed}) <= 4
    for b in {r["bucket_length"] for r in placed}:
        room, own = max(1, 500 // b), [r for r in placed if r["bucket_length"] == b]
        assert sorted(r["batch"] * room + r["slot"] for r in own) == list(range(len(own)))
    assert all(r["batch"] is None for r in out if not r["n_tokens"])
    assert pack(df.where("false")).count() == 0


def labelled(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_quality_on_held_out_labels(spark):
    docs, labels = labelled(spark, "/root/testdata/sf0.1")
    test = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0
    model = quality.train(docs, labels.where(~test))
    got = quality.score(docs, model, carry=["doc_id"]).join(labels.where(test), "doc_id").withColumn("bad", (F.col("quality") == 0) | (F.col("toxic") == 1))
    n = {(r["bad"], r["rejected"]): r["n"] for r in got.groupBy("bad", "rejected").agg(F.count("*").alias("n")).collect()}
    assert n[(True, True)] / (n[(True, True)] + n.get((True, False), 0)) > 0.9
    assert n[(False, False)] / (n[(False, False)] + n.get((False, True), 0)) > 0.98


def test_quality_edges(spark, sf):
    docs, labels = labelled(spark, sf)
    odd = spark.createDataFrame([(None, None, None, None, None), (900001, "", "en", "s", 0), (900002, "word " * 50000, None, "s", None)], docs.schema)
    more = docs.union(odd).withColumn("rejected", F.lit("x")).withColumn("meta_slots", F.lit(1))
    out = quality.drop_rejected(more, labels.union(labels).union(spark.createDataFrame([(None, None, None)], labels.schema)))
    assert out.columns == more.columns and out.where("text is null or text = ''").count() == 0
    none = quality.score(docs, quality.train(docs, labels.where("false")))
    assert none.where("rejected").count() == 0
    assert quality.score(docs.where("false"), quality.train(docs.where("false"), labels)).count() == 0


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    ids = {r[0] for r in docs.select("doc_id").collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = corpus_pipeline.staged(stage(spark, docs, sf), "test")
        if i == 4:
            break
        assert docs.columns == columns, name
        kept = [r[0] for r in docs.select("doc_id").collect()]
        assert len(kept) == len(set(kept)) and set(kept) <= ids
        ids = set(kept)
        texts = [tuple(r) for r in before.select("doc_id", "text").collect()]
        if i == 1:
            assert ids == {d for d, _, _, k in brute.near(texts, 5) if k}
        if i == 2:
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert ids == {r[0] for r in brute.contamination(texts, items) if not r[-1]}
    assert {r[0] for r in docs.select("doc_id").collect()} == ids
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_registered_queries(spark, sf):
    import __spark_entry__ as entry
    names = [k for k in entry.queries() if k.startswith("op") or k == "pipeline"]
    assert len(names) == 11


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_an_empty_table(spark, sf, stage):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    assert corpus_pipeline.STAGES[stage][1](spark, docs, sf).count() == 0


def test_queries_equal_their_sql(spark, sf):
    import duckdb

    import __spark_entry__ as entry
    from tools.check_oracle import compare
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for key, sql in entry.LLM_ORACLES.items():
        sdf = entry.queries()[key](spark, sf)
        res = con.execute(sql)
        assert compare([tuple(r) for r in sdf.collect()], sdf.columns, res.fetchall(), [d[0] for d in res.description]) is None, key
