"""Operators do the whole job, at any size."""

import math
import random
from collections import Counter

from dsengine.llm import quality, urls
from dsengine.llm.decontaminate import decontaminate
from dsengine.llm.secrets import find_secrets, redact


def url_scores(ruled, asked, order=6, strength=4.0):
    """Score of each text by exact counts of (text, good)."""
    end, counts, total = b"\xff", (Counter(), Counter()), [0, 0]
    for text, good in ruled:
        data = text.encode() + end
        total[good] += len(data)
        for i in range(len(data)):
            counts[good].update(data[i - k:i + 1] for k in range(min(i + 1, order)))
    out = []
    for text in asked:
        data, score = text.encode() + end, 0.0
        for i in range(len(data)):
            for side, sign in ((1, 1), (0, -1)):
                p = 1 / 256
                for k in range(min(i + 1, order)):
                    seen = counts[side][data[i - k:i]] if k else total[side]
                    p = (counts[side][data[i - k:i + 1]] + strength * p) / (seen + strength)
                score += sign * math.log(p)
        out.append(score / len(data))
    return out


def ruled_urls(spark):
    r = random.Random(4)
    texts = [f"http://{r.choice('abcdé')}{r.randrange(999)}.{r.choice(['org/s', 'com/de/x', 'net/q'])}{r.randrange(1 << 30):x}" for _ in range(800)]
    pages = spark.createDataFrame([(u,) for u in [*texts, *texts[:9], None, ""]], "url string").repartition(5)
    return pages, [row.asDict() for row in urls.judge_urls(pages).collect()]


def test_url_scores_are_of_exact_counts(spark, monkeypatch):
    monkeypatch.setattr(urls, "BLOCK", 2000, raising=False)
    _, got = ruled_urls(spark)
    assert len(got) == 811
    texts = [r["host"] + r["path"] for r in got]
    ruled = [(t, r["verdict"] == "allow") for t, r in zip(texts, got) if r["rule"]]
    for r, want in zip(got, url_scores(ruled, texts)):
        assert abs(r["score"] - want) < 1e-9


def test_classifier_learns_from_all_unlabelled_documents(spark):
    r = random.Random(8)
    plain = [f"word{i}" for i in range(400)]
    docs = []
    for i in range(24000):
        spam = r.random() < (0.4 if i < 800 else 0.05)
        words = r.sample(plain, 12) + (["cheap", "pills"] if spam and r.random() < 0.9 else [])
        docs.append((i, " ".join(words), "farm" if spam else f"site{i % 5}", spam))
    # from the farm without a word that labels know, and one such text elsewhere
    rare = ["zorgly", "quxine", "blentor"]
    docs += [(30000 + i, " ".join(r.sample(plain, 12) + rare), "farm", True) for i in range(14)]
    frame = spark.createDataFrame([d[:3] for d in docs], "doc_id long, text string, source string").repartition(4)
    labels = spark.createDataFrame([(d[0], int(not d[3]), 0) for d in docs[:800]], "doc_id long, quality int, toxic int")
    model = quality.train(frame, labels)
    (weights, _), _ = model["low_quality"][0]
    slots, _ = quality.text_features(quality.pa.array(rare))
    assert (weights[slots] > 0).sum() >= len(rare)
    asked = [(i, " ".join(r.sample(plain, 12) + (rare if i < 40 else [])), "site1") for i in range(80)]
    p = {x["doc_id"]: x["p_low_quality"] for x in quality.score(spark.createDataFrame(asked, frame.schema), model).collect()}
    assert min(p[i] for i in range(40)) > max(p[i] for i in range(40, 80))


def test_long_random_strings_are_secrets(spark):
    r = random.Random(5)
    keys = ["".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n)) for n in (512, 513, 1600, 200_000)]
    docs = [(i, f"the key {key} is here", f"owner{i}/repo") for i, key in enumerate(keys)]
    docs += [(10 + i, f"all have {keys[2][::-1]}", f"owner{i}/repo") for i in range(3)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    found = {x["doc_id"]: [(f["kind"], f["start"], f["end"], f["n_owners"]) for f in x["findings"]] for x in find_secrets(frame).collect()}
    masked = {x["doc_id"]: x["text"] for x in redact(frame).collect()}
    for i, key in enumerate(keys):
        assert found[i] == [("live", 8, 8 + len(key), 1)] and masked[i] == "the key [SECRET] is here"
    assert not found[10] and masked[10] == docs[4][1]


def test_short_benchmark_items_are_cut(spark):
    short, long = "What is the capital of Iceland", " ".join(f"item{i}" for i in range(15))
    rest = [f"w{i}" for i in range(700)]
    text = " ".join([*rest[:300], short.upper() + "?", *rest[300:600], long, *rest[600:], "what is the capital of"])
    docs = spark.createDataFrame([(1, text), (2, short)], "doc_id long, text string")
    items = spark.createDataFrame([(1, short), (2, long)], "item_id long, text string")
    for most in (300_000, 20):  # words of the benchmark a pass
        got = decontaminate(docs, items, max_words=most).collect()
        assert [tuple(x) for x in got] == [(1, text.replace(short.upper(), "").replace(long, ""))]


def test_calibration_never_ends_above_the_text_score():
    """Undamped steps diverge on scores that split the classes nearly."""
    import numpy as np

    from dsengine.llm.quality import _mix
    for seed in range(40):
        r = np.random.Generator(np.random.PCG64(seed))
        y = (r.random(200) < 0.1).astype(float)
        x = np.column_stack([np.where(y > 0, 8, -9) * r.uniform(0.1, 3) + r.standard_normal(200) * r.uniform(0.1, 9), r.standard_normal(200) * r.uniform(0, 20)])

        def loss(z):
            return np.logaddexp(0, z).mean() - (y * z).mean()
        w, b = _mix(x, y)
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        assert loss(x @ w + b) <= loss(x[:, 0]) + 1e-9 and np.abs(w).max() < 1e3
        assert abs(p.mean() - y.mean()) < 0.05


def test_sums_of_tasks_do_not_depend_on_partitions(spark, sf):
    """One row a task and head, added in two levels; labels of absent documents take no place."""
    import numpy as np

    from dsengine.llm import quality
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    absent = labels.select((labels.doc_id + 10_000_000).alias("doc_id"), "quality", "toxic")
    models = [quality.train(d, x) for d, x in ((docs.repartition(3), labels), (docs.repartition(60), labels.union(absent)))]
    for t in quality.TARGETS:
        if models[0][t] is not None:
            for (w, b), (u, c) in zip(models[0][t][0], models[1][t][0]):
                assert np.allclose(w, u) and np.isclose(b, c)
