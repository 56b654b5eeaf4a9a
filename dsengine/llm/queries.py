"""Driver keys of the training-data operators, one per operator, each over its
whole table with production parameters. The queries derive the digest columns
that the contract names from the operators' own outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dsengine.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_LOW = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all({text}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_REACHED = """
far AS (SELECT {id} AS a, {id} AS b FROM {of} UNION SELECT far.a, l.b FROM far JOIN (SELECT a, b FROM link UNION SELECT b, a FROM link) l ON far.b = l.a),
comp AS (SELECT a, min(b) AS c FROM far GROUP BY a)"""

_NEAR_DOCS = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_LOW.format(text="coalesce(text, '')"))} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
{_REACHED.format(id="doc_id", of="documents")}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept FROM documents d JOIN comp ON d.doc_id = a LEFT JOIN size ON size.doc_id = d.doc_id"""


@register("op7_minhash_near_dedup", _NEAR_DOCS)
def op7(spark, sf_dir):
    from dsengine.llm.minhash import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"), width=4).select("doc_id", "n_shingles", "component_id", "kept")


_CONTAMINATED = f"""
WITH dw AS (SELECT doc_id, {_ALNUM.format(text=_LOW.format(text="coalesce(text, '')"))} AS ws FROM documents),
iw AS (SELECT item_id, {_ALNUM.format(text=_LOW.format(text="coalesce(text, '')"))} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i:i + 12], ' ') AS s
        FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 11, 2))) AS i FROM iw WHERE len(ws) > 0)),
placed AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS s
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)),
met AS (SELECT placed.*, item_id FROM placed JOIN win USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS h FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS k, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS STRING) AS item FROM met) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(h, 0) AS n_hit, coalesce(k, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(h, 0) > 0 AND 20 * coalesce(h, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)"""


@register("op8_benchmark_decontamination", _CONTAMINATED)
def op8(spark, sf_dir):
    from dsengine.llm.decontaminate import match_benchmark
    found = match_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


_SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
least_doc AS (SELECT s, min(doc_id) AS d FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT win.doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN least_doc USING (s) WHERE d < win.doc_id)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)"""


@register("op10_substring_dedup", _SUBSTRINGS)
def op10(spark, sf_dir):
    from dsengine.llm.substrings import dedup_substrings
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@register("op3_token_counts")
def op3(spark, sf_dir):
    from dsengine.llm.lengths import length_histogram, length_report
    return length_report(length_histogram(table(spark, sf_dir, "documents")))


@register("op4_secret_scans")
def op4(spark, sf_dir):
    from dsengine.llm.secrets import find_secrets, span_text
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), carry=["doc_id"])
    base = F.filter("findings", lambda x: x.kind != "live")

    def n(kind):
        return F.size(F.filter("findings", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"), span_text(F.col("findings")).alias("spans"),
                        n("live"), F.size(F.filter("findings", lambda x: x.live)).cast("long").alias("n_owner_specific"))


@register("op5_sharding")
def op5(spark, sf_dir):
    from dsengine.llm.sharding import shard_documents
    return shard_documents(table(spark, sf_dir, "documents"))


@register("op6_packing")
def op6(spark, sf_dir):
    from dsengine.llm.packing import pack
    return pack(table(spark, sf_dir, "documents"))


@register("op9_url_filters")
def op9(spark, sf_dir):
    from dsengine.llm.urls import judge_urls
    return judge_urls(table(spark, sf_dir, "pages"), carry=["page_id"]).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


_NEAR_VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.95),
{_REACHED.format(id="vec_id", of="v")},
n AS (SELECT a, count(*) AS n FROM (SELECT a FROM link UNION ALL SELECT b FROM link) GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM v JOIN comp ON vec_id = comp.a LEFT JOIN n ON vec_id = n.a"""


@register("op2_embedding_near_dedup", _NEAR_VECTORS)
def op2(spark, sf_dir):
    from dsengine.llm.vectors import near_vectors
    return near_vectors(table(spark, sf_dir, "embeddings"))


@register("op1_quality_classifier")
def op1(spark, sf_dir):
    from dsengine.llm.quality import score, train
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")), carry=["doc_id"])


_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
met AS (SELECT x.vec_id AS anchor_id, y.vec_id AS other, x.label = y.label AS same, CAST(list_dot_product(x.q, y.q) AS BIGINT) AS score
        FROM v x JOIN v y ON x.vec_id % 100 = 0 AND x.vec_id <> y.vec_id),
pos AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM met WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
neg AS (SELECT pos.anchor_id, positive_id, other AS negative_id, positive_score, score AS negative_score,
        row_number() OVER (PARTITION BY pos.anchor_id, positive_id ORDER BY score DESC, other) AS rank
        FROM pos JOIN met ON pos.anchor_id = met.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 10"""


@register("op13_hard_negatives", _NEGATIVES)
def op13(spark, sf_dir):
    from dsengine.llm.negatives import hard_negatives
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    q = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * 256))
    return hard_negatives(table(spark, sf_dir, "embeddings"), label, q, F.col("vec_id") % 100 == 0)


@register("op12_spelling_variants")
def op12(spark, sf_dir):
    from dsengine.llm.spelling import variants
    return variants(table(spark, sf_dir, "documents"))


_MAIN_TEXT = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)', 1) AS h FROM pages),
b AS (SELECT page_id, url, regexp_replace(h, '(?s)(</article>|<footer>).*', '') AS h FROM a),
piece AS (SELECT page_id, url, unnest(string_split_regex(h, '</?(?:h1|p)>')) AS t, generate_subscripts(string_split_regex(h, '</?(?:h1|p)>'), 1) AS i FROM b),
plain AS (SELECT page_id, url, i, regexp_replace(t, '<br>', ' ', 'g') AS t FROM piece),
clean AS (SELECT page_id, url, i, regexp_replace(regexp_replace(t, '<[^>]*(>|$)', '', 'g'), '&quot;?', '"', 'g') AS t FROM plain),
seen AS (SELECT page_id, url, i, regexp_replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&#x27;', ''''), '&#39;', ''''), '&amp;?', '&', 'g') AS t FROM clean),
block AS (SELECT page_id, i, trim(regexp_replace(t, '\s+', ' ', 'g')) AS t FROM seen),
whole AS (SELECT page_id, string_agg(t, chr(10) ORDER BY i) AS t FROM block WHERE t <> '' GROUP BY 1)
SELECT page_id, url, coalesce(t, '') AS text, CAST(length(coalesce(t, '')) AS BIGINT) AS n_chars FROM pages LEFT JOIN whole USING (page_id)"""


@register("op11_html_extraction", _MAIN_TEXT)
def op11(spark, sf_dir):
    from dsengine.llm.htmltext import extract, train
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages)).select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))
