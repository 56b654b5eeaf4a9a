"""Page trees, messages against enumeration, and text on pages the model has not seen."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from dsengine.llm import htmltext
from dsengine.llm.htmltext import Forest, Page, extract, main_text, train
from dsengine.llm.labelled_pages import PAGES

BODY = "The quick fox went over the hill, and nobody saw it again. It was late in the year."


@pytest.fixture(scope="module")
def model(spark, sf):
    return train(spark.read.parquet(f"{sf}/pages.parquet"))


def blocks(source):
    p = Page(source)
    return [(htmltext.BLOCKS[p.tag[p.parent[i]]], t) for i, t in p.texts.items()]


@pytest.mark.parametrize("source,want", [
    ("", []), ("plain", [("html", "plain")]), ("a<b>c</b> d\n\t e", [("html", "ac d e")]),
    ("<p>one<p>two</p>three", [("p", "one"), ("p", "two"), ("html", "three")]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", [("li", "a"), ("li", "b"), ("li", "c"), ("li", "d")]),
    ("<script>var t='</p><p>x';</script><style>p{}</style><p>y", [("p", "y")]),
    ("<p>a &amp; b &lt;c&gt; &#233;&eacute;&nbsp;z &am", [("p", "a & b <c> éé z &am")]),
    ("<p title='a>b' data-x=\"</p>\">x</p><!-- <p>no</p> -->y<!-- open <p>z", [("p", "x"), ("html", "y")]),
    ("<table><tr><td>1<td>2<tr><td>3</table>after", [("td", "1"), ("td", "2"), ("td", "3"), ("html", "after")]),
    ("<h1>T</h2><P>x<BR>y</P></div></p><p>cut <a href=\"/x", [("h1", "T"), ("p", "x y"), ("p", "cut")]),
    ("<button>go<p>rest", [("html", "go"), ("p", "rest")]), ("x < y <3 <p>z", [("html", "x < y <3"), ("p", "z")]),
    ("<p class=a\">q</p><svg><p>no</p></svg>r", [("p", "q"), ("html", "r")]),
])
def test_trees(source, want):
    assert blocks(source) == want


def test_messages_equal_enumeration(model):
    forest = Forest([Page(f"<div class=nav><p><a href=x>Home</a></div><div><h1>T</h1><p>{BODY}</div>"), Page("<p>x")])
    p = forest.content(model)
    emit = model["emit"][forest.features()].sum(1)
    for page in range(2):
        nodes = range(forest.first[page], forest.first[page + 1])
        total = np.zeros((len(nodes), 3))
        for states in itertools.product(range(3), repeat=len(nodes)):
            s = dict(zip(nodes, states))
            score = sum(emit[i, s[i]] if not (forest.leaf[i] and s[i] == 2) else htmltext.FLOOR for i in nodes)
            score += sum(model["move"][int(forest.leaf[i]), s[forest.parent[i]], s[i]] for i in nodes if forest.parent[i] >= 0)
            for k, i in enumerate(nodes):
                total[k, s[i]] += np.exp(score)
        want = total[:, 1] / total.sum(1)
        assert np.allclose(p[list(nodes)], want, atol=1e-9)


def plain_of(source):
    """The same page without any telling name."""
    source = re.sub(r"<(/?)(article|nav|footer)>", r"<\1div>", source)
    return source.replace('<div class="ad">', "<div>")


def test_pages_without_names(spark, model):
    """Held out: the small table trained the model, another one is read, and no
    name or class tells what is what."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    want = main_text(pages, model)
    got = main_text([plain_of(p) for p in pages], model)
    same = missing = extra = total = 0
    for w, g in zip(want, got):
        w, g = w.split("\n"), g.split("\n")
        total += len(w)
        missing += len([x for x in w if x not in g])
        extra += len([x for x in g if x and x not in w])
    assert missing < 0.1 * total and extra < 0.1 * total, (missing, extra, total)


def test_labelled_pages_are_read_as_labelled(model):
    forest = Forest([Page(p) for p in PAGES])
    want = forest.states(forest.label)[forest.leaves] == htmltext.CONTENT
    got = forest.content(model)[forest.leaves] >= 0.5
    assert (want == got).mean() > 0.97


@pytest.mark.parametrize("source,want", [
    (f"<body><header><h2>Site</h2></header><nav><a href=/>Home</a></nav><article><h1>T</h1><p>{BODY}</p><aside><p>{BODY}</p></aside></article><footer>(c) x</footer>", f"T\n{BODY}"),
    (f"<div class='cookie-banner'><p>{BODY}</p></div><main><h1>T</h1><p>{BODY} One.</p><p>{BODY}</p></main><div id=comments><div class=comment><p>{BODY}</p></div></div>", f"T\n{BODY} One.\n{BODY}"),
    (f"<article><p>{BODY}</p><form><label>Mail</label><p>{BODY}</p></form><section class=comments><p>{BODY}</p></section></article>", BODY),
    (f"<article><p>{BODY}</p><div class='ad'><p>{BODY}</p></div><p>No.</p></article>", f"{BODY}\nNo."),
])
def test_unseen_shapes(model, source, want):
    assert main_text([source], model) == [want]


def test_rows_of_any_kind(spark, model):
    long = "<article>" + "<p>" + BODY * 3000 + "</p>" + "<div>" * 3000 + "deep</article>"
    rows = [(1, None, "u"), (2, "", "u"), (None, f"<article><p>{BODY}</article>", None), (2, "", "u"), (5, long, "x")]
    df = spark.createDataFrame([(i, h, u, "t", 1) for i, h, u in rows], "page_id long, html string, url string, text string, row int").repartition(3)
    got = sorted(((r["row"]["page_id"] or 0, r["row"]["text"], r["row"]["row"], r["text"]) for r in extract(df, model).collect()))
    assert [x[:3] for x in got] == [(0, "t", 1), (1, "t", 1), (2, "t", 1), (2, "t", 1), (5, "t", 1)]
    assert [x[3] for x in got[:4]] == [BODY, "", "", ""] and got[4][3].startswith((BODY * 3000).strip())
    assert extract(df.where("false"), model).count() == 0
    assert set(train(df.where("false"))) == {"move", "emit"}


def test_training_does_not_depend_on_partitions(spark, sf, model):
    other = train(spark.read.parquet(f"{sf}/pages.parquet").repartition(7))
    assert all(np.array_equal(model[k], other[k]) for k in model)
    assert spark.range(1).select(F.lit(1)).count() == 1
