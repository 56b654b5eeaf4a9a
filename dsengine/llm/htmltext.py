"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of its block elements with the runs of text between block
bounds as leaves; inline elements are transparent. Every node is in one of three
states: boilerplate, content, or a mix of both (an element around content; leaves
are never mixed). Potentials join a node's state with its features (name, hint words
in class, id and role; for text its length, share of links, sentence marks and the
block it stands in) and with its parent's state, by kind of child. Sum-product
messages run up and down all trees of a batch, level by level (numpy), and the
leaves whose content marginal is a half or more are the text.

Potentials are trained from labelled pages by the same messages (gradient: observed
minus expected counts). Labelled are pages of the table whose markup names the main
part (``article``, else ``main``): at most ``SAMPLE`` of them, the first different
ones in hash order, and of at most ``NODES`` nodes; and a few pages labelled by hand
for parts that the table lacks, which weigh as much in all. Each counts once as it
is and once, for less, with names and hints blanked, so that plain ``div`` pages can
be read too. All pages of the table are then read in a narrow map.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dsengine.llm.common import small_batches
from dsengine.llm.labelled_pages import PAGES

# Fixed values of the markup language.
BLOCKS = ("html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
          "header hgroup hr li main menu nav ol p pre search section summary table caption colgroup thead tbody tfoot tr td th ul").split()
RAW = ("script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp")
CONTROLS = ("button", "select", "svg", "math", "template", "object", "audio", "video", "canvas", "datalist", "noscript")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: start tag -> open elements it ends, and elements that shield them
ENDS = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)),
        "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
        "thead": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)), "tbody": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
        "tfoot": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)), "body": (("head",), ("html",))}
BESIDE = ("nav", "aside", "footer", "header", "form", "menu", "dialog", "search", "head")
BESIDE_WORDS = frozenset("ad ads adslot advert advertisement advertising banner bio breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies copyright disqus "
                         "footer form gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted recommended "
                         "related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar topbar widget".split())
MAIN_WORDS = frozenset("article articlebody body content entry main post story text".split())
#: names that a blanked copy keeps
PLAIN = frozenset("html head body p li ul ol dl dt dd pre blockquote table tr td th".split() + list(HEADINGS))

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|style|data-c)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|\b(hidden)\b""", re.I)
WORD = re.compile(r"[a-z]+")
CLOSERS = {t: re.compile(f"</{t}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I) for t in RAW + CONTROLS}
BLOCK = frozenset(BLOCKS)

# Features: block name, hint; leaf: block it stands in, length, links, sentence marks.
TAG = {t: i for i, t in enumerate(BLOCKS)}
HINT, UNDER = len(TAG), len(TAG) + 4
LENGTH, LINKS, MARKS, N_FEATURES = UNDER + len(TAG), UNDER + len(TAG) + 14, UNDER + len(TAG) + 18, UNDER + len(TAG) + 20
BESIDE_STATE, CONTENT, MIXED = 0, 1, 2
#: Labelled pages of the table that train at most, nodes of one at most.
SAMPLE, NODES = 400, 5000
#: Share that a blanked copy counts; steps of the fit, their size, pull towards zero.
BLANKED, STEPS, RATE, PULL = 0.25, 200, 0.1, 1e-4
FLOOR = -50.0


def _hint(attributes: str) -> tuple[int, int]:
    """Hint of class, id and role words (1 beside, 2 main, 3 both), and the hand label."""
    hint, label = 0, -1
    for m in ATTRIBUTE.finditer(attributes):
        if m[3]:
            hint |= 1
            continue
        name, value = m[1].lower(), m[2].strip("\"'").lower()
        if name == "data-c":
            label = int(value)
        elif name == "style":
            hint |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        else:
            found = set(WORD.findall(value))
            hint |= (not found.isdisjoint(BESIDE_WORDS)) | 2 * (not found.isdisjoint(MAIN_WORDS))
    return hint, label


class Page:
    """Nodes of one page in document order: name (-1 for text), hint, hand label, parent; texts of the leaves."""

    __slots__ = ("tag", "hint", "label", "parent", "texts", "links")

    def __init__(self, source: str):
        self.tag, self.hint, self.label, self.parent, self.texts, self.links = [0], [0], [-1], [-1], {}, {}
        stack, count, missing = [0], {"html": 1}, set()
        run, linked, link, at, pos = [], 0, False, 0, 0

        def flush():
            nonlocal run, linked
            if run:
                text = " ".join("".join(run).split())
                if text:
                    i = len(self.tag)
                    self.tag.append(-1), self.hint.append(0), self.label.append(-1), self.parent.append(stack[-1])
                    self.texts[i], self.links[i] = text, min(1.0, linked / len(text))
                run, linked = [], 0

        def text(piece):
            nonlocal linked
            if "&" in piece:
                piece = entities.unescape(piece)
            run.append(piece)
            if link:
                linked += len(piece.strip())

        def pop():
            name = BLOCKS[self.tag[stack.pop()]]
            count[name] -= 1

        while True:
            m = TOKEN.search(source, pos)
            if m is None:
                break
            if m.start() > at:
                text(source[at:m.start()])
            at = pos = m.end()
            name = m[2]
            if name is None:
                continue
            name, end = name.lower(), m[1]
            if name in BLOCK:
                if end:
                    if name in ("html", "body"):
                        continue
                    names = HEADINGS if name in HEADINGS else (name,)
                    if any(count.get(x) for x in names):
                        flush()
                        link = False
                        while BLOCKS[self.tag[stack[-1]]] not in names:
                            pop()
                        pop()
                    continue
                flush()
                if name == "html" or name == "hr":
                    continue
                if BLOCKS[self.tag[stack[-1]]] == "p" or name in HEADINGS and BLOCKS[self.tag[stack[-1]]] in HEADINGS:
                    pop()
                if name in ENDS:
                    ended, shields = ENDS[name]
                    if any(count.get(x) for x in ended):
                        for depth in range(len(stack) - 1, 0, -1):
                            above = BLOCKS[self.tag[stack[depth]]]
                            if above in shields:
                                break
                            if above in ended:
                                while len(stack) > depth:
                                    pop()
                                break
                hint, label = _hint(m[3]) if m[3] and name != "body" else (0, -1)
                self.tag.append(TAG[name]), self.hint.append(hint), self.label.append(label), self.parent.append(stack[-1])
                stack.append(len(self.tag) - 1)
                count[name] = count.get(name, 0) + 1
            elif name in CLOSERS and not end and name not in missing:
                close = CLOSERS[name].search(source, pos)
                if close:
                    at = pos = close.end()
                elif name in RAW:
                    at = len(source)
                    break
                else:
                    missing.add(name)
            elif name == "br":
                run.append(" ")
            elif name == "a":
                link = not end
        if at < len(source):
            text(source[at:])
        flush()


class Trees:
    """Trees as arrays: each node's parent (-1 at a root) and whether it is a leaf."""

    def __init__(self, parent: np.ndarray, leaf: np.ndarray):
        self.parent, self.leaf, self.levels = parent, leaf, []
        level, order = np.flatnonzero(parent < 0), np.argsort(parent, kind="stable")
        bound = np.searchsorted(parent[order], np.arange(-1, len(parent) + 1))
        while len(level):
            self.levels.append(level)
            lo, hi = bound[level + 1], bound[level + 2]
            size = hi - lo
            level = order[np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())]

    def messages(self, emit: np.ndarray, move: np.ndarray, pairs: bool = False):
        """State probabilities of every node and, if asked, of every (parent, child)
        in the order of the levels: sum-product up and down."""
        up = emit.copy()
        up[self.leaf, MIXED] = FLOOR
        kind, sent, joint = self.leaf.astype(np.int64), np.zeros_like(up), []
        for level in reversed(self.levels[1:]):
            sent[level] = _sum(move[kind[level]] + up[level][:, None, :], 2)
            np.add.at(up, self.parent[level], sent[level])
        belief = up.copy()
        for level in self.levels[1:]:
            rest = belief[self.parent[level]] - sent[level]
            rest -= rest.max(1, keepdims=True)
            both = move[kind[level]] + rest[:, :, None]
            belief[level] += _sum(both, 1)
            if pairs:
                joint.append(_share((both + up[level][:, None, :]).reshape(-1, 9)))
        return _share(belief), joint


class Forest(Trees):
    """The nodes of many pages as arrays."""

    def __init__(self, pages: list[Page]):
        sizes = [len(p.tag) for p in pages]
        self.first = np.cumsum([0] + sizes)
        n = int(self.first[-1])
        self.tag = np.fromiter((t for p in pages for t in p.tag), np.int64, n)
        self.hint = np.fromiter((t for p in pages for t in p.hint), np.int64, n)
        self.label = np.fromiter((t for p in pages for t in p.label), np.int64, n)
        parent = np.fromiter((t for p in pages for t in p.parent), np.int64, n)
        super().__init__(np.where(parent < 0, -1, parent + np.repeat(self.first[:-1], sizes)), self.tag < 0)
        self.leaves = np.flatnonzero(self.leaf)
        self.texts = [t for p in pages for t in p.texts.values()]
        self.links = np.fromiter((x for p in pages for x in p.links.values()), np.float64, len(self.texts))

    def features(self, blank: bool = False) -> np.ndarray:
        """Feature numbers of every node, four columns; N_FEATURES for none."""
        tag, hint = np.maximum(self.tag, 0), self.hint
        if blank:
            plain = np.array([t in PLAIN for t in BLOCKS])
            tag, hint = np.where(plain[tag], tag, TAG["div"]), np.zeros_like(hint)
        out = np.full((len(tag), 4), N_FEATURES)
        block = ~self.leaf
        out[block, 0], out[block, 1] = tag[block], HINT + hint[block]
        if len(self.leaves):
            size = np.array([len(t) for t in self.texts])
            marks = np.array([any(c in t for c in ".!?") for t in self.texts])
            out[self.leaves, 0] = UNDER + tag[self.parent[self.leaves]]
            out[self.leaves, 1] = LENGTH + np.minimum(np.log2(size + 1).astype(np.int64), 13)
            out[self.leaves, 2] = LINKS + np.searchsorted([0.01, 0.34, 0.67], self.links)
            out[self.leaves, 3] = MARKS + marks
        return out

    def states(self, given: np.ndarray) -> np.ndarray:
        """States that follow from marked nodes (1 content, 0 beside, -1 unmarked)."""
        holds = given == CONTENT
        for level in reversed(self.levels[1:]):
            np.logical_or.at(holds, self.parent[level], holds[level])
        state = np.where(holds, MIXED, BESIDE_STATE)
        for level in self.levels:
            up = np.where(self.parent[level] < 0, MIXED, state[self.parent[level]])
            state[level] = np.where(up == BESIDE_STATE, BESIDE_STATE, np.where(given[level] >= 0, given[level], np.where(up == CONTENT, CONTENT, state[level])))
        return state

    def named(self) -> tuple[np.ndarray, np.ndarray]:
        """Marks from the markup, and the pages that have any content so marked."""
        n, names = len(self.tag), np.array([t in BESIDE for t in BLOCKS] + [False])
        page = np.searchsorted(self.first, np.arange(n), "right") - 1
        is_article = self.tag == TAG["article"]
        has = np.zeros(len(self.first) - 1, bool)
        has[page[is_article]] = True
        main = is_article | (self.tag == TAG["main"]) & ~has[page]
        beside = names[self.tag] | ~main & (self.hint == 1) | is_article & (self.hint == 1)
        given = np.where(beside, BESIDE_STATE, np.where(main, CONTENT, -1))
        around = main & ~beside
        for level in reversed(self.levels[1:]):
            np.logical_or.at(around, self.parent[level], around[level])
        given[around & (given == BESIDE_STATE) & ~names[self.tag]] = -1  # a hint on what holds the main part
        ok = np.zeros(len(has), bool)
        ok[page[(given == CONTENT)]] = True
        return given, ok[page]

    def content(self, model: dict[str, np.ndarray]) -> np.ndarray:
        """Probability of content of every node."""
        return self.messages(model["emit"][self.features()].sum(1), model["move"])[0][:, CONTENT]


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


def _share(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


LABELLED = "parent array<int>, leaf array<boolean>, state array<int>, named array<int>, blank array<int>"


def _label(batches):
    """Trees, states and features of the pages whose markup names their main part."""
    for batch in batches:
        rows = []
        for source in batch["text"].to_pylist():
            forest = Forest([Page(source or "")])
            given, ok = forest.named()
            if ok.all() and len(forest.tag) <= NODES:
                rows.append({"parent": forest.parent.tolist(), "leaf": forest.leaf.tolist(), "state": forest.states(given).tolist(),
                             "named": forest.features().ravel().tolist(), "blank": forest.features(True).ravel().tolist()})
        kind = pa.list_(pa.int32())
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("parent", kind), ("leaf", pa.list_(pa.bool_())), ("state", kind), ("named", kind), ("blank", kind)]))


def fit(trees: Trees, feature: np.ndarray, state: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Potentials that raise the weighted likelihood of ``state``."""
    emit, move = np.zeros((N_FEATURES + 1, 3)), np.zeros((2, 3, 3))
    child = np.concatenate(trees.levels[1:]) if len(trees.levels) > 1 else np.zeros(0, np.int64)
    pair = trees.leaf[child] * 9
    weight = weight / weight.sum()
    flat = feature.ravel()

    def totals(one, both):
        w = one * weight[:, None]
        e = np.stack([np.bincount(flat, np.repeat(w[:, k], feature.shape[1]), N_FEATURES + 1) for k in range(3)], 1)
        e[N_FEATURES] = 0
        w = both * weight[child][:, None]
        return e, np.stack([np.bincount(trees.leaf[child], w[:, k], 2) for k in range(9)], 1).reshape(2, 3, 3)
    seen = totals(np.eye(3)[state], np.eye(9)[state[trees.parent[child]] * 3 + state[child]])
    first, second = [np.zeros_like(emit), np.zeros_like(move)], [np.zeros_like(emit), np.zeros_like(move)]
    for step in range(1, STEPS + 1):
        one, both = trees.messages(emit[feature].sum(1), move, True)
        want = totals(one, np.concatenate(both) if both else np.zeros((0, 9)))
        for i, value in enumerate((emit, move)):
            g = seen[i] - want[i] - PULL * value
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            value += RATE * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.99 ** step)) + 1e-8)
    return {"emit": emit, "move": move}


def train(pages: DataFrame, html: str = "html") -> dict[str, np.ndarray]:
    """Potentials from the labelled pages of the table and those labelled by hand.
    The driver holds ``SAMPLE`` trees of at most ``NODES`` nodes."""
    small_batches(pages.sparkSession)
    src = pages.select(F.col(f"`{html}`").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    least = src.groupBy("h").agg(F.lit(1)).orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    rows = []
    if least is not None:
        some = src.where(F.col("h") <= least).groupBy("h").agg(F.min("text").alias("text"))
        rows = some.orderBy("h").select("text").mapInArrow(_label, LABELLED).collect()
    hand = Forest([Page(p) for p in PAGES])
    found = [(np.array(r["parent"]), np.array(r["leaf"]), np.array(r["state"]), np.array(r["named"]).reshape(-1, 4), np.array(r["blank"]).reshape(-1, 4)) for r in rows]
    there = sum(len(x[0]) for x in found)
    each = len(hand.tag) / there if there else 0.0
    found = [(hand.parent, hand.leaf, hand.states(hand.label), hand.features(), hand.features(True))] + found
    parts, at = [], 0
    for i, (parent, leaf, state, *features) in enumerate(found):
        for feature, share in zip(features, (1.0, BLANKED)):
            parts.append((np.where(parent < 0, -1, parent + at), leaf, state, feature, np.full(len(leaf), share * (each if i else 1.0))))
            at += len(leaf)
    parent, leaf, state, feature, weight = (np.concatenate(x) for x in zip(*parts))
    return fit(Trees(parent, leaf), feature, state, weight)


def main_text(sources: list[str], model: dict[str, np.ndarray]) -> list[str]:
    forest = Forest([Page(s) for s in sources])
    keep = forest.content(model)[forest.leaves] >= 0.5
    page = np.searchsorted(forest.first, forest.leaves, "right") - 1
    out: list[list[str]] = [[] for _ in sources]
    for i in np.flatnonzero(keep):
        out[page[i]].append(forest.texts[i])
    return ["\n".join(x) for x in out]


def extract(pages: DataFrame, model: dict[str, np.ndarray], html: str = "html") -> DataFrame:
    """All columns of ``pages`` in a struct ``row``, and ``text``: the main text,
    blocks in page order joined by a line break, character references decoded,
    white space inside a block as one space. Null, empty and textless pages give an
    empty text; a page is read whole, however long; rows that repeat give equal rows.
    A tag that the page's end cuts off is dropped."""
    small_batches(pages.sparkSession)
    kept = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != html] or [F.lit(None).cast("int").alias("none")]).alias("row"), F.col(f"`{html}`").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            texts = main_text([t or "" for t in batch["text"].to_pylist()], model)
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(texts, pa.string())], names=["row", "text"])

    return kept.mapInArrow(run, kept.schema)
