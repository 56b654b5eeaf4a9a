"""Quality classifier by co-training of a text view and a metadata view.

Two targets, low quality and toxic, are learnt from ``labels``. The text view
sees the words, symbol runs and simple statistics of the whole text, the
metadata view the other columns. Both start from the same labelled documents;
in every round each view names the unlabelled documents it is sure of, at
thresholds that keep the wanted precision on held-out labels, and these
pseudo-labels teach the other view. In the end a small logistic model over both
views, fitted on the held-out labels, gives calibrated probabilities, and every
document is scored.

The labelled sample is bounded: at most ``SAMPLE`` documents, the first in the
order of a hash, whole texts. The unlabelled side is every other document: each
round but the first is a pass over all of them, which adds up in Spark, for each
feature, the documents that the other view is sure of on either side. These
class counts select features and set the weight that a feature is drawn to, also
of features that no labelled document has. Models are weights over 2**SLOT_BITS
hashed features, of which at most 2 * ``SELECTED`` differ from zero. Scoring is
a map over all documents, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dsengine.llm import textkernel as K
from dsengine.llm.common import boxed, small_batches, unboxed

U = np.uint64
SAMPLE = 8000
SLOT_BITS, SELECTED = 18, 3000
ROUNDS, PRECISION = 3, 0.95
CHANCE = 12.0  # chi square that a feature has to pass, beyond what the best of all slots reach by chance
HELD_OUT = 4  # one labelled document in so many calibrates
PSEUDO = 0.5  # weight of a pseudo-label
STEPS = 120
LEAST_DOCS = 3  # of a feature in the sample
STEM = 6  # bytes of a word beginning
FAN = 32  # tasks' sums are added in so many groups a head before the last
TARGETS = ("low_quality", "toxic")
META = ("lang", "source", "n_chars")

UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[0x21:0x30] = SYMBOL[0x3A:0x41] = SYMBOL[0x5B:0x61] = SYMBOL[0x7B:0x7F] = True
LETTER = UPPER.copy()
LETTER[0x61:0x7B] = True


def _row_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values, dtype=np.int64))
    return total[bounds[1:]] - total[bounds[:-1]]


def text_features(column) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all features of the texts and the row of each: words (A-Z
    lowered), word beginnings, runs of symbols, and tenths of four shares (upper case, symbols,
    distinct words, the commonest word). Null and empty texts have none."""
    data, bounds = K.buffers(column)
    shift = U(64 - SLOT_BITS)
    low = K.LOWER[data]
    start, end, first = K.words(low, bounds, K.ALNUM)
    words = K.hash_words(low, start, end)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    s, e, f = K.words(data, bounds, SYMBOL)
    symbols = K.mix(K.hash_words(data, s, e) + U(1))
    n = np.diff(first)
    order = np.lexsort((words, row))
    head = np.ones(len(words), bool)
    head[1:] = (np.diff(words[order]) != 0) | (np.diff(row[order]) != 0)
    at = np.flatnonzero(head)
    runs = np.diff(np.append(at, len(words)))
    top = np.zeros(len(n), np.int64)
    np.maximum.at(top, row[order][at], runs)
    some = np.maximum(n, 1)
    letters = np.maximum(_row_sum(LETTER[data], bounds), 1)
    shares = [_row_sum(UPPER[data], bounds) / letters, _row_sum(SYMBOL[data], bounds) / np.maximum(np.diff(bounds), 1),
              np.bincount(row[order][at], minlength=len(n)) / some, top / some, np.log2(some) / 10]
    extra, where = [], np.flatnonzero(n > 0)
    for i, share in enumerate(shares):
        step = np.minimum((share[where] * (20 if i else 10)).astype(np.int64), 20)
        extra.append(K.mix((step + 1000 * (i + 1)).astype(np.uint64)))
    # word beginnings, once, and again where a text has two words with one
    rows = [row, np.repeat(np.arange(len(n)), np.diff(f)), *[where] * len(shares)]
    long = np.flatnonzero(end - start > STEM)
    stems, stem_row = K.mix(K.hash_words(low, start[long], start[long] + STEM) + U(2)), row[long]
    order = np.lexsort((stems, stem_row))
    stems, stem_row = stems[order], stem_row[order]
    same = (np.diff(stems) == 0) & (np.diff(stem_row) == 0)
    once, twice = np.append(True, ~same)[:len(stems)], np.append(False, same)[:len(stems)]
    extra += [stems[once], K.mix(stems[twice] + U(3))]
    rows += [stem_row[once], stem_row[twice]]
    slots = np.concatenate([words, symbols, *extra]) >> shift
    return slots.astype(np.int64), np.concatenate(rows)


def meta_features(docs: DataFrame, columns: tuple[str, ...]) -> Column:
    """Slots of the metadata columns that ``docs`` has: the value of a text
    column, the binary order of a number; null is a value of its own."""
    out = []
    for name, kind in docs.dtypes:
        if name in columns:
            c = F.col(f"`{name}`")
            value = F.floor(F.log2(F.abs(c.cast("double")) + 1) * 2).cast("string") if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") else c.cast("string")
            out.append(F.shiftrightunsigned(F.xxhash64(F.lit(name), F.coalesce(value, F.lit("\x00null"))), 64 - SLOT_BITS))
    return F.array(*out).cast("array<long>")


def _features(batches):
    for batch in batches:
        _, bounds = K.buffers(batch["text"])
        for lo, hi in K.slices(bounds):
            part = batch.slice(lo, hi - lo)
            slots, row = text_features(part["text"])
            lists = [np.unique(x) for x in np.split(slots[np.argsort(row, kind="stable")], np.cumsum(np.bincount(row, minlength=hi - lo))[:-1])]
            yield pa.RecordBatch.from_pydict({"low_quality": part["low_quality"], "toxic": part["toxic"], "h": part["h"], "meta": part["meta"],
                                              "slots": pa.array([x.astype(np.int32) for x in lists], pa.list_(pa.int32()))})


class Rows:
    """Sparse 0/1 rows."""

    def __init__(self, at: np.ndarray, row: np.ndarray, n: int):
        self.at, self.row, self.n = at.astype(np.int32), row.astype(np.int32), n

    @staticmethod
    def of(lists) -> Rows:
        lists = lists.combine_chunks()
        return Rows(lists.flatten().to_numpy(), np.repeat(np.arange(len(lists), dtype=np.int32), lists.value_lengths().to_numpy()), len(lists))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at], self.n)

    def only(self, rows: np.ndarray, slots: np.ndarray | None = None) -> Rows:
        number = np.full(self.n, -1, np.int32)
        number[rows] = np.arange(len(rows), dtype=np.int32)
        ok = number[self.row] >= 0
        if slots is not None:
            ok &= slots[self.at]
        return Rows(self.at[ok], number[self.row[ok]], len(rows))


def _sides(x: Rows, y: np.ndarray) -> np.ndarray:
    """Rows that have each slot, and in the last place all rows, by side."""
    return np.stack([np.append(np.bincount(x.at, (y == side)[x.row], 1 << SLOT_BITS), (y == side).sum()) for side in (0, 1)])


def _selected(count: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The slots whose presence tells most of the target (signed chi square).
    ``count``: weights as of ``_sides``; ``docs``: documents with each slot."""
    df, pos, n = count[:, :-1].sum(0), count[1, :-1], count[:, -1].sum()
    share = count[1, -1] / n
    gain = (pos - df * share) ** 2 / np.maximum(df * share * (1 - share), 1e-9)
    gain[docs < LEAST_DOCS] = 0
    out = np.zeros(1 << SLOT_BITS, bool)
    best = np.argsort(-gain, kind="stable")[:SELECTED]
    out[best[gain[best] > CHANCE]] = True
    return out


def _fit(x: Rows, y: np.ndarray, drawn: np.ndarray, penalty: float = 0.1) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam on the slots that ``x`` has; the penalty
    draws the weights to ``drawn``, which slots that ``x`` lacks keep."""
    used, at = np.unique(x.at, return_inverse=True)
    w, b = drawn[used], float(np.log((y.sum() + 1) / ((1 - y).sum() + 1)))
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, STEPS + 1):
        err = 1 / (1 + np.exp(-np.clip(np.bincount(x.row, w[at], x.n) + b, -30, 30))) - y
        grad = np.append(np.bincount(at, err[x.row], len(used)) + penalty * (w - drawn[used]), err.sum()) / x.n
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = 0.2 / (1 + t / 60) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    full = drawn.copy()
    full[used] = w
    return full, float(b)


def _sure(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scores from which, and up to which, held-out labels show ``PRECISION``
    beyond doubt: by the lower bound of Wilson's interval."""
    bounds = []
    for sign, right in ((-1, y), (1, 1 - y)):
        order = np.argsort(sign * score, kind="stable")
        n = np.arange(1, len(y) + 1)
        share = np.cumsum(right[order]) / n
        lower = (share + 2 / n - 2 * np.sqrt(share * (1 - share) / n + 1 / n ** 2)) / (1 + 4 / n)
        ok = np.flatnonzero(lower >= PRECISION)
        bounds.append(float(score[order[ok[-1]]]) if len(ok) else -sign * np.inf)
    return bounds[0], bounds[1]


class _View:
    """One view's model of one target: fitted on the labelled rows ``train`` of
    ``x``, drawn to what the other view's pseudo-labels say."""

    def __init__(self, x: Rows, y: np.ndarray, train: np.ndarray, test: np.ndarray):
        self.held, self.part, self.told, self.checked = x.only(test), x.only(train), y[train], y[test]
        self.sides = _sides(self.part, self.told)
        self.first = self.w = None
        self.b = 0.0

    def fit(self, pseudo: np.ndarray | None) -> None:
        """``pseudo``: documents by side and slot, as of ``_sides``."""
        slots = _selected(self.sides, self.sides[:, :-1].sum(0))
        drawn = np.zeros(1 << SLOT_BITS)
        if pseudo is not None:
            count = self.sides + PSEUDO * pseudo
            slots |= _selected(count, (self.sides + pseudo)[:, :-1].sum(0))
            odds = np.log((count[1, :-1] + 0.5) / (count[1, -1] + 1)) - np.log((count[0, :-1] + 0.5) / (count[0, -1] + 1))
            # weights are as much smaller than log odds as those that labels alone gave
            both = self.first != 0
            scale = float(self.first[both] @ odds[both] / np.maximum(odds[both] @ odds[both], 1e-9))
            drawn[slots] = np.clip(scale, 0, 1) * odds[slots]
        self.w, self.b = _fit(self.part.only(np.arange(self.part.n), slots), self.told, drawn)
        self.first = self.w if self.first is None else self.first

    def score(self) -> np.ndarray:
        """Of the held-out rows."""
        return self.held.times(self.w) + self.b

    def sure(self) -> tuple[np.ndarray, float, float, float]:
        return self.w, self.b, *_sure(self.score(), self.checked)


def _views(text: Rows, meta: Rows, y: np.ndarray, held: np.ndarray) -> list[_View] | None:
    """Both views; ``y``: 1, 0, or nan for rows without a label."""
    known = ~np.isnan(y)
    train, test = known & ~held, known & held
    if min((y[train] == 1).sum(), (y[train] == 0).sum(), (y[test] == 1).sum(), (y[test] == 0).sum()) < 5:
        return None
    return [_View(x, y, np.flatnonzero(train), np.flatnonzero(test)) for x in (text, meta)]


def _head(views: list[_View] | None):
    """Weights of both views, their mix, and the threshold on its logit."""
    if views is None:
        return None
    y = views[0].checked
    scores = np.stack([v.score() for v in views], 1)
    mix, bias = _mix(scores, y)
    logit = scores @ mix + bias
    # the threshold with the best F score, in the middle of its gap
    order = np.argsort(-logit, kind="stable")
    hits = np.cumsum(y[order])
    f = 2 * hits / (np.arange(1, len(hits) + 1) + y.sum())
    k = int(f.argmax())
    level = logit[order]
    return [(v.w, v.b) for v in views], mix, bias, float((level[k] + level[min(k + 1, len(level) - 1)]) / 2)


def _tell(model):
    """Sums over a task: documents by head (target and view that learns), slot
    (the last one is all documents) and side that the other view is sure of."""
    def run(batches):
        heads, size = model.value, 1 << SLOT_BITS
        sums = {t: np.zeros((2, 2, size + 1), np.int64) for t in heads}
        for batch in batches:
            _, bounds = K.buffers(batch["text"])
            for lo, hi in K.slices(bounds):
                part = batch.slice(lo, hi - lo)
                slots, row = text_features(part["text"])
                pair = np.unique(row << SLOT_BITS | slots)
                metas = part["meta"]
                lists = [(pair & (size - 1), pair >> SLOT_BITS), (np.asarray(metas.flatten().to_numpy(zero_copy_only=False), np.int64),
                                                                 np.repeat(np.arange(hi - lo), metas.value_lengths().to_numpy(zero_copy_only=False)))]
                for t, views in heads.items():
                    free = part[t].is_null().to_numpy(zero_copy_only=False)
                    for i, (w, b, high, low) in enumerate(views):
                        at, of = lists[i]
                        score = np.bincount(of, w[at], hi - lo) + b
                        at, of = lists[1 - i]
                        for side, sure in ((1, score >= high), (0, (score <= low) & (score < high))):
                            sure = sure & free
                            sums[t][1 - i, side, :-1] += np.bincount(at[sure[of]], minlength=size)
                            sums[t][1 - i, side, -1] += sure.sum()
        for k, t in enumerate(TARGETS):
            for i in range(2 if t in sums else 0):
                yield from _packed(2 * k + i, sums[t][i]).to_batches()

    return run


TOLD = "head int, slot array<int>, n0 array<long>, n1 array<long>"


def _packed(head: int, sums: np.ndarray) -> pa.Table:
    """One row: the slots that any side has, and both sides' sums."""
    at = np.flatnonzero(sums.any(0))
    return pa.table({"head": pa.array([head], pa.int32()), "slot": pa.array([at.astype(np.int32)], pa.list_(pa.int32())),
                     **{f"n{side}": pa.array([sums[side, at]], pa.list_(pa.int64())) for side in (0, 1)}})


def _unpacked(slot, n0, n1) -> np.ndarray:
    sums = np.zeros((2, (1 << SLOT_BITS) + 1), np.int64)
    slot = slot.combine_chunks().flatten().to_numpy()
    for side, n in enumerate((n0, n1)):
        np.add.at(sums[side], slot, n.combine_chunks().flatten().to_numpy())
    return sums


def _add(key, rows):
    return _packed(key[0].as_py(), _unpacked(rows["slot"], rows["n0"], rows["n1"]))


def _pseudo(docs: DataFrame, heads: dict[str, list[_View]]) -> dict[str, np.ndarray]:
    """What all documents without a label of a target teach each view of it."""
    model = docs.sparkSession.sparkContext.broadcast({t: [v.sure() for v in views] for t, views in heads.items()})
    told = docs.mapInArrow(_tell(model), TOLD)
    told = told.groupBy("head", F.pmod(F.spark_partition_id(), F.lit(FAN)).alias("fan")).applyInArrow(_add, TOLD)
    got = told.groupBy("head").applyInArrow(_add, TOLD).toArrow()
    sums = np.zeros((len(TARGETS), 2, 2, (1 << SLOT_BITS) + 1))
    for i, head in enumerate(got["head"].to_pylist()):
        sums[head >> 1, head & 1] = _unpacked(*(got[c].slice(i, 1) for c in ("slot", "n0", "n1")))
    model.destroy()
    return {t: sums[k] for k, t in enumerate(TARGETS)}


def _mix(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic model over the two views' scores, drawn to the text score alone:
    Newton steps, halved until the penalised loss falls; it ends below that of the
    text score as it is."""
    a, first = np.column_stack([x, np.ones(len(x))]), np.array([1.0, 0.0, 0.0])

    def loss(w):
        z = a @ w
        return float(np.logaddexp(0, z).sum() - y @ z + 0.05 * (w - first) @ (w - first))
    w, now = first, loss(first)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(3)
        step = np.linalg.solve(hess, a.T @ (p - y) + 0.1 * (w - first))
        size = 1.0
        while size > 1e-6 and not loss(w - size * step) < now:
            size /= 2
        if size <= 1e-6 or now - loss(w - size * step) < 1e-9:
            break
        w = w - size * step
        now = loss(w)
    return w[:2], float(w[2])


def _score(model, carry: list[str]):
    def run(batches):
        heads = model.value
        for batch in batches:
            _, bounds = K.buffers(batch["text"])
            for lo, hi in K.slices(bounds):
                part = batch.slice(lo, hi - lo)
                slots, row = text_features(part["text"])
                full = np.bincount(row, minlength=hi - lo) > 0
                metas = part["meta_slots"]
                meta = np.asarray(metas.flatten().to_numpy(zero_copy_only=False), np.int64)
                meta_row = np.repeat(np.arange(hi - lo), metas.value_lengths().to_numpy(zero_copy_only=False))
                out, reject = {c: part[c] for c in carry}, ~full
                for name, head in heads.items():
                    if head is None:
                        out[f"p_{name}"] = pa.array(np.zeros(hi - lo))
                        continue
                    ((w, b), (u, c)), mix, bias, threshold = head
                    ok = w[slots] != 0
                    pair = np.unique(row[ok] << SLOT_BITS | slots[ok])
                    text = np.bincount(pair >> SLOT_BITS, w[pair & ((1 << SLOT_BITS) - 1)], hi - lo) + b
                    other = np.bincount(meta_row, u[meta], hi - lo) + c
                    logit = text * mix[0] + other * mix[1] + bias
                    out[f"p_{name}"] = pa.array(np.round(1 / (1 + np.exp(-np.clip(logit, -30, 30))), 6))
                    reject = reject | (logit >= threshold)
                yield pa.RecordBatch.from_pydict(out | {"rejected": pa.array(reject)})

    return run


def train(docs: DataFrame, labels: DataFrame, meta: tuple[str, ...] = META) -> dict:
    """A co-trained model a target, None where labels of a side are too few."""
    small_batches(docs.sparkSession)
    told = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        (F.min("quality") == 0).cast("double").alias("low_quality"), (F.max("toxic") == 1).cast("double").alias("toxic"))
    told = told.where(F.coalesce("low_quality", "toxic").isNotNull())
    # only labels of documents that are there count towards the sample
    told = told.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), meta_features(docs, meta).alias("meta"))
    src = src.withColumn("h", F.xxhash64("doc_id", "text"))
    joined = src.join(F.broadcast(told), "doc_id", "left").select("doc_id", "text", "low_quality", "toxic", "h", "meta")
    one = joined.where(F.coalesce("low_quality", "toxic").isNotNull()).dropDuplicates(["doc_id", "h"]).drop("doc_id")
    one = one.mapInArrow(_features, "low_quality double, toxic double, h long, meta array<long>, slots array<int>")
    rows = one.orderBy("h").limit(SAMPLE).toArrow().combine_chunks()
    if not rows.num_rows:
        return dict.fromkeys(TARGETS)
    rows = rows.take(np.argsort(rows["h"].to_numpy(), kind="stable"))
    held = K.mix(rows["h"].to_numpy().view(np.uint64)) % U(HELD_OUT) == 0
    told = {t: np.asarray(rows[t].to_numpy(), float) for t in TARGETS}
    text, other = Rows.of(rows["slots"]), Rows.of(rows["meta"])
    del rows
    heads = {t: _views(text, other, told[t], held) for t in TARGETS}
    del text, other
    some = {t: views for t, views in heads.items() if views is not None}
    free = joined.where(F.col("low_quality").isNull() | F.col("toxic").isNull()).select("text", "low_quality", "toxic", "meta")
    for k in range(ROUNDS if some else 0):
        pseudo = _pseudo(free, some) if k else {}
        for t, views in some.items():
            for i, view in enumerate(views):
                view.fit(pseudo[t][i] if k else None)
    return {t: _head(views) for t, views in heads.items()}


def score(docs: DataFrame, model: dict, meta: tuple[str, ...] = META, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all, if None), p_low_quality, p_toxic
    (calibrated) and rejected: a probability beyond its target's threshold, or
    a text without any word or symbol. Null text counts as empty. A target
    without model has probability 0. Columns named like a new one are replaced."""
    new = [*(f"p_{t}" for t in TARGETS), "rejected"]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in new]
    src = docs.select(*[F.col(f"`{c}`") for c in carry if c != "text"], F.col("text").cast("string").alias("text"), meta_features(docs, meta).alias("meta_slots"))
    return _scored(src, model, carry)


def _scored(src: DataFrame, model: dict, carry: list[str]) -> DataFrame:
    small_batches(src.sparkSession)
    types = dict(src.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in carry] + [f"p_{t} double" for t in TARGETS] + ["rejected boolean"])
    return src.mapInArrow(_score(src.sparkSession.sparkContext.broadcast(model), carry), schema)


def drop_rejected(docs: DataFrame, labels: DataFrame, meta: tuple[str, ...] = META) -> DataFrame:
    """``docs`` without the documents that the model trained on them rejects."""
    src = boxed(docs, meta_features(docs, meta).alias("meta_slots"))
    return unboxed(_scored(src, train(docs, labels, meta), ["row", "text"]).where(~F.col("rejected")), docs.columns)
