"""Near-duplicate documents by fast similarity sketching.

A document's set of word shingles is thrown into the sketch's bins round after
round: in the first ``t`` rounds each shingle draws a bin and a value, in the
next ``t`` rounds round i fills bin i, and a bin keeps the smallest (round,
value). So every coordinate fills, whatever the size of the set, and two sets
agree on a coordinate with probability their Jaccard similarity, concentrated
as for independent coordinates. Four coordinates make a band; with 32 bands a
pair at similarity 0.8 shares one with probability 1 - 5e-8. Pairs that share a
band are checked on their full sets.

Plan. Documents with equal sets form one class at once (a grouped minimum), so
copies cost nothing further. In each bucket of a band the members are checked
against its smallest; where this leaves several components in a bucket, the
members outside the largest are checked against it and against one another, in
tiles of about ``TILE`` members or ``WEIGHT`` shingles a side, whichever is
less; a tile's intersections are matrix products. All groups are cut by their
counted size, so no bucket meets in one task; sets are made from whole texts
inside the groups. A crowd whose members stay apart just below the similarity
wanted is compared in full: c members outside are dealt to c / TILE tiles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dsengine.llm import textkernel as K
from dsengine.llm.common import id_of, key_of, release, small_batches, staged
from dsengine.llm.components import components

U = np.uint64
COORDINATES, BAND = 128, 4
GROUP = 128
#: Members and shingles of a side of a crowded bucket, shingles of a matrix product.
TILE, WEIGHT, COLUMNS = 1024, 1 << 18, 2048
FULL = U((1 << 64) - 1)
LINK = "a long, b long"


def shingle_sets(column, width: int):
    """Sorted distinct shingle hashes of all rows, and each row's first one.
    Words are split at white space after A-Z are lowered; a text of fewer
    words is one shingle, one without words has none."""
    data, bounds = K.buffers(column)
    data = K.LOWER[data]
    start, end, first = K.words(data, bounds, K.NOT_SPACE)
    hashes = K.hash_words(data, start, end)
    at, found = K.windows(hashes, first, width)
    cut = np.searchsorted(at, first)
    sets = []
    for i in range(len(first) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= width:
            sets.append(np.unique(found[cut[i]:cut[i + 1]]))
        elif b > a:
            sets.append(K.windows(hashes[a:b], np.array([0, b - a]), b - a)[1] ^ U(b - a))
        else:
            sets.append(np.zeros(0, np.uint64))
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.append(0, np.cumsum(sizes))


def sketches(items: np.ndarray, first: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Sketch of every row's set, rows x coordinates; an empty set stays FULL."""
    rows = len(first) - 1
    out = np.full(rows * coordinates, FULL)
    row = np.repeat(np.arange(rows), np.diff(first))
    for i in range(2 * coordinates):
        if not len(row):
            break
        h = K.mix(items + U((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        place = (h >> U(44)) % U(coordinates) if i < coordinates else U(i - coordinates)
        np.minimum.at(out, row * coordinates + place.astype(np.int64), (h & U((1 << 44) - 1)) | U(i << 44))
        open_ = (out.reshape(rows, coordinates) == FULL).any(1)[row]
        if not open_.all():
            items, row = items[open_], row[open_]
    return out.reshape(rows, coordinates)


def _signatures(width: int, coordinates: int, band: int):
    def run(batches):
        for batch in batches:
            _, bounds = K.buffers(batch["text"])
            for lo, hi in K.slices(bounds):
                part = batch.slice(lo, hi - lo)
                items, first = shingle_sets(part["text"], width)
                n = np.diff(first)
                padded = np.append(items, U(0))
                some = (n > 0)
                high = np.add.reduceat(padded, first[:-1]) * some
                low = np.add.reduceat(K.mix(padded ^ U(0x5851F42D4C957F2D)), first[:-1]) * some
                grid = sketches(items, first, coordinates).reshape(hi - lo, coordinates // band, band)
                keys = np.broadcast_to(np.arange(coordinates // band, dtype=np.uint64), grid.shape[:2])
                for i in range(band):
                    keys = K.mix(keys * U(31) + grid[:, :, i])
                bands = [k if s else None for k, s in zip(keys.view(np.int64), some)]
                yield pa.RecordBatch.from_arrays(
                    [part["key"], part["th"], pa.array(n, pa.int64()), pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), pa.array(bands, pa.list_(pa.int64()))],
                    names=["key", "th", "n", "hi", "lo", "bands"])

    return run


def _close(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int((a[at] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sets(rows, width: int):
    text, out = rows["text"].combine_chunks(), []
    for lo, hi in K.slices(K.buffers(text)[1]):
        items, first = shingle_sets(text.slice(lo, hi - lo), width)
        out += [items[first[i]:first[i + 1]].copy() for i in range(hi - lo)]
    return out


def _links(found) -> pa.Table:
    return pa.table([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])


def _check_star(width: int, percent: int):
    def check(key, rows):
        lead, nodes, sets = key[0].as_py(), rows["node"].to_pylist(), _sets(rows, width)
        heads = [s for n, s in zip(nodes, sets) if n == lead]
        return _links([(lead, n) for n, s in zip(nodes, sets) if n != lead and any(_close(h, s, percent) for h in heads)])

    return check


def _places(sets, known: np.ndarray):
    """(place in ``known``, row) of the sets' items found there, by place."""
    items = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = np.minimum(np.searchsorted(known, items), len(known) - 1)
    held = known[at] == items
    at, row = at[held], row[held]
    order = np.argsort(at, kind="stable")
    return at[order], row[order]


def _shared(left, right) -> np.ndarray:
    """Sizes of the intersections of all sets of ``left`` with all of ``right``
    (which may be the same list), by matrix products over ``COLUMNS`` shingles
    at a time. Shingles that only one set holds meet nothing."""
    both = np.zeros((len(left), len(right)), np.float32)
    if left is right:
        known, n = np.unique(np.concatenate(left), return_counts=True)
        known = known[n > 1]
    else:
        known = np.intersect1d(np.concatenate(left), np.concatenate(right))
    if not len(known):
        return both
    sides = [(len(sets), *_places(sets, known)) for sets in (left, right)]
    for lo in range(0, len(known), COLUMNS):
        grids = []
        for size, at, row in sides:
            a, b = np.searchsorted(at, [lo, lo + COLUMNS])
            grid = np.zeros((size, COLUMNS), np.float32)
            grid[row[a:b], at[a:b] - lo] = 1
            grids.append(grid)
        both += grids[0] @ grids[1].T
    return both


def _check_rest(width: int, percent: int):
    """Links between members of different components; a component is joined
    once, what is joined already needs no further link."""

    def check(key, rows):
        nodes, comps, sets = rows["node"].to_pylist(), rows["comp"].to_pylist(), _sets(rows, width)
        side = np.asarray(rows["side"].to_numpy())
        across = key[1].as_py() or key[2].as_py() != key[3].as_py()
        left = np.flatnonzero(side == side.min()) if across else np.arange(len(nodes))
        right = np.flatnonzero(side != side.min()) if across else left
        if not (len(left) and len(right)):
            return _links([])
        some = [sets[i] for i in left]
        both = _shared(some, [sets[j] for j in right] if across else some)
        size, comp = np.array([len(s) for s in sets], np.float64), np.array(comps)
        near = (both > 0) & (100 * both >= percent * (size[left][:, None] + size[right][None] - both))
        near &= comp[left][:, None] != comp[right][None]
        parent, found = {c: c for c in comps}, []

        def root(c):
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
            i, j = int(left[i]), int(right[j])
            a, b = root(comps[i]), root(comps[j])
            if a != b:
                parent[a] = b
                found.append((nodes[i], nodes[j]))
        return _links(found)

    return check


def _sides(count, weight):
    """Into how many sides so many members with so many shingles are cut."""
    return F.greatest(F.ceil(count / TILE), F.ceil(weight / WEIGHT)).cast("int")


def similar_links(classes: DataFrame, texts_of, width: int, percent: int) -> DataFrame:
    """Links (a, b) that join all classes of similar sets into components.

    ``classes``: node, n (size of its set), bands. ``texts_of(nodes)`` gives
    (node, text)."""
    keys = classes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.min("node").alias("lead"), F.count("*").alias("c")).where("c > 1")
    members = staged(keys.join(shared, "bucket"), "buckets")
    texts = staged(texts_of(members.select("node").distinct()), "texts")

    pairs = members.where("lead <> node").select("lead", "node").distinct()
    cuts = pairs.groupBy("lead").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("cuts"))
    dealt = pairs.join(cuts, "lead").select("lead", F.pmod(F.xxhash64("node"), "cuts").cast("int").alias("cut"), "node")
    dealt = dealt.union(cuts.select("lead", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), F.col("lead").alias("node")))
    star = staged(dealt.join(texts, "node").groupBy("lead", "cut").applyInArrow(_check_star(width, percent), LINK), "star")

    comp = components(star)
    held = members.join(comp, "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("comp"))
    held = staged(held, "held")
    # of each bucket with several components: the largest, and how much is outside it
    sizes = held.groupBy("bucket", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("w")).groupBy("bucket").agg(F.max(F.struct("k", "comp", "w")).alias("x"), F.sum("k").alias("c"), F.sum("w").alias("w"))
    sizes = sizes.where(F.col("c") > F.col("x.k")).select("bucket", "c", "w", F.col("x.comp").alias("main"), _sides(F.col("x.k"), F.col("x.w")).alias("in"), _sides(F.col("c") - F.col("x.k"), F.col("w") - F.col("x.w")).alias("out"))
    rest = held.join(sizes, "bucket")
    one = (F.col("c") <= TILE) & (F.col("w") <= WEIGHT)
    # buckets with the same members need one look; their size is at most TILE
    small = (rest.where(one).groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("node", "comp"))).alias("m"))
             .select("m").distinct().select(F.xxhash64("m").alias("bucket"), F.explode("m").alias("m")))
    zero = F.lit(0)
    small = small.select("bucket", zero.alias("i"), zero.alias("j"), F.lit(False).alias("across"), "m.node", "m.comp", zero.alias("side"))
    # in others members outside the largest component meet it and one another
    large = rest.where(~one)
    inner, outer = large.where("comp = main"), large.where("comp <> main")
    mine = F.pmod(F.xxhash64("node"), "out").cast("int")
    met = [inner.select("bucket", F.pmod(F.xxhash64("node"), "in").cast("int").alias("i"), F.explode(F.sequence(zero, F.col("out") - 1)).alias("j"), F.lit(True).alias("across"), "node", "comp", zero.alias("side")),
           outer.select("bucket", F.explode(F.sequence(zero, F.col("in") - 1)).alias("i"), mine.alias("j"), F.lit(True).alias("across"), "node", "comp", F.lit(1).alias("side"))]
    pairs = outer.withColumn("side", mine).withColumn("other", F.explode(F.sequence(zero, F.col("out") - 1)))
    met.append(pairs.select("bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), F.lit(False).alias("across"), "node", "comp", "side"))
    dealt = small
    for x in met:
        dealt = dealt.union(x)
    more = staged(dealt.join(texts, "node").groupBy("bucket", "across", "i", "j").applyInArrow(_check_rest(width, percent), LINK), "rest")
    for done in (members, texts, held):
        release(done)
    return star.union(more)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, coordinates: int = COORDINATES, band: int = BAND) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id
    reachable over links, itself included), kept (doc_id = component_id), and
    key and th, which name the document and its text.

    Documents link when their sets of ``width``-word shingles have a Jaccard
    similarity of at least ``percent`` / 100. Null, empty or blank texts have no
    shingles and link with nothing. Rows that share a doc_id are one document:
    their links are united. A row without a doc_id takes part; component_id is
    null, and kept true, only for the first of a component that has no ids at
    all. Ties of equal texts go to the smallest id. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    src = src.select(key_of(F.col("doc_id"), F.col("text")).alias("key"), F.xxhash64("text").alias("th"), "text")
    sig = staged(src.mapInArrow(_signatures(width, coordinates, band), "key long, th long, n long, hi long, lo long, bands array<long>"), "signatures")
    some = sig.where("n > 0")
    classes = staged(some.groupBy("hi", "lo", "n").agg(F.min(F.struct("key", "th", "bands")).alias("x")).select("hi", "lo", "n", F.col("x.key").alias("node"), "x.th", "x.bands"), "classes")

    def texts_of(nodes):
        wanted = classes.join(nodes, "node", "left_semi").select("node", "th")
        return src.join(wanted.withColumnRenamed("node", "key"), ["key", "th"]).dropDuplicates(["key", "th"]).select(F.col("key").alias("node"), "text")

    comp = components(similar_links(classes, texts_of, width, percent).union(_shared_ids(some.select("key", "hi", "lo", "n"), classes.select("hi", "lo", "n", "node"))))
    named = classes.join(comp, "node", "left").select("hi", "lo", "n", F.coalesce("root", "node").alias("root"))
    out = some.join(named, ["hi", "lo", "n"]).select("key", "th", "n", "root").union(sig.where("n = 0").select("key", "th", "n", F.col("key").alias("root")))
    return out.select(id_of(F.col("key")).alias("doc_id"), F.col("n").alias("n_shingles"), id_of(F.col("root")).alias("component_id"),
                      (F.col("key") == F.col("root")).alias("kept"), "key", "th")


def _shared_ids(some: DataFrame, classes: DataFrame) -> DataFrame:
    """Links that tie the classes of rows with one doc_id."""
    at = F.struct("hi", "lo", "n")
    several = some.groupBy("key").agg(F.min(at).alias("x"), F.max(at).alias("y")).where("x <> y").select("key")
    return some.join(several, "key").join(classes, ["hi", "lo", "n"]).select(F.col("key").alias("a"), F.col("node").alias("b"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest
    doc_id; of rows that share its doc_id, the one whose text hash is least."""
    kept = near_duplicates(docs, **how).where("kept").groupBy("key").agg(F.min("th").alias("th"))
    names = [c for c in docs.columns]
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), key_of(F.col("doc_id"), F.col("text").cast("string")).alias("key"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    return src.join(kept, ["key", "th"]).dropDuplicates(["key", "th"]).select("row.*")
