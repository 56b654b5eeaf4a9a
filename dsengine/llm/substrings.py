"""Substring dedup: every window of fixed length gets a Rabin-Karp hash, Spark
counts the hashes over the corpus, and repeated windows merge into maximal
removal intervals.

Plan. Documents are dealt by a hash of their id into blocks of a few MB. A
block sends each distinct window hash once, with the smallest document that
has it there, as compressed sorted arrays cut by hash range; so a passage that
a third of all rows share costs one entry a block. A task per hash range finds
the smallest document of every hash and answers each block with one bit per
hash. The block, read again from the same shuffle, turns bits into intervals.
Nothing of the corpus passes the driver; a block and a hash range have a fixed
expected size, and their number grows with the input.

Equality of windows is that of 64-bit hashes; ``confirm`` of the tests compares
with the words themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dsengine.llm import textkernel as K
from dsengine.llm.common import parts, small_batches, text_bytes

WIDTH = 50
BLOCK_BYTES = 4 << 20
RANGE_WINDOWS = 1 << 20
LAST = np.int64((1 << 63) - 1)
SENT = "span int, block int, docs binary, packed binary"
REPLY = "block int, span int, bits binary"
RESULT = ("doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string")


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def _block(rows: pa.Table, width: int):
    """Windows of a block in the order of document ids (null ids last)."""
    ids = rows["doc_id"].to_numpy(zero_copy_only=False) if not rows["doc_id"].null_count else rows["doc_id"].fill_null(int(LAST)).to_numpy()
    ids = np.asarray(ids, np.int64)
    order = np.argsort(ids, kind="stable")
    text = rows["text"].take(pa.array(order))
    ids = ids[order]
    data, bounds = K.buffers(text)
    start, end, first = K.words(data, bounds, K.NOT_SPACE)
    at, hashes = K.windows(K.hash_words(data, start, end), first, width)
    distinct, one, back = np.unique(hashes, return_index=True, return_inverse=True)
    row = np.repeat(np.arange(len(ids)), np.diff(first))
    return rows.take(pa.array(order)), ids, (data, start, end, first), at, distinct, one, back, row


def _send(width: int, cuts: int):
    shift = np.uint64(64 - cuts) if cuts else None

    def send(key, rows):
        _, ids, _, at, distinct, one, _, row = _block(rows, width)
        low = ids[row[at[one]]]
        span = (distinct >> shift).astype(np.int64) if cuts else np.zeros(len(distinct), np.int64)
        heads = np.flatnonzero(np.diff(span, prepend=-1))
        out = {"span": [], "block": [], "docs": [], "packed": []}
        for a, b in zip(heads, [*heads[1:], len(span)]):
            docs, number = np.unique(low[a:b], return_inverse=True)
            step = np.diff(distinct[a:b], prepend=np.uint64(0))
            out["span"].append(int(span[a]))
            out["block"].append(key[0].as_py())
            out["docs"].append(docs.tobytes())
            small = np.uint16 if len(docs) <= 1 << 16 else np.uint32
            p, q = _pack(step), _pack(number.astype(small))
            out["packed"].append(len(p).to_bytes(4, "little") + p + q)
        return pa.table([pa.array(out["span"], pa.int32()), pa.array(out["block"], pa.int32()), pa.array(out["docs"], pa.binary()), pa.array(out["packed"], pa.binary())], names=list(out))

    return send


def _count(key, rows):
    """Which hashes of each block also occur in a smaller document."""
    hashes, low, sizes = [], [], []
    for docs, packed in zip(rows["docs"].to_pylist(), rows["packed"].to_pylist()):
        n = int.from_bytes(packed[:4], "little")
        hashes.append(np.cumsum(_unpack(packed[4:4 + n], np.uint64)))
        docs = np.frombuffer(docs, np.int64)
        low.append(docs[_unpack(packed[4 + n:], np.uint16 if len(docs) <= 1 << 16 else np.uint32)])
        sizes.append(len(hashes[-1]))
    hashes, low = np.concatenate(hashes), np.concatenate(low)
    order = np.argsort(hashes, kind="stable")
    heads = np.flatnonzero(np.diff(hashes[order], prepend=hashes[order[0]] + np.uint64(1)))
    least = np.minimum.reduceat(low[order], heads)
    later = np.empty(len(hashes), bool)
    later[order] = low[order] > np.repeat(least, np.diff([*heads, len(hashes)]))
    out = {"block": [], "span": [], "bits": []}
    for block, part in zip(rows["block"].to_pylist(), np.split(later, np.cumsum(sizes)[:-1])):
        if part.any():
            out["block"].append(block)
            out["span"].append(key[0].as_py())
            out["bits"].append(np.packbits(part).tobytes())
    return pa.table([pa.array(out["block"], pa.int32()), pa.array(out["span"], pa.int32()), pa.array(out["bits"], pa.binary())], names=list(out))


def _remove(width: int, cuts: int):
    shift = np.uint64(64 - cuts) if cuts else None

    def remove(rows, replies):
        rows, ids, (data, start, end, first), at, distinct, one, back, row = _block(rows, width)
        later = np.zeros(len(distinct), bool)
        for span, bits in zip(replies["span"].to_pylist(), replies["bits"].to_pylist()):
            a, b = (np.searchsorted(distinct >> shift, [span, span + 1])) if cuts else (0, len(distinct))
            later[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        gone = np.zeros(len(start) + 1, np.int64)
        if len(at):
            hit = at[later[back] | (ids[row[at]] > ids[row[at[one]]][back])]
            np.add.at(gone, hit, 1)
            np.add.at(gone, hit + width, -1)
        gone = np.cumsum(gone)[:-1] > 0
        removed = np.add.reduceat(np.append(gone, False), first[:-1], dtype=np.int64) * (np.diff(first) > 0) if len(first) > 1 else np.zeros(0, np.int64)
        spans, texts = [], []
        raw = data.tobytes()
        for i, text in enumerate(rows["text"].to_pylist()):
            a, b = int(first[i]), int(first[i + 1])
            if not removed[i]:
                spans.append([])
                texts.append(" ".join(_plain(text)) if text else "")
                continue
            cut = np.flatnonzero(np.diff(gone[a:b].astype(np.int8), prepend=0, append=0)).tolist()
            spans.append([{"start": x, "end": y} for x, y in zip(cut[::2], cut[1::2])])
            keep = np.flatnonzero(~gone[a:b]) + a
            texts.append(b" ".join(raw[x:y] for x, y in zip(start[keep].tolist(), end[keep].tolist())).decode())
        return pa.table([rows["doc_id"], pa.array(np.diff(first), pa.int64()), pa.array(removed, pa.int64()),
                         pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(texts, pa.string())],
                        names=["doc_id", "n_words", "n_removed", "spans", "kept_text"])

    return remove


def _plain(text: str) -> list[str]:
    return [w.decode() for w in text.encode().split()]


def dedup_substrings(docs: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, range_windows: int = RANGE_WINDOWS) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, spans (maximal runs
    of removed words, in word numbers, end exclusive) and kept_text (kept words
    joined by one space).

    A window of ``width`` words is removed where the same words also start in
    a document with a smaller doc_id; windows are judged on the input.
    Null or blank text: no words, empty kept_text. Texts under ``width`` words
    lose nothing. Rows with one doc_id do not remove each other's words. A null
    doc_id counts as larger than any other. Other columns are not read. An
    empty table gives an empty table.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    small_batches(docs.sparkSession)
    size = text_bytes(src)
    blocks = parts(size, block_bytes)
    cuts = max(0, (parts(size / 6, range_windows, 1) - 1).bit_length())
    block = F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text")), F.lit(17)), F.lit(blocks)).cast("int")
    dealt = src.withColumn("block", block).repartition(blocks, "block")
    sent = dealt.groupBy("block").applyInArrow(_send(width, cuts), SENT)
    replies = sent.groupBy("span").applyInArrow(_count, REPLY)
    return dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_remove(width, cuts), RESULT)
