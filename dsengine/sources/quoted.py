"""Large delimited files with quoted line breaks, read by many tasks.

Where a split starts inside quotes follows from the number of quotes before it
in its file. A first pass counts the quotes of every split; running sums over a
table of one row per split give each split's parity. A second pass cuts each
split's lines into records where the parity is even; the pieces of a record
that crosses splits are put together by a grouped concatenation, and the
records are parsed by ``from_csv``.

This holds for well-formed files. A quote that neither opens, closes nor is
doubled in a quoted field (``5" pipe``), a lone carriage return or an unclosed
quote is seen in the first pass, which then gives None, and the caller reads
whole files.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: Splits whose parity is sent to every executor; whole files are read beyond.
MOST_SPLITS = 1_000_000
QUOTE, RETURN, BREAK = ord('"'), ord("\r"), ord("\n")
SPLIT = "file long, block long, length long, quotes long, closes boolean, bad_even boolean, bad_odd boolean"
PIECE = "file long, block long, kind int, first boolean, text string"
WHOLE, HEAD, TAIL, INSIDE = 0, 1, 2, 3


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_block_length").alias("length"), "value")


def _runs(batch):
    """Parts of a batch that are of one split."""
    file, block = batch["file"].to_numpy(), batch["block"].to_numpy()
    cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(file)]):
        if hi > lo:
            yield (int(file[lo]), int(block[lo])), batch.slice(lo, hi - lo)


def _bytes(column):
    column = column.cast(pa.large_string())
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def _count(sep: int):
    """One row per split: its quotes, whether an odd number of them lies before
    some line's end, and whether it is ill-formed if it starts outside (even)
    or inside quotes (odd)."""

    def run(batches):
        key, state = None, None
        for batch in batches:
            for at, part in _runs(batch):
                if at != key:
                    if key:
                        yield _row(key, state)
                    key, state = at, [0, False, False, False, part["length"][0].as_py()]
                data, bounds = _bytes(part["value"])
                q = np.flatnonzero(data == QUOTE)
                start, end = np.isin(q, bounds[:-1]), np.isin(q + 1, bounds[1:])
                before, after = data[q - 1] if len(q) else q, data[np.minimum(q + 1, len(data) - 1)] if len(q) else q
                last = np.isin(q + 2, bounds[1:]) & (after == RETURN)
                opens = start | (before == sep) | (before == QUOTE)
                closes = end | last | (after == sep) | (after == QUOTE)
                even = (state[0] + np.arange(len(q))) % 2 == 0
                returns = np.flatnonzero(data == RETURN)
                lone = not np.isin(returns + 1, bounds[1:]).all()
                state[2] |= lone or not np.where(even, opens, closes).all()
                state[3] |= lone or not np.where(even, closes, opens).all()
                state[1] |= bool(((state[0] + np.searchsorted(q, bounds[1:])) % 2 == 1).any())
                state[0] += len(q)
        if key:
            yield _row(key, state)

    def _row(key, state):
        return pa.RecordBatch.from_pydict({"file": [key[0]], "block": [key[1]], "length": [state[4]], "quotes": [state[0]], "closes": [bool(state[1])],
                                           "bad_even": [bool(state[2])], "bad_odd": [bool(state[3])]})

    return run


def _cut(batches):
    """Records of each split, and the pieces of those that cross its ends."""
    key, parity, inside, first, held = None, 0, False, False, []

    def piece(kind, text):
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([kind], pa.int32()), pa.array([first]), pa.array([text.decode()])],
                                          names=["file", "block", "kind", "first", "text"])

    for batch in batches:
        for at, part in _runs(batch):
            if at != key:
                if held:
                    yield piece(INSIDE if inside else TAIL, b"".join(held))
                key, parity, held = at, int(part["odd"][0].as_py()), []
                inside, first = parity == 1, at[1] == 0
            data, bounds = _bytes(part["value"])
            before = (parity + np.searchsorted(np.flatnonzero(data == QUOTE), bounds)) % 2
            broken = before[1:] == 1  # the record goes on after this line
            text = np.insert(data, bounds[1:][broken], BREAK)
            bounds = bounds + np.append(0, np.cumsum(broken))
            starts = np.flatnonzero(before[:-1] == 0)
            parity = int(before[-1])
            head = int(starts[0]) if len(starts) else len(part)
            if head:
                held.append(text[:bounds[head]].tobytes())
                if before[head] == 0:
                    yield piece(HEAD if inside else WHOLE, b"".join(held))
                    held, inside, first = [], False, False
            if not len(starts):
                continue
            if parity:
                held, ends = [text[bounds[starts[-1]]:].tobytes()], bounds[starts]
            else:
                ends = bounds[np.append(starts, len(part))]
            n = len(ends) - 1
            if n:
                raw = text[ends[0]:ends[-1]].tobytes()
                records = pa.LargeStringArray.from_buffers(n, pa.py_buffer((ends - ends[0]).astype(np.int64).tobytes()), pa.py_buffer(raw)).cast(pa.string())
                tops = np.zeros(n, bool)
                tops[0], first = first, False
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key[0])), pa.array(np.full(n, key[1])), pa.array(np.zeros(n, np.int32)), pa.array(tops), records],
                                                 names=["file", "block", "kind", "first", "text"])
    if held:
        yield piece(INSIDE if inside else TAIL, b"".join(held))


def read_quoted(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame | None:
    """Text columns of ``schema`` from all files of ``path``, whose first
    records are headers, or None where a file is not well-formed.

    Both passes have to see the same splits: where these change in between (a
    file grown, another ``spark.sql.files.maxPartitionBytes``), the rows end in
    an error, never in wrong records. Empty lines are skipped. A record with too few fields has nulls, of one
    with too many the first are taken, as when whole files are read. The order
    of rows is that of the files but for records that cross splits."""
    lines = _lines(spark, path)
    splits = lines.mapInArrow(_count(ord(sep)), SPLIT).persist()
    order = W.partitionBy("file").orderBy("block")
    known = splits.withColumn("until", F.sum("quotes").over(order)).withColumn("odd", (F.col("until") - F.col("quotes")) % 2 == 1)
    tail = (F.col("until") % 2 == 1) & (~F.col("odd") | F.col("closes"))
    known = known.withColumn("owner", F.max(F.when(tail, F.col("block"))).over(order.rowsBetween(W.unboundedPreceding, -1)))
    ends = known.groupBy("file").agg(F.max_by("until", "block").alias("total"), F.bool_or(F.when(F.col("odd"), F.col("bad_odd")).otherwise(F.col("bad_even"))).alias("bad"), F.count("*").alias("splits"))
    told = ends.agg(F.bool_or(F.col("bad") | (F.col("total") % 2 == 1)), F.sum("splits")).first()
    if told[0] or (told[1] or 0) > MOST_SPLITS:
        splits.unpersist()
        return None
    at = ["file", "block", "length"]
    changed = F.raise_error(F.lit("splits changed since the file's quotes were counted: read the table anew")).cast("boolean")
    odd = F.when(F.col("odd").isNull(), changed).otherwise(F.col("odd")).alias("odd")
    pieces = lines.join(F.broadcast(known.select(*at, "odd")), at, "left").select("file", "block", odd, "value").mapInArrow(_cut, PIECE)
    whole = pieces.where(F.col("kind") == WHOLE).select("first", "text")
    crossing = pieces.where(F.col("kind") != WHOLE).join(known.select("file", "block", "owner"), ["file", "block"])
    crossing = crossing.withColumn("owner", F.when(F.col("kind") == TAIL, F.col("block")).otherwise(F.col("owner")))
    crossing = crossing.groupBy("file", "owner").agg(F.bool_or("first").alias("first"), F.sort_array(F.collect_list(F.struct("block", "text"))).alias("p"))
    crossing = crossing.select("first", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    records = whole.unionByName(crossing).where(~F.col("first")).select(F.regexp_replace("text", r"\r\z", "").alias("text")).where("text <> ''")
    fields = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(schema))])
    parsed = records.select(F.from_csv("text", fields.simpleString()[7:-1].replace(":", " "), {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(f.name) for i, f in enumerate(schema.fields)])
