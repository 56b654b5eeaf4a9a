"""Secret scan with corpus-wide ownership frequency.

Every text is searched for secrets of fixed shape (assignments, access keys,
hex digests) and for further random-looking strings. The sha256 of each
candidate is aggregated over the corpus by distinct repository and owner: a
value that many owners hold is a copied example, one that stays with few is
owner-specific and looks live. Only hashes leave the scanning task. Counting
goes (value, owner, repository) -> (value, owner) -> value, so a value that a
third of all documents hold is combined before each shuffle.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dsengine.llm import textkernel as K
from dsengine.llm.common import boxed, small_batches, staged, unboxed

#: fixed values: kinds in their order, and the patterns of the contract
KINDS = ("assign", "access", "hex", "live")
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_HINTS = (b"passw", b"secret", b"token", b"api")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{12,}")
ASSIGN_LEAST, HEX_LEAST = 8, 32
#: random-looking strings that the method adds
LOOSE_LEAST, LOOSE_BITS = 20, 3.5
#: a value held by so many owners is an example
EXAMPLE_OWNERS = 3

HEX = np.zeros(256, bool)
HEX[0x30:0x3A] = HEX[0x61:0x67] = True
LOOSE = np.zeros(256, bool)
LOOSE[0x30:0x3A] = LOOSE[0x41:0x5B] = LOOSE[0x61:0x7B] = True
LOOSE[[0x2B, 0x2F, 0x5F, 0x3D, 0x2D]] = True

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.string())])
SPANS = "array<struct<kind:string,start:long,end:long,hash:string>>"


def _random(value: bytes) -> bool:
    """Letters of both cases and digits, and many bits a character."""
    a = np.frombuffer(value, np.uint8)
    if not (((a >= 48) & (a < 58)).any() and ((a >= 65) & (a < 91)).any() and ((a >= 97) & (a < 123)).any()):
        return False
    share = np.bincount(a)
    share = share[share > 0] / len(a)
    return float(-(share * np.log2(share)).sum()) >= LOOSE_BITS


def _scan(carry: list[str]):
    def run(batches):
        for batch in batches:
            data, bounds = K.buffers(batch["text"])
            spans: list[list[tuple]] = [[] for _ in range(batch.num_rows)]
            for lo, hi in K.slices(bounds, 8 << 20):
                base = int(bounds[lo])
                part, cut = data[base:int(bounds[hi])], bounds[lo:hi + 1] - base
                whole = part.tobytes()
                start, end, _ = K.words(part, cut, HEX)
                long = np.flatnonzero(end - start >= HEX_LEAST)
                found = [("hex", a, b, a, b) for a, b in zip(start[long].tolist(), end[long].tolist())]
                for i in range(hi - lo):
                    a, b = int(cut[i]), int(cut[i + 1])
                    raw = whole[a:b]
                    low = raw.lower()
                    if any(h in low for h in ASSIGN_HINTS):
                        found += [("assign", a + m.start(), a + m.end(), a + m.start(2), a + m.end(2)) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
                    if b"AKIA" in raw:
                        found += [("access", a + m.start(), a + m.end(), a + m.start(), a + m.end()) for m in ACCESS.finditer(raw)]
                taken = sorted((x[1], x[2]) for x in found)
                begins, stops = np.array([x for x, _ in taken], np.int64), np.maximum.accumulate(np.array([y for _, y in taken], np.int64)) if taken else np.zeros(0, np.int64)
                start, end, _ = K.words(part, cut, LOOSE)
                size = end - start
                for k in np.flatnonzero(size >= LOOSE_LEAST).tolist():
                    a, b = int(start[k]), int(end[k])
                    before = int(np.searchsorted(begins, b))
                    if (not before or stops[before - 1] <= a) and _random(whole[a:b]):
                        found.append(("live", a, b, a, b))
                if found:
                    chars = np.append(0, np.cumsum((part & 0xC0) != 0x80))
                    for kind, a, b, x, y in found:
                        i = int(np.searchsorted(cut, a, "right")) - 1
                        spans[lo + i].append((kind, int(chars[a] - chars[cut[i]]), int(chars[b] - chars[cut[i]]), hashlib.sha256(whole[x:y]).hexdigest()))
            rows = [[dict(zip(("kind", "start", "end", "hash"), s)) for s in sorted(x, key=lambda s: (s[1], KINDS.index(s[0])))] for x in spans]
            yield pa.RecordBatch.from_pydict({c: batch[c] for c in carry} | {"secret_spans": pa.array(rows, pa.list_(SPAN))})

    return run


def candidates(docs: DataFrame, repo: Column, owner: Column, carry: list[str]) -> DataFrame:
    """``carry`` columns, repository, owner and the candidate spans of each
    whole text: kind, start, end (code points) and sha256 of the value."""
    small_batches(docs.sparkSession)
    src = docs.select(*[F.col(f"`{c}`") for c in carry if c != "text"], F.coalesce(repo.cast("string"), F.lit("")).alias("secret_repo"),
                      F.coalesce(owner.cast("string"), F.lit("")).alias("secret_owner"), F.col("text").cast("string").alias("text"))
    keep = [*carry, "secret_repo", "secret_owner"]
    types = dict(src.dtypes)
    return src.mapInArrow(_scan(keep), ", ".join([f"`{c}` {types[c]}" for c in keep] + [f"secret_spans {SPANS}"]))


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_repos and n_owners: distinct (owner, repository) and owners."""
    one = found.select(F.explode("secret_spans.hash").alias("hash"), "secret_owner", "secret_repo").distinct()
    return (one.groupBy("hash", "secret_owner").agg(F.count("*").alias("r"))
            .groupBy("hash").agg(F.sum("r").alias("n_repos"), F.count("*").alias("n_owners")))


def find_secrets(docs: DataFrame, repo: Column | None = None, owner: Column | None = None, carry: list[str] | None = None,
                 example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all, if None) and ``findings``, sorted
    by start and kind: kind, start, end (code points, end exclusive), n_repos,
    n_owners, live.

    Kinds assign, access and hex are listed whatever their frequency; kind live
    is a random-looking string outside those that fewer than ``example_owners``
    owners hold. ``live`` says so of every finding. The repository is the column
    source and its owner the part before the first slash, if not given; null
    counts as the empty name. Null or empty text has no findings. Repeated rows
    stay, with the same findings. A column named findings is replaced."""
    repo = F.col("source") if repo is None else repo
    owner = F.substring_index(repo, "/", 1) if owner is None else owner
    carry = [c for c in (docs.columns if carry is None else carry) if c != "findings"]
    found = staged(candidates(docs, repo, owner, carry), "secrets")
    some = found.where(F.size("secret_spans") > 0)
    ids = [F.col(f"`{c}`") for c in found.columns]
    some = some.withColumn("secret_row", F.struct(F.xxhash64(*ids), F.xxhash64(F.lit(1), *ids)))
    flat = some.select("secret_row", "secret_spans").dropDuplicates(["secret_row"]).select("secret_row", F.explode("secret_spans").alias("s")).select("secret_row", "s.*")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    live = F.col("n_owners") < example_owners
    told = flat.join(ownership(found), "hash").where((F.col("kind") != "live") | live).groupBy("secret_row").agg(
        F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end", "n_repos", "n_owners", live.alias("live")))).alias("f"))
    kind = "array<struct<kind:string,start:long,end:long,n_repos:long,n_owners:long,live:boolean>>"
    listed = F.transform("f", lambda x: F.struct(x.kind.alias("kind"), x.start.alias("start"), x.end.alias("end"), x.n_repos.alias("n_repos"), x.n_owners.alias("n_owners"), x.live.alias("live")))
    names = [F.col(f"`{c}`") for c in carry]
    with_some = some.join(told, "secret_row", "left").select(*names, F.coalesce(listed, F.array()).cast(kind).alias("findings"))
    return with_some.union(found.where(F.size("secret_spans") == 0).select(*names, F.array().cast(kind).alias("findings")))


def span_text(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", repo: str = "source", **how) -> DataFrame:
    """``docs`` with every live finding replaced by ``mark`` in the text;
    overlapping findings get one mark. Examples that many owners hold stay."""
    live = F.filter("findings", lambda x: x.live)
    # pieces between the ends reached so far and the next start
    step = F.aggregate(live, F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at")), lambda acc, x: F.when(
        x.end <= acc.at, acc).otherwise(F.struct(
            F.when(x.start >= acc.at, F.concat(acc.done, F.col("text").substr((acc.at + 1).cast("int"), (x.start - acc.at).cast("int")), F.lit(mark))).otherwise(acc.done).alias("done"), x.end.alias("at"))),
        lambda acc: F.concat(acc.done, F.col("text").substr((acc.at + 1).cast("int"), F.length("text"))))
    text = F.when(F.size(live) > 0, step).otherwise(F.col("text"))
    found = find_secrets(boxed(docs), repo=F.col(f"row.`{repo}`"), **how)
    return unboxed(found.withColumn("text", text), docs.columns)
