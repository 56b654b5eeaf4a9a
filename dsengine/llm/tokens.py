"""Exact token counts of texts with a public byte-pair tokenizer.

The tokenizer encodes each piece of its splitting pattern on its own, so the
number of tokens of a text is the sum over its pieces; counts of pieces are
kept between texts in a table of bounded size.
"""

from __future__ import annotations

import base64
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dsengine.llm.common import small_batches

VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KNOWN = 400_000  # pieces kept

_counters: dict = {}


def counter(vocabulary: str, pattern: str):
    """A function from a text to its number of tokens."""
    if (vocabulary, pattern) not in _counters:
        import regex
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        pieces = regex.compile(pattern).findall

        class Known(dict):
            def __missing__(self, piece):
                if len(self) >= KNOWN:
                    self.clear()
                n = len(encode(piece))
                if len(piece) < 64:
                    self[piece] = n
                return n

        known = Known()

        def count(text: str) -> int:
            return sum(map(known.__getitem__, pieces(text)))

        _counters[(vocabulary, pattern)] = count
    return _counters[(vocabulary, pattern)]


def _lengths(vocabulary: str, pattern: str, carry: list[str], into: str):
    def run(batches):
        count = counter(vocabulary, pattern)
        for batch in batches:
            n = [count(t) if t else 0 for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({c: batch[c] for c in carry} | {into: pa.array(n, pa.int64())})

    return run


def token_lengths(docs: DataFrame, carry: list[str] | None = None, into: str = "n_tokens", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all, if None) and the encoded length
    of the whole text; null and empty texts have length 0. The vocabulary file
    has to be at the same path on every executor."""
    small_batches(docs.sparkSession)
    carry = [c for c in (docs.columns if carry is None else carry) if c != into]
    src = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*carry, "text"])]).withColumn("text", F.col("text").cast("string"))
    types = dict(src.dtypes)
    return src.mapInArrow(_lengths(vocabulary, pattern, carry, into), ", ".join([f"`{c}` {types[c]}" for c in carry] + [f"`{into}` long"]))
