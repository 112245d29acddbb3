"""Token counts: batch encoding in Arrow functions that return lengths only.

A text is cut at safe boundaries, a single blank or line feed between two characters that are not white space. There
the byte-level tokenizer always starts a new piece (a blank goes to the word behind it, a line feed stands alone), so
counts of pieces add up to the count of the text, however long it is. Batches hold about the same number of UTF-8 bytes;
a piece that the worker has met before is looked up in a bounded table and not encoded again.

Defined cases: a null text is empty and has 0 tokens; null ids are kept; special strings inside a text count as the
library's default has them (one token); repeated rows give repeated results; an empty table gives an empty result; other
columns, whatever their names, aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import single_threaded, table, text_or_empty, tokenizer_path

VOCABULARY, LIMIT = "byte_bpe_50k.json", 1024
BATCH_BYTES, LONGEST_KEPT, MOST_KEPT = 1_000_000, 40, 1_500_000
_LINE = re.compile(r"(?<=\S)\n(?=\S)")
_BLANK = re.compile(r"(?<=\S) (?=\S)")
_BEFORE_BLANK = re.compile(r"(?<=\S)(?= \S)")


def _cut(line: str) -> list[str]:
    """A line's pieces, each but the first with the blank before it."""
    return _BLANK.sub("\x00 ", line).split("\x00") if "\x00" not in line else _BEFORE_BLANK.split(line)


class PieceCounter:
    def __init__(self, path: str):
        single_threaded()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept: dict[str, int] = {}
        self.line_feed = len(self.tokenizer.encode("a\nb", add_special_tokens=False).ids) - 2

    def _lengths(self, pieces: list[str]) -> Iterator[int]:
        batch, size = [], 0
        for p in pieces:
            batch.append(p)
            size += len(p.encode("utf-8", "surrogatepass")) + 8
            if size > BATCH_BYTES:
                yield from (len(x) for x in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False))
                batch, size = [], 0
        if batch:
            yield from (len(x) for x in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False))

    def count(self, texts: list[str], n_bytes: list[int]) -> list[int]:
        """Token counts of texts, given how many bytes each has: in batches of at most BATCH_BYTES, or of one text."""
        out, batch, size = [], [], 0
        for t, n in zip(texts, n_bytes, strict=True):
            if batch and size + n > BATCH_BYTES:
                out += self._batch(batch)
                batch, size = [], 0
            batch.append(t)
            size += n
        return out + self._batch(batch)

    def _batch(self, texts: list[str]) -> list[int]:
        if len(self.kept) > MOST_KEPT:
            self.kept = {}
        kept, cut = self.kept, []
        for t in texts:
            lines = _LINE.split(t)
            cut.append(([p for line in lines for p in _cut(line)], len(lines) - 1))
        new = set().union(*(p for p, _ in cut)).difference(kept)
        here = dict(zip(new, self._lengths(list(new)), strict=True)) if new else {}
        long = {p: n for p, n in here.items() if len(p) > LONGEST_KEPT}
        kept.update((p, n) for p, n in here.items() if p not in long)
        if long:
            return [sum(kept[p] if p in kept else long[p] for p in pieces) + self.line_feed * n for pieces, n in cut]
        return [sum(map(kept.__getitem__, pieces)) + self.line_feed * n for pieces, n in cut]


_counters: dict[str, PieceCounter] = {}


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row: the id, n_bytes, n_tokens, over_limit. One scan, no shuffle."""

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        if path not in _counters:
            _counters[path] = PieceCounter(path)
        for texts, n_bytes in batches:
            yield pd.Series(_counters[path].count(texts.tolist(), n_bytes.tolist()), dtype="int64")

    text = text_or_empty(text_col)
    n_bytes = F.octet_length(text).cast("long")
    counted = docs.select(F.col(id_col), n_bytes.alias("n_bytes"), count(text, n_bytes).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY))
