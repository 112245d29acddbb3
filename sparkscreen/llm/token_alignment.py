"""Cross-tokenizer alignment by galloping intersection of token ends.

A text's tokens by two tokenizers are two lists of byte ends. The shorter list drives: each of its ends is looked up in the
longer by exponential steps from the last place and a binary search in the last step. Ends that both have cut the tokens
into groups; the ranks at which an end and the one before it fall give the range of tokens that the token between them
overlaps, and so all links, without comparing tokens.

Texts are cut at a blank between two characters that are not white space. Both tokenizers start a token there (the byte
level one puts the blank to the next piece; of the pieces of the other none has its blank mark behind another character,
which is read from the model when a worker loads it, and only then is a text cut), so such a place is a common end, and a
cut is aligned by itself. A worker keeps cuts that it has met in a bounded table.

How many texts hold a pair of ids linked is counted over the whole corpus, from one row a text and pair that is added up
before any shuffle. The MOST_BROADCAST most frequent pairs, a fixed number, are broadcast; the links of all other pairs
are joined with their counts by a shuffle, in which no pair is hot.

Defined cases: null and empty texts, and texts whose token bytes differ from blank + text by either tokenizer (a text with
U+2581 itself does), have no tokens, zeros and no groups; strings of special tokens inside a text are plain text; null ids
are kept; each row counts as a document, also one that repeats another; a text of any length is aligned whole; an empty
table gives an empty result; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, single_threaded, table, text_or_empty, tokenizer_path
from .token_counts import _cut

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
MOST_BROADCAST = 1 << 20  # pairs, 17 bytes each
MOST_KEPT, LONGEST_KEPT, LONGEST_JOINED, BATCH_CHARS = 600_000, 60, 5_000, 1_000_000
_BLANK_MARK = "▁"
#: White space next to which a blank is no safe place, and white space that is rare enough to cut such a text by pattern.
_BESIDE, _RARE = [*" \t\n\r\x0b\x0c", "\x85", "\xa0"], re.compile("[\x1c-\x1f\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Fixed value: how the byte level tokenizer cuts a text into pieces.
_PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def cuts_of(text: str) -> list[str]:
    """A text cut at its safe places, blanks there left out."""
    if text[0] == " " or text[-1] == " " or any(f" {c}" in text or f"{c} " in text for c in _BESIDE) or not text.isascii() and _RARE.search(text):
        return [c[1:] for c in _cut(" " + text)]
    return text.split(" ")


def gallop(short, long, start):
    """For each end of short: how many ends of long are smaller, and whether long has it. start: a place in long for each
    end of short that isn't behind its own. Steps from there double until they pass the end; then the last step is halved."""
    import numpy as np

    n, step, below = len(long), np.ones(len(short), np.int64), start.astype(np.int64)
    at = np.flatnonzero(below < n)
    while len(at):
        at = at[(below[at] + step[at] <= n) & (long[np.minimum(below[at] + step[at], n) - 1] < short[at])]
        step[at] *= 2
    low, high = below + step // 2, np.minimum(below + step, n)  # the place is in between
    while len(at := np.flatnonzero(low < high)):
        mid = (low[at] + high[at]) // 2
        less = long[mid] < short[at]
        low[at], high[at] = np.where(less, mid + 1, low[at]), np.where(less, high[at], mid)
    return low, (low < n) & (long[np.minimum(low, n - 1)] == short)


def align(a_ends, b_ends, a_start=None, b_start=None):
    """(a, b): the places of the linked tokens of two ascending lists of ends that end alike; and the last places (a, b)
    of the groups. *_start: for each end a place in the other list that isn't behind its own (without: 0)."""
    import numpy as np

    swapped = len(b_ends) < len(a_ends)
    short, long, start = (b_ends, a_ends, b_start) if swapped else (a_ends, b_ends, a_start)
    below, equal = gallop(short, long, np.zeros(len(short), np.int64) if start is None else start)
    first = np.concatenate([[0], (below + equal)[:-1]])  # the first token that ends after this one starts
    n = below - first + 1
    x = np.repeat(np.arange(len(short)), n)
    y = np.arange(len(x)) - np.repeat(np.cumsum(n) - n - first, n)
    last, other = np.flatnonzero(equal), below[equal]
    return ((y, x), (other, last)) if swapped else ((x, y), (last, other))


class _Table:
    """Rows of numbers that grow."""

    def __init__(self, width: int | None = None):
        import numpy as np

        self.rows, self.n = np.zeros((1024, width) if width else 1024, np.int64), 0

    def add(self, rows) -> None:
        import numpy as np

        if self.n + len(rows) > len(self.rows):
            self.rows = np.concatenate([self.rows[: self.n], np.zeros((self.n + len(rows), *self.rows.shape[1:]), np.int64)])
        self.rows[self.n : self.n + len(rows)] = rows
        self.n += len(rows)


class Aligner:
    """Aligned texts. Cuts that were met are numbered; a number has counts, groups as text, and linked pairs of ids."""

    def __init__(self, a_path: str, b_path: str):
        single_threaded()
        import numpy as np
        import sentencepiece
        from tokenizers import Tokenizer

        from .token_encoding import _byte_letters

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        letters = {chr(c): b for b, c in _byte_letters().items()}
        vocabulary = {i: bytes([letters.get(c, ord(c) & 255) for c in t]) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = [vocabulary.get(i, b"") for i in range(max(vocabulary) + 1)]
        self.ranked = self._ranked(vocabulary)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_BLANK_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_length, self.b_length = np.array([len(x) for x in self.a_bytes]), np.array([len(x) for x in self.b_bytes])
        self.a_name, self.b_name = [str(i) for i in range(len(self.a_bytes))], [str(i) for i in range(len(self.b_bytes))]
        self.cuts = not any(_BLANK_MARK in p.lstrip(_BLANK_MARK) for p in pieces)
        self._forget()

    def _ranked(self, vocabulary: dict[int, bytes]):
        """A faster encoder of the same merges, if the file's ids are in the order of its merges and its steps are the plain
        ones; else None, and the library encodes."""
        import tiktoken

        own = json.loads(self.a.to_str())
        steps = own["pre_tokenizer"] or {}
        plain = own["normalizer"] is None and steps.get("type") == "ByteLevel" and steps.get("use_regex") is True and steps.get("add_prefix_space") is False
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in own["model"].get("merges", [])]
        ids = own["model"]["vocab"]
        if not plain or any(own["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")) or [ids.get(m) for m in merges] != [256 + i for i in range(len(merges))]:
            return None
        return tiktoken.Encoding("own", pat_str=_PIECES, mergeable_ranks={vocabulary[i]: i for i in range(256 + len(merges))}, special_tokens={})

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.said: list[str | None] = []
        self.counts, self.from_, self.pairs = _Table(4), _Table(), _Table()
        self.from_.add([0])

    def _encoded(self, cuts: list[str]):
        """Of cuts with their blanks: the ids of all by both tokenizers, and how many each cut has."""
        import numpy as np

        if self.ranked:
            a, n_a, short = [], [], []
            for at, c in enumerate([*cuts, None]):  # runs of short cuts are encoded as one text; long ones by the library
                if c is not None and len(c) <= LONGEST_JOINED:
                    short.append(c)
                    continue
                if short:
                    ids = self.ranked.encode_ordinary("".join(short))
                    ends = np.cumsum(self.a_length[ids])
                    n_a.append(np.diff(np.searchsorted(ends, np.cumsum([len(x.encode()) for x in short])) + 1, prepend=0))
                    a.append(ids)
                    short = []
                if c is not None:
                    a.append(self.a.encode(c, add_special_tokens=False).ids)
                    n_a.append(np.array([len(a[-1])]))
            n_a = np.concatenate(n_a)
        else:
            a = [x.ids for x in self.a.encode_batch(cuts, add_special_tokens=False)]
            n_a = np.array([len(x) for x in a])
        b = self.b.encode([c[1:] for c in cuts], num_threads=1)
        return np.fromiter(chain.from_iterable(a), np.int64), n_a, np.fromiter(chain.from_iterable(b), np.int64), np.array([len(x) for x in b])

    def _meet(self, cuts: list[str]) -> None:
        """Number new cuts."""
        import numpy as np

        blank = [" " + c for c in cuts]
        a, n_a, b, n_b = self._encoded(blank)
        whole = "".join(blank).encode()
        xs, ys = [self.a_bytes[i] for i in a.tolist()], [self.b_bytes[i] for i in b.tolist()]
        if b"".join(xs) != whole or b"".join(ys) != whole:  # some cut's bytes differ: those have no groups and are left out
            at_a, at_b = np.cumsum(n_a).tolist(), np.cumsum(n_b).tolist()
            fine = [b"".join(xs[i - n : i]) == b"".join(ys[j - m : j]) == c.encode() for i, n, j, m, c in zip(at_a, n_a.tolist(), at_b, n_b.tolist(), blank, strict=True)]
            for c, ok in zip(cuts, fine, strict=True):
                if not ok:
                    self.number[c] = len(self.said)
                    self.said.append(None)
                    self.counts.add([[0, 0, 0, 0]])
                    self.from_.add([self.pairs.n])
            if good := [c for c, ok in zip(cuts, fine, strict=True) if ok]:
                self._meet(good)
            return
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        (i, j), (last_a, last_b) = align(np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b]), np.repeat(first_b, n_a), np.repeat(first_a, n_b))
        of_a, of_b = np.repeat(np.arange(len(cuts)), n_a), np.repeat(np.arange(len(cuts)), n_b)
        links = np.bincount(of_a[i], minlength=len(cuts))
        self.from_.add(self.pairs.n + np.cumsum(links))
        self.pairs.add(a[i] << 32 | b[j])
        self.counts.add(np.column_stack([n_a, n_b, np.bincount(of_a[last_a], minlength=len(cuts)), links]))
        # Each group is its a's, then its b's: a's move behind the b's of earlier groups, b's behind the a's of their own.
        end_a, end_b = last_a + 1, last_b + 1
        at_a = np.arange(len(a)) + np.repeat(np.concatenate([[0], end_b[:-1]]), np.diff(end_a, prepend=0))
        at_b = np.arange(len(b)) + np.repeat(end_a, np.diff(end_b, prepend=0))
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[last_a], mark_b[last_b] = 1, 2
        mark_b[np.cumsum(n_b) - 1] = 3
        out: list = [None] * (len(a) + len(b))
        marks = ",", "|", ";", ""
        for at, ids, mark, names in ((at_a, a, mark_a, self.a_name), (at_b, b, mark_b, self.b_name)):
            for k, x, m in zip(at.tolist(), ids.tolist(), mark.tolist(), strict=True):
                out[k] = names[x] + marks[m]
        ends = np.cumsum(n_a + n_b).tolist()
        self.number.update(zip(cuts, range(len(self.said), len(self.said) + len(cuts)), strict=True))
        self.said += ["".join(out[x:y]) for x, y in zip([0, *ends], ends, strict=False)]

    def texts(self, texts: list[str]) -> Iterator[tuple]:
        """Per text: groups, n_a, n_b, n_groups, n_links, distinct pairs and how often each is linked, as bytes."""
        batch, size = [], 0
        for t in texts:
            batch.append(t)
            size += len(t)
            if size > BATCH_CHARS:
                yield from self._batch(batch)
                batch, size = [], 0
        yield from self._batch(batch)

    def _batch(self, texts: list[str]) -> Iterator[tuple]:
        import numpy as np

        every = [[] if not t else cuts_of(t) if self.cuts else [t] for t in texts]
        if new := list(set().union(*every).difference(self.number)):
            self._meet(new)
        number, said = self.number, self.said
        for cuts in every:
            of = list(map(number.__getitem__, cuts))
            groups = [said[i] for i in of]
            if not groups or None in groups:
                yield "", 0, 0, 0, 0, b"", b""
                continue
            at = np.array(of)
            counts, first = self.counts.rows[at], self.from_.rows[at]
            n = counts[:, 3]
            places = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
            pairs, times = np.unique(self.pairs.rows[places], return_counts=True)
            yield ";".join(groups), *counts.sum(axis=0).tolist(), pairs.tobytes(), times.astype("<i4").tobytes()
        if len(number) > MOST_KEPT or any(len(c) > LONGEST_KEPT for c in new):
            self._forget() if len(number) > MOST_KEPT else self._drop_long(new)

    def _drop_long(self, new: list[str]) -> None:
        for c in new:
            if len(c) > LONGEST_KEPT:
                self.said[self.number.pop(c)] = None


_aligners: dict[tuple[str, str], Aligner] = {}


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, groups, n_a, n_b, n_groups, n_links; pairs: distinct linked ids (a's, 32 bits up, and b's); times: links of each."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _aligners.setdefault((a_path, b_path), None) or Aligner(a_path, b_path)
        _aligners[a_path, b_path] = own
        for pdf in frames:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                found = pd.DataFrame(own.texts(part["text"].tolist()), columns=["groups", "n_a", "n_b", "n_groups", "n_links", "pairs", "times"])
                yield found.assign(id=part["id"].to_numpy())

    plain = docs.select(F.col(id_col).cast("string").alias("id"), text_or_empty(text_col).alias("text"))  # as text, so nulls stay apart
    found = plain.mapInPandas(rows, "id string, groups string, n_a long, n_b long, n_groups long, n_links long, pairs binary, times binary")
    return found.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n: in how many rows it is linked; best: whether no pair of its a has more. rows: pairs."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for pdf in frames:
            pairs, n = np.unique(np.frombuffer(b"".join(pdf["pairs"]), "<i8"), return_counts=True)
            yield pd.DataFrame({"pair": pairs, "n": n})

    counts = rows.select("pairs").mapInPandas(partial, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "pair-counts")
    # An a has at most one row here for each id of the other vocabulary.
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    return materialize(counts.join(most, F.shiftright("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-bests")


def _frequent(counts: DataFrame, most: int) -> int:
    """The least count of which at most so many pairs have as much or more, to within an eighth of an octave."""
    step = F.floor(8 * F.log2("n")).cast("int")
    total, least = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).collect(), key=lambda r: -r["step"]):  # at most 512 rows
        total += r["pairs"]
        if total > most:
            break
        least = r["least"]
    return 1 << 62 if least is None else least


def link_sums(rows: DataFrame, counts: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """rows (pairs, times and other columns) with n_best and count_sum in their place."""
    import numpy as np

    spark = rows.sparkSession
    least = _frequent(counts, most)
    hot = counts.filter(F.col("n") >= least).sort("pair").toArrow()
    known = spark.sparkContext.broadcast(tuple(hot.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")))
    others = [f for f in rows.schema.fields if f.name not in ("pairs", "times")]

    def look_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, n, best = known.value
        for pdf in frames:
            out = {"n_best": [], "count_sum": [], "rest": [], "rest_times": []}
            for p, t in zip(pdf["pairs"], pdf["times"], strict=True):
                p, t = np.frombuffer(p, "<i8"), np.frombuffer(t, "<i4").astype(np.int64)
                at = np.minimum(np.searchsorted(pairs, p), max(len(pairs) - 1, 0))
                here = pairs[at] == p if len(pairs) else np.zeros(len(p), bool)
                out["n_best"].append(int(t[here] @ best[at[here]]))
                out["count_sum"].append(int(t[here] @ n[at[here]]))
                out["rest"].append(p[~here])
                out["rest_times"].append(t[~here])
            yield pdf.drop(columns=["pairs", "times"]).assign(**out)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    found = rows.select(*[f.name for f in others], "pairs", "times").mapInPandas(look_up, f"{kinds}, n_best long, count_sum long, rest array<long>, rest_times array<long>")
    names = [f.name for f in others]
    if counts.filter(F.col("n") < least).isEmpty():
        return found.select(*names, "n_best", "count_sum")
    found = materialize(found.withColumn("_at", F.monotonically_increasing_id()), "links-known")  # the numbers are fixed by writing them
    rest = found.select("_at", F.explode(F.arrays_zip("rest", "rest_times")).alias("x")).select("_at", F.col("x.rest").alias("pair"), F.col("x.rest_times").alias("t"))
    sums = rest.join(counts, "pair").groupBy("_at").agg(F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("more_best"), F.sum(F.col("t") * F.col("n")).alias("more"))
    whole = found.join(sums, "_at", "left")
    return whole.select(*names, (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aligned(table(spark, sf_dir, "documents"), tokenizer_path(A_VOCABULARY), tokenizer_path(B_VOCABULARY))
    sha = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    rows = materialize(found.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", sha.alias("groups_sha256"), "pairs", "times"), "aligned")
    summed = link_sums(rows, pair_counts(rows))
    return summed.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
