"""Spelling variants: each word's edits are probed against Bloom filters of the vocabulary, and hits are joined with it.

The vocabulary is every word of enough letters and occurrences. It fills blocked Bloom filters, one a word length (all
words of over LONGEST letters share one): a word sets a few bits of one 64-bit block. Each word's neighbours one letter
away are generated as hashes: a hash is a sum of a number for each (place, letter), so that of an edit follows by a few
additions, for whole arrays of words at once. Of two near words one is the other with a letter less, or with one letter
replaced by a later one of the alphabet; so every pair is found from one side by deletions and such replacements only, and
insertions needn't be made. Only hashes that a filter holds leave the task. A join of those with the vocabulary by
hash removes false positives, and a comparison of the two words collisions of hashes.

Filters are broadcast. Their size grows with the vocabulary, so they go in rounds of at most FILTER_BYTES: whole lengths
while they fit, ranges of blocks of a length that alone is larger. A round reads the words that are as long as its
filters' words, or one letter longer, and probes all their edits that lie in the round. Nothing is left out at any size.

A word's form is its near word of most occurrences, if these are at least ten times its own; the root is the end of the
chain of forms, found by doubling steps. A chain has at most 19 steps, as each has ten times the occurrences.

Defined cases: null and empty texts have no words; a null id counts as an empty one; a word is a maximal run of letters,
A-Z in lower case, by the rule of drops below; rows that repeat count each time; runs of any length are words, and edits of
very long ones are made in slices; an empty table gives an empty result; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, text_or_empty

LEAST_LENGTH, LEAST_COUNT, RATIO, DROP_EVERY = 7, 2, 10, 31
BITS_A_WORD, BITS_SET, LONGEST, CHUNK, FILTER_BYTES = 24, 4, 40, 1 << 16, 64 << 20  # CHUNK: blocks that one task fills
SLICE, FLUSH = 1 << 18, 1 << 19  # letters that are worked on at once; words that a task adds up before it passes them on
_RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}")
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def words_of(doc_id: str, text: str, least: int = LEAST_LENGTH) -> Counter:
    """A text's words and their counts. A run whose hash with the id is divisible by DROP_EVERY loses one letter."""
    out: Counter = Counter()
    for run, n in Counter(_RUN.findall(text)).items():
        run = run.translate(_LOWER)
        h = zlib.crc32(f"{doc_id}:{run}".encode())
        if h % DROP_EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= least:
            out[run] += n
    return out


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, word, length, n, h of each word with at least so many occurrences."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for pdf in frames:
            for doc_id, text in zip(pdf["id"], pdf["text"], strict=True):
                found.update(words_of(doc_id, text))
                if len(found) > FLUSH:
                    yield pd.DataFrame({"word": list(found), "n": list(found.values())})
                    found = Counter()
        if found:
            yield pd.DataFrame({"word": list(found), "n": list(found.values())})

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for part, letters in _by_length(pdf):
                yield part.assign(h=word_hashes(letters).view("i8"))

    plain = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), text_or_empty(text_col).alias("text"))
    counts = plain.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    numbered = counts.select(F.monotonically_increasing_id().alias("id"), "word", F.length("word").alias("length"), "n")
    return materialize(numbered.mapInPandas(hashed, "id long, word string, length int, n long, h long"), "vocabulary")  # the numbers are fixed by writing them


def _by_length(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, object]]:
    """Rows of one length at a time, and their letters as a matrix; at most SLICE letters, or one word."""
    import numpy as np

    for length, rows in pdf.groupby("length"):
        most = max(1, SLICE // int(length))
        for at in range(0, len(rows), most):
            part = rows.iloc[at : at + most]
            yield part, np.frombuffer("".join(part["word"]).encode("latin-1"), np.uint8).reshape(len(part), int(length))


def _terms(places, letters):
    """A number for each (place, letter): unsigned 64 bits, mixed."""
    import numpy as np

    x = places.astype(np.uint64) * np.uint64(_ODD[0]) + (letters.astype(np.uint64) + np.uint64(1)) * np.uint64(_ODD[2])
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_ODD[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_ODD[2])
    return x ^ (x >> np.uint64(31))


def word_hashes(letters):
    """The hash of each row of a matrix of letters."""
    import numpy as np

    return _terms(np.arange(letters.shape[1])[None, :], letters).sum(axis=1, dtype=np.uint64)


def edit_hashes(letters, alphabet) -> Iterator[tuple]:
    """(rows, hashes, letters less) of the words' distinct deletions, and of replacements by later letters of alphabet."""
    import numpy as np

    n, length = letters.shape
    places, rows = np.arange(length), np.arange(n)
    own = _terms(places[None, :], letters)
    whole = own.sum(axis=1, dtype=np.uint64)
    if length > 1:
        moved = np.zeros_like(own)
        moved[:, 1:] = _terms(places[None, :-1], letters[:, 1:])
        before, after = np.cumsum(own, axis=1) - own, np.cumsum(moved[:, ::-1], axis=1)[:, ::-1] - moved
        other = np.ones(letters.shape, bool)  # of a run of one letter only the last is deleted
        other[:, :-1] = letters[:, :-1] != letters[:, 1:]
        r, _ = np.nonzero(other)
        yield r, (before + after)[other], 1
    for c in alphabet:
        to = _terms(places, np.full(length, c, np.uint8))[None, :]
        later = letters < c
        r = np.repeat(rows, later.sum(axis=1))
        yield r, (whole[:, None] - own + to)[later], 0


def _masks():
    import numpy as np

    out = np.zeros(4096, np.uint64)
    for i, row in enumerate(np.random.default_rng(11).random((4096, 64)).argsort(axis=1)[:, :BITS_SET]):
        out[i] = np.bitwise_or.reduce(np.uint64(1) << row.astype(np.uint64))
    return out


def _block(h: Column, blocks: Column) -> Column:
    return F.shiftright(F.shiftrightunsigned(h, 32) * blocks, 32)


def held(h, blocks: int, first: int, filled, masks):
    """Whether each hash is in a filter of so many blocks, of which filled has those from first on."""
    import numpy as np

    block = (((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64) - first
    mask = masks[(h & np.uint64(4095)).astype(np.int64)]
    if first == 0 and len(filled) == blocks:
        return (filled[block] & mask) == mask
    inside = (block >= 0) & (block < len(filled))
    return inside & ((filled[np.where(inside, block, 0)] & mask) == mask)


def filter_rounds(sizes: dict[int, int], most_bytes: int = FILTER_BYTES) -> list[list[tuple[int, int, int, int]]]:
    """sizes: words a shard. Rounds of (shard, its blocks, first block, end block), of at most most_bytes each."""
    rounds: list[list[tuple[int, int, int, int]]] = [[]]
    used, most = 0, max(CHUNK, most_bytes // 8 // CHUNK * CHUNK)
    for shard, n in sorted(sizes.items()):
        blocks, first = -(-n * BITS_A_WORD // 64), 0
        while first < blocks:
            end = min(blocks, first + most)
            if used and used + end - first > most:
                rounds.append([])
                used = 0
            rounds[-1].append((shard, blocks, first, end))
            used += end - first
            first = end
    return [r for r in rounds if r]


def _shard(length: Column) -> Column:
    return F.least(length, F.lit(LONGEST + 1))


def _filters(words: DataFrame, parts: list[tuple[int, int, int, int]]) -> dict:
    """(shard, its blocks, first block) -> filled blocks."""
    import numpy as np

    spark = words.sparkSession
    sizes = F.broadcast(spark.createDataFrame(parts, "shard int, blocks long, low long, high long"))
    placed = words.select(_shard(F.col("length")).alias("shard"), "h").join(sizes, "shard").withColumn("block", _block(F.col("h"), F.col("blocks")))
    placed = placed.filter("block >= low and block < high").withColumn("chunk", F.floor((F.col("block") - F.col("low")) / CHUNK))
    masks = spark.sparkContext.broadcast(_masks())

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        filled = np.zeros(CHUNK, np.uint64)
        first = pdf.iloc[0]
        np.bitwise_or.at(filled, (pdf["block"] - pdf["low"] - pdf["chunk"] * CHUNK).to_numpy(np.int64), masks.value[pdf["h"].to_numpy(np.int64).view(np.uint64) & np.uint64(4095)])
        return pd.DataFrame({"shard": [first["shard"]], "low": [first["low"]], "chunk": [first["chunk"]], "filled": [filled.tobytes()]})

    rows = placed.groupBy("shard", "low", "chunk").applyInPandas(fill, "shard int, low long, chunk long, filled binary").collect()  # at most FILTER_BYTES
    out = {}
    for shard, blocks, low, high in parts:
        chunks = {r["chunk"]: np.frombuffer(bytes(r["filled"]), np.uint64) for r in rows if r["shard"] == shard and r["low"] == low}
        none = np.zeros(CHUNK, np.uint64)
        out[shard, blocks, low] = np.concatenate([chunks.get(i, none) for i in range(-(-(high - low) // CHUNK))])[: high - low]
    return out


def _probed(words: DataFrame, parts: list[tuple[int, int, int, int]], alphabet: bytes) -> DataFrame:
    """id, h: the words' edits that the filters of a round hold."""
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast((_filters(words, parts), _masks()))
    shards = sorted({p[0] for p in parts})
    asked = words.filter(_shard(F.col("length")).isin(shards) | _shard(F.col("length") - 1).isin(shards))

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        filters, masks = shared.value
        found, n = [], 0

        def given() -> pd.DataFrame:
            ids, h = zip(*found, strict=True) if found else ([np.zeros(0, np.int64)], [np.zeros(0, np.uint64)])
            return pd.DataFrame({"id": np.concatenate(ids), "h": np.concatenate(h).view(np.int64)})

        for pdf in frames:
            for part, letters in _by_length(pdf):
                ids, length = part["id"].to_numpy(np.int64), letters.shape[1]
                for rows, h, less in edit_hashes(letters, alphabet):
                    for (shard, blocks, first), filled in filters.items():
                        if shard == min(length - less, LONGEST + 1) and (on := held(h, blocks, first, filled, masks)).any():
                            found.append((ids[rows[on]], h[on]))
                            n += len(found[-1][0])
                    if n > FLUSH:
                        yield given()
                        found, n = [], 0
        yield given()

    return materialize(asked.select("id", "word", "length").mapInPandas(probe, "id long, h long"), "edits")


def near_pairs(words: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """a, b (ids), word_a, word_b, n_a, n_b of all pairs of words one letter apart, once each."""
    # The letters that occur: at most 90.
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct()
    alphabet = "".join(sorted(r["c"] for r in letters.collect())).encode("latin-1")
    sizes = {r["shard"]: r["count"] for r in words.groupBy(_shard(F.col("length")).alias("shard")).count().collect()}  # at most LONGEST + 1 rows
    rounds = [_probed(words, parts, alphabet) for parts in filter_rounds(sizes, filter_bytes)]
    spark = words.sparkSession
    hits = spark.createDataFrame([], "id long, h long")
    for r in rounds:
        hits = hits.unionByName(r)
    a = words.select(F.col("id").alias("a"), F.col("word").alias("word_a"), F.col("n").alias("n_a"))
    b = words.select(F.col("id").alias("b"), F.col("word").alias("word_b"), F.col("n").alias("n_b"), "h")
    met = hits.withColumnRenamed("id", "a").join(b, "h").select("a", "b", "word_b", "n_b").dropDuplicates(["a", "b"])
    return materialize(met.join(a, "a").filter(F.levenshtein("word_a", "word_b", 1) == 1), "near-words")


def roots(forms: DataFrame) -> DataFrame:
    """forms: id, form_id (no cycles). id, root_id: the end of each id's chain."""
    at = materialize(forms.select("id", F.col("form_id").alias("root_id")), "roots")
    while True:
        on = at.select(F.col("id").alias("root_id"), F.col("root_id").alias("further"))
        after = materialize(at.join(on, "root_id", "left").select("id", F.coalesce("further", "root_id").alias("root_id"), F.col("further").isNotNull().alias("moved")), "roots")
        at = after.drop("moved")
        if after.filter("moved").isEmpty():
            return at


def grouped(docs: DataFrame, ratio: int = RATIO, filter_bytes: int = FILTER_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    words = vocabulary(docs, id_col=id_col, text_col=text_col)
    pairs = near_pairs(words, filter_bytes)
    both = pairs.select("a", "b", "word_b", "n_a", "n_b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("word_a").alias("word_b"), F.col("n_b").alias("n_a"), F.col("n_a").alias("n_b")))
    better = F.when(F.col("n_b") >= ratio * F.col("n_a"), F.struct((-F.col("n_b")).alias("order"), "word_b", "b"))
    near = materialize(both.groupBy("a").agg(F.count("*").alias("n_near"), F.min(better).alias("best")), "near-counts")
    formed = near.filter("best is not null").select(F.col("a").alias("id"), F.col("best.b").alias("form_id"))
    ends = roots(formed).join(words.select(F.col("id").alias("root_id"), F.col("word").alias("root")), "root_id").select(F.col("id").alias("a"), "root")
    found = words.select(F.col("id").alias("a"), "word", "n").join(near, "a", "left").join(ends, "a", "left")
    return found.select("word", F.col("best.word_b").alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), (-F.col("best.order")).alias("form_n"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents"))
