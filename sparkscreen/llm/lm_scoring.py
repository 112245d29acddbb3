"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions. For each decision there is a context tree of the up to DEPTH bytes before; a node
holds the zeros and ones seen in training under its context, and the tree mixes the Krichevsky-Trofimov estimates of
all depths: P(node) = 1/2 KT(node) + 1/2 product of P(children), at full depth KT alone. The model is trained in one
pass of counts and a grouped sum for each depth, from the deepest up: exact counts of all training texts, on Spark.
What a decision then gets is the chance that the trained tree gives to one more bit: on the path of its contexts, each
depth's estimate with the weight KT / (KT + product of children) of its node, the rest to the next depth. A context not
seen in training says 1/2.

Scoring is by the exact nodes. Contexts and bytes of texts that aren't trained on are in the tree with counts of zero,
which change no sum. From the root down each node gets what its path says so far, by a join of each depth with the one
above, and so each distinct (context, byte) of the corpus, a gram, its chance. The most frequent grams, at most HOT,
are broadcast, a fixed number; a task looks up each distinct gram of a batch once. The others are joined with their
chances, text by text; as they are less frequent than any of those, none is a hot key.

The unigram base is exact: the end and the KNOWN most frequent words are broadcast, a fixed number of at most LONGEST
bytes each, as longer words go by a digest. The others are joined with their counts; as they are less frequent than any
of those, none is a hot key.

A-Z are lower-cased; a text starts after DEPTH bytes that no text has and ends with another, so lengths are comparable.
Defined cases: a null text is empty and has the end only; a null id counts as the empty string for the split; repeated
rows are scored alike (and counted each time in training); a text of any length is scored whole, and a word of any
length counted as one; an empty table gives an empty result; without training texts each bit gets 1/2; other columns,
whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, text_or_empty

DEPTH, HOT, KNOWN, LONGEST = 4, 2**21, 131_072, 64
START, END = 0xFE, 0xFF  # bytes that UTF-8 doesn't use
BATCH, MOST_WORDS = 4_000_000, 400_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def folded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER)


def grams_of(texts: list[bytes], depth: int = DEPTH):
    """(DEPTH context bytes and a byte as one number) for each byte of the texts and their ends; each text's first place."""
    import numpy as np

    raw = b"".join(bytes([START] * depth) + t + bytes([END]) for t in texts)
    a = np.frombuffer(raw, np.uint8)
    g = a[: len(a) - depth].astype(np.uint64)
    for i in range(1, depth + 1):
        g <<= np.uint64(8)
        g |= a[i : len(a) - depth + i]
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes + depth)[:-1]])
    keep = np.ones(len(g), bool)
    for s in range(1, depth + 1):  # places whose byte belongs to the next text's start
        at = starts[1:] - s
        keep[at] = False
    return g[keep], np.concatenate([[0], np.cumsum(sizes)[:-1]])


def most_texts(depth: int) -> int:
    """How many texts a batch may have, so that a text's number and a gram fit one 64-bit number."""
    return 2 ** min(24, 64 - 8 * (depth + 1))


def text_grams(texts: list[bytes], depth: int = DEPTH):
    """The distinct grams of each text: (text's place, gram, times), by text and gram; and the distinct grams of all texts.

    One plain sort of numbers that hold both. At most most_texts(depth) texts."""
    import numpy as np

    g, starts = grams_of(texts, depth)
    bits = np.uint64(8 * (depth + 1))
    if len(texts) == 1:  # the only case in which a gram may fill all 64 bits
        u, times = np.unique(g, return_counts=True)
        return np.zeros(len(u), np.int64), u, times, u
    sizes = np.diff(np.concatenate([starts, [len(g)]]))
    both, times = np.unique(g | np.repeat(np.arange(len(texts), dtype=np.uint64) << bits, sizes), return_counts=True)
    own = both & ((np.uint64(1) << bits) - np.uint64(1))
    return (both >> bits).astype(np.int64), own, times, np.unique(own)


def word_key(word: bytes) -> bytes:
    """A word itself, or for one of over LONGEST bytes a digest, which no word equals; so keys are of bounded size."""
    return word if len(word) <= LONGEST else b"\0" + hashlib.sha512(word).digest()


def _is_training(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 != 1


def _partial_counts(texts: DataFrame, depth: int) -> DataFrame:
    """gram or word, n and, for grams, times: what each task has seen in training texts and in all. Tables in a task are emptied when full.

    texts: text, training."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        seen, many = np.zeros(0, np.uint64), np.zeros((2, 0), np.int64)
        words: Counter = Counter()

        def grams_out():
            return pd.DataFrame({"gram": seen.astype(np.int64), "word": None, "n": many[1], "times": many.sum(axis=0)})

        def words_out():
            return pd.DataFrame({"gram": pd.array([None] * len(words), "Int64"), "word": list(words.keys()), "n": list(words.values()), "times": 0})

        def batches() -> Iterator[tuple[list[bytes], int]]:
            """Folded texts, and whether they are trained on (1) or not (0)."""
            batch, size = ([], []), [0, 0]
            for pdf in frames:
                for t, i in zip(pdf["text"], pdf["training"].astype(int), strict=True):
                    batch[i].append(folded(t))
                    size[i] += len(batch[i][-1])
                    if size[i] > BATCH:
                        yield list(batch[i]), i
                        batch[i].clear()
                        size[i] = 0
            for i in (0, 1):
                if batch[i]:
                    yield batch[i], i

        for batch, training in batches():
            g, _ = grams_of(batch, depth)
            u, n = np.unique(g, return_counts=True)
            at = np.searchsorted(seen, u)
            old = seen[np.minimum(at, len(seen) - 1)] == u if len(seen) else np.zeros(len(u), bool)
            many[training, at[old]] += n[old]
            fresh = np.zeros((2, len(u) - int(old.sum())), np.int64)
            fresh[training] = n[~old]
            seen, many = np.insert(seen, at[~old], u[~old]), np.insert(many, at[~old], fresh, axis=1)
            if len(seen) > 2_000_000:
                yield grams_out()
                seen, many = np.zeros(0, np.uint64), np.zeros((2, 0), np.int64)
            if not training:
                continue
            for t in batch:
                words.update(map(word_key, t.split()))
            words[bytes([END])] += len(batch)
            if len(words) > MOST_WORDS:
                yield words_out()
                words = Counter()
        yield grams_out()
        yield words_out()

    return texts.mapInPandas(count, "gram long, word binary, n long, times long")


def _lgamma(x: Column) -> Column:
    """ln of the gamma function for x of at least 1/2: Stirling's series at x + 7."""
    y, product = x + 7, x
    for i in range(1, 7):
        product = product * (x + i)
    return (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - F.ln(product)


def _kt(n0: Column, n1: Column) -> Column:
    """ln of the Krichevsky-Trofimov chance of a sequence with these counts."""
    chance = _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - F.lit(1.1447298858494002) - _lgamma(n0 + n1 + 1.0)
    return F.when(n0 + n1 > 0, chance).otherwise(0.0)


def _decisions(counts: DataFrame) -> DataFrame:
    """The eight decisions of each gram: gram, ctx, node, bit, n."""
    split = counts.select("gram", F.expr("shiftrightunsigned(gram, 8)").alias("ctx"), F.expr("gram & 255").alias("b"), "n", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    return split.select("gram", "ctx", F.expr("shiftleft(1L, k) | shiftright(b, 8 - k)").alias("node"), F.expr("shiftright(b, 7 - k) & 1").alias("bit"), "n")


def context_trees(counts: DataFrame, depth: int = DEPTH) -> list[DataFrame]:
    """counts: gram, n. The nodes of each depth, from 0: ctx, node, n0, n1, own (ln KT), below (ln of the children's product), all."""
    level = _decisions(counts).groupBy("ctx", "node").agg(F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("n1"))
    level = level.withColumn("own", _kt(F.col("n0"), F.col("n1"))).withColumn("below", F.col("own")).withColumn("all", F.col("own"))
    level = materialize(level, f"ctw-{depth}")
    levels = [level]
    for d in range(depth - 1, -1, -1):
        up = level.groupBy(F.expr(f"ctx & {256**d - 1}L").alias("ctx"), "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("all").alias("below"))
        up = up.withColumn("own", _kt(F.col("n0"), F.col("n1")))
        top = F.greatest("own", "below")
        up = up.withColumn("all", top + F.ln(F.exp(F.col("own") - top) + F.exp(F.col("below") - top)) - F.ln(F.lit(2.0)))
        level = materialize(up.select(*level.columns), f"ctw-{d}")
        levels.append(level)
    return levels[::-1]


def gram_chances(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """counts: gram, n, times. gram, times, chance: log10 of the model's chance of each gram's byte after its context.

    What a path says of a bit is linear in what its deeper part says: said + left * deeper. A node has at most 256 children.
    """
    kt = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
    weight = 1.0 / (1.0 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("below") - F.col("own")))))
    path = None
    for d, level in enumerate(context_trees(counts, depth)):
        nodes = level.select("ctx", "node", kt.alias("kt"), (weight if d < depth else F.lit(1.0)).alias("w"))
        if path is None:
            path = nodes.select("ctx", "node", (F.col("w") * F.col("kt")).alias("said"), (1.0 - F.col("w")).alias("left"))
            continue
        above = path.select(F.col("ctx").alias("up"), "node", "said", "left")
        path = nodes.withColumn("up", F.expr(f"ctx & {256 ** (d - 1) - 1}L")).join(above, ["up", "node"]).select(
            "ctx", "node", (F.col("said") + F.col("left") * F.col("w") * F.col("kt")).alias("said"), (F.col("left") * (1.0 - F.col("w"))).alias("left")
        )
    bits = _decisions(counts.select("gram", F.col("times").alias("n"))).join(path.select("ctx", "node", "said"), ["ctx", "node"])
    chance = F.sum(F.log10(F.when(F.col("bit") == 1, F.col("said")).otherwise(1.0 - F.col("said"))))
    return materialize(bits.groupBy("gram").agg(F.first("n").alias("times"), chance.alias("chance")), "lm-chances")


def hot_grams(chances: DataFrame, most: int) -> tuple:
    """Of the most frequent grams at most so many, as sorted numbers, and their chances: those of at least a number of times, so ties go together."""
    import numpy as np

    # Classes of times, finer than one in 64: a bounded number of rows.
    kind = F.floor(F.ln("times") * 64).cast("int")
    taken, least = 0, None
    for r in sorted(chances.groupBy(kind.alias("kind")).count().collect(), key=lambda r: -r["kind"]):
        taken += r["count"]
        if taken > most:
            break
        least = r["kind"]
    grams, logs = [np.zeros(0, np.uint64)], [np.zeros(0)]
    if least is not None:

        def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                yield pd.DataFrame({"gram": [pdf["gram"].to_numpy(np.int64).tobytes()], "chance": [pdf["chance"].to_numpy(np.float64).tobytes()]})

        for r in chances.filter(kind >= least).select("gram", "chance").mapInPandas(pack, "gram binary, chance binary").toLocalIterator():
            grams.append(np.frombuffer(bytes(r["gram"]), np.uint64))
            logs.append(np.frombuffer(bytes(r["chance"])))
    grams, logs = np.concatenate(grams), np.concatenate(logs)
    order = np.argsort(grams)
    return grams[order], logs[order]


def scored(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    import math

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("string").alias("id"), text_or_empty(text_col).alias("text"), _is_training(F.col(id_col)).alias("training"))
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    part = materialize(_partial_counts(rows.select("text", "training"), depth), "lm-counts")
    counts = materialize(part.filter("gram is not null").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("times").alias("times")), "lm-grams")
    chances = gram_chances(counts, depth)
    hot_chances = spark.sparkContext.broadcast(hot_grams(chances, HOT))
    words = materialize(part.filter("word is not null").groupBy("word").agg(F.sum("n").alias("c")), "lm-words")
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    end = bytes([END])
    is_end = F.col("word") == F.lit(end)
    frequent = {bytes(r["word"]): r["c"] for r in words.filter(is_end).unionByName(words.filter(~is_end).orderBy(F.desc("c"), "word").limit(KNOWN)).toLocalIterator()}
    known = spark.sparkContext.broadcast({w: (math.log10(c + 0.5), 1) for w, c in frequent.items()})
    unseen_end = (math.log10(0.5), 0)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        (grams, logs), hot = hot_chances.value, known.value

        def out(keys: list, ids: list, training: list, texts: list[bytes]) -> list[pd.DataFrame]:
            place, own_grams, times, u = text_grams(texts, depth)
            at = np.minimum(np.searchsorted(grams, u), max(len(grams) - 1, 0))
            found_hot = grams[at] == u if len(grams) else np.zeros(len(u), bool)
            of_u = np.zeros(len(u))
            of_u[found_hot] = logs[at[found_hot]]
            where = np.searchsorted(u, own_grams)
            chance = np.bincount(place, of_u[where] * times, len(texts))
            # Grams that aren't broadcast, by text: for the join.
            cold = ~found_hot[where]
            c = pd.DataFrame({"key": np.array(keys)[place[cold]], "gram": own_grams[cold].astype(np.int64), "n": times[cold]})
            own, rest = [], []
            for key, i, tr, t, s in zip(keys, ids, training, texts, chance, strict=True):
                found = t.split()
                base, n_known = hot.get(end, unseen_end)
                for w, n in Counter(map(word_key, found)).items():
                    if x := hot.get(w):
                        base += n * x[0]
                        n_known += n
                    else:
                        rest.append((key, w, n))
                own.append((key, i, not tr, len(found) + 1, n_known, base, float(s), len(t)))
            a = pd.DataFrame(own, columns=["key", "id", "held_out", "n_tokens", "n_known", "base", "score", "n_bytes"])
            b = pd.DataFrame(rest, columns=["key", "word", "n"])
            return [x.reindex(columns=names).astype(kinds) for x in (a, b, c) if len(x)]

        for pdf in frames:
            at, size = 0, 0
            texts = [folded(t) for t in pdf["text"]]
            for i, t in enumerate(texts):
                size += len(t) + 1
                if size > BATCH or i + 1 - at == most_texts(depth) or i + 1 == len(texts):
                    part = slice(at, i + 1)
                    yield from out(pdf["key"].iloc[part].tolist(), pdf["id"].iloc[part].tolist(), pdf["training"].iloc[part].tolist(), texts[part])
                    at, size = i + 1, 0

    schema = "key long, id string, held_out boolean, n_tokens long, n_known long, base double, score double, n_bytes long, word binary, gram long, n long"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"held_out": "boolean", **dict.fromkeys(("n_tokens", "n_known", "n_bytes", "gram", "n"), "Int64"), **dict.fromkeys(("base", "score"), "float64"), **dict.fromkeys(("id", "word"), "object")}
    once = materialize(rows.withColumn("key", F.monotonically_increasing_id()).mapInPandas(score, schema), "lm-scores")
    c = F.coalesce(F.col("c"), F.lit(0))
    rest = once.filter("word is not null").select("key", "word", "n").join(words, "word", "left")
    rest = rest.select("key", F.when(c > 0, F.col("n")).otherwise(0).alias("more_known"), (F.col("n") * F.log10(c + 0.5)).alias("more")).groupBy("key").agg(F.sum("more_known").alias("more_known"), F.sum("more").alias("more"))
    rare = once.filter("gram is not null").select("key", "gram", "n").join(chances.select("gram", "chance"), "gram")
    rare = rare.groupBy("key").agg(F.sum(F.col("n") * F.col("chance")).alias("more_score"))
    joined = once.filter("word is null and gram is null").join(rest, "key", "left").join(rare, "key", "left")
    score_all = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    per_token = math.log10(total["n"] + 0.5 * (total["v"] + 1))
    return joined.select(
        F.col("id").cast(kind).alias("id"), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(total["n"])).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(per_token)).alias("base_score"), score_all.alias("score"), "n_bytes",
        (-score_all / math.log10(2) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
