"""Near-duplicates by ProbMinHash over weighted word shingles, banding and verification.

A text's shingles (five lower-cased words; a shorter text is one shingle) are weighted by 1 + ln of their counts, so that
a passage that one copy repeats doesn't part it from the others, and a line that two texts repeat doesn't join them. Each
shingle sends its arrivals to the m registers of the signature: the t-th arrival comes after an exponential gap of rate
weight * (m - t) and hits a register that this shingle hasn't hit before, so a register's first arrival is exponential
with the shingle's weight as rate. A shingle stops as soon as its next arrival is later than every register's first.
Two texts agree in a register with their probability Jaccard similarity. Registers are cut into bands; texts that agree
in a whole band are candidates, and a pair is linked if its exact probability Jaccard reaches the threshold.

Hot groups: equal texts are one node from the start. In each band's bucket the member that meets most others is the
centre, and every member is verified against it, which takes as many pairs as the bucket has members. Links make
classes. In buckets that still hold several classes, members outside the centre's class are verified against all members
of other classes, so no link between candidates is lost: pair by pair in small buckets, in blocks of members in larger
ones, where one matrix product rules out most pairs. Within the centre's class no pair is expanded.

Work is by node, a distinct word list: its shingles are computed once, from one row that is chosen by hashes of its id
and text, however many rows repeat it. Rows are reduced to one an id and text before they are shuffled.

Defined cases: texts without words are classes of their own; null ids are kept and name a class only if it has no other;
repeated rows give a row each; a text of any length is one set of shingles; an empty table gives an empty result; other
columns, whatever their names, aren't read. A class is named by its smallest id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, text_or_empty
from .components import components

WORDS, THRESHOLD, REGISTERS, BANDS, BAND, BLOCK, TOGETHER, HOT_SHARE = 5, 0.8, 128, 25, 5, 128, 8, 1000
SLACK = 1e-12  # sums of fractions that are the threshold exactly may come out a little below it
_ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mixed(x):
    """A 64-bit finalizer over numpy's unsigned longs."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(_ODD[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_ODD[2])
    return x ^ (x >> np.uint64(31))


def words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


def shingles(found: list[bytes], n: int = WORDS):
    """(hashes, weights) of a word list's shingles, by hash."""
    import numpy as np
    import xxhash

    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    k, mult = min(n, len(h)), 1
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out += h[i : len(h) - k + 1 + i] * np.uint64(mult)
        mult = mult * _ODD[0] % 2**64
    found, times = np.unique(_mixed(out), return_counts=True)
    return found, (1 + np.log(times)).astype("<f4")


def signatures(sets: list, m: int = REGISTERS):
    """The signature (m shingles) of each of several weighted sets (hashes, weights)."""
    import numpy as np

    n = len(sets)
    e = np.concatenate([s for s, _ in sets])
    w = np.concatenate([c for _, c in sets]).astype(np.float64)
    d = np.repeat(np.arange(n), [len(s) for s, _ in sets])
    first, owner = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    start, step = _mixed(e ^ np.uint64(_ODD[0])) & np.uint64(m - 1), _mixed(e ^ np.uint64(_ODD[1])) & np.uint64(m - 1) | np.uint64(1)
    at = np.zeros(len(e))
    latest = np.full(n, np.inf)
    for t in range(m):
        unit = ((_mixed(e + np.uint64((t + 1) * _ODD[0] % 2**64)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        at = at - np.log(unit) / (w * (m - t))
        on = at < latest[d]
        if not on.all():
            e, w, d, at, start, step = e[on], w[on], d[on], at[on], start[on], step[on]
            if not len(e):
                break
        k = d * m + ((start + step * np.uint64(t)) & np.uint64(m - 1)).astype(np.int64)
        np.minimum.at(first, k, at)
        won = first[k] == at
        owner[k[won]] = e[won]
        latest = first.reshape(n, m).max(axis=1)
    return owner.reshape(n, m)


def band_keys(sig, bands: int = BANDS, size: int = BAND):
    """One hash a band."""
    import numpy as np

    cut = sig[:, : bands * size].reshape(len(sig), bands, size)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_ODD[1]), cut.shape[:2]).copy()
    for i in range(size):
        out = _mixed(out + cut[:, :, i] * np.uint64(_ODD[0]))
    return out.view(np.int64)


def probability_jaccard(a: tuple, b: tuple) -> float:
    """Exact, of two weighted sets (sorted hashes, weights)."""
    import numpy as np

    a, b = (a[0], a[1].astype(np.float64)), (b[0], b[1].astype(np.float64))
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    both = b[0][at] == a[0]
    x, y = a[1][both], b[1][at[both]]
    if not len(x):
        return 0.0
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    # sum of max(x_j / x_i, y_j / y_i): x counts where y_j / x_j is at most y_i / x_i
    upto, after = np.cumsum(x), y.sum() - np.cumsum(y)
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    return float((1.0 / ((only_a + upto) / x + (only_b + after) / y)).sum())


def _signed(docs: DataFrame) -> DataFrame:
    """id, key, row (hashes of the text, and of id and text), fp (digest of the word list; null without words), bands."""

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                lists = [words(t) for t in part["text"]]
                fps = [hashlib.blake2b(b" ".join(x), digest_size=16).digest() if x else None for x in lists]
                some = [i for i, x in enumerate(lists) if x]
                keys: list = [None] * len(lists)
                if some:
                    for i, row in zip(some, band_keys(signatures([shingles(lists[i]) for i in some])), strict=True):
                        keys[i] = row
                yield part[["id", "key", "row"]].assign(fp=fps, bands=keys)

    return docs.mapInPandas(sign, "id long, key long, row long, fp binary, bands array<long>")


def _features(docs: DataFrame, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """node, s, w: hashes and weights of the shingles, as bytes, of the asked nodes, one row each. nodes: node, key, row."""
    texts = docs.groupBy("key", "row").agg(F.first("text").alias("text"))
    wanted = nodes.join(asked, "node").select("node", "key", "row")

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [shingles(words(t)) for t in pdf["text"]]
            yield pd.DataFrame({"node": pdf["node"], "s": [s.tobytes() for s, _ in found], "w": [w.tobytes() for _, w in found]})

    return materialize(texts.join(wanted, ["key", "row"]).select("node", "text").mapInPandas(features, "node long, s binary, w binary"), "shingles")


def _set(s: bytes, w: bytes) -> tuple:
    import numpy as np

    return np.frombuffer(s, "<u8"), np.frombuffer(w, "<f4")


def _verified(pairs: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """pairs (a, b: nodes) whose exact similarity reaches the threshold. found: features.

    An a with over a thousandth of all pairs, as the centre of many near copies is, is copied once for each thousandth, and
    its pairs are dealt to the copies; those a are at most a thousand rows whatever the data."""
    times = pairs.groupBy("a").agg(F.count("*").alias("n"))
    total = F.broadcast(times.agg(F.sum("n").alias("total")))
    hot = F.broadcast(times.crossJoin(total).filter(F.col("n") * HOT_SHARE > F.col("total")).select("a", F.ceil(F.col("n") * HOT_SHARE / F.col("total")).alias("copies")))
    pairs = pairs.join(hot, "a", "left").withColumn("copy", F.pmod(F.xxhash64("b"), F.coalesce("copies", F.lit(1)))).drop("copies")
    left = found.select(F.col("node").alias("a"), F.col("s").alias("sa"), F.col("w").alias("wa")).join(hot, "a", "left")
    left = left.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
    right = found.select(F.col("node").alias("b"), F.col("s").alias("sb"), F.col("w").alias("wb"))

    def linked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            ok = [probability_jaccard(_set(sa, wa), _set(sb, wb)) >= threshold - SLACK for sa, wa, sb, wb in zip(pdf["sa"], pdf["wa"], pdf["sb"], pdf["wb"], strict=True)]
            yield pdf.loc[ok, ["a", "b"]]

    return materialize(pairs.join(right, "b").join(left, ["a", "copy"]).mapInPandas(linked, "a long, b long"), "verified")


def block_links(x: list[tuple], y: list[tuple], threshold: float) -> list[tuple[int, int]]:
    """Places (i, j) of the pairs of two blocks of weighted sets that reach the threshold. One matrix product counts the
    common shingles of all pairs. Where no shingle of a pair repeats, that gives the similarity itself; else the share of
    a set's weight on common shingles bounds it from above, and what the bound leaves is computed."""
    import numpy as np

    known = np.unique(np.concatenate([s for s, _ in x]))
    both = known[np.isin(known, np.concatenate([s for s, _ in y]))]

    def matrix(sets: list[tuple]):
        weights, here = np.zeros((len(sets), len(both)), np.float32), np.zeros((len(sets), len(both)), np.float32)
        for i, (s, c) in enumerate(sets):
            at = np.searchsorted(both, s)
            at[at == len(both)] = 0
            on = both[at] == s if len(both) else np.zeros(len(s), bool)
            weights[i, at[on]], here[i, at[on]] = c[on] / c.sum(), 1
        plain = np.array([c.max() == 1 for _, c in sets])
        return weights, here, plain, np.array([len(s) for s, _ in sets], np.float64)

    (wx, hx, px, nx), (wy, hy, py, ny) = matrix(x), matrix(y)
    common = (hx @ hy.T).astype(np.float64)
    sure = np.outer(px, py)
    exact = common / (nx[:, None] + ny[None, :] - common)
    bound = np.where(sure, exact, np.minimum(wx @ hy.T, (wy @ hx.T).T) + 1e-5)
    return [(i, j) for i, j in np.argwhere(bound >= threshold - SLACK).tolist() if sure[i, j] or probability_jaccard(x[i], y[j]) >= threshold - SLACK]


def _block_verified(rows: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """rows: bucket, node, cls, side (0: the bucket's main class, 1: others), n0, n1. Links (a, b) between members of
    different classes of one bucket. Members are dealt by hash into blocks of about BLOCK; a block of others meets every
    block of its bucket, so nothing but links comes out. TOGETHER blocks of others and as many of all meet in a task, so a
    large bucket is spread over the square of its groups of blocks, and a task holds few of them at a time."""
    n = F.ceil(F.when(F.col("side") == 0, F.col("n0")).otherwise(F.col("n1")) / BLOCK)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("node"), n)).select("bucket", "side", "block", "n0", "n1", "node", "cls").join(found, "node")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        one = [*pdf[["bucket", "side", "block", "n0", "n1"]].iloc[0].tolist(), pdf["node"].tolist(), pdf["cls"].tolist(), pdf["s"].tolist(), pdf["w"].tolist()]
        return pd.DataFrame([one], columns=["bucket", "side", "block", "n0", "n1", "nodes", "classes", "s", "w"])

    cols = "bucket long, side int, block long, n0 long, n1 long, nodes array<long>, classes array<long>, s array<binary>, w array<binary>"
    blocks = materialize(dealt.groupBy("bucket", "side", "block").applyInPandas(pack, cols), "blocks")
    g0, g1 = (F.ceil(F.ceil(F.col(c) / BLOCK) / TOGETHER) for c in ("n0", "n1"))  # groups of blocks; those of others come last
    group, upto = F.floor(F.col("block") / TOGETHER), lambda c: F.sequence(F.lit(0).cast("long"), c - 1)
    x = blocks.filter("side = 1").select("bucket", group.alias("gx"), F.explode(upto(g0 + g1)).alias("g"), F.col("block").alias("xb"), *[F.col(c).alias(f"x_{c}") for c in ("nodes", "classes", "s", "w")])
    y = blocks.select("*", F.explode(upto(g1)).alias("gx"), F.when(F.col("side") == 0, group).otherwise(g0 + group).alias("g")).drop("n0", "n1")
    meet = x.join(y, ["bucket", "gx", "g"]).filter("side = 0 or xb <= block")

    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                pairs = block_links([_set(*z) for z in zip(r.x_s, r.x_w, strict=True)], [_set(*z) for z in zip(r.s, r.w, strict=True)], threshold)
                yield pd.DataFrame([(r.x_nodes[i], r.nodes[j]) for i, j in pairs if r.x_classes[i] != r.classes[j]], columns=["a", "b"], dtype="int64")

    # A row is two blocks, a few MB; Arrow batches are bounded in bytes too.
    return materialize(meet.mapInPandas(link, "a long, b long").distinct(), "block-links")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, key (a hash of the text), class_id (the smallest id of its class), kept (whether the row has its
    class's id and, of that id's texts in the class, the first)."""
    text = text_or_empty(text_col)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), F.xxhash64(F.col(id_col).cast("long"), text).alias("row"), text.alias("text"))
    signed = materialize(_signed(plain), "signed")
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "key", "row"))
    reps = signed.filter("fp is not null").groupBy("fp").agg(first.alias("one"), F.first("bands").alias("bands")).select("fp", "one.id", "one.key", "one.row", "bands")
    reps = materialize(reps.withColumn("node", F.monotonically_increasing_id()), "nodes")  # the numbers are fixed by writing them
    nodes = reps.select("node", "id", "key", "row", "fp")

    rows = reps.select("node", F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    live = materialize(rows.join(sizes, "bucket"), "buckets")
    degree = live.groupBy("node").agg(F.sum("n").alias("degree"))
    ranked = live.join(degree, "node").select("bucket", "node", F.struct("degree", (-F.col("node")).alias("o")).alias("by"))
    centres = ranked.groupBy("bucket").agg((-F.max("by")["o"]).alias("centre"))
    star = materialize(live.join(centres, "bucket").filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    found = _features(plain, nodes, star.select(F.col("a").alias("node")).unionByName(star.select(F.col("b").alias("node"))).distinct())
    links = _verified(star, found, threshold)
    classes = materialize(components(links), "classes")

    # What the centres couldn't decide: members of other classes than their bucket's centre.
    classed = live.join(classes, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("cls"))
    main = centres.join(classes.withColumnRenamed("node", "centre"), "centre", "left").select("bucket", F.coalesce("component", "centre").alias("main"))
    sided = classed.join(main, "bucket").select("bucket", "node", "cls", (F.col("cls") != F.col("main")).cast("int").alias("side"))
    counts = sided.groupBy("bucket").agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1")).filter("n1 > 0")
    rest = materialize(sided.join(counts, "bucket"), "mixed-buckets")
    few = rest.filter(F.col("n0") + F.col("n1") <= BLOCK // 2)
    a, b = few.filter("side = 1").select("bucket", F.col("node").alias("a"), F.col("cls").alias("ca")), few.select("bucket", F.col("node").alias("b"), F.col("cls").alias("cb"), "side")
    cross = a.join(b, "bucket").filter("ca <> cb and (side = 0 or ca < cb)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    new = materialize(cross.join(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "cross-pairs")
    more = _verified(new, found, threshold)
    more = more.unionByName(_block_verified(rest.filter(F.col("n0") + F.col("n1") > BLOCK // 2), found, threshold))
    # The new links join classes: components of classes, not of all nodes again.
    of = classes.select("node", "component")
    joins = more.join(of.toDF("a", "ca"), "a", "left").join(of.toDF("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    wider = components(joins).toDF("cls", "wider")
    ids = classes.unionByName(joins.select(F.col("a").alias("node")).unionByName(joins.select(F.col("b").alias("node"))).distinct().join(classes.select("node"), "node", "left_anti").withColumn("component", F.col("node")))
    classes = materialize(ids.withColumnRenamed("component", "cls").join(wider, "cls", "left").select("node", F.coalesce("wider", "cls").alias("component")), "all-classes")

    named = nodes.join(classes, "node", "left").select("node", "id", "fp", F.coalesce("component", "node").alias("cls"))
    names = named.groupBy("cls").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "node")).alias("first"))
    texts = named.join(names, "cls").select("fp", F.col("first.id").alias("class_id"), (F.col("node") == F.col("first.node")).alias("first"))
    known = signed.filter("fp is not null").select("id", "key", "fp").join(materialize(texts, "text-classes"), "fp")
    known = known.select("id", "key", "class_id", (F.col("first") & F.col("id").eqNullSafe(F.col("class_id"))).alias("kept"))
    alone = signed.filter("fp is null").select("id", "key", F.col("id").alias("class_id"), F.lit(True).alias("kept"))
    return known.unionByName(alone)


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class the row with the smallest id stays; of rows that repeat that id and text, one.

    A row without words is a class of its own and stays; so does one with a null id, unless its class has another id.
    Columns, also nulls and any with clashing names, are kept as they are; an empty table stays empty."""
    losers = near_duplicates(docs).filter("not kept").select("id", "key").distinct()
    text = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    kept = docs.join(losers, docs["doc_id"].eqNullSafe(losers["id"]) & (text == losers["key"]), "left_anti")
    own = [F.col(f"`{c}`") for c in docs.columns]
    return kept.dropDuplicates(["doc_id", "text"]).select(*own)
