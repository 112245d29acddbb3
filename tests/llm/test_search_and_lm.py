"""Vector search against all pairs, and context-tree scores against exact trees."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkscreen.llm import ann_search, lm_scoring


def test_search(spark, data):
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    got: dict = {}
    for r in ann_search.op5_ann_search(spark, data).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in rows if i % 20 == 0}
    hits = []
    for q, found in got.items():
        best = sorted(((-float((rows[i] * rows[q]).sum()), i) for i in rows if i != q))[:20]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(best) + 1))
        assert all(s == float((rows[i] * rows[q]).sum()) for _, i, s in found)
        hits.append(len({i for _, i in best} & {i for _, i, _ in found}) / len(best))
    assert np.mean(hits) >= 0.9


def test_windows_recall():
    """A segment of evenly spread vectors: windows leave most of them out, also where no bound is known before."""
    rng = np.random.default_rng(1)
    v = rng.standard_normal((6000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    ids = np.arange(len(v))
    order, values = ann_search.sorted_arrays(np.column_stack([v, np.zeros(len(v))]), ann_search.directions(65))
    best = {i: np.lexsort((ids, -np.where(ids == i, -9.0, (v * v[i]).sum(axis=1))))[:20] for i in range(20)}
    for bounds in (np.full(20, -np.inf), np.array([(v[best[i][-1]] * v[i]).sum() for i in range(20)])):
        q, found, score, verified = ann_search.search_segment(ids[:20], v[:20], bounds, ids, v, 1.0, order, values)
        assert np.mean([len(set(best[i]) & set(found[q == i])) / 20 for i in range(20)]) >= 0.9
        assert all(s == (v[a] * v[b]).sum() for a, b, s in zip(q, found, score, strict=True))
        assert verified < 0.7 * 20 * len(v)


def test_reach_is_what_the_binomial_asks():
    rng = np.random.default_rng(0)
    collide = (np.abs(rng.standard_normal((20000, ann_search.PROJECTIONS))) <= ann_search.reach()).sum(axis=1) >= ann_search.THRESHOLD
    assert abs(collide.mean() - ann_search.SURE) < 0.01


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (8, [1.0, 1.0, 1.0]), (40, [1.0, 2.0, 3.0]), (1, [0.5, 0.5]), (9, [])]
    df = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<double>, v string")
    got = sorted([tuple(r) for r in ann_search.nearest(df, F.col("id") % 20 == 0).collect()])
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 0, 0.0), (40, 1, 8, 6.0)]
    assert ann_search.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0


def recall(spark, v, every=100, **how):
    """Mean recall at 20 of each so many-th vector, and the share of all vectors that a query verified."""
    ids = np.arange(len(v))
    df = spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": v.tolist()}))
    found = ann_search.found_by_segment(df, F.col("id") % every == 0, **how).toPandas()
    best = {q: set(np.lexsort((ids, -np.where(ids == q, -np.inf, (v * v[q]).sum(axis=1))))[:20].tolist()) for q in ids[::every].tolist()}
    top = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(20)
    got = top.groupby("query_id")["vec_id"].apply(set).to_dict()
    assert set(got) == set(best) and not found.duplicated(["query_id", "vec_id"]).any()
    return np.mean([len(best[q] & got[q]) / 20 for q in best]), found["verified"].sum() / len(best) / len(v)


@pytest.mark.parametrize("norms", ["one long", "one very long", "log-normal"])
def test_recall_where_norms_differ(spark, norms):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((6000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    if norms == "log-normal":
        v *= np.exp(0.5 * rng.standard_normal(len(v)))[:, None]
    else:
        v[17] *= {"one long": 3, "one very long": 100}[norms]
    assert recall(spark, v)[0] >= 0.9


def test_recall_of_many_vectors_and_the_share_verified(spark, monkeypatch):
    """20,000 evenly spread vectors in several segments; the share falls as the table grows, by the same rule."""
    monkeypatch.setattr(ann_search, "SEGMENT", 4096)
    v = np.random.default_rng(4).standard_normal((20_000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    large, small = recall(spark, v, 200), recall(spark, v[:1000], 20)
    print("recall and share verified of 20,000:", large, "of 1,000:", small)
    assert large[0] >= 0.9 and small[0] >= 0.9
    assert large[1] < 0.3 and large[1] < 0.6 * small[1]


def test_clusters_meet_only_what_is_near(spark, monkeypatch):
    """Clustered vectors: most pairs of a block and a segment are never formed, and recall holds."""
    monkeypatch.setattr(ann_search, "SEGMENT", 256)
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 64)) * 4
    v = centres[rng.integers(0, 40, 5000)] + 0.3 * rng.standard_normal((5000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    got = recall(spark, v, 50)
    assert got[0] >= 0.9 and got[1] < 0.1


def test_copies_of_a_third_of_all(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((900, 8))
    v[::3] = v[0]
    assert recall(spark, v, 30)[0] >= 0.9


DEPTH = 2


@pytest.fixture(scope="module")
def docs():
    texts = ["the cat sat on the mat", "The dog sat", None, "", "a é b", "zzz " * 50, "the end of the\ttale"] * 3
    return [(i if i != 4 else None, t) for i, t in enumerate(texts)]


def steps(text):
    b = bytes([lm_scoring.START] * DEPTH) + lm_scoring.folded(text or "") + bytes([lm_scoring.END])
    for i in range(DEPTH, len(b)):
        for k in range(8):
            yield b[i - DEPTH : i], (1 << k) | (b[i] >> (8 - k)), (b[i] >> (7 - k)) & 1


def exact(docs):
    """The training texts, and a function of a text's score by trees in plain Python."""
    training = [t for i, t in docs if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1]
    counts: dict = defaultdict(lambda: [0, 0])
    for t in training:
        for x, node, bit in steps(t):
            for d in range(DEPTH + 1):
                counts[d, x[DEPTH - d :], node][bit] += 1
    below: dict = defaultdict(float)
    weight = {}
    for d in range(DEPTH, -1, -1):
        for k in [k for k in counts if k[0] == d]:
            a, b = counts[k]
            own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
            weight[k] = 1.0 if d == DEPTH else 1 / (1 + math.exp(min(700, below[k] - own)))
            if d:
                below[d - 1, k[1][1:], k[2]] += own if d == DEPTH else np.logaddexp(own, below[k]) - math.log(2)

    def score(t):
        s = 0.0
        for x, node, bit in steps(t):
            p = 0.5
            for d in range(DEPTH, -1, -1):
                if (k := (d, x[DEPTH - d :], node)) in counts:
                    p = weight[k] * (counts[k][1] + 0.5) / (sum(counts[k]) + 1) + (1 - weight[k]) * p
            s += math.log10(p if bit else 1 - p)
        return s

    return training, score


def test_scores_against_exact_trees(spark, docs):
    df = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, word string")
    got = lm_scoring.scored(df, DEPTH).collect()
    assert len(got) == len(docs)
    training = [t for i, t in docs if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1]
    counts: dict = defaultdict(lambda: [0, 0])
    for t in training:
        for x, node, bit in steps(t):
            for d in range(DEPTH + 1):
                counts[d, x[DEPTH - d :], node][bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    below: dict = defaultdict(float)
    weight = {}
    for d in range(DEPTH, -1, -1):
        for k in [k for k in counts if k[0] == d]:
            own = kt(*counts[k])
            weight[k] = 1.0 if d == DEPTH else 1 / (1 + math.exp(below[k] - own))
            total = own if d == DEPTH else np.logaddexp(own, below[k]) - math.log(2)
            if d:
                below[d - 1, k[1][1:], k[2]] += total

    def score(t):
        s = 0.0
        for x, node, bit in steps(t):
            p = 0.5
            for d in range(DEPTH, -1, -1):
                if (k := (d, x[DEPTH - d :], node)) in counts:
                    p = weight[k] * (counts[k][1] + 0.5) / (sum(counts[k]) + 1) + (1 - weight[k]) * p
            s += math.log10(p if bit else 1 - p)
        return s

    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", lm_scoring.folded(t or "").decode()), "<end>"]
    c = Counter(w for t in training for w in words(t))
    n, v = sum(c.values()), len(c)
    by = {(r["id"]): r for r in got}
    for i, t in docs:
        r = by[i]
        assert r["score"] == pytest.approx(score(t), rel=1e-3), t
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words(t)), sum(c[w] > 0 for w in words(t)), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t)))
        assert r["held_out"] == (zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1)


@pytest.mark.parametrize("hot", [0, 4, 2**21])
def test_rare_grams_keep_scores_exact(spark, monkeypatch, hot):
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(97, 123, 40))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(lm_scoring, "HOT", hot)
    got = {r["id"]: r["score"] for r in lm_scoring.scored(df, DEPTH).collect()}
    _, score = exact([(i, t) for i, t in enumerate(texts)])
    assert len(got) == len(texts)
    assert all(got[i] == pytest.approx(score(t), rel=1e-9) for i, t in enumerate(texts))


def base_of(docs):
    """(n_tokens, n_known, base score) of a text by the unigram rule in plain Python, and the number of training tokens."""
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", lm_scoring.folded(t or "").decode()), None]
    c = Counter(w for i, t in docs if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1 for w in words(t))
    n, v = sum(c.values()), len(c)
    return lambda t: (len(words(t)), sum(c[w] > 0 for w in words(t)), sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t)))


@pytest.mark.parametrize("known", [0, 1, 2])
def test_rare_words_come_from_the_join(spark, monkeypatch, known):
    """The end is never among the most frequent words here, and words longer than any key occur."""
    docs = [(i, f"same same word{i} {'long' * 40} {'y' * 3000 if i % 2 else 'z' * 70}") for i in range(6)]
    monkeypatch.setattr(lm_scoring, "KNOWN", known)
    base = base_of(docs)
    got = {r["id"]: r for r in lm_scoring.scored(spark.createDataFrame(docs, "doc_id long, text string"), DEPTH).collect()}
    for i, t in docs:
        want = base(t)
        assert (got[i]["n_tokens"], got[i]["n_known"]) == want[:2] and got[i]["base_score"] == pytest.approx(want[2])


def test_empty(spark):
    assert lm_scoring.scored(spark.createDataFrame([], "doc_id long, text string"), DEPTH).count() == 0


def test_chances_are_a_distribution(spark):
    """Of one context, the chances of all 256 bytes, seen or not, add up to 1."""
    rng = np.random.default_rng(0)
    grams = [(0x4142 << 8 | b, int(rng.integers(0, 5)), 1) for b in range(256)] + [(0x4342 << 8 | b, 3, 3) for b in range(9)]
    got = lm_scoring.gram_chances(spark.createDataFrame(grams, "gram long, n long, times long"), DEPTH).filter("shiftright(gram, 8) = 16706").collect()
    assert len(got) == 256 and sum(10 ** r["chance"] for r in got) == pytest.approx(1.0)


@pytest.mark.parametrize("depth", [0, 2, 4, 6, 7])
def test_grams_of_each_text(depth):
    texts = [b"", b"abab abab", "ü\U0001f600".encode(), b"", b"a" * 999, b"abab abab"][: lm_scoring.most_texts(depth)]
    want = Counter()
    for i, t in enumerate(texts):
        whole = bytes([lm_scoring.START] * depth) + t + bytes([lm_scoring.END])
        want.update((i, int.from_bytes(whole[k : k + depth + 1], "big")) for k in range(len(t) + 1))
    place, grams, times, distinct = (x.tolist() for x in lm_scoring.text_grams(texts, depth))
    assert dict(zip(zip(place, grams, strict=True), times, strict=True)) == want
    assert distinct == sorted({g for _, g in want})


@pytest.mark.parametrize("huge", [1e200, 1e-200, 1e-310, 1e308])
def test_norms_beyond_a_square(spark, huge):
    """Vectors whose squares vanish or overflow, as queries and as candidates, change nothing for the others."""
    rng = np.random.default_rng(3)
    v = {i: rng.standard_normal(4) for i in range(60)}
    v[7], v[20], v[23] = np.array([huge, 0, huge / 2, 0]), np.array([huge, 0, 2 * huge if huge < 1e300 else huge, 0]), np.array([0, huge, 0, 0])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in v.items()], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann_search.nearest(df, F.col("id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {0, 20, 40}
    with np.errstate(all="ignore"):
        for q, found in got.items():
            score = {i: float((x * v[q]).sum()) for i, x in v.items() if i != q}
            best = sorted(score, key=lambda i: (-score[i] if not math.isnan(score[i]) else math.inf, i))[:20]
            assert len(found) == 20 and all(s == score[i] or math.isnan(s) and math.isnan(score[i]) for _, i, s in found)
            assert len(set(best) & {i for _, i, _ in found}) >= 18


def test_pivots_of_many_vectors(spark, monkeypatch):
    """Pivots from sums that tasks add up: as many as asked for, unit vectors, and near their own vectors."""
    monkeypatch.setattr(ann_search, "SEGMENT", 50)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((8, 6))
    rows = [(i, (centres[i % 8] + 0.05 * rng.standard_normal(6)).tolist()) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, v array<double>").withColumn("dim", F.size("v")).withColumn("norms", F.lit(0))
    ((key, pivots),) = ann_search._pivots(df).items()
    assert key == (6, 0) and pivots.shape == (16, 6) and np.allclose((pivots**2).sum(axis=1), 1)
    unit = centres / np.linalg.norm(centres, axis=1)[:, None]
    assert (unit @ pivots.T).max(axis=1).mean() > 0.9
