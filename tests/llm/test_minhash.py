"""Near-duplicate classes against all pairs."""

import random

import numpy as np
import pytest

from sparkscreen.llm import minhash_dedup as m

R = random.Random(3)


def edited(base, k):
    w = list(base)
    for _ in range(k):
        w[R.randrange(len(w))] = f"x{R.randrange(10**6)}"
    return " ".join(w)


def classes(texts):
    sets = {i: m.shingles(m.words(t)) for i, t in enumerate(texts) if t and m.words(t)}
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = 0
    for i in sets:
        for j in sets:
            if j < i and m.probability_jaccard(sets[i], sets[j]) >= m.THRESHOLD:
                links += 1
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(texts))], links


def test_probability_jaccard():
    s = lambda d: (np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)]))
    assert m.probability_jaccard(s({1: 1, 2: 1, 3: 1}), s({2: 1, 3: 1, 4: 1})) == pytest.approx(0.5)
    assert m.probability_jaccard(s({1: 2, 2: 4}), s({1: 1, 2: 2})) == pytest.approx(1.0)
    assert m.probability_jaccard(s({1: 1}), s({2: 1})) == 0.0
    for _ in range(50):
        a, b = ({k: R.randrange(1, 6) for k in R.sample(range(30), 12)} for _ in range(2))
        want = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())
        assert m.probability_jaccard(s(a), s(b)) == pytest.approx(want)


def test_signatures_estimate():
    base = [f"w{i}" for i in range(300)]
    got, want = [], []
    for k in (2, 5, 10, 20):
        for _ in range(20):
            x, y = m.shingles(m.words(" ".join(base))), m.shingles(m.words(edited(base, k)))
            a, b = m.signatures([x, y])
            got.append((a == b).mean())
            want.append(m.probability_jaccard(x, y))
    assert abs(np.mean(got) - np.mean(want)) < 0.03
    assert (m.signatures([x])[0] == m.signatures([y, x])[1]).all()
    assert len(set(m.signatures([m.shingles([b"one"])])[0])) == 1


@pytest.mark.parametrize("block", [128, 8])
def test_hot_group_keeps_all_links(spark, monkeypatch, block):
    monkeypatch.setattr(m, "BLOCK", block)
    base = [f"w{i}" for i in range(150)]
    texts = [edited(base, R.randrange(9)) for _ in range(120)] + ["a b c", "A B  C", "d", None, "", " ", "d", "long " * 30_000] + [f"own {i} text number {i} of many here" for i in range(20)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r["id"]: r for r in m.near_duplicates(df).collect()}
    want, _ = classes(texts)
    assert [got[i]["class_id"] for i in range(len(texts))] == want


def test_repeats_nulls_and_empty(spark):
    t = "one two three four five six"
    df = spark.createDataFrame([(5, t), (5, t), (9, t), (None, "other words that are here now"), (7, None)], "doc_id long, text string")
    got = sorted([(r["id"], r["class_id"]) for r in m.near_duplicates(df).collect()], key=str)
    assert got == sorted([(5, 5), (5, 5), (9, 5), (None, None), (7, 7)], key=str)
    assert m.near_duplicates(df.limit(0)).count() == 0
    kept = m.stage(spark, df, "")
    assert sorted([r["doc_id"] for r in kept.collect()], key=str) == [5, 7, None] and kept.columns == df.columns


def test_an_id_with_two_texts(spark):
    t = " ".join(f"w{i}" for i in range(60))
    rows = [(5, t + " end"), (5, "quite another text than that one"), (3, "quite another text than that one"), (5, t), (8, t)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r["doc_id"], r["text"]) for r in m.stage(spark, df, "").collect())
    assert len(kept) == 2 and kept[0] == (3, rows[1][1]) and kept[1] in ((5, t), (5, t + " end"))


def test_repeated_rows_make_one_feature_and_one_pair(spark, monkeypatch):
    """Forty equal rows of each of two near texts, with an id and without: one feature row a node, one verified pair."""
    base = [f"w{i}" for i in range(80)]
    a, b = " ".join(base), " ".join(base + ["end"])
    rows = [(1, a)] * 40 + [(2, b)] * 40 + [(None, a + " of nobody")] * 40
    asked, pairs = [], []
    features, verified = m._features, m._verified
    monkeypatch.setattr(m, "_features", lambda *x: asked.append(features(*x)) or asked[-1])
    monkeypatch.setattr(m, "_verified", lambda p, *x: pairs.append(p.count()) or verified(p, *x))
    got = {(r["id"], r["class_id"]) for r in m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (None, 1)}
    assert asked[0].count() == 3 and asked[0].select("node").distinct().count() == 3 and sum(pairs) <= 3


def test_a_repeated_passage_parts_no_copies_and_joins_no_strangers(spark):
    base = [f"w{i}" for i in range(200)]
    once, often = " ".join(base), " ".join(base[:24] * 5 + base[24:])
    line = "all rights reserved by nobody at all here "
    rows = [(1, once), (2, often), (3, line * 40 + " ".join(f"a{i}" for i in range(60))), (4, line * 40 + " ".join(f"b{i}" for i in range(60)))]
    got = {r["id"]: r["class_id"] for r in m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_given_texts(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()
    got = {r["doc_id"]: r["class_id"] for r in m.op3_minhash_dedup(spark, data).collect()}
    want, _ = classes([d["text"] for d in docs])
    assert [got[d["doc_id"]] for d in docs] == [docs[w]["doc_id"] for w in want]
