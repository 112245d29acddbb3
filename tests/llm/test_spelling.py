"""Spelling variants against all edits of every word."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkscreen.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows):
    n = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    words = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    letters, near = sorted({c for w in words for c in w}), defaultdict(set)
    for w in words:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near[w] = (edits & words.keys()) - {w}
    form = {w: b for w in words if near[w] and words[b := min(near[w], key=lambda x: (-words[x], x))] >= 10 * words[w]}
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def docs():
    """Chains of forms, ties, doubled letters, words at both bounds, a very long word and its variants, odd rows."""
    r = random.Random(3)
    chain = [("establish", 2000), ("establjsh", 150), ("establjshh", 12), ("estabjshh", 2), ("Àéîõüÿßx", 40), ("àéîõüÿßx", 3), ("Éîõüÿßxx", 2), ("aaaaaaaa", 30), ("aaaaaaa", 2), ("aaaaaaaaa", 2)]
    tied = [("lantern", 2), ("lanterns", 40), ("lanternx", 40), ("xlantern", 39), ("shorts", 90), ("seven77", 9)]
    words = [w for w, n in chain + tied for _ in range(n)] + ["".join(r.choice("abc") for _ in range(r.randrange(6, 9))) for _ in range(4000)]
    r.shuffle(words)
    long = "".join(r.choice("abcdefgh") for _ in range(1200))
    rows = [(i // 2, " ".join(words[i * 20 : i * 20 + 20]) + "-÷×.\n") for i in range(-(-len(words) // 20))]
    rows += [(7, f"{long} {long}"), (8, f"{long[:-1]} {long[:-1]}x {long}"), (9, f"{long} {long[:500]}z{long[501:]} " * 2), (None, None), (None, "lantern Lantern"), (5, ""), (5, ""), (6, "x" * 45 + " " + "x" * 46), (6, "x" * 45 + " " + "x" * 46)]
    return rows


@pytest.mark.parametrize("filter_bytes", [spelling.FILTER_BYTES, 2048])
def test_words_and_forms(spark, docs, rows, monkeypatch, filter_bytes):
    """Also with filters of a few words a round, so that lengths are cut into ranges of blocks."""
    if filter_bytes == 2048:
        monkeypatch.setattr(spelling, "CHUNK", 32)
    df = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, word string")
    got = spelling.grouped(df, filter_bytes=filter_bytes)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = by_hand(docs)
    assert any(w[2] != w[1] for w in want if w[1]) and any(len(w[0]) > 1000 and w[4] for w in want)
    assert rows(got) == want


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.grouped(df).collect() == []
    assert spelling.grouped(spark.createDataFrame([(1, None), (2, ""), (3, "short")], "doc_id long, text string")).collect() == []


def test_query(spark, data, rows):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert rows(spelling.op11_spelling_variants(spark, data)) == by_hand(docs)


def test_edits_are_all_of_one_side():
    """Hashes of deletions and replacements by later letters are those of the words themselves."""
    alphabet = b"abcz\xe9"
    for w in (b"aabbcc", b"zzz\xe9", b"a"):
        letters = np.frombuffer(w, np.uint8)[None, :]
        want = {w[:i] + w[i + 1 :] for i in range(len(w)) if len(w) > 1} | {w[:i] + bytes([c]) + w[i + 1 :] for i in range(len(w)) for c in alphabet if c > w[i]}
        made = [h for _, hs, _ in spelling.edit_hashes(letters, alphabet) for h in hs.tolist()]
        assert sorted(made) == sorted(int(spelling.word_hashes(np.frombuffer(x, np.uint8)[None, :])[0]) for x in want)


def test_filters_hold_all_and_little_else():
    rng = np.random.default_rng(2)
    h, masks = rng.integers(0, 2**63, 40_000).astype(np.uint64) * np.uint64(2), spelling._masks()
    blocks = -(-len(h) * spelling.BITS_A_WORD // 64)
    filled = np.zeros(blocks, np.uint64)
    np.bitwise_or.at(filled, (((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(int), masks[(h & np.uint64(4095)).astype(int)])
    assert spelling.held(h, blocks, 0, filled, masks).all()
    assert (spelling.held(h, blocks, 0, filled[:1000], masks) | spelling.held(h, blocks, 1000, filled[1000:], masks)).all()
    assert spelling.held(rng.integers(0, 2**63, 100_000).astype(np.uint64) * np.uint64(2) + np.uint64(1), blocks, 0, filled, masks).mean() < 0.01


def test_rounds_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(spelling, "CHUNK", 16)
    sizes = {7: 100, 8: 1000, 9: 3, 41: 500}
    rounds = spelling.filter_rounds(sizes, 64 * 8)
    assert all(sum(end - first for *_, first, end in r) <= 64 for r in rounds)
    for shard, n in sizes.items():
        parts = [(first, end) for r in rounds for s, _, first, end in r if s == shard]
        assert parts[0][0] == 0 and parts[-1][1] == -(-n * spelling.BITS_A_WORD // 64) and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
