"""Alignment of two tokenizers' ends, whole texts by the libraries themselves."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkscreen.llm import token_alignment as ta
from sparkscreen.llm.common import materialize, tokenizer_path

tokenizers, sentencepiece = pytest.importorskip("tokenizers"), pytest.importorskip("sentencepiece")
R = random.Random(9)
ODD = [None, "", " ", "a", "  a  b \n c", "x\ny\n\nz ", "▁ a", "a▁b c", "<|endoftext|> <s> </s> <unk> <0x0A>", "tab\tx \t y\r\n z", "\x00 a b", "é ﬁ ́x İstanbul", "日本語 テキスト。", "a\xa0 b \x85c", "  a　b c", "don't I'LL 's", "x" * 9000 + " y", "1234 5.6e7", "same words same words same"]
ODD += ["".join(R.choice("abé Z’'.!19\n\t<|>日 \xa0") for _ in range(R.randrange(80))) for _ in range(300)]


def by_hand(texts):
    a_tok = tokenizers.Tokenizer.from_file(tokenizer_path(ta.A_VOCABULARY))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(ta.B_VOCABULARY))
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
    docs = []
    for t in texts:
        if not t:
            docs.append(None)
            continue
        a, b = a_tok.encode(" " + t, add_special_tokens=False).ids, b_tok.encode(t)
        xs = [bytes(letters[c] for c in a_tok.id_to_token(i)) for i in a]
        ys = [bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_tok.id_to_piece(i)]]
        if not b"".join(xs) == b"".join(ys) == (" " + t).encode():
            docs.append(None)
            continue
        ends = [np.cumsum([len(x) for x in z]).tolist() for z in (xs, ys)]
        common, groups, before = sorted(set(ends[0]) & set(ends[1])), [], [0, 0]
        for e in common:
            now = [ends[0].index(e) + 1, ends[1].index(e) + 1]
            groups.append(",".join(map(str, a[before[0] : now[0]])) + "|" + ",".join(map(str, b[before[1] : now[1]])))
            before = now
        links, first = [], 0
        for i, e in enumerate(ends[0]):
            while ends[1][first] <= (ends[0][i - 1] if i else 0):
                first += 1
            j = first
            while j < len(b) and (ends[1][j - 1] if j else 0) < e:
                links.append((a[i], b[j]))
                j += 1
        docs.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    n = Counter(x for d in docs if d for x in set(d[3]))
    most = defaultdict(int)
    for (a, _), k in n.items():
        most[a] = max(most[a], k)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else (d[0], d[1], d[2], len(d[3]), sum(n[x] == most[x[0]] for x in d[3]), sum(n[x] for x in d[3]), d[4]) for d in docs]


def test_gallop_places():
    for _ in range(300):
        long = np.array(sorted(R.sample(range(1, 400), R.randrange(1, 120))))
        short = np.array(sorted(R.sample(range(1, 420), R.randrange(1, 40))))
        for start in (np.zeros(len(short), int), np.array([R.randrange(bisect_left(long, x) + 1) for x in short])):
            below, equal = ta.gallop(short, long, start)
            assert below.tolist() == [bisect_left(long, x) for x in short.tolist()]
            assert equal.tolist() == [x in set(long.tolist()) for x in short.tolist()]


def test_links_are_the_overlaps():
    for _ in range(300):
        total = R.randrange(1, 40)
        ends = [np.array(sorted({*(R.randrange(1, total + 1) for _ in range(R.randrange(20))), total})) for _ in "ab"]
        (x, y), (last_a, last_b) = ta.align(*ends)
        spans = [list(zip([0, *e.tolist()], e.tolist(), strict=False)) for e in ends]
        assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == [(i, j) for i, p in enumerate(spans[0]) for j, q in enumerate(spans[1]) if p[0] < q[1] and q[0] < p[1]]
        common = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
        assert ends[0][last_a].tolist() == common == ends[1][last_b].tolist()


@pytest.mark.parametrize("most", [ta.MOST_BROADCAST, 40, 0])
def test_texts(spark, data, most):
    """All, few and no pairs broadcast."""
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()][:120]
    ids = [None if i == 3 else i // 2 if i < 8 else i for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, "c") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, pairs string")
    rows = materialize(ta.aligned(df, tokenizer_path(ta.A_VOCABULARY), tokenizer_path(ta.B_VOCABULARY)), "aligned-test")
    got = ta.link_sums(rows, ta.pair_counts(rows), most).collect()
    made = [(r["id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], hashlib.sha256(r["groups"].encode()).hexdigest() if r["n_a"] else "") for r in got]
    assert sorted(made, key=str) == sorted([(i, *w) for i, w in zip(ids, by_hand(texts), strict=True)], key=str)


def test_forgetting_and_the_library_change_nothing(monkeypatch):
    texts = [t or "" for t in ODD] * 2
    usual = list(ta.Aligner(tokenizer_path(ta.A_VOCABULARY), tokenizer_path(ta.B_VOCABULARY)).texts(texts))
    monkeypatch.setattr(ta, "MOST_KEPT", 50)
    monkeypatch.setattr(ta, "BATCH_CHARS", 500)
    monkeypatch.setattr(ta, "LONGEST_KEPT", 4)
    assert list(ta.Aligner(tokenizer_path(ta.A_VOCABULARY), tokenizer_path(ta.B_VOCABULARY)).texts(texts)) == usual
    plain = ta.Aligner(tokenizer_path(ta.A_VOCABULARY), tokenizer_path(ta.B_VOCABULARY))
    plain.ranked, plain.cuts = None, False
    assert list(plain.texts(texts)) == usual


def test_query(spark, data):
    want = dict(zip(*zip(*[(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()], strict=True), strict=True))
    want = dict(zip(want, by_hand(list(want.values())), strict=True))
    got = ta.op12_token_alignment(spark, data)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    rows = materialize(ta.aligned(df, tokenizer_path(ta.A_VOCABULARY), tokenizer_path(ta.B_VOCABULARY)), "aligned-test")
    assert ta.link_sums(rows, ta.pair_counts(rows)).collect() == []
