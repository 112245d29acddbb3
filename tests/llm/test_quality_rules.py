"""Quality rules against plain Python, on odd texts and on the given ones."""

import re

import pytest

from sparkscreen.llm import quality_rules as q
from sparkscreen.llm.common import GAP_CHARS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n", "a", "a b c", "a b c a b c", "x " * 200, "é ü\n\né ü\nz", "# * % a", "one\ttwo\x0bthree\x0cfour\r\nfive", "a\n" * 60, "the of " * 40 + "end", "\x85a\xa0b", "word " + "y" * 100_000, "\n a \n a \na", "a" + " " * 300_000 + "b", " ".join(str(i * i % 37) for i in range(300))]


def plain(t):
    t = t or ""
    w = WORD.findall(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)} if len(grams) < 500 else None
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in q.SYMBOLS for c in t), len(lines) - len(set(lines)), None if hit is None else len(hit)


def test_odd_texts(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(ODD)], "doc_id long, text string, n_words string")
    got = {r["doc_id"]: r for r in q.quality(df).select(*q.RESULT).collect()}
    assert len(got) == len(ODD)
    for i, t in enumerate(ODD):
        r = got[i]
        want = plain(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, t
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_given_texts(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r["doc_id"]: r for r in q.quality(docs).collect()}
    for d in docs.limit(60).collect():
        want = plain(d["text"])
        r = got[d["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == want[:4]


def test_verdicts_follow_labels(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    judged = q.quality(docs).join(labels, "doc_id").filter("not base_failed").collect()
    assert sum(r["kept"] == bool(r["quality"]) for r in judged) >= 0.97 * len(judged)


@pytest.mark.parametrize("rule", (*q.RULES, q.NOT_ENDLESS))
def test_each_rule_is_a_bound(spark, rule):
    """A value at a bound passes, one beyond it fails."""
    bounds = [(x, sign) for x, sign in ((rule.low, -1), (rule.high, 1)) if x is not None]
    cases = [(float(x), True) for x, _ in bounds] + [(x + sign * 1e-6, False) for x, sign in bounds]
    df = spark.createDataFrame(cases, f"{rule.measure} double, want boolean")
    assert cases and all(r["got"] == r["want"] for r in df.select("want", *[c.alias("got") for c in q.compile_rules((rule,))]).collect())


def test_a_very_long_text_is_judged_by_the_same_rules(spark):
    text = " ".join(f"the a{i} of b{i}" for i in range(300_000))
    got = q.quality(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got["n_words"] == 1_200_000 and got["kept"] and "not_endless" not in got["failed_rules"]
    assert q.quality(spark.createDataFrame([(1, text)], "doc_id long, text string"), (*q.RULES, q.NOT_ENDLESS)).first()["failed_rules"] == ["not_endless"]


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert q.quality(empty).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    assert q.quality(twice).count() == 3


def test_stage_keeps_columns(spark):
    good = "the house of and to be is that it for was on with as by this are at from a in " * 1 + " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, good, "x", "s", 3), (2, "bad", None, None, None)], "doc_id long, text string, kept string, source string, n_chars long")
    out = q.stage(spark, docs, "")
    assert out.columns == docs.columns and [r["doc_id"] for r in out.collect()] == [1]
    assert GAP_CHARS[0] == " "
