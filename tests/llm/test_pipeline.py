"""The pipeline over the smallest tables and odd rows, each stage against brute force over what came before it."""

import re

import pytest
import test_minhash
import test_mixing
import test_quality_rules
import test_tokens

corpus_pipeline = pytest.importorskip("corpus_pipeline")

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def good(t):
    """The verdict of the rules in plain Python."""
    from sparkscreen.llm import quality_rules as q

    t = t or ""
    w = WORD.findall(t)
    grams: dict = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    repeated = len({p for at in grams.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)})
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n, stop = len(w), sum(x in q.STOP_WORDS for x in re.split(r"[\s.,!?;:]+", t.lower()))
    return (
        n >= 50 and 100 * repeated <= 50 * n and 2 * n <= sum(map(len, w)) <= 12 * n and sum(c in q.SYMBOLS for c in t) <= 0.1 * n and t.count("!") <= 0.5 * n and stop >= 0.03 * n
        and len(lines) - len(set(lines)) <= 0.5 * len(lines)
    )


def distinct(rows):
    """One row of each class of near copies, with the smallest id."""
    unique = list({(r["doc_id"], r["text"]): r for r in rows}.values())
    unique.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    top, _ = test_minhash.classes([r["text"] for r in unique])
    return [r for i, r in enumerate(unique) if top[i] == i]


def redacted(t):
    from sparkscreen.llm import secret_scan as s

    spans = sorted((m.start(), m.end()) for r in s.RULES for m in re.finditer(r.pattern, t, re.ASCII) if len(m.group(r.group)) >= r.least)
    out, at = "", 0
    for a, b in spans:
        if a >= at:
            out += t[at:a] + "[secret]"
        at = max(at, b)
    return out + t[at:]


def mixed(rows):
    from sparkscreen.llm import mixing

    domain = lambda s: "web" if re.fullmatch("src[0-9]", s or "") else "curated" if re.fullmatch("src1[0-9]", s or "") else "other"
    taken = {i for i, *_ in test_mixing.plain([(r["doc_id"], domain(r["source"]), r["lang"], r["source"], len(WORD.findall(r["text"]))) for r in rows], mixing.STAGE_MIX)}
    return [r for r in rows if r["doc_id"] in taken]


def odd_rows():
    """Nulls, repeats, copies, secrets, a very long text and ties, beside the given documents."""
    text = "the house of and to be is that it was on with as by this are at from a in " + " ".join(f"word{i}" for i in range(70))
    key = "password=hunter22hunter "
    return [
        (None, text + " of nobody", None, None, None, "c"), (10**6, text + " one", "en", "src1", 1, "c"), (10**6, text + " one", "en", "src1", 1, "c"), (10**6 + 1, text + " two", "en", "src1", 1, "c"), (10**6 + 2, None, "en", "src1", 0, "c"),
        (10**6 + 3, "", "en", None, 0, "c"), (10**6 + 4, key + "the house of and to be is that it was " + " ".join(f"thing{i}" for i in range(70)) + " " + key, "de", "src12", None, None), (10**6 + 5, " ".join(f"the long{i % 977} of{i}" for i in range(60_000)), "en", "src3", None, "c"),
    ]


def test_each_stage_against_brute_force(spark, data):
    from sparkscreen.llm.common import materialize, table, tokenizer_path
    from tokenizers import Tokenizer

    given = table(spark, data, "documents")
    odd = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string, n_chars long, bucket string").drop("bucket")
    docs = given.unionByName(odd.select(*[odd[c].cast(t) for c, t in given.dtypes])).selectExpr("*", "'c' AS node", "'c' AS `a.b`")
    columns = docs.columns
    rows = lambda df: sorted([r.asDict() for r in df.collect()], key=str)
    ids = lambda rs: sorted([r["doc_id"] for r in rs], key=str)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_dedup", "secret_scan", "mixing", "packing"]

    kept = materialize(stages["quality_rules"](spark, docs, data), "t")
    want = [r for r in rows(docs) if good(r["text"])]
    assert kept.columns == columns and rows(kept) == want and 0 < len(want) < docs.count()
    apart = materialize(stages["near_dedup"](spark, kept, data), "t")
    survivors = distinct(want)
    assert apart.columns == columns and ids(rows(apart)) == ids(survivors) and len(survivors) < len(want)
    clean = materialize(stages["secret_scan"](spark, apart, data), "t")
    before = {r["doc_id"]: r for r in rows(apart)}
    assert clean.columns == columns and {r["doc_id"]: r["text"] for r in rows(clean)} == {i: redacted(r["text"]) for i, r in before.items()}
    assert any("[secret]" in r["text"] for r in rows(clean))
    mix = materialize(stages["mixing"](spark, clean, data), "t")
    assert mix.columns == columns and rows(mix) == sorted(mixed(rows(clean)), key=str) and 0 < mix.count() < clean.count()
    packed = stages["packing"](spark, mix, data).collect()
    word = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    pieces = [(-1 if r["doc_id"] is None else r["doc_id"], word.encode(r["text"], add_special_tokens=False).ids + [0]) for r in rows(mix)]
    n = test_tokens.check_packing(packed, pieces, 2048)
    assert n <= 1.05 * -(-sum(len(x) for _, x in pieces) // 2048) + 2


def test_run_gives_the_last_stage(spark, data):
    got = corpus_pipeline.run(spark, data)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns) and 0 < got.select("doc_id").distinct().count() < spark.read.parquet(f"{data}/documents.parquet").count()
    assert test_quality_rules.WORD.pattern == WORD.pattern


def test_empty(spark, data):
    from sparkscreen.llm.common import materialize, table

    docs = table(spark, data, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, data), name)
    assert docs.count() == 0
