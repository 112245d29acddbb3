"""Mixing against a plain recursive budget and prefix."""

import hashlib

import pytest

from sparkscreen.llm import mixing


def share(budget, nodes):
    """nodes: (name, capacity, weight). Whole tokens by weight, at most the capacity, what is left to the others."""
    order = sorted([n for n in nodes if n[2] > 0], key=lambda n: (n[1] / n[2], n[0] is not None, n[0] or ""))
    got = {}
    while order and order[0][1] * sum(n[2] for n in order) <= budget * order[0][2]:
        name, cap, _ = order.pop(0)
        got[name] = cap
        budget -= cap
    total = sum(n[2] for n in order)
    return got | {n[0]: budget * n[2] // total for n in order}


def plain(rows, mix):
    """(id, leaf, epoch, taken) of rows (id, domain, lang, source, tokens)."""
    leaves = {}
    for r in rows:
        leaves.setdefault(r[1:4], []).append(r)
    cap = {k: sum(r[4] for r in v) * mix.epochs for k, v in leaves.items()}
    groups = lambda n, at: {k[n] for k in cap if k[:n] == at}
    size = lambda at: sum(c for k, c in cap.items() if k[: len(at)] == at)
    budget = sum(r[4] for r in rows) * mix.budget_percent // 100
    out = []
    for d, b1 in share(budget, [(d, size((d,)), mix.domains.get(d, 1)) for d in groups(0, ())]).items():
        for lang, b2 in share(b1, [(x, size((d, x)), mix.langs.get(x, 1)) for x in groups(1, (d,))]).items():
            for s, b3 in share(b2, [(x, size((d, lang, x)), mix.sources.get(x, 1)) for x in groups(2, (d, lang))]).items():
                own = leaves[d, lang, s]
                supply = sum(r[4] for r in own)
                whole, rest = (b3 // supply, b3 % supply) if supply else (0, 0)
                key = lambda r: hashlib.md5(f"{mix.seed}:{whole}:{'' if r[0] is None else r[0]}".encode()).hexdigest()  # noqa: E731, B023
                out += [(r[0], (d, lang, s), e, r[4]) for r in own if r[4] for e in range(whole)]
                at = 0
                for k in sorted({key(r) for r in own}):
                    same = [r for r in own if key(r) == k]
                    if at < rest:
                        out += [(r[0], (d, lang, s), whole, min(r[4], rest - at)) for r in same if r[4]]
                    at += sum(r[4] for r in same)
    return sorted(out, key=str)


@pytest.mark.parametrize(
    "mix",
    [mixing.MIX, mixing.STAGE_MIX, mixing.Mix(budget_percent=0), mixing.Mix(domains={"web": 0, "curated": 9}, budget_percent=300, epochs=2), mixing.Mix(sources={"src1": 0, "src2": 50}, budget_percent=55, epochs=1)],
)
def test_against_plain(spark, mix):
    rows = [(i if i % 17 else None, " ".join(["w"] * (i * 7 % 40)) if i % 13 else None, ["en", "de", None][i % 3], ["src0", "src1", "src12", "src2", None, "zzz"][(i * i) % 6], "clash") for i in range(300)]
    rows += [rows[5]] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, domain string")
    got = sorted([(r["id"], (r["domain"], r["lang"], r["source"]), r["epoch"], r["n_taken"]) for r in mixing.chosen(df, mix, "doc_id", "text", "source", "lang").collect()], key=str)
    domain = lambda s: "other" if s is None or not s.startswith("src") else "web" if len(s) == 4 else "curated"
    assert got == plain([(i, domain(s), lang, s, len((t or "").split())) for i, t, lang, s, _ in rows], mix)


def test_budget_is_met(spark, data):
    got = mixing.op1_mixing(spark, data).toPandas()
    docs = spark.read.parquet(f"{data}/documents.parquet").toPandas()
    total = docs["text"].str.split().str.len().sum()
    assert abs(got["n_taken"].sum() - total * mixing.MIX.budget_percent // 100) <= got["source"].nunique() * 4
    assert got["epoch"].max() < mixing.MIX.epochs


def test_empty_and_stage(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert mixing.stage(spark, empty, "").count() == 0
    docs = spark.createDataFrame([(i, "a b c", "en", "src1", 5) for i in range(50)], "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.stage(spark, docs, "")
    assert out.columns == docs.columns and out.count() == 45
