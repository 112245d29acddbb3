"""Line dedup against plain sets, and its SQL."""

import hashlib
import random
from collections import defaultdict

import pytest

from sparkscreen.llm import line_dedup as ld

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def by_hand(docs):
    held = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(-1 if i is None else i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held[key(x)]) >= 3 and max(held[key(x)]) != (-1 if i is None else i))]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def docs():
    r = random.Random(4)
    pool = [f"A shared line of number {i:04d}" for i in range(60)] + ["exactly twenty chars", "nineteen characters", "ÉÉÉÉÉ lower only ascii É", "ééééé lower only ascii é"]
    odd = [lambda x: f" \t{x}\x0c", str.upper, lambda x: x + "\r", lambda x: x + "\xa0"]
    text = lambda: "\n".join(r.choice(odd)(x) if r.random() < 0.2 else x for x in (r.choice(pool) if r.random() < 0.6 else f"own {r.random():.17f}" for _ in range(r.randrange(12))))
    docs = [(i, text()) for i in range(200)] + [(i, "one very common line of all texts\n" + text()) for i in range(200, 400)]
    docs += [(3, text()), (3, docs[3][1]), (3, docs[3][1]), (None, docs[5][1]), (None, docs[5][1]), (None, None), (7, ""), (8, "\n\n"), (500, "\n".join(pool * 300))]
    return docs


@pytest.mark.parametrize(("batches", "fanout"), [(1, 4), (7, 2), (8, 4)])
def test_lines(spark, docs, rows, batches, fanout):
    df = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, line string")
    want = by_hand(docs)
    assert sum(w[3] for w in want) > 500
    assert rows(ld.without_common_lines(df, batches=batches, fanout=fanout)) == want


def test_runs_are_levelled(spark, docs):
    """Full levels are merged, and known lines don't enter again."""
    df = spark.createDataFrame([(i, t, 0) for i, t in docs if i is not None], "id long, text string, row long")
    runs = ld.LineRuns(spark, fanout=2)
    lines = ld.line_rows(df).cache()
    for low in (300, 200, 100, 0):
        runs.add(lines.filter(f"id >= {low} and id < {low + 100}"), 10**9)
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    ((name, _),) = runs.levels[2]
    entries = spark.table(name)
    assert entries.count() == lines.filter("id < 400").select("h1", "h2").distinct().count()
    assert entries.agg({"n": "sum"}).first()[0] < lines.filter("id < 400").select("h1", "h2", "id").distinct().count()
    plan = lines.select("h1", "h2").hint("merge").join(entries, ["h1", "h2"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the batch is dealt, the run isn't
    assert runs.settled().filter("keeper < 300").count() < runs.least_docs * 400 and runs.levels == []
    lines.unpersist()


def test_no_long_line(spark, rows):
    df = spark.createDataFrame([(1, "a\nb"), (2, None)], "doc_id long, text string")
    assert rows(ld.without_common_lines(df)) == [(1, "a\nb", 2, 0), (2, "", 1, 0)]
    assert ld.without_common_lines(df.limit(0)).collect() == []


def test_query_and_sql(spark, data):
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    got = ld.op13_line_dedup(spark, data)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    want = by_hand([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()])
    plain = sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in want)
    assert sorted(tuple(r) for r in got.collect()) == plain == sorted(duckdb.sql(ld.ORACLE_SQL).fetchall())
