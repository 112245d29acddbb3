"""Indicators that go on from a state, against the whole run."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from sparkscreen.operators import indicator_state as ist
from sparkscreen.operators import technicals as tech

START = datetime.date(2020, 1, 1)
COLUMNS = ["ma25", "ma75", "bb_sigma", "bb_p2sig", "macd", "macd_signal", "macd_hist", "rsi_14", "ma_divergence", "trend_score", "trading_value", "macd_status"]


def series(seed, n, first=0):
    r, p, out = random.Random(seed), 100.0, []
    for i in range(n):
        p = max(1.0, p * (1 + r.uniform(-0.04, 0.04))) if seed != "flat" else 100.0
        out.append((START + datetime.timedelta(days=first + i), p, r.randrange(1000)))
    return out


def frame(spark, bars):
    return spark.createDataFrame([(c, *b) for c, rows in bars.items() for b in rows], "code string, entry_date date, price double, volume long")


def close(a, b):
    return a == b or a is None and b is None or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def compare(got, want):
    got = {(r["code"], r["entry_date"]): r for r in got.collect()}
    want = {(r["code"], r["entry_date"]): r for r in want.collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        for c in COLUMNS:
            assert close(got[k][c], w[c]), (k, c, got[k][c], w[c])


@pytest.fixture(scope="module")
def bars():
    return {"long": series(1, 1500), "short": series(2, 20), "mid": series(3, 74), "flat": series("flat", 90), "gone": series(4, 40), "new": series(5, 35, 1400)}


def keep(df, tmp_path, name):
    df.write.parquet(f"{tmp_path}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{tmp_path}/{name}")


def test_steps_equal_a_whole_run(spark, bars, tmp_path):
    """Bars in pieces of 1, 7, 60 and all others, some sent twice; a code that starts late, one that ends early."""
    cut = {c: 10 if c == "short" else 1380 if c == "long" else len(b) // 2 for c, b in bars.items() if c != "new"}
    state = keep(ist.whole_run(frame(spark, {c: bars[c][:n] for c, n in cut.items()})).state, tmp_path, "s0")
    done, rows = dict(cut), None
    for i, step in enumerate((1, 7, 60, 2000)):
        piece = {c: b[max(0, done.get(c, 0) - 5) : done.get(c, 0) + step] for c, b in bars.items() if c != "gone" and (c != "new" or i >= 2)}
        new = frame(spark, piece)
        found = ist.advance(state, new, new.limit(0))  # no code is computed anew, so no history is read
        rows = keep(found.rows, tmp_path, f"r{i}") if rows is None else rows.unionByName(keep(found.rows, tmp_path, f"r{i}"))
        state = keep(found.state, tmp_path, f"s{i + 1}")
        done |= {c: min(len(bars[c]), done.get(c, 0) + step) for c in piece}
    assert done["long"] == 1500 and done["new"] == 35
    whole = tech.indicators(frame(spark, bars))
    later = F.col("code").isin("new")
    for c, n in cut.items():
        if c != "gone":
            later = later | (F.col("code") == c) & (F.col("entry_date") >= F.lit(bars[c][n][0]))
    compare(rows, whole.filter(later))
    want = {r["code"]: r for r in ist.whole_run(frame(spark, bars | {"gone": bars["gone"][:20]})).state.collect()}
    got = {r["code"]: r for r in state.collect()}
    assert set(got) == set(want)
    for c, w in want.items():
        assert (got[c]["n"], got[c]["last_date"], got[c]["tail"]) == (w["n"], w["last_date"], w["tail"])
        assert all(close(got[c][k], w[k]) for k in (*ist.AVERAGES, "signal"))


def test_a_changed_price_renews_its_code_alone(spark, bars, tmp_path):
    old = {c: bars[c][:-3] for c in ("long", "mid", "flat", "short")}
    state = keep(ist.whole_run(frame(spark, old)).state, tmp_path, "state")
    changed = {"mid": [(d, p * 0.5 if i == 40 else p, v) for i, (d, p, v) in enumerate(bars["mid"])], "short": [(d, None if i == 3 else p, v) for i, (d, p, v) in enumerate(bars["short"])]}
    new = frame(spark, {"long": bars["long"][-5:], "mid": changed["mid"][38:], "short": changed["short"], "flat": bars["flat"][:1] + bars["flat"][-3:]})
    history = frame(spark, bars | changed | {"long": [(START, 1.0, 1)]})  # a wrong history of a code that isn't renewed changes nothing
    rows = ist.advance(state, new, history).rows
    renewed = tech.indicators(frame(spark, bars | changed)).filter("code in ('mid', 'short', 'flat')")  # flat: a bar before its tail
    late = tech.indicators(frame(spark, {"long": bars["long"]})).filter(F.col("entry_date") >= F.lit(bars["long"][-3][0]))
    compare(rows, renewed.unionByName(late))


def test_nothing_new(spark, bars, tmp_path):
    state = keep(ist.whole_run(frame(spark, {"mid": bars["mid"]})).state, tmp_path, "state")
    none = frame(spark, {"mid": bars["mid"][-2:]})
    for new in (none, none.limit(0), none.withColumn("price", F.lit(None).cast("double")).withColumn("entry_date", F.date_add("entry_date", 400))):
        found = ist.advance(state, new, none)
        assert found.rows.count() == 0 and found.state.collect() == state.collect()
    empty = ist.whole_run(none.limit(0))
    assert empty.rows.count() == 0 and empty.state.count() == 0


def test_history_is_not_read_for_codes_that_go_on(spark, bars, tmp_path):
    """The plan reads the history once, behind a semi-join with the codes that are stale."""
    state = keep(ist.whole_run(frame(spark, {"mid": bars["mid"]})).state, tmp_path, "state")
    history = keep(frame(spark, {"mid": bars["mid"]}), tmp_path, "history")
    rows = ist.advance(state, frame(spark, {"mid": bars["mid"][-3:]}), history).rows
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") >= 2 and rows.count() == 0


def test_what_both_results_read_is_kept_once(spark, bars, tmp_path):
    """Rows and state come from stored frames, without a window of their own; a whole run's state takes three windows."""
    run = ist.whole_run(frame(spark, {"mid": bars["mid"][:-9]}))
    assert run.state._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 3
    names, state = [], keep(run.state, tmp_path, "state")

    def put(df, what):
        names.append(what)
        return keep(df, tmp_path, what)

    new = frame(spark, {"mid": bars["mid"][-12:], "new": bars["new"]})
    found, lazy = ist.advance(state, new, lambda codes: new.join(codes, "code", "left_semi"), keep=put), ist.advance(state, new, new)
    assert sorted(names) == ["ahead", "going-on", "renewed", "stale"] and found.renewed.count() == 0
    for df in (found.rows, found.state):
        assert "Window [" not in df._jdf.queryExecution().optimizedPlan().toString()
    compare(found.rows, lazy.rows)
    assert sorted(found.state.collect()) == sorted(lazy.state.collect())
