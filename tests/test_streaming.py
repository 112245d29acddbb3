"""Streaming forms against the batch."""

import datetime as dt
import glob

from sparkscreen.streaming import events as st


def test_settled_bars(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 10)
    rows = [(i, t + dt.timedelta(hours=6 * i), i % 2, "x", float(i), "") for i in range(20)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = st.run_to_table(st.settled_bars(st.read_events(spark, str(tmp_path / "in"))), str(tmp_path / "out"))
    days = {r["entry_date"] for r in got.collect()}
    last = max(r[1] for r in rows) - dt.timedelta(days=1)
    assert days == {r[1].date() for r in rows if dt.datetime.combine(r[1].date(), dt.time()) + dt.timedelta(days=1) <= last}
    assert got.agg({"volume": "sum"}).first()[0] == sum(r[1].date() in days for r in rows)


def test_distinct_events(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i % 5, t, 1, "x", 1.0, "") for i in range(20)], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    df.write.parquet(str(tmp_path / "in"))
    assert st.run_to_table(st.distinct_events(st.read_events(spark, str(tmp_path / "in"))), str(tmp_path / "out")).count() == 5


def test_merge_batches(spark, tmp_path):
    day = dt.date(2024, 1, 1)
    kind = "code string, entry_date date, price double"
    state = {"now": spark.createDataFrame([("1", day, 1.0)], kind)}

    def save(df, number):
        df.write.mode("overwrite").parquet(str(tmp_path / str(number)))
        state["now"] = spark.read.parquet(str(tmp_path / str(number)))

    merge = st.merge_batches(lambda: state["now"], save)
    merge(spark.createDataFrame([("1", day, 2.0), ("2", day, 3.0)], kind), 0)
    assert sorted((r["code"], r["price"]) for r in state["now"].collect()) == [("1", 2.0), ("2", 3.0)]


def test_distinct_splits_go_on_after_a_restart(spark, tmp_path):
    """Pieces in the order of their dates, each a run of its own: as the batch keeps them; state and timers outlive a run."""
    import random

    from sparkscreen.operators.splits import dedup_events
    from sparkscreen.streaming.splits import distinct_splits

    r, start = random.Random(6), dt.date(2015, 1, 1)
    rows = [(f"c{r.randrange(4)}", start + dt.timedelta(days=r.randrange(700)), r.choice([2.0, 3.0, 1.0, 500.0])) for _ in range(260)]
    kind = "code string, split_date date, ratio double"
    whole = spark.createDataFrame(rows, kind)
    for low, high in ((0, 250), (250, 255), (255, 256), (256, 700)):
        piece = [x for x in rows if low <= (x[1] - start).days < high]
        spark.createDataFrame(piece, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = st.run_to_table(distinct_splits(spark.readStream.schema(whole.schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"))
    want = sorted(tuple(x) for x in dedup_events(whole).collect())
    assert sorted(tuple(x) for x in got.collect()) == want and len(want) > 60


def test_split_pieces_are_written_by_many_tasks(spark, data, monkeypatch):
    """A piece isn't one task's: with coalesce(1) a single task made and wrote all events of a piece."""
    from sparkscreen.plans import registry

    made = []
    monkeypatch.setattr(registry.streams, "run_to_table", lambda stream, path: made.append(len(glob.glob(f"{path.removesuffix('-out').removeprefix('file://')}-in/*.parquet"))) or spark.createDataFrame([(1.0,)], "ratio double"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        registry.QUERIES["stream_distinct_splits"](spark, data)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert made[0] > 1
