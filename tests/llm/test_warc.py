"""The archive's round trip."""

import hashlib

import pytest

from sparkscreen.llm import warc_archive as w
from sparkscreen.llm.common import new_path

BIG = "é" * 600


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, None, BIG), (4, "http://a\r\nWARC-Type: x", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (None, "n", BIG), (8, "line WARC-Type: odd", "z" * 999), (9, "u", "z" * 999), (10, "u", "y" * 1000), (10, "u", "y" * 1000), (-3, "u", "y" * 1000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' AS digest", "'c' AS payload")


def test_round_trip(spark, pages):
    path = w.write_archive(pages, new_path(spark, "w"))
    got = sorted([(r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in w.read_records(spark, path).collect()], key=str)
    want = []
    rows = pages.collect()
    for r in rows:
        b = (r["html"] or "").encode()
        same = [x["page_id"] for x in rows if (x["html"] or "") == (r["html"] or "") and x["page_id"] is not None]
        revisit = len(b) >= 1000 and r["page_id"] != max(same)
        want.append((r["page_id"], len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    assert got == sorted(want, key=str)
    assert spark.read.parquet(f"{path}/payloads").count() == len({(r["html"] or "") for r in rows})


def test_records_are_exact(spark, pages):
    path = w.write_archive(pages, new_path(spark, "w"))
    for r in w.reconstruct(spark, path).filter("id = 3 or id = 2 or id = 4").collect():
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and rest.endswith(b"\r\n\r\n")
        length = int(head.split(b"Content-Length: ")[1])
        assert len(rest) == length + 4
        if r["id"] == 2:
            assert b"WARC-Refers-To: <urn:page:3:" in head and length == 0 and bytes(r["payload"]) == BIG.encode()
        if r["id"] == 4:
            assert b"http://a%0D%0AWARC-Type: x" in head


@pytest.mark.parametrize("spread", [1, 3, 1000])
def test_a_payload_of_a_third_of_all_is_dealt_to_tasks(spark, monkeypatch, spread):
    monkeypatch.setattr(w, "SPREAD", spread)
    rows = [(i, f"u{i}", BIG if i % 3 == 0 else f"{i} " * 600) for i in range(90)] + [(90, "u", "long " * 500_000)]
    path = w.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), new_path(spark, "w"))
    got = {r["id"]: r for r in w.reconstruct(spark, path).collect()}
    assert len(got) == 91 and all(bytes(got[i]["payload"]).decode() == t and got[i]["target"] == u for i, u, t in rows)
    assert {i for i, r in got.items() if r["record_type"] == "revisit"} == {i for i in range(0, 90, 3) if i != 87}
    assert w.read_records(spark, path).count() == 91


def test_targets_and_ids_that_are_null_or_empty(spark):
    rows = [(None, None, BIG), (None, "", BIG), (3, "", "x" * 1500), (None, "n", "x" * 1500)]
    path = w.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), new_path(spark, "w"))
    got = sorted([(r["id"], r["target"], r["record_type"], r["refers_to"]) for r in w.read_records(spark, path).collect()], key=str)
    assert got == sorted([(None, None, "response", None), (None, "", "response", None), (3, "", "response", None), (None, "n", "revisit", 3)], key=str)


def test_damage_is_noticed(spark, pages):
    from pyspark.sql import functions as F

    def damaged(table, column, new):
        path = w.write_archive(pages, new_path(spark, "w"))
        df = spark.read.parquet(f"{path}/{table}")
        rows = df.withColumn(column, new).collect() if new is not None else df.collect()[1:]
        spark.createDataFrame(rows, df.schema).write.mode("overwrite").parquet(f"{path}/{table}")
        return w.read_records(spark, path).collect()

    with pytest.raises(Exception, match="digest"):
        damaged("payloads", "payload", F.encode(F.lit("other"), "UTF-8"))
    with pytest.raises(Exception, match="missing"):
        damaged("payloads", "payload", None)
    with pytest.raises(Exception, match="header says"):
        damaged("headers", "header", F.encode(F.regexp_replace(F.decode("header", "UTF-8"), "Length: [1-9]", "Length: 77"), "UTF-8"))


def test_empty(spark, pages):
    path = w.write_archive(pages.limit(0), new_path(spark, "w"))
    assert w.read_records(spark, path).count() == 0


def test_record_ids_are_unique_and_can_be_looked_up(spark, pages):
    """Every record has the lines that the format demands; a revisit names the one response it refers to."""
    from pyspark.sql import functions as F

    dated = pages.withColumn("at", F.when(F.col("page_id") == 2, F.lit("2024-02-03 04:05:06").cast("timestamp")))
    path = w.write_archive(dated, new_path(spark, "w"), date_col="at")
    heads = [dict(x.split(": ", 1) for x in bytes(r["record"]).split(b"\r\n\r\n")[0].decode().split("\r\n")[1:]) for r in w.reconstruct(spark, path).collect()]
    by_id = {h["WARC-Record-ID"]: h for h in heads}
    assert len(by_id) == len(heads) == pages.count()
    for h in heads:
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(h)
        assert h["WARC-Date"] == ("2024-02-03T04:05:06Z" if h["WARC-Record-ID"].startswith("<urn:page:2:") else w.NO_DATE)
        if h["WARC-Type"] == "revisit":
            kept = by_id[h["WARC-Refers-To"]]
            assert kept["WARC-Type"] == "response" and kept["WARC-Payload-Digest"] == h["WARC-Payload-Digest"]
    assert sum(h["WARC-Type"] == "revisit" for h in heads) == 4
