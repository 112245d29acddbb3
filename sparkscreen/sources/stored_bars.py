"""Bars as stored tables: bucketed for reading by code, and as monthly snapshots for keyed writes."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def month_of(date: str | Column) -> Column:
    return F.date_format(date, "yyyy-MM")


#: Rows of a bucket at most, on average: a task sorts a bucket in some hundred MB, however many rows a table has.
BUCKET_ROWS = 1 << 20


def buckets_for(rows: int, least: int = 4) -> int:
    """Buckets for so many rows."""
    return max(least, -(-rows // BUCKET_ROWS))


def store_bucketed(bars: DataFrame, table: str, path: str, buckets: int) -> None:
    """Bars as a table that is bucketed by code, sorted by code and date, and partitioned by month.

    Rows are dealt to the buckets before they are written, so that each bucket has one file a month. buckets: as many as
    tasks are to read the table later; a bucket holds whole codes."""
    dealt = bars.withColumn("month", month_of("entry_date")).repartition(buckets, "code")
    dealt.write.mode("overwrite").option("path", path).partitionBy("month").bucketBy(buckets, "code").sortBy("code", "entry_date").format("parquet").saveAsTable(table)


def read_bucketed(spark: SparkSession, table: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Bars of a bucketed table, both days inclusive. Windows and joins by code need no exchange; days prune months."""
    rows = spark.table(table)
    if since is not None:
        rows = rows.filter((F.col("month") >= since[:7]) & (F.col("entry_date") >= F.lit(since).cast("date")))
    if until is not None:
        rows = rows.filter((F.col("month") <= until[:7]) & (F.col("entry_date") <= F.lit(until).cast("date")))
    return rows.drop("month")


@dataclass(frozen=True)
class Snapshot:
    """months: month -> its folder, under the store's path."""

    version: int = 0
    months: dict[str, str] = field(default_factory=dict)
    schema: str | None = None


class MonthlyBars:
    """Rows of a key that has a date, one folder a month. A write makes new folders for the months that it touches, and is
    published by one small pointer file that must not be there yet: a failed write leaves the last snapshot as it was, and
    of two writers at a time one fails. A month has one folder, so reading needs no merge."""

    def __init__(self, spark: SparkSession, path: str, date: str = "entry_date"):
        self.spark, self.path, self.date = spark, path.rstrip("/"), date
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs, self._at = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def _pointers(self) -> list[str]:
        folder = self._at(f"{self.path}/pointers")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(n for n in names if re.fullmatch(r"\d{12}[.]json", n))

    def snapshot(self) -> Snapshot:
        names = self._pointers()
        if not names:
            return Snapshot()
        told = json.loads("\n".join(r["value"] for r in self.spark.read.option("wholetext", "true").text(f"{self.path}/pointers/{names[-1]}").collect()))
        return Snapshot(int(names[-1][:12]), told["months"], told["schema"])

    def _read(self, snapshot: Snapshot, months: Iterable[str]) -> DataFrame | None:
        if snapshot.schema is None:
            return None
        schema = T.StructType.fromJson(json.loads(snapshot.schema))
        folders = [f"{self.path}/{snapshot.months[m]}" for m in sorted(months)]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, since: str | None = None, until: str | None = None) -> DataFrame:
        """Rows between two days, inclusive, of the last snapshot; only the folders of their months are read. Rows without a
        date are kept in a month of their own and read when no day is given."""
        snapshot = self.snapshot()
        months = [m for m in snapshot.months if (since is None or m >= since[:7] and m != "none") and (until is None or m <= until[:7])]
        rows = self._read(snapshot, months)
        if rows is None:
            raise FileNotFoundError(f"no snapshot in {self.path}")
        if since is not None:
            rows = rows.filter(F.col(self.date) >= F.lit(since).cast("date"))
        return rows if until is None else rows.filter(F.col(self.date) <= F.lit(until).cast("date"))

    def write(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Snapshot:
        """merge(stored, new) replaces the stored rows of the months that new touches. What it returns must lie in those
        months. Columns that it adds are null in other months."""
        last, month = self.snapshot(), F.coalesce(month_of(self.date), F.lit("none"))
        touched = sorted(r[0] for r in new.select(month).distinct().collect())  # one row a month
        if not touched:
            return last
        stored = self._read(last, [m for m in touched if m in last.months])
        rows = merge(new.limit(0) if stored is None else stored, new)
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn("_month", month).repartition("_month", *[c for c in ("code",) if c in rows.columns]).write.partitionBy("_month").parquet(f"{self.path}/{folder}")
        made = {s.getPath().getName().removeprefix("_month=") for s in self._fs.listStatus(self._at(f"{self.path}/{folder}")) if s.isDirectory()}
        if not made <= set(touched):
            raise ValueError(f"rows of months that weren't read: {sorted(made - set(touched))}")
        months = {m: f for m, f in last.months.items() if m not in touched} | {m: f"{folder}/_month={m}" for m in made}
        old = T.StructType.fromJson(json.loads(last.schema)).fields if last.schema else []
        schema = T.StructType([f for f in rows.schema.fields] + [f for f in old if f.name not in rows.columns])
        now = Snapshot(last.version + 1, months, schema.json())
        self._publish(now)
        return now

    def _publish(self, snapshot: Snapshot) -> None:
        out = self._fs.create(self._at(f"{self.path}/pointers/{snapshot.version:012d}.json"), False)  # fails if it is there
        out.write(bytearray(json.dumps({"months": snapshot.months, "schema": snapshot.schema}).encode()))
        out.close()

    def remove_old(self, keep: int = 1) -> None:
        """Delete all but the newest snapshots and the folders that none of those has."""
        names = self._pointers()
        kept = {f for n in names[-keep:] for f in json.loads(self.spark.read.option("wholetext", "true").text(f"{self.path}/pointers/{n}").first()["value"])["months"].values()}
        for n in names[:-keep]:
            self._fs.delete(self._at(f"{self.path}/pointers/{n}"), False)
        data = self._at(f"{self.path}/data")
        for s in self._fs.listStatus(data) if self._fs.exists(data) else []:
            commit = s.getPath()
            for m in self._fs.listStatus(commit):
                if m.isDirectory() and f"data/{commit.getName()}/{m.getPath().getName()}" not in kept:
                    self._fs.delete(m.getPath(), True)
            if not any(f.startswith(f"data/{commit.getName()}/") for f in kept):
                self._fs.delete(commit, True)
