"""Line dedup over levelled sorted runs of line hashes.

A run is a table of line hashes, each once, with how many documents hold the line and the largest document id that does;
it is bucketed by the hash and sorted within its buckets, so that a join with a batch's entries moves none of its rows.
Each new batch of documents is reduced to its distinct (line, document) pairs and to one entry a line. Entries about which
a run already says all that matters (enough documents, a larger id) are anti-joined away; what is left becomes a run of
level 0. When a level has FANOUT runs they are merged into one of the next level, so an entry is moved once a level. After
the last batch all runs are merged, and lines of enough documents are settled: they go everywhere but in the document of
the largest id.

Batches go from large ids to small ones, so a line's keeper is in the first batch that holds the line, and a common line
enters the runs once or twice, not once a batch. The order only saves work: merging takes sums and maxima.

Hot lines: entries are pre-aggregated before any shuffle by line. A line with over a thousandth of a batch's entries is
marked hot, at most a thousand a batch whatever the data; hot lines are broadcast when documents learn what they lose, and
all others are joined by a shuffle.

Defined cases: a line's key is the line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased, under two 64-bit hashes.
A null or empty text is one empty line; null ids count as one document, smaller than any other; rows that repeat an id are
one document when documents are counted, and each gives a row; lines repeated within the keeper all stay; texts of any
length are cut into lines; an empty table gives an empty result; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import functools
import string
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import GAP_CHARS, materialize, new_path, remove, table, text_or_empty

LEAST_LENGTH, LEAST_DOCS, BATCHES, FANOUT, HOT_SHARE = 20, 3, 8, 4, 1000
KEY = ["h1", "h2"]


class LineRuns:
    """Levels of runs. A run has as many buckets as the session has shuffle partitions."""

    def __init__(self, spark: SparkSession, least_docs: int = LEAST_DOCS, fanout: int = FANOUT):
        self.spark, self.least_docs, self.fanout = spark, least_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = []

    def _write(self, entries: DataFrame) -> tuple[str, str]:
        name, path = f"line_run_{uuid.uuid4().hex}", new_path(self.spark, "line-run")
        entries.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
        return name, path

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE {name}")
            remove(self.spark, path)

    def merged(self, runs: list[tuple[str, str]]) -> DataFrame:
        """One entry a line of several runs, read as plain files: a union of bucketed tables counts as bucketed in Spark 4.1
        even where its scans aren't, and then loses matches."""
        rows = self.spark.read.schema("h1 long, h2 long, n long, keeper long, hot boolean").parquet(*[path for _, path in runs])
        return rows.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"), F.max("hot").alias("hot"))

    def add(self, lines: DataFrame, n_lines: int) -> None:
        """lines: KEY and id, of documents that no earlier batch held; n_lines: how many rows there are."""
        entries = lines.select(*KEY, "id").distinct().groupBy(*KEY).agg(F.count("*").alias("n"), F.max("id").alias("keeper"))
        entries = entries.withColumn("hot", F.col("n") * HOT_SHARE > F.lit(n_lines))
        for name, _ in (run for level in self.levels for run in level):
            known = self.spark.table(name).filter(F.col("n") >= self.least_docs).select(*KEY, F.col("keeper").alias("known"))
            entries = entries.join(known, (entries["h1"] == known["h1"]) & (entries["h2"] == known["h2"]) & (entries["keeper"] <= known["known"]) & ~entries["hot"], "left_anti")
        self._put(0, self._write(entries))

    def _put(self, level: int, run: tuple[str, str]) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._write(self.merged(full)))
            self._drop(full)

    def settled(self) -> DataFrame:
        """KEY, keeper, hot of the lines that enough documents hold. Ends these runs."""
        runs = [run for level in self.levels for run in level]
        out = materialize(self.merged(runs).filter(F.col("n") >= self.least_docs).select(*KEY, "keeper", "hot"), "settled-lines")
        self._drop(runs)
        self.levels = []
        return out


def _key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(GAP_CHARS)), string.ascii_uppercase, string.ascii_lowercase)


def line_rows(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """docs: id, row, text. id, row, pos, h1, h2 of each line whose key is long enough."""
    lines = docs.select("id", "row", F.posexplode(F.transform(F.split("text", "\n", -1), _key)).alias("pos", "line")).filter(F.length("line") >= least_length)
    return lines.select("id", "row", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"))


def _batch(docs: DataFrame, batches: int) -> Column:
    """The number of an id's batch: about even shares of the ids, the largest ids first, null ids last."""
    bounds = docs.approxQuantile("id", [i / batches for i in range(1, batches)], 0.02) if batches > 1 else []
    return functools.reduce(lambda a, b: a + b, [F.when(F.col("id") >= F.lit(x).cast("long"), 0).otherwise(1) for x in bounds], F.lit(0))


@F.pandas_udf(T.StringType())
def _without(texts: pd.Series, drops: pd.Series) -> pd.Series:
    """Texts without the lines at the given places."""
    out = []
    for t, places in zip(texts, drops, strict=True):
        if t is None or places is None:
            out.append(t)
        else:
            gone = set(places.tolist())
            out.append("\n".join([x for i, x in enumerate(t.split("\n")) if i not in gone]))
    return pd.Series(out, dtype=object)


def without_common_lines(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: id, text (what stays), n_lines (before), n_dropped."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    plain = plain.withColumn("row", F.xxhash64("id", "text"))
    path = new_path(spark, "lines")
    line_rows(plain, least_length).withColumn("batch", _batch(plain, batches)).write.option("compression", "zstd").partitionBy("batch").parquet(path)
    lines = spark.read.schema("id long, row long, pos int, h1 long, h2 long, batch int").parquet(path)

    runs = LineRuns(spark, least_docs, fanout)
    for batch, n in sorted((r["batch"], r["count"]) for r in lines.groupBy("batch").count().collect()):  # one row a batch
        runs.add(lines.filter(F.col("batch") == batch), n)
    if not runs.levels:  # no line is long enough
        return plain.select("id", "text", _n_lines(F.col("text")).alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    settled = runs.settled()

    hot = F.broadcast(settled.filter("hot"))
    lost = lines.join(hot, KEY).unionByName(lines.join(hot.select(*KEY), KEY, "left_anti").join(settled.filter("not hot"), KEY)).filter(~F.col("id").eqNullSafe(F.col("keeper")))
    drops = lost.groupBy("id", "row").agg(F.collect_set("pos").alias("places")).select(F.col("id").alias("lost_id"), F.col("row").alias("lost_row"), "places")
    found = plain.join(drops, (F.col("row") == F.col("lost_row")) & F.col("id").eqNullSafe(F.col("lost_id")), "left")
    kept = F.when(F.col("places").isNull(), F.col("text")).otherwise(_without(F.when(F.col("places").isNotNull(), F.col("text")), F.col("places")))
    return found.select("id", kept.alias("text"), _n_lines(F.col("text")).alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"))


def _n_lines(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_common_lines(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_GAPS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM docs),
keyed AS (SELECT *, translate(trim(line, {_GAPS}), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS k FROM lines),
common AS (
  SELECT k, max(doc_id) AS keeper FROM (SELECT DISTINCT k, doc_id FROM keyed WHERE length(k) >= {LEAST_LENGTH})
  GROUP BY k HAVING count(*) >= {LEAST_DOCS}),
judged AS (SELECT rid, line, i, keeper IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone FROM keyed LEFT JOIN common USING (k)),
kept AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM judged GROUP BY rid)
SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM docs JOIN kept USING (rid)
"""
