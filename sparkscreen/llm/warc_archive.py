"""Content-addressed archive of WARC records.

Two tables in the shared folder make an archive: headers, with the exact header bytes of every record and the strong
digest (SHA-256) of its payload, and payloads, each distinct payload's bytes once under that digest. Reading joins them
again and rebuilds every record's bytes. A payload's digest is computed anew from the bytes read, and what a header says
of its block is held against the rebuilt record; a mismatch stops the job, so a record never gets other bytes than it was
written with.

A payload of at least min_revisit bytes that several records share belongs to the record with the largest id, the
response; the others are revisits that name its record's id in WARC-Refers-To. Record ids are unique: the page's id and a
number of the record. Smaller payloads make responses only. The choice is a
grouped maximum, combined before the shuffle. A payload that a third of all pages share is no hot group: its narrow facts
reach the records by broadcast (at most a thousand such payloads), and on reading its bytes are copied once for each
SPREAD of its records, so that a task joins about that many at most.

Defined cases: a null payload is empty; a null id counts as smaller than any other and is read back as null; rows that
repeat the largest id are all responses, and where all ids are null, all are; a null target has no line and is read back
as null, an empty one as empty; line ends in a target are percent-encoded; payloads and targets of any length are kept
whole; an empty table makes an empty archive; other columns of the input, whatever their names, aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_skewed, materialize, new_path, table

MIN_REVISIT, SPREAD = 1000, 1000
END, NO_DATE = "\r\n", "1970-01-01T00:00:00Z"


def _urn(id_col: Column, number: Column) -> Column:
    """A record's own id: the page's and the record's number, as pages may share an id or have none."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(":"), number.cast("string"), F.lit(">"))


def _header() -> Column:
    """The exact header block, with the empty line behind it."""
    revisit = F.col("record_type") == "revisit"
    target = F.replace(F.replace(F.col("target"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    fields = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _urn(F.col("id"), F.col("number"))),
        F.concat(F.lit("WARC-Date: "), F.col("date")),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("keeper.id"), -F.col("keeper.back")))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes")).cast("string")),
    ]
    return F.encode(F.concat(F.concat_ws(END, *fields), F.lit(END + END)), "UTF-8")


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", target_col: str = "url", payload_col: str = "html", min_revisit: int = MIN_REVISIT, date_col: str | None = None) -> str:
    """One record a row; returns the archive's path. date_col: when a page was fetched, a timestamp; a page without one, and
    every page where no such column is named, has the date NO_DATE."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    fetched = F.date_format(F.to_utc_timestamp(F.col(date_col).cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'") if date_col else F.lit(None).cast("string")
    hashed = pages.select(F.col(id_col).alias("id"), F.col(target_col).alias("target"), F.coalesce(fetched, F.lit(NO_DATE)).alias("date"), payload.alias("payload")).select(
        "id", "target", "date", "payload", F.octet_length("payload").cast("long").alias("n_bytes"), F.sha2("payload", 256).alias("digest")
    )
    store = hashed.groupBy("digest").agg(F.first("payload").alias("payload"), F.count("*").alias("uses"))
    store.write.option("compression", "zstd").parquet(f"{path}/payloads")
    numbered = hashed.select("id", "target", "date", "n_bytes", "digest", F.sha1("payload").alias("sha1"), F.monotonically_increasing_id().alias("number"))
    records = materialize(numbered, "warc-records")  # the numbers are fixed by writing them
    keepers = records.groupBy("digest").agg(F.max(F.struct("id", (-F.col("number")).alias("back"))).alias("keeper"), F.count("*").alias("uses"))
    typed = join_skewed(records, keepers, "digest", "uses")
    shared = (F.col("n_bytes") >= min_revisit) & F.col("keeper.id").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper.id"))
    typed = typed.withColumn("record_type", F.when(shared, "revisit").otherwise("response"))
    typed.select("digest", "uses", _header().alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")
    return path


def _verified(store: DataFrame) -> DataFrame:
    right = F.sha2("payload", 256) == F.col("digest")
    return store.select("digest", "uses", F.when(right, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload doesn't match its digest "), F.col("digest")))).alias("payload"))


def _parsed(headers: DataFrame) -> DataFrame:
    """Adds what a header says."""
    text = F.decode("header", "UTF-8")
    get = lambda name, pattern: F.regexp_extract(text, rf"(?md)^{name}: {pattern}\r\n", 1)
    number = lambda s: F.expr(f"try_cast({s} AS BIGINT)")
    found = headers.select(
        "*", get("WARC-Type", "(.*?)").alias("record_type"), get("WARC-Record-ID", "<urn:page:(.*?):[0-9]+>").alias("_id"), get("WARC-Refers-To", "<urn:page:(.*?):[0-9]+>").alias("_to"),
        F.when(F.contains(text, F.lit(f"{END}WARC-Target-URI: ")), get("WARC-Target-URI", "(.*?)")).alias("target"), get("WARC-Payload-Digest", "sha1:(.*?)").alias("sha1"), get("Content-Length", "([0-9]+)").cast("long").alias("length"),
    )
    return found.withColumns({"id": number("_id"), "refers_to": number("_to")}).drop("_id", "_to")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """Per record: what its header says, its original bytes (header, block, two line ends) and its full payload."""
    copies = lambda uses: F.ceil(F.col(uses) / SPREAD)
    headers = spark.read.parquet(f"{path}/headers").withColumn("copy", F.pmod(F.xxhash64("header"), copies("uses")))
    payloads = _verified(spark.read.parquet(f"{path}/payloads")).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies("uses") - 1))).drop("uses")
    joined = _parsed(headers.join(payloads, ["digest", "copy"], "left"))
    lost = F.raise_error(F.lit("a record's payload is missing"))
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.coalesce("payload", lost.cast("binary")))
    return joined.select("id", "target", "record_type", "refers_to", "sha1", "length", F.octet_length("header").alias("_head"), F.concat("header", block, F.lit((END + END).encode())).alias("record"), F.coalesce("payload", lost.cast("binary")).alias("payload"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Per record, from its rebuilt bytes: id, target, record_type, refers_to, payload_bytes and payload_digest (SHA-1) of
    its full payload. A response's payload is cut out of the record again; a length or SHA-1 that its header states
    otherwise stops the job."""
    rebuilt = reconstruct(spark, path)
    block = F.expr("substring(record, _head + 1, octet_length(record) - _head - 4)")
    whole = rebuilt.withColumn("_block", block).withColumn("_full", F.when(F.col("record_type") == "revisit", F.col("payload")).otherwise(F.col("_block")))
    facts = whole.select("id", "target", "record_type", "refers_to", "sha1", (F.octet_length("_block") == F.col("length")).alias("_fits"), F.octet_length("_full").cast("long").alias("payload_bytes"), F.sha1("_full").alias("_sha1"))
    right = F.col("_fits") & (F.col("_sha1") == F.col("sha1"))
    return facts.select("id", "target", "record_type", "refers_to", "payload_bytes", F.when(right, F.col("_sha1")).otherwise(F.raise_error(F.lit("a record differs from what its header says"))).alias("payload_digest"))


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_archive(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return read_records(spark, path).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest, sha256(b) AS strong FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY strong) AS keeper FROM h)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM k
"""
