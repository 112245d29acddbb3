"""Content-addressed store of token ids: chunks cut by a rolling hash, document recipes and Merkle manifests.

A document's ids are cut where a hash over the last WINDOW ids meets a mask, so equal passages give equal chunks
wherever they stand. The store has three tables in the shared folder: chunks (each distinct chunk's ids once, under its
SHA-256, and how often recipes name it), recipes (per document, in ascending id order, the digests of its chunks, their
Merkle root and its place) and manifest. Ids are little-endian, in two bytes where the vocabulary allows, else four.

The manifest is a tree over places: a node of level 1 covers up to 2^FAN documents, one of a higher level as many nodes,
up to one at the top; each holds its documents, ids, where its ids start, and the Merkle root over its children's. No
node gathers more than 2^FAN children, and starts come from parents, so no task sees all documents.

Texts are encoded once, to a work table outside of the store that is deleted when the store is written; a batch keeps
the bytes of each of its chunks once. Only narrow columns are sorted by id; chunk bytes are shuffled once, to store each
once, combined before the shuffle. Reading first rebuilds the manifest from the recipes and stops at any difference, so
a recipe that is lost, changed or moved is noticed. It hashes each stored chunk where it lies, joins only digests, counts
and checksums (chunks that many documents share by broadcast, at most a thousand), and combines checksums in recipe
order; a digest or root that differs stops the job. read_documents rebuilds the ids themselves.

Defined cases: a null text is empty and has only the end id; rows with the same id are ordered by their roots, and
equal rows in any order; null ids come first; a text of any length is cut into chunks of at most MOST ids; an empty table
makes an empty store; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_skewed, materialize, new_path, remove, table, text_or_empty, tokenizer_path
from .token_encoding import encoder

VOCABULARY, END_ID = "word_bpe_49k.json", 1
WINDOW, MEAN, LEAST, MOST = 16, 512, 64, 4096
RUN = 500_000  # ids that are marked at once, if they aren't one longer text's
FAN = 16  # bits: a node of the manifest has at most 65,536 children
_MIX, _STEP = 0x9E3779B97F4A7C15, 0x2545F4914F6CDD1D


def marked(ids):
    """The places after which a chunk may end, by the WINDOW ids before them (of ids, a numpy array), in ascending order."""
    import numpy as np

    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(_MIX)
    x ^= x >> np.uint64(29)
    h, reach, factor = x, 1, _STEP
    while reach < WINDOW:  # the sum of the last WINDOW mixed ids, each times a power of the step, by doubling
        longer = h.copy()
        longer[reach:] += h[:-reach] * np.uint64(factor)
        h, reach, factor = longer, 2 * reach, factor * factor % 2**64
    h = h ^ (h >> np.uint64(32))
    return np.flatnonzero((h * np.uint64(_MIX)) >> np.uint64(40) & np.uint64(MEAN - 1) == 0) + 1


def ends_at(n: int, marks: list[int]) -> list[int]:
    """Ends of the chunks of n ids with such marks."""
    ends, last = [], 0
    for e in marks:
        while e - last > MOST:
            last += MOST
            ends.append(last)
        if e - last >= LEAST:
            ends.append(e)
            last = e
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def cut_points(ids) -> list[int]:
    """Ends of the chunks of ids (a numpy array), by their content alone."""
    return ends_at(len(ids), marked(ids).tolist())


def cut_together(texts: Iterable[bytes]) -> Iterator[tuple]:
    """Per text, ids in four bytes: the ids of a run of texts (a numpy array), where in it the text starts, and the ends of its
    chunks. A run is marked at once: no mark before a text's id LEAST counts, and LEAST is more than WINDOW, so the texts before
    a text don't matter."""
    import numpy as np

    def cut(run: list[bytes]) -> Iterator[tuple]:
        ids = np.frombuffer(b"".join(run), "<u4")
        marks, starts = marked(ids), np.cumsum([0] + [len(t) // 4 for t in run])
        among = np.searchsorted(marks, starts, "right").tolist()
        for start, end, first, last in zip(starts.tolist(), starts[1:].tolist(), among, among[1:], strict=False):
            yield ids, start, ends_at(end - start, (marks[first:last] - start).tolist())

    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t) // 4
        if size >= RUN:
            yield from cut(run)
            run, size = [], 0
    if run:
        yield from cut(run)


def merkle_root(leaves: list[bytes]) -> bytes:
    """Leaves and inner nodes are hashed with different first bytes; an odd last node moves up as it is."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"\0").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def write_store(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", width: int = 2) -> str:
    """Write the store of docs to path; width: bytes of an id."""
    spark, end = docs.sparkSession, end_id.to_bytes(4, "little")

    def chunked(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = encoder(vocabulary)
        kinds = {"id": pa.string(), "n_tokens": pa.int64(), "root": pa.binary(), "digests": pa.list_(pa.binary()), "parts": pa.list_(pa.binary())}
        for batch in batches:
            sizes, roots, ends_of, digests, parts, met, held, raw = [], [], [0], [], [], set(), None, b""
            for ids, start, ends in cut_together(data + end for data in enc.encode(batch.column(1).to_pylist())):
                if ids is not held:
                    if width == 2 and int(ids.max()) > 65535:
                        raise ValueError("an id doesn't fit two bytes; write the store with width=4")
                    held, raw = ids, ids.astype(f"<u{width}").tobytes()
                own = []
                for a, b in zip([0, *ends], ends, strict=False):
                    part = raw[(start + a) * width : (start + b) * width]
                    own.append(d := hashlib.sha256(part).digest())
                    parts.append(None if d in met else part)
                    met.add(d)
                sizes.append(ends[-1])
                roots.append(merkle_root(own))
                digests += own
                ends_of.append(len(digests))
            lists = [pa.ListArray.from_arrays(pa.array(ends_of, pa.int32()), pa.array(x, pa.binary())) for x in (digests, parts)]
            yield pa.record_batch([batch.column(0), sizes, roots, *lists], schema=pa.schema(kinds))

    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    text = docs.select(F.col(id_col).cast("string").alias("id"), text_or_empty(text_col).alias("text"))
    staged = text.mapInArrow(chunked, "id string, n_tokens long, root binary, digests array<binary>, parts array<binary>")
    work = new_path(spark, "token-staging")
    staged.withColumn("id", F.col("id").cast(kind)).write.option("compression", "zstd").parquet(work)
    staging = spark.read.parquet(work)

    chunks = staging.select(F.explode(F.arrays_zip("digests", "parts")).alias("c")).select(F.col("c.digests").alias("digest"), F.col("c.parts").alias("ids"))
    chunks.groupBy("digest").agg(F.first("ids", ignorenulls=True).alias("ids"), F.count("*").alias("uses")).write.option("compression", "zstd").parquet(f"{path}/chunks")

    recipes = staging.select("id", "n_tokens", "root", "digests").repartitionByRange(F.col("id").asc_nulls_first(), F.col("root")).sortWithinPartitions(F.col("id").asc_nulls_first(), "root")
    recipes.withColumn("place", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(f"{path}/recipes")
    manifest_of(spark.read.parquet(f"{path}/recipes"), width).write.parquet(f"{path}/manifest")
    remove(spark, work)
    return path


def _root_of(children: Column) -> Column:
    """The Merkle root over the roots of children, an array of struct(node, root) in any order."""

    @F.pandas_udf("binary")
    def root(s: pd.Series) -> pd.Series:
        return s.map(lambda roots: merkle_root([bytes(r) for r in roots]))

    return root(F.transform(F.sort_array(children), lambda x: x["root"]))


def manifest_of(recipes: DataFrame, width: int) -> DataFrame:
    """recipes: place, n_tokens, root. level, node, docs, tokens, start, root, width."""
    children = F.collect_list(F.struct("node", "root"))
    level = recipes.select(F.col("place").alias("node"), F.lit(1).cast("long").alias("docs"), F.col("n_tokens").alias("tokens"), "root")
    levels = []
    while not levels or levels[-1].filter("node > 0").limit(1).count():
        up = level.groupBy(F.expr(f"shiftright(node, {FAN})").alias("node")).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"), children.alias("_c"))
        level = materialize(up.select("node", "docs", "tokens", _root_of(F.col("_c")).alias("root")), "manifest")
        levels.append(level)
    among = Window.partitionBy("_up").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    placed, out = None, None
    for n in range(len(levels), 0, -1):
        own = levels[n - 1].withColumn("_up", F.expr(f"shiftright(node, {FAN})")).withColumn("start", F.coalesce(F.sum("tokens").over(among), F.lit(0)))
        if placed is not None:
            own = own.join(placed.select(F.col("node").alias("_up"), F.col("start").alias("_from")), "_up").withColumn("start", F.col("start") + F.col("_from"))
        placed = own.select(F.lit(n).alias("level"), "node", "docs", "tokens", "start", "root", F.lit(width).alias("width"))
        out = placed if out is None else out.unionByName(placed)
    return out


def checked_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The stored manifest. An error, if it isn't the one that the recipes give."""
    stored = spark.read.parquet(f"{path}/manifest")
    width = stored.agg(F.coalesce(F.max("width"), F.lit(2))).first()[0]
    found = manifest_of(spark.read.parquet(f"{path}/recipes"), width)
    same = F.struct(*[F.col(f"a.{c}") for c in ("docs", "tokens", "start", "root", "width")]).eqNullSafe(F.struct(*[F.col(f"b.{c}") for c in ("docs", "tokens", "start", "root", "width")]))
    both = stored.alias("a").join(found.alias("b"), (F.col("a.level") == F.col("b.level")) & (F.col("a.node") == F.col("b.node")), "full")
    if bad := both.filter(~same).select(F.coalesce("a.level", "b.level"), F.coalesce("a.node", "b.node")).first():
        raise ValueError(f"the recipes don't give the manifest: level {bad[0]}, node {bad[1]}")
    return stored


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """Chunks whose bytes agree with their digest."""
    right = F.sha2("ids", 256) == F.lower(F.hex("digest"))
    return spark.read.parquet(f"{path}/chunks").select("digest", "uses", F.when(right, F.col("ids")).otherwise(F.raise_error(F.lit("a chunk doesn't match its digest"))).alias("ids"))


def _lines(recipes: DataFrame) -> DataFrame:
    return recipes.select("place", F.posexplode("digests").alias("k", "digest"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the stored chunks: id, start, n_tokens, ids_crc32 (of the ids in four bytes)."""
    recipes, manifest = spark.read.parquet(f"{path}/recipes"), checked_manifest(spark, path)
    width = manifest.agg(F.coalesce(F.max("width"), F.lit(2))).first()[0]

    def facts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for pdf in frames:
            ends = np.cumsum([len(x) // width for x in pdf["ids"]])
            four = memoryview(np.frombuffer(b"".join(pdf["ids"]), f"<u{width}").astype("<u4").tobytes())
            starts = np.concatenate([[0], ends[:-1]])
            crc = [zlib.crc32(four[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pd.DataFrame({"digest": pdf["digest"], "uses": pdf["uses"], "n": ends - starts, "crc": crc})

    known = materialize(_stored(spark, path).mapInPandas(facts, "digest binary, uses long, n long, crc long"), "chunk-facts")
    found = join_skewed(_lines(recipes), known, "digest", "uses").groupBy("place").agg(F.sort_array(F.collect_list(F.struct("k", "n", "crc", "digest"))).alias("c"))
    joined = recipes.select("id", "place", F.col("n_tokens").alias("said"), "root").join(found, "place", "left")

    @F.pandas_udf("n long, crc long, root binary")
    def combined(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        zeros = {}
        for s in batches:
            rows = []
            for chunks in s:
                total, crc, digests = 0, 0, []
                for c in chunks if chunks is not None else ():
                    n = c["n"]
                    if n not in zeros:
                        zeros[n] = (bytes(4 * n), zlib.crc32(bytes(4 * n)))
                    pad, of_pad = zeros[n]
                    # crc(a + b) = crc(a + zeros) ^ crc(b) ^ crc(zeros), where b and zeros are equally long
                    crc = zlib.crc32(pad, crc) ^ c["crc"] ^ of_pad if total else c["crc"]
                    total += n
                    digests.append(bytes(c["digest"]))
                rows.append((total, crc, merkle_root(digests)))
            yield pd.DataFrame(rows, columns=["n", "crc", "root"])

    got = joined.withColumn("got", combined("c")).withColumn("ok", (F.col("got.n") == F.col("said")) & (F.col("got.root") == F.col("root")))
    checked = got.select("id", "place", F.when(F.col("ok"), F.col("got.n")).otherwise(F.raise_error(F.lit("a document doesn't match its recipe"))).alias("n_tokens"), F.col("got.crc").alias("ids_crc32"))
    checked = checked.withColumn("node", F.expr(f"shiftright(place, {FAN})"))
    before = Window.partitionBy("node").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.filter("level = 1").select("node", "start")
    return checked.withColumn("_in", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).join(starts, "node").select("id", (F.col("start") + F.col("_in")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document its ids as an array, rebuilt from chunks."""
    recipes = spark.read.parquet(f"{path}/recipes")
    width = checked_manifest(spark, path).agg(F.coalesce(F.max("width"), F.lit(2))).first()[0]
    whole = join_skewed(_lines(recipes), _stored(spark, path), "digest", "uses").groupBy("place").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("c"))

    @F.pandas_udf("array<int>")
    def ids(s: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series([np.frombuffer(b"".join(bytes(c["ids"]) for c in chunks), f"<u{width}").astype("int32") for chunks in s])

    return recipes.select("id", "place").join(whole, "place").select("id", ids("c").alias("ids"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_store(table(spark, sf_dir, "documents"), new_path(spark, "tokens"), tokenizer_path(VOCABULARY))
    return read_index(spark, path).withColumnRenamed("id", "doc_id")
