"""Approximate nearest neighbours by collision-counting hashing with query-centred windows.

Each of PROJECTIONS random directions gives a sorted array of the vectors' projections. A query opens a window around
its own projection in every array and widens all windows together (virtual rehashing: a wider window is the bucket of a
coarser hash, without a new table). A vector inside the windows of at least THRESHOLD arrays is a candidate, and
candidates are verified by the exact inner product in double precision. Widening ends by a rule that knows no sizes:
projections of a difference of length r are normal with deviation r, so a vector at the distance of the k-th best one
found so far is a candidate with probability SURE once the windows' half width is reach() times that distance. What is
farther can't be among the k best. So a smaller table, or one whose neighbours are nearer, is not treated differently.

Vectors are dealt into ranges of norm, in each of which norms differ by a factor of at most RANGE, ranges into cells
around pivots, and cells by hash into segments of about SEGMENT, each with its own sorted arrays. Pivots are fitted on a
bounded sample (SAMPLE vectors a pivot, MOST_PIVOTS pivots in all); every vector is indexed. Largest inner product
becomes smallest distance by one more coordinate, sqrt(1 - |v|^2 / M^2), M the largest norm of the segment; it is 0 for
queries, which are brought to norm 1 (that changes no order).

A query first searches one segment near it. The k-th best score from there is the bound with which it goes to the other
segments: windows are opened once, at the width that the bound asks for. A segment whose longest vector can't reach the
bound, or that lies beyond it by its centre and radius, is skipped without loss; where no query of a block needs a
segment, the pair is never formed. Blocks hold queries of one cell. A segment goes to as many tasks as its pairs ask
for, FEW blocks each, so no segment or block is tied to one task, and a task holds a few MB however large the table is.

Copies: of rows with equal vectors the k + 1 with the smallest ids are indexed. No other can be among any query's k
best, as ties go to the smaller id and a query leaves out only itself.

Defined cases: vectors that are null, zero or hold null or non-finite components, and rows with a null id, take no part;
of rows that repeat an id the one with the smallest vector counts; vectors meet only those of the same dimension; equal
scores go by the smaller id; an empty table gives an empty result; very long vectors are as any other; other columns,
whatever their names, aren't read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

K, PROJECTIONS, THRESHOLD, SURE, SEGMENT, BLOCK, FEW, SEED = 20, 96, 82, 0.90, 8192, 512, 4, 5
RANGE, SAMPLE, MOST_PIVOTS, ROUNDS = 1.25, 64, 4096, 6
START, WIDEN, SLACK = 0.1, 1.25, 1e-5  # half of the first window of a query without a bound, its growth, float rounding
SEG = ["dim", "norms", "cell", "part"]


def directions(dim: int, m: int = PROJECTIONS, seed: int = SEED):
    import numpy as np

    return np.random.default_rng(seed).standard_normal((m, dim))


@functools.cache
def reach(m: int = PROJECTIONS, threshold: int = THRESHOLD, sure: float = SURE) -> float:
    """Half the window, in distances, in which a vector collides in at least threshold of m arrays with probability sure."""

    def least(holds) -> float:
        low, high = 0.0, 8.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if holds(mid) else (mid, high)
        return high

    at_least = lambda p: sum(math.comb(m, i) * p**i * (1 - p) ** (m - i) for i in range(threshold, m + 1))
    return least(lambda w: at_least(math.erf(w / math.sqrt(2))) >= sure)


def sorted_arrays(vectors, a):
    """Per projection: vector numbers by projected value, and those values."""
    import numpy as np

    p = (vectors @ a.T).T.astype("<f4")
    order = np.argsort(p, axis=1, kind="stable")
    return order.astype(np.int32), np.take_along_axis(p, order, axis=1)


def collisions(projected, half, order, values) -> Iterator:
    """Per query (a row of projected, half its window) the number of arrays in whose window each vector lies."""
    import numpy as np

    m, n = order.shape
    lows = np.stack([np.searchsorted(values[j], projected[:, j] - half, side="left") for j in range(m)], axis=1).tolist()
    highs = np.stack([np.searchsorted(values[j], projected[:, j] + half, side="right") for j in range(m)], axis=1).tolist()
    for lo, hi in zip(lows, highs, strict=True):
        if 2 * (sum(hi) - sum(lo)) <= m * n:
            yield np.bincount(np.concatenate([order[j, lo[j] : hi[j]] for j in range(m)]), minlength=n)
        else:  # where windows hold most of the arrays, what lies outside is counted
            yield m - np.bincount(np.concatenate([order[j, x] for j in range(m) for x in (slice(0, lo[j]), slice(hi[j], n))]), minlength=n)


def search_segment(qids, qs, bounds, ids, v, top: float, order, values, k: int = K, threshold: int = THRESHOLD, sure: float = SURE):
    """(query id, vector id, score) of at most k vectors a query, as three arrays, and the number of vectors verified.

    bounds: a score that each query's k-th best is known to reach, or -inf. top: the largest norm of the segment."""
    import numpy as np

    m = len(order)
    width = reach(m, threshold, sure)
    length = _norms(qs)
    projected = (np.column_stack([_unit(qs), np.zeros(len(qs))]) @ directions(v.shape[1] + 1, m).T).astype("<f4")
    whole = np.abs(projected).max(axis=1) + np.abs(values).max() + SLACK  # windows as wide hold everything

    def cosine(bound):
        """Of a vector of the longest norm at that score; nothing is known (-inf) where a score or a norm overflows."""
        with np.errstate(all="ignore"):
            out = bound / length / top
        return np.where(np.isfinite(out), out, -np.inf)

    def half_for(bound: float, q: int) -> float:
        c = cosine(np.full(len(length), bound))[q]
        return min(float(whole[q]), width * math.sqrt(max(0.0, 2 - 2 * c)) + SLACK)

    out: list = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
    verified = 0

    def best_of(q: int, counts):
        nonlocal verified
        c = np.flatnonzero(counts >= threshold)
        c = c[ids[c] != qids[q]]
        with np.errstate(all="ignore"):
            score = (v[c] * qs[q]).sum(axis=1)
        verified += len(c)
        best = np.lexsort((ids[c], -score))[:k]
        return ids[c[best]], score[best]

    def give(q: int, found) -> None:
        out[0].append(np.full(len(found[0]), qids[q]))
        out[1].append(found[0])
        out[2].append(found[1])

    known = np.flatnonzero((bounds != -np.inf) & (cosine(bounds) <= 1 + SLACK))
    if len(known):
        half = np.array([half_for(bounds[q], q) for q in known], "<f4")
        for q, counts in zip(known, collisions(projected[known], half, order, values), strict=True):
            give(q, best_of(q, counts))
    start = START
    for q in np.flatnonzero(bounds == -np.inf):
        half = start
        while True:
            (counts,) = collisions(projected[q : q + 1], np.float32(half), order, values)
            found = best_of(q, counts) if np.count_nonzero(counts >= threshold) > k else None
            if found is not None or half >= whole[q]:
                break
            half *= WIDEN
        start = max(START, half / WIDEN)  # a query's neighbour is likely to need about as much
        if found is None:
            found = best_of(q, counts)
        if len(found[0]) == k and half_for(found[1][-1], q) > half:
            (counts,) = collisions(projected[q : q + 1], np.float32(half_for(found[1][-1], q)), order, values)
            found = best_of(q, counts)
        give(q, found)
    return *(np.concatenate(x) for x in out), verified


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(F.coalesce(fine, F.lit(False))).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def _norm_range(v: Column) -> Column:
    """The number of a vector's range of norms; norm 1 is in the middle of range 0. Squares are of parts of the longest component."""
    longest = F.array_max(F.transform(v, F.abs))
    squares = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x / longest) * (x / longest))
    return F.round((F.ln(longest) + 0.5 * F.ln(squares)) / math.log(RANGE)).cast("int")


def _norms(v):
    """Norms, by way of the longest component, so that squares neither vanish nor overflow."""
    import numpy as np

    longest = np.abs(v).max(axis=1)
    with np.errstate(over="ignore"):
        return longest * np.sqrt(((v / longest[:, None]) ** 2).sum(axis=1))


def _unit(v):
    import numpy as np

    v = v / np.abs(v).max(axis=1)[:, None]
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def _nearest_pivot(x, pivots):
    """x, pivots: unit vectors. Products of at most 1024 rows are held at a time, 32 MB with MOST_PIVOTS."""
    import numpy as np

    return np.concatenate([(x[i : i + 1024] @ pivots.T).argmax(axis=1) for i in range(0, len(x), 1024)])


def _pivots(rows: DataFrame) -> dict:
    """(dim, norms) -> pivots, for ranges of more than a segment. At most MOST_PIVOTS, and one more for each such range.

    Spherical k-means on a sample of SAMPLE vectors a pivot: each round's tasks add up their vectors by nearest pivot, and
    only those sums, one row a pivot and task, are shuffled. The driver holds the pivots alone."""
    import numpy as np

    n = rows.groupBy("dim", "norms").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), F.lit(MOST_PIVOTS) / F.sum(F.ceil(F.col("n") / SEGMENT)).over(Window.partitionBy(F.lit(0))))
    sized = n.select("dim", "norms", F.ceil(F.ceil(F.col("n") / SEGMENT) * share).alias("pivots")).filter("pivots > 1")
    ranked = rows.join(sized, ["dim", "norms"]).withColumn("place", F.row_number().over(Window.partitionBy("dim", "norms").orderBy(F.xxhash64("id"), "id")))

    picked = ranked.filter((F.col("place") <= F.lit(SAMPLE * MOST_PIVOTS)) & (F.col("place") <= F.lit(SAMPLE) * F.col("pivots")))
    sample = materialize(picked.select("dim", "norms", "v", "place", "pivots"), "pivot-sample")
    first = sample.filter("place <= pivots").groupBy("dim", "norms", "place").agg(F.first("v").alias("v")).orderBy("dim", "norms", "place").collect()
    found: dict = {}
    for r in first:
        found.setdefault((r["dim"], r["norms"]), []).append(r["v"])
    found = {k: _unit(np.array(v)) for k, v in found.items()}

    def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for pdf in frames:
            for key, part in pdf.groupby(["dim", "norms"]):
                pivots, x = shared.value[key], _unit(np.stack(part["v"].to_numpy()))
                np.add.at(sums.setdefault(key, np.zeros_like(pivots)), _nearest_pivot(x, pivots), x)
        for (dim, norms), total in sums.items():
            some = np.flatnonzero(np.abs(total).sum(axis=1))
            yield pd.DataFrame({"dim": dim, "norms": norms, "pivot": some, "total": [t.tobytes() for t in total[some]]})

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(t) for t in pdf["total"]], axis=0)
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "norms": pdf["norms"].iloc[:1], "pivot": pdf["pivot"].iloc[:1], "total": [total.tobytes()]})

    kinds = "dim int, norms int, pivot long, total binary"
    for _ in range(ROUNDS if found else 0):
        shared = rows.sparkSession.sparkContext.broadcast(found)
        for r in sample.select("dim", "norms", "v").mapInPandas(added, kinds).groupBy("dim", "norms", "pivot").applyInPandas(merged, kinds).collect():  # a row a pivot
            total = np.frombuffer(bytes(r["total"]))
            if np.abs(total).max() > 0:
                found[r["dim"], r["norms"]][r["pivot"]] = _unit(total[None, :])[0]
    return found


def _with_cells(rows: DataFrame, pivots) -> DataFrame:
    """rows: id, v, dim, norms. Adds cell, the number of the nearest pivot of the range. pivots: a broadcast."""

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for pdf in frames:
            cell = pd.Series(0, index=pdf.index, dtype="int64")
            for key, part in pdf.groupby(["dim", "norms"]):
                if key in pivots.value:
                    cell.loc[part.index] = _nearest_pivot(_unit(np.stack(part["v"].to_numpy())), pivots.value[key])
            yield pdf.assign(cell=cell)

    return rows.select("id", "v", "dim", "norms").mapInPandas(near, "id long, v array<double>, dim int, norms int, cell long")


def _index(rows: DataFrame) -> DataFrame:
    """One row a segment: SEG, n, centre, radius, top, and ids, vectors, order, values as bytes."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        v = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        top, longest = float(_norms(v).max()), np.abs(v).max()
        unit = v / longest
        unit = unit / np.sqrt((unit * unit).sum(axis=1)).max()
        x = np.column_stack([unit, np.sqrt(np.maximum(1.0 - (unit * unit).sum(axis=1), 0.0))])
        centre = x.mean(axis=0)
        order, values = sorted_arrays(x, directions(x.shape[1]))
        key = [pdf[c].iloc[0] for c in SEG]
        one = [*key, len(v), centre, float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max()), top, pdf["id"].to_numpy(np.int64).tobytes(), v.tobytes(), order.tobytes(), values.tobytes()]
        return pd.DataFrame([one], columns=[*SEG, "n", "centre", "radius", "top", "ids", "vectors", "order", "values"])

    kinds = "dim int, norms int, cell long, part long, n long, centre array<double>, radius double, top double, ids binary, vectors binary, order binary, values binary"
    return rows.groupBy(*SEG).applyInPandas(build, kinds)


HOME = [f"home_{c}" for c in SEG]


def _blocks(queries: DataFrame) -> DataFrame:
    """queries: HOME, id, v, bound. One row a block of queries of one home: HOME, block, its centre and radius, the least
    bound as a part of the query's norm, and qids, qs, bounds as bytes."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        q, bounds = np.stack(pdf["v"].to_numpy()).astype(np.float64), pdf["bound"].to_numpy(np.float64)
        unit = np.column_stack([_unit(q), np.zeros(len(q))])
        centre = unit.mean(axis=0)
        with np.errstate(all="ignore"):
            asked = bounds / _norms(q)
        least = float(np.where(np.isfinite(asked), asked, -np.inf).min())  # where it can't be told, every segment is searched
        one = [*[pdf[c].iloc[0] for c in HOME], pdf["block"].iloc[0], centre, float(np.sqrt(((unit - centre) ** 2).sum(axis=1)).max()), least,
               pdf["id"].to_numpy(np.int64).tobytes(), q.tobytes(), bounds.tobytes()]
        return pd.DataFrame([one], columns=[*HOME, "block", "q_centre", "q_radius", "q_bound", "qids", "qs", "bounds"])

    sizes = queries.groupBy(*HOME).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = queries.join(sizes, HOME).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    kinds = "home_dim int, home_norms int, home_cell long, home_part long, block long, q_centre array<double>, q_radius double, q_bound double, qids binary, qs binary, bounds binary"
    return dealt.groupBy(*HOME, "block").applyInPandas(pack, kinds)


def _meet(pairs: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """pairs: SEG and a block's columns. query_id, vec_id, score, and verified (of the block, at its first row). A segment
    is copied once for each FEW of its blocks; a task gets one copy and its blocks."""
    pairs = pairs.select(*SEG, F.xxhash64(*HOME, "block").alias("who"), "qids", "qs", "bounds")
    copies = pairs.groupBy(*SEG).agg(F.ceil(F.count("*") / FEW).alias("copies"))
    n = max(1, copies.agg(F.sum("copies")).first()[0] or 0)
    keys = [*SEG, "copy"]
    left = pairs.join(copies, SEG).withColumn("copy", F.pmod("who", F.col("copies"))).drop("copies", "who")
    right = index.join(copies, SEG).select(*SEG, F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), "top", "ids", "vectors", "order", "values")
    n = min(2000, 2 * n)

    def search(own: pd.DataFrame, segment: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        if not len(own):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "verified": []})
        s = segment.iloc[0]
        ids = np.frombuffer(s["ids"], np.int64)
        v, order = np.frombuffer(s["vectors"]).reshape(len(ids), -1), np.frombuffer(s["order"], np.int32).reshape(-1, len(ids))
        values = np.frombuffer(s["values"], "<f4").reshape(order.shape)
        out = []
        for r in own.itertuples():
            qids = np.frombuffer(r.qids, np.int64)
            q, vec, score, verified = search_segment(qids, np.frombuffer(r.qs).reshape(len(qids), -1), np.frombuffer(r.bounds), ids, v, s["top"], order, values, k)
            one = pd.DataFrame({"query_id": q, "vec_id": vec, "score": score, "verified": 0})
            if len(one):
                one.loc[0, "verified"] = verified
            out.append(one)
        return pd.concat(out)

    together = left.repartition(n, *keys).groupBy(*keys).cogroup(right.repartition(n, *keys).groupBy(*keys))
    return together.applyInPandas(search, "query_id long, vec_id long, score double, verified long")


def found_by_segment(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, vec_id, score, verified: the k best of each segment that a query searched."""
    spark = vectors.sparkSession
    usable = materialize(_usable(vectors, id_col, vector_col).withColumn("norms", _norm_range(F.col("v"))), "vectors")
    copies = Window.partitionBy("v").orderBy("id")
    rows = materialize(usable.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).drop("copy"), "vectors-distinct")
    pivots = spark.sparkContext.broadcast(_pivots(rows))
    celled = _with_cells(rows, pivots)
    parts = materialize(celled, "vectors-cells")
    sizes = parts.groupBy("dim", "norms", "cell").agg(F.count("*").alias("n"), F.ceil(F.count("*") / SEGMENT).alias("parts"))
    dealt = parts.join(sizes.drop("n"), ["dim", "norms", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    index = materialize(_index(dealt), "vector-index")

    # A query's home is a segment near it, in the range of the largest norms that fill a segment, else in the fullest range.
    ranges = sizes.groupBy("dim", "norms").agg(F.sum("n").alias("n"))
    home = ranges.groupBy("dim").agg(F.max_by("norms", F.struct(F.least("n", F.lit(SEGMENT)), "norms")).alias("home_norms"))
    asked = usable.filter(is_query).join(F.broadcast(home), "dim")  # one row a dimension
    near = _with_cells(asked.select("id", "v", "dim", F.col("home_norms").alias("norms")), pivots)
    held = near.join(sizes.drop("n"), ["dim", "norms", "cell"], "left").select(
        F.col("dim").alias("home_dim"), F.col("norms").alias("home_norms"), F.col("cell").alias("home_cell"), F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).alias("home_part"), "id", "v"
    )
    queries = materialize(held, "vector-queries")
    at_home = _blocks(queries.withColumn("bound", F.lit(float("-inf")))).withColumns(dict(zip(SEG, map(F.col, HOME), strict=True)))
    first = materialize(_meet(at_home, index, k), "found-at-home")

    bounds = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("bound"))
    known = queries.join(bounds, queries["id"] == bounds["query_id"], "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf")))).drop("query_id")
    blocks = materialize(_blocks(known), "query-blocks")
    # Pairs of a block and a segment that may hold something nearer than the block's worst bound.
    spread = 16
    one = blocks.select(*HOME, "block", "q_centre", "q_radius", "q_bound", F.pmod(F.xxhash64(*HOME, "block"), F.lit(spread)).alias("salt"))
    segments = index.select(*SEG, "centre", "radius", "top", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("salt"))
    apart = F.sqrt(F.aggregate(F.zip_with("centre", "q_centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x))
    within = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("q_bound") / F.col("top")))
    hopeful = (F.col("q_bound") <= F.col("top") * (1 + SLACK)) & (apart - F.col("radius") - F.col("q_radius") <= within + SLACK)
    other = ~functools.reduce(lambda a, b: a & b, [F.col(s) == F.col(h) for s, h in zip(SEG, HOME, strict=True)])
    pairs = one.join(segments, (F.col("home_dim") == F.col("dim")) & (one["salt"] == segments["salt"])).filter(other & hopeful).select(*HOME, "block", *SEG)
    second = _meet(materialize(pairs, "vector-pairs").join(blocks, [*HOME, "block"]), index, k)
    return first.unionByName(materialize(second, "found-elsewhere"))


def nearest(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per query its k nearest found: query_id, rank, vec_id, score. is_query: a condition on the column id."""
    found = found_by_segment(vectors, is_query, k, id_col, vector_col)
    order = Window.partitionBy("query_id").orderBy(F.nanvl("score", F.lit(float("-inf"))).desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
