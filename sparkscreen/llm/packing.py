"""Best-fit packing by sums of squares: each piece goes where the squared counts of open bins per residual gap become
smallest.

Documents become pieces of at most the capacity; only longer documents are cut. Pieces that fill a sequence alone are
done. The rest are dealt at random into groups of bounded size, and each group is packed in one task, longest pieces
first. Placing a piece of length n into an open bin with gap g changes the sum of N(gap)^2 by 2 N(g - n) + 1 - (2 N(g) - 1),
opening a bin by 2 N(capacity - n) + 1, and a gap of 0 counts nothing; the smallest change wins, then the smallest gap left.
With late_opening a bin is opened only if no open one has room: a step aside from the rule that leaves fewer bins half
full (the tests count both). What a group leaves open is packed again, as pieces, with that of other groups, until all
fits one group.

Defined cases: a null text is empty and makes one piece with the end id; null ids are kept; repeated rows make pieces of
their own; a text of any length is cut into as many pieces as it takes; equal lengths go by the order of written rows; an
empty table gives no pieces; other columns of the input, whatever their names, aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, text_or_empty, tokenizer_path
from .token_encoding import encoder

VOCABULARY, CAPACITY, END_ID, GROUP = "word_bpe_49k.json", 2048, 0, 32768


def sum_of_squares(lengths: list[int], capacity: int, late_opening: bool = False) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, in the given order of pieces."""
    import numpy as np

    counts = np.zeros(capacity + 1, np.int64)  # open bins per gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    n_bins, out, never = 0, [], np.iinfo(np.int64).max
    for n in lengths:
        # What the bin's new gap costs and its old one saves, for gaps g = n .. capacity; the last stands for a new bin.
        after = 2 * counts[: capacity - n + 1] + 1
        after[0] = 0
        change = after - 2 * counts[n:] + 1
        change[counts[n:] == 0] = never
        change[-1] = after[-1]
        if late_opening and len(change) > 1 and change[:-1].min() < never:
            change[-1] = never
        g = n + int(change.argmin())
        if g == capacity:
            b = n_bins
            n_bins += 1
        else:
            b = stacks[g].pop()
            counts[g] -= 1
        out.append((b, capacity - g))
        if g > n:
            stacks[g - n].append(b)
            counts[g - n] += 1
    return out


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32."""
    end = end_id.to_bytes(4, "little")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in frames:
            rows = []
            for key, ids in zip(pdf["id"], enc.encode(pdf["text"].tolist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((key, k, at // 4, len(part) // 4, zlib.crc32(part)))
            out = pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32"])
            yield out.assign(id=out["id"].astype(pdf["id"].dtype)) if len(out) else out

    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    text = docs.select(F.col(id_col).cast("string").alias("id"), text_or_empty(text_col).alias("text"))
    return text.mapInPandas(cut, "id string, piece int, start long, length long, ids_crc32 long").withColumn("id", F.col("id").cast(kind))


def _pack_groups(items: DataFrame, n_groups: int, capacity: int, late_opening: bool) -> DataFrame:
    """items: item, length. Adds bin (unique over all groups), at, fill."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "item"], ascending=[False, True], ignore_index=True)
        places = sum_of_squares(pdf["length"].tolist(), capacity, late_opening)
        pdf["bin"] = [b for b, _ in places]
        pdf["at"] = [at for _, at in places]
        pdf["fill"] = pdf.groupby("bin")["length"].transform("sum")
        pdf["bin"] += pdf["group"].astype("int64") * 2**32
        return pdf[["item", "length", "bin", "at", "fill"]]

    dealt = items.withColumn("group", F.pmod(F.xxhash64("item"), F.lit(n_groups)))
    return dealt.groupBy("group").applyInPandas(pack, "item long, length long, bin long, at long, fill long")


def pack(found: DataFrame, capacity: int = CAPACITY, group: int = GROUP, late_opening: bool = False) -> DataFrame:
    """found: pieces. Adds sequence_id and offset."""
    # The numbers of written rows don't change when a task is run again.
    found = materialize(materialize(found, "pieces").withColumn("item", F.monotonically_increasing_id()), "items")
    whole = found.filter(F.col("length") == capacity).withColumn("sequence_id", -F.col("item") - 1).withColumn("offset", F.lit(0).cast("long"))
    open_pieces = found.filter(F.col("length") < capacity)
    n = open_pieces.count()
    n_groups = max(1, -(-n // group))
    packed = materialize(_pack_groups(open_pieces.select("item", "length"), n_groups, capacity, late_opening), "packed-0")
    place = packed.select("item", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    rounds, half = 0, capacity - 16
    while n_groups > 1:
        # Bins that another could still join are items of the next round; the others stay as they are.
        rounds += 1
        bins = packed.filter(F.col("fill") <= half).select(F.col("bin").alias("item"), F.col("fill").alias("length")).distinct()
        n_next = max(1, -(-bins.count() // group))
        if n_next >= n_groups:
            break
        n_groups = n_next
        packed = materialize(_pack_groups(bins, n_groups, capacity, late_opening), f"packed-{rounds}")
        moved = packed.select(F.col("item").alias("sequence_id"), (F.col("bin") + F.lit(rounds * 2**56)).alias("_to"), F.col("at").alias("_at"))
        place = place.join(moved, "sequence_id", "left").select("item", F.coalesce("_to", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("_at", F.lit(0))).alias("offset"))
        place = materialize(place, f"place-{rounds}")
        packed = packed.select((F.col("bin") + F.lit(rounds * 2**56)).alias("bin"), "fill")
    joined = open_pieces.join(place, "item")
    return whole.unionByName(joined).drop("item")


def packed_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    found = pieces(docs, path, capacity, end_id)
    return pack(found, capacity).withColumnRenamed("id", "doc_id")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the packed pieces of the documents that came so far, each row's own; cases as above."""
    return packed_documents(docs, tokenizer_path(VOCABULARY))
