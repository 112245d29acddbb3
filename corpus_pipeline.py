"""The training-data pipeline: stages over the documents table, each written as Parquet and read again for the next.

Cases are those of the stages: null and blank texts go at the first; a null id passes all of them and stays null; of rows
that repeat an id and a text one stays; very long texts are judged, compared, searched and packed whole; other columns pass
through up to the last stage, which returns pieces; an empty table gives no pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkscreen.llm import minhash_dedup, mixing, packing, quality_rules, secret_scan
from sparkscreen.llm.common import materialize, table

#: (name, function of (spark, docs, sf_dir)). All but the last return the columns of documents.
STAGES = [
    ("quality_rules", quality_rules.stage),
    ("near_dedup", minhash_dedup.stage),
    ("secret_scan", secret_scan.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: SQL can't express near-duplicate classes or the packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
