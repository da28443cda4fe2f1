"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, mixing, packed token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet into the shared
folder and rereads it as the next stage's documents, so a lost executor or a failed stage costs a rerun from
the last table. All but the last return the columns of documents.

Null, empty and very short texts go at the first stage. Null ids, sources and other columns are carried along.
Repeated rows and exact copies are near-duplicates of which one stays: that with the least id, and of equal ids
that with the least hash of its other columns. The mix then repeats whole rows. An empty table, or one of which nothing is kept, gives no rows at every later stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, mixing, neardup, packing, quality
from .common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.unique(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("token ids", token_ids),
]

#: The mined, sampled and tokenised stages have no SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
