"""A corpus from documents: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents.

Odd rows, by stage. Null and empty texts fail the quality rules, as do texts of fewer than 50 words. Very
long texts go through whole. Null doc_ids: kept by the quality rules; near-dedup keeps the smallest
doc_id of a group, one row without an id if the group has no other; the rest treat them as ids of
their own. Repeated rows are one document for near-dedup. A null source is a source of its own, the
last, for mixing. An empty table passes through as one. Other columns are kept up to sharding, which
returns doc_id, arrival, text_sha256 and merges_due.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import decontam, mixing, neardup, quality, sharding
from tidemill.llm.shared import kept, remove, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the compacted shards: doc_id, arrival, text_sha256, merges_due."""
    return sharding.shard_report(docs)


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix_sources), ("sharding", shard)]

#: SQL can't express suffix arrays, similarity joins or files: the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in sf_dir."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    out = kept(STAGES[-1][1](spark, docs, sf_dir))
    remove(spark, last)
    return out
