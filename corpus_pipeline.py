"""A corpus from raw documents: quality rules, near-dedup, substring dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the
last return the columns of ``documents``. Every row is decided by itself: rows that share a doc_id, or
have none, don't share a fate.

Cases: null and empty texts fail the quality rules and go; of rows equal in doc_id and text near-dedup
keeps one; ties go to the smaller id; a null lang or source is one of its own; texts of any length go
through whole; an empty table gives empty results in all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderline.llm.common import one_of_each, stored, with_row_ids
from ladderline.llm.mixing import mix, mixed_documents
from ladderline.llm.near_dedup import near_duplicates
from ladderline.llm.packing import pack_documents
from ladderline.llm.quality import score_quality
from ladderline.llm.substring_dedup import passages, remove_passages


def _without(rows: DataFrame, gone: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The rows of (id, row) whose id isn't in ``gone``. Up to ``most`` ids are broadcast, so that texts
    stay where they are; beyond that both sides are shuffled."""
    gone = stored(gone.distinct(), "pipeline-gone")
    small = gone.limit(most + 1).count() <= most
    return rows.join(F.broadcast(gone) if small else gone, "id", "left_anti").select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    rows, row = with_row_ids(docs, ("lang",)), F.col("row")
    judged = score_quality(rows.select(F.col("id").alias("doc_id"), row["text"].alias("text"), row["lang"].alias("lang")))
    return _without(rows, judged.where(~F.col("kept")).select(F.col("doc_id").alias("id")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    rows = one_of_each(with_row_ids(docs))
    found = near_duplicates(rows.select(F.col("id").alias("doc_id"), F.col("row")["text"].alias("text")), percent=80)
    return _without(rows, found.where(~F.col("kept")).select(F.col("doc_id").alias("id")))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out."""
    return remove_passages(docs, passages(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs, mix(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a packed sequence."""
    packed = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Near-dedup, chaining and packing are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
