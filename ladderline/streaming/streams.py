"""The incremental forms of the batch operators, as file streams that drain what is there and stop.

A stream keeps its state, its checkpoint and its output under one root; called again with the same root
it goes on where it ended. Batch results are the truth: each stream must give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderline.operators import records
from ladderline.sources.shared import scratch
from ladderline.streaming import ratings


def _read(spark: SparkSession, path: str) -> DataFrame:
    folder, _, name = path.rpartition("/")
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if not name.endswith(".parquet") else f"{folder}/{name}*")


def _drained(rows: DataFrame, root: str, each=None) -> None:
    w = rows.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    w = w.foreachBatch(each) if each else w.format("parquet").option("path", f"{root}/out")
    w.start().awaitTermination()


def deduplicated(spark: SparkSession, path: str, root: str | None = None, delay: str | None = None) -> DataFrame:
    """Raw records, each (source, endpoint, content_hash) once. With ``delay`` a record is remembered only
    until the watermark is that far behind it: state stays bounded, a later repeat comes through."""
    root, key = root or scratch(spark, "stream"), ["source", "endpoint", "content_hash"]
    rows = _read(spark, path).select(F.lit("feed").alias("source"), F.col("event_type").alias("endpoint"), F.sha2("props", 256).alias("content_hash"), F.col("ts").cast("timestamp").alias("ts"))
    once = rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key) if delay else rows.dropDuplicates(key)
    _drained(once.select(*key), root)
    return spark.read.parquet(f"{root}/out")


def _snapshots(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the snapshots that were written to their end."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/table-*/_SUCCESS")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(int(s.getPath().getParent().getName()[6:]) for s in found or [])


def merged_stream(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """Keyed upserts by micro-batch: last row wins, the first time a key is seen stays. A snapshot is a new
    folder, numbered as its batch; a batch that is done again begins from the snapshot before it."""
    root = root or scratch(spark, "stream")

    def upsert(batch: DataFrame, number: int) -> None:
        rows = batch.select("user_id", "event_type", "value", F.col("ts").alias("first_seen"), "event_id")
        new = records.collapsed(rows, ["user_id"], F.col("event_id"), keep_first=["first_seen"]).drop("event_id")
        before = [n for n in _snapshots(spark, root) if n < number]
        old = batch.sparkSession.read.parquet(f"{root}/table-{before[-1]}") if before else new.limit(0)
        records.merged(old, new, ["user_id"], keep_first=["first_seen"]).write.mode("overwrite").parquet(f"{root}/table-{number}")

    _drained(_read(spark, path), root, upsert)
    return spark.read.parquet(f"{root}/table-{_snapshots(spark, root)[-1]}")


def rated_stream(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """Ratings of all contests so far, by :func:`ladderline.streaming.ratings.rate_stream`."""
    root = root or scratch(spark, "stream")
    contests = _read(spark, path).select(
        F.col("o_orderkey").alias("match_id"), F.col("o_orderdate").alias("start_time"), (F.col("o_custkey") % 25).alias("radiant_team_id"),
        ((F.col("o_custkey") % 25 + 1 + F.col("o_orderkey") % 24) % 25).alias("dire_team_id"), (F.col("o_totalprice") > 200000).alias("radiant_win"),
    )
    ratings.rate_stream(contests, root)
    return ratings.ratings(spark, root)
