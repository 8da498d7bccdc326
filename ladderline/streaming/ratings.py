"""Ratings of a stream of contests that may come late, resumed where the last run ended.

State, a snapshot per batch: the ratings of each pool's teams up to the watermark, and the contests that
are still open, those that came in since and could yet be preceded by a late one. Every batch is put
together with the open contests, sorted by Spark and folded on top of the closed ratings, so no task
holds a pool's contests. What the batch's own watermark has passed is closed for good, for every
later batch drops what is older; the rest is rated provisionally, so a late contest changes what follows
it. One that is later still is landed all the same, :func:`missed` names it, and
:func:`ladderline.plans.ratings.update` over the landed contests rates it. A contest without a time has
no place in the order and is landed only.

The checkpoint, the landed contests, the snapshots and the output lie under a fixed root; every batch is
a folder of its own that a repeated batch writes again from the snapshot before it, and the last word on
a contest counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderline.operators.elo import BASE, K_FACTOR, RATED, rated

OUT = RATED.replace("timestamp_ntz", "timestamp") + ", closed boolean"
OPEN = "match_id long, start_time timestamp, radiant_team_id long, dire_team_id long, radiant_win boolean"
SNAPSHOT = "team_id long, rating double, pool long"


def _batches(spark: SparkSession, root: str, name: str) -> list[int]:
    """Numbers of the batches of a table that were written to their end."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/batch=*/_SUCCESS")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(int(s.getPath().getParent().getName()[6:]) for s in found or [])


def _rate_batch(spark: SparkSession, root: str, number: int, lateness: str, k: float, base: float) -> None:
    """Batch ``number`` of the landed contests on top of the last snapshot: its words and its snapshot."""
    before = [n for n in _batches(spark, root, "marks") if n < number][-1:]

    def last(name: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{root}/{name}/batch={before[0]}") if before else spark.createDataFrame([], schema)

    def put(rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
        return spark.read.schema(rows.schema).parquet(f"{root}/{name}/batch={number}")

    landed = spark.read.schema(f"{OPEN}, pool long").parquet(f"{root}/contests/batch={number}").where("start_time is not null")
    passed = last("marks", "mark timestamp").agg(F.max("mark").alias("mark"))  # a row, null at first
    newest = landed.agg((F.max("start_time") - F.expr(f"interval {lateness}")).alias("newest"))
    mark = put(newest.crossJoin(passed).select(F.greatest("newest", "mark").alias("mark")), "marks-ahead")
    fresh = landed.crossJoin(F.broadcast(passed)).where("mark is null or start_time > mark").drop("mark")
    kept = [c.split()[0] for c in OPEN.split(", ")] + ["pool"]
    known = fresh.withColumn("now", F.lit(1)).unionByName(last("open", f"{OPEN}, pool long").withColumn("now", F.lit(0)))
    known = known.groupBy("match_id").agg(F.max_by(F.struct(*kept[1:]), "now").alias("r")).select("match_id", "r.*")  # told again: the last word counts
    began = last("ratings", SNAPSHOT)
    walked = rated(known, k, base, "pool", began, named=True).withColumn("start_time", F.col("start_time").cast("timestamp"))
    closed = F.coalesce(F.col("start_time") < F.col("mark"), F.lit(False)).alias("closed")
    words = put(walked.crossJoin(F.broadcast(mark)).select(*[c.split()[0] for c in RATED.split(", ")], closed, F.col("pool_").alias("pool")), "told")
    put(words.where("not closed").select(*kept), "open")
    sides = F.array(*[F.struct(F.col(f"{s}_team_id").alias("team_id"), F.col(f"{s}_post").alias("rating"), F.lit(i).alias("side")) for i, s in enumerate(("radiant", "dire"))])
    ended = words.where("closed").select("pool", "start_time", "match_id", F.inline(sides))
    new = ended.groupBy("pool", "team_id").agg(F.max_by("rating", F.struct("start_time", "match_id", "side")).alias("rating")).select("team_id", "rating", "pool")
    put(new.unionByName(began.join(new, ["pool", "team_id"], "left_anti").select("team_id", "rating", "pool")), "ratings")
    put(mark, "marks")  # the last: a batch that has it is done


def rate_stream(contests: DataFrame, root: str, lateness: str = "30 days", pool: str | None = None, k: float = K_FACTOR, base: float = BASE) -> None:
    """Drains what a stream of contests has since the last run under ``root``, and stops. A contest may
    come ``lateness`` behind the latest one; ``pool`` is the column of independent pools."""
    spark = contests.sparkSession
    rows = contests.where("radiant_win is not null and radiant_team_id is not null and dire_team_id is not null").select(
        F.col("match_id").cast("long"), F.col("start_time").cast("timestamp"), F.col("radiant_team_id").cast("long"), F.col("dire_team_id").cast("long"),
        "radiant_win", (F.col(pool).cast("long") if pool else F.lit(0).cast("long")).alias("pool"),
    )

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/contests/batch={number}")
        _rate_batch(spark, root, number, lateness, k, base)

    rows.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def contests(spark: SparkSession, root: str) -> DataFrame:
    """All contests that the stream has had, as it had them last."""
    rows = spark.read.schema(f"{OPEN}, pool long, batch long").parquet(f"{root}/contests")
    kept = [c for c in rows.columns if c not in ("match_id", "batch")]
    last = rows.groupBy("match_id").agg(F.max_by(F.struct(*kept), "batch").alias("r")).select("match_id", "r.*")
    return last.withColumn("start_time", F.col("start_time").cast("timestamp_ntz"))


def told(spark: SparkSession, root: str) -> DataFrame:
    """The last word on each contest that was rated, and whether it is closed."""
    rows = spark.read.schema(f"{OUT}, batch long").parquet(f"{root}/told")
    kept = [c for c in rows.columns if c not in ("match_id", "batch")]
    last = rows.groupBy("match_id").agg(F.max_by(F.struct(*kept), F.struct("closed", "batch")).alias("r")).select("match_id", "r.*")
    return last.withColumn("start_time", F.col("start_time").cast("timestamp_ntz"))


def ratings(spark: SparkSession, root: str) -> DataFrame:
    """The rated contests, as :func:`ladderline.operators.elo.rated` gives them."""
    return told(spark, root).drop("closed")


def missed(spark: SparkSession, root: str) -> DataFrame:
    """Contests that came too late for the state; a store's ratings take them up."""
    return contests(spark, root).join(told(spark, root).select("match_id"), "match_id", "left_anti")
