"""As-of and interval joins on half-open validity periods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_periods(rows: DataFrame, start: str, *keys: str) -> DataFrame:
    """Adds ``valid_from`` and ``valid_to``: each row holds from ``start`` until the next of its key.
    Without keys all rows are one sequence (a small reference table)."""
    w = W.partitionBy(*(keys or [F.lit(0)])).orderBy(start)
    return rows.withColumn("valid_from", F.col(start)).withColumn("valid_to", F.lead(start).over(w))


def holds(at, start="valid_from", end="valid_to"):
    at, start, end = (F.col(x) if isinstance(x, str) else x for x in (at, start, end))
    return (start <= at) & (end.isNull() | (end > at))


def version_of(matches: DataFrame, versions: DataFrame, most: int = 100_000) -> DataFrame:
    """Left as-of join with a calendar (patch_id, released_at): the latest released at or before the
    start, else null.

    It is an equi-join on days: each period is listed under every day it touches (an open one until the
    last contest's), a contest has one day. The list is broadcast if it has at most ``most`` rows.
    """
    periods = as_periods(versions.select("patch_id", "released_at"), "released_at").select("patch_id", "valid_from", "valid_to")
    last = matches.agg(F.max(F.to_date("start_time"))).first()[0]
    upto = F.coalesce(F.to_date("valid_to"), F.greatest(F.to_date("valid_from"), F.lit(last).cast("date")))
    listed = periods.withColumn("day_", F.explode(F.sequence(F.to_date("valid_from"), upto)))
    if listed.limit(most + 1).count() <= most:
        listed = F.broadcast(listed)
    rows = matches.withColumn("day_", F.to_date("start_time"))
    joined = rows.join(listed, (rows["day_"] == listed["day_"]) & holds("start_time"), "left").drop("day_", "valid_to")
    return joined.withColumnRenamed("valid_from", "released_at")


def last_before(left: DataFrame, right: DataFrame, key: str, at: str, time: str, *values: str) -> DataFrame:
    """For each left row the values of the last right row of its key strictly before ``at``.

    Both sides are merged into one ordered sequence per key, so it is a sort and a window however many
    rows match; rows at the same time come after the left row.
    """
    packed = F.struct(*[F.col(v) for v in values])
    a = left.withColumns({"t_": F.col(at), "left_": F.lit(True), "row_": F.struct(*left.columns), "v_": F.lit(None).cast(right.select(packed).schema[0].dataType)})
    b = right.select(key, F.col(time).alias("t_"), F.lit(False).alias("left_"), packed.alias("v_"))
    both = a.select(key, "t_", "left_", "row_", "v_").unionByName(b.withColumn("row_", F.lit(None).cast(a.schema["row_"].dataType)))
    w = W.partitionBy(key).orderBy("t_", F.desc("left_")).rowsBetween(W.unboundedPreceding, -1)
    seen = both.withColumn("seen_", F.last("v_", ignorenulls=True).over(w)).where("left_")
    return seen.select("row_.*", *[F.col(f"seen_.{v}").alias(v) for v in values])
