"""The contest tables, as views over the star schema that stands in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def contests(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    p = F.col("o_orderpriority")
    return o.select(
        key.alias("match_id"),
        F.col("o_orderdate").alias("start_time"),
        (cust % 25).alias("radiant_team_id"),
        ((cust % 25 + 1 + key % 24) % 25).alias("dire_team_id"),
        (F.col("o_totalprice") > 200000).alias("radiant_win"),
        F.when(p == "1-URGENT", "premium").when(p == "2-HIGH", "professional").otherwise("amateur").alias("league_tier"),
        p.alias("league_id"),
    )


def worlds(spark: SparkSession, d: str) -> DataFrame:
    """Contests within 125 worlds of eight teams that never meet another world's: a world for each nation
    and market segment of the customer."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    key, cust, s = F.col("o_orderkey"), F.col("o_custkey"), F.col("c_mktsegment")
    segment = F.when(s == "AUTOMOBILE", 0).when(s == "BUILDING", 1).when(s == "FURNITURE", 2).when(s == "HOUSEHOLD", 3).otherwise(4)
    world = (F.col("c_nationkey") * 5 + segment).cast("long")
    rows = o.join(c.select(F.col("c_custkey").alias("o_custkey"), world.alias("world")), "o_custkey")
    return rows.select(
        key.alias("match_id"), F.col("o_orderdate").alias("start_time"), (F.col("world") * 8 + cust % 8).alias("radiant_team_id"),
        (F.col("world") * 8 + (cust % 8 + 1 + key % 7) % 8).alias("dire_team_id"), (F.col("o_totalprice") > 200000).alias("radiant_win"),
    )


def pro_contests(spark: SparkSession, d: str) -> DataFrame:
    """Left join with the tiers and a filter on them, which Catalyst turns into an inner join."""
    m = contests(spark, d).drop("league_tier")
    leagues = contests(spark, d).select("league_id", "league_tier").distinct()
    both = m.join(leagues, "league_id", "left").where(F.col("league_tier").isin("premium", "professional"))
    return both.where("radiant_team_id is not null and dire_team_id is not null")


def versions(spark: SparkSession, d: str) -> DataFrame:
    q = F.date_trunc("quarter", "o_orderdate").cast("timestamp_ntz")
    r = table(spark, d, "orders").select(q.alias("released_at")).distinct()  # a row per quarter
    return r.withColumn("patch_id", F.row_number().over(W.orderBy("released_at")))


def versioned(spark: SparkSession, d: str) -> DataFrame:
    from ladderline.operators.asof import version_of

    return version_of(contests(spark, d), versions(spark, d))


def children(spark: SparkSession, d: str) -> DataFrame:
    """Line items in a fixed order within their contest: ``rn`` from 1."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    return table(spark, d, "lineitem").withColumn("rn", F.row_number().over(w))


def players(spark: SparkSession, d: str) -> DataFrame:
    """Player rows: odd ``rn`` radiant, even dire."""
    c = children(spark, d).select(F.col("l_orderkey").alias("match_id"), (F.col("rn") % 2 == 1).alias("is_radiant"), "rn", F.col("l_suppkey").alias("account_id"), F.col("l_quantity").alias("kills"))
    m = contests(spark, d).select("match_id", "start_time", "radiant_team_id", "dire_team_id", "radiant_win")
    team = F.when(F.col("is_radiant"), F.col("radiant_team_id")).otherwise(F.col("dire_team_id"))
    return c.join(m, "match_id").select("match_id", "start_time", team.alias("team_id"), "is_radiant", "rn", "account_id", "kills")


def picks(spark: SparkSession, d: str) -> DataFrame:
    c = children(spark, d).select(F.col("l_orderkey").alias("match_id"), F.col("rn").alias("ord"), F.col("l_partkey").alias("hero_id"), (F.col("l_returnflag") != "R").alias("is_pick"), (F.col("rn") % 2).alias("side"))
    m = versioned(spark, d).select("match_id", "start_time", "patch_id", "radiant_team_id", "dire_team_id", "radiant_win")
    rad = F.col("side") == 1
    return c.join(m, "match_id").select(
        "match_id", "start_time", "patch_id", F.when(rad, F.col("radiant_team_id")).otherwise(F.col("dire_team_id")).alias("team_id"),
        "ord", "hero_id", "is_pick", F.when(rad, F.col("radiant_win")).otherwise(~F.col("radiant_win")).alias("won"),
    )


def forecasts(spark: SparkSession, d: str) -> DataFrame:
    """A deterministic stand-in for a model's forecasts: (match_id, start_time, league_tier, p, won)."""
    m = contests(spark, d)
    p = 0.5 + (F.col("radiant_team_id") - F.col("dire_team_id")) / 60
    return m.select("match_id", "start_time", "league_tier", p.alias("p"), F.col("radiant_win").alias("won"))


def raw_records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.lit("feed").alias("source"), F.col("event_type").alias("endpoint"), F.sha2("props", 256).alias("content_hash"),
        F.col("props").alias("body"), F.col("ts").alias("fetched_at"), F.col("event_id").alias("position"),
    )
