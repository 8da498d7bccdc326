"""Pools of teams that meet, directly or through others: components of the who-met-whom graph.

Large-star and small-star rounds in turn (each hooks neighbours to the smallest one known). Every step
is an aggregate and a join over rows of two ids, so a team that meets a third of all others is a row
count, not a group held in memory; the number of rounds grows with the logarithm of the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderline.sources.shared import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are hooked to the smallest node that it knows, itself included."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are hooked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    rest = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.withColumnRenamed("m", "b")).distinct()


def components(edges: DataFrame, few: int = 100_000) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b): the smallest node that each can reach.
    Up to ``few`` edges are one partition."""
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
    nodes = stored(edges.where("a <> b").distinct(), "edges")
    lone = edges.where("a = b").select(F.col("a").alias("node"))
    now, before = nodes, None
    while True:
        small = now.limit(few + 1).count() <= few
        nxt = _small_star(stored(_large_star(now.coalesce(1) if small else now), "large-star"))
        now = stored(nxt.coalesce(1) if small else nxt, "small-star")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    hooked = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    found = hooked.unionByName(roots).unionByName(lone.select("node", F.col("node").alias("component")))
    return found.groupBy("node").agg(F.min("component").alias("component"))


def team_pools(matches: DataFrame) -> DataFrame:
    """(team_id, pool) for all teams of ``matches``; a pool is named by its smallest team."""
    met = matches.where("radiant_team_id is not null and dire_team_id is not null")
    found = components(met.select(F.col("radiant_team_id").alias("a"), F.col("dire_team_id").alias("b")).distinct())
    return found.select(F.col("node").alias("team_id"), F.col("component").alias("pool"))


def with_pools(matches: DataFrame, name: str = "pool") -> DataFrame:
    """``matches`` with the pool of its teams; contests that lack a team have none and go."""
    pools = stored(team_pools(matches), "pools").select(F.col("team_id").alias("radiant_team_id"), F.col("pool").alias(name))
    return matches.where("dire_team_id is not null").join(pools, "radiant_team_id")
