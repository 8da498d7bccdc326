"""Ratings kept in a store and mended from the earliest change on.

The store holds the rated contests by month and, as states, the last rating of each team in each month
that it played in; a team's rating before a month is its newest state. A late contest, or one that
changed, changes nothing before its month and nothing in pools whose teams don't meet it: only those
pools are walked again, from the month's states on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderline.operators.elo import BASE, K_FACTOR, rated
from ladderline.operators.pools import team_pools
from ladderline.sources.shared import stored
from ladderline.sources.store import Store

CONTEST = ["match_id", "start_time", "radiant_team_id", "dire_team_id", "radiant_win"]


def _month(time: str = "start_time"):
    return F.date_format(time, "yyyy-MM")


def states_before(store: Store, month: str) -> DataFrame:
    """(team_id, rating) of every team that played before ``month``; later states aren't read."""
    rows = store.read_parts("rating_states", [p for p in store.parts("rating_states") if p < month])
    return rows.groupBy("team_id").agg(F.max_by("rating", "month").alias("rating"))


def _last_of_month(walked: DataFrame) -> DataFrame:
    sides = F.array(*[F.struct(F.col(f"{s}_team_id").alias("team_id"), F.col(f"{s}_post").alias("rating"), F.lit(i).alias("side")) for i, s in enumerate(("radiant", "dire"))])
    each = walked.select("match_id", "start_time", _month().alias("month"), F.inline(sides))
    return each.groupBy("month", "team_id").agg(F.max_by("rating", F.struct("start_time", "match_id", "side")).alias("rating"))


def update(store: Store, contests: DataFrame, k: float = K_FACTOR, base: float = BASE) -> int:
    """Brings the store's ratings to those of ``contests`` (all there are now); gives how many were walked.

    The states are written first: if the run dies between the two tables, the next one finds the same
    changes and begins from states that are older than them.
    """
    ready = contests.where("radiant_win is not null and radiant_team_id is not null and dire_team_id is not null")
    new = ready.select(*[F.col(c).cast("long") if c.endswith("_id") else F.col(c) for c in CONTEST]).withColumn("start_time", F.col("start_time").cast("timestamp_ntz"))
    old = store.read("contest_ratings")
    changed = stored(new.join(old, CONTEST, "left_anti").unionByName(old.select(*CONTEST).join(new, CONTEST, "left_anti")), "changed-contests")
    first = changed.agg(F.min(_month())).first()[0]
    if first is None:
        return 0
    pools = stored(team_pools(new.select("radiant_team_id", "dire_team_id").unionByName(changed.select("radiant_team_id", "dire_team_id"))), "pools")
    hit = changed.select(F.col("radiant_team_id").alias("team_id")).unionByName(changed.select(F.col("dire_team_id").alias("team_id"))).distinct()
    touched = pools.join(hit, "team_id").select("pool").distinct()
    teams = stored(pools.join(touched, "pool"), "touched-teams")
    of = teams.withColumnRenamed("team_id", "radiant_team_id")
    suffix = new.where(_month() >= first).join(of, "radiant_team_id")
    walked = stored(rated(suffix, k, base, "pool", states_before(store, first).join(teams, "team_id")), "walked")

    def put(table: str, rows: DataFrame, team: str, months: list[str]) -> None:
        later = [p for p in store.parts(table) if p >= first]
        kept = store.read_parts(table, later).join(teams.select(F.col("team_id").alias(team)), team, "left_anti")
        store.replace(table, rows.unionByName(kept.select(*rows.columns)), [*later, *months])

    states = stored(_last_of_month(walked), "states")
    months = [r[0] for r in states.select("month").distinct().collect()]  # calendar months
    put("rating_states", states, "team_id", months)
    put("contest_ratings", walked, "radiant_team_id", months)
    return walked.count()
