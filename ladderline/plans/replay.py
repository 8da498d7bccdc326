"""The state of all teams as of a time, by what was known then: two times, not one.

``before`` bounds what had happened, ``known_at`` what had been loaded. A contest that was played before
a forecast but landed after it is in the one and not in the other.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderline.operators import rosters
from ladderline.plans.serving import standing
from ladderline.sources.store import Store


def replayed(matches: DataFrame, players: DataFrame, before: str) -> DataFrame:
    """team_id, elo, recent_winrate, matches_played_before, last_match, lineup (accounts of its last contest
    that has any), for the teams that played before ``before``; nothing later is looked at."""
    past = players.where(F.col("start_time") < F.lit(before).cast("timestamp_ntz"))
    sides = rosters.lineups(past).where(F.size("lineup") > 0)
    last = sides.groupBy("team_id").agg(F.max_by("lineup", F.struct("start_time", "match_id")).alias("lineup"))
    return standing(matches, before).join(last, "team_id", "left")


def as_known(store: Store, before: str, known_at: datetime | None = None) -> DataFrame:
    """:func:`replayed` over the store's tables as they were at ``known_at``."""
    matches = store.read("matches", known_at).withColumn("start_time", F.col("start_time").cast("timestamp_ntz"))
    players = store.read("match_players", known_at).join(matches.select("match_id", "start_time"), "match_id")
    return replayed(matches, players, before)
