"""Point-in-time features: what was known of both sides strictly before a contest.

Order within a team is (start_time, match_id). All windows share one partitioning, so a plan that uses
several of them shuffles once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ladderline.functions import days_between

FORM_WINDOW = 5


def by_team():
    return W.partitionBy("team_id").orderBy("start_time", "match_id")


def before():
    """All of the team's contests before the row."""
    return by_team().rowsBetween(W.unboundedPreceding, -1)


def team_centric(matches: DataFrame, *carry: str) -> DataFrame:
    """Two rows per contest, one from each side; a single scan."""

    def side(own: str, other: str, radiant: bool) -> Column:
        won = F.col("radiant_win") if radiant else ~F.col("radiant_win")
        return F.struct(
            F.col(own).alias("team_id"), F.col(other).alias("opponent_id"), F.lit(radiant).alias("is_radiant"), won.alias("won")
        )

    sides = F.array(side("radiant_team_id", "dire_team_id", True), side("dire_team_id", "radiant_team_id", False))
    return matches.select("match_id", "start_time", *carry, F.inline(sides))


def won() -> Column:
    return F.col("won").cast("int").cast("double")


def recent_winrate(n: int = FORM_WINDOW) -> Column:
    """Mean of the last n or fewer results; null without any."""
    return F.avg(won()).over(by_team().rowsBetween(-n, -1))


def played_before() -> Column:
    return F.count(F.lit(1)).over(before())


def winrate_before() -> Column:
    return F.avg(won()).over(before())


def rest_days() -> Column:
    """Days since the team's contest before; null for its first."""
    return days_between(F.col("start_time"), F.lag("start_time").over(by_team()))


def ema_form(weight: float = 0.3) -> Column:
    """Exponential mean of results from 0.5 on, ``weight`` on the newest (over 0, under 1). The frame goes
    back to where a result weighs less than the last bit of a double, so it is bounded by the weight."""
    depth = math.ceil(-53 * math.log(2) / math.log(1 - weight))
    past = F.collect_list(won()).over(by_team().rowsBetween(-depth, -1))
    return F.aggregate(past, F.lit(0.5), lambda a, x: weight * x + (1 - weight) * a)


def form_features(matches: DataFrame, window: int = FORM_WINDOW) -> DataFrame:
    return team_centric(matches).select(
        "match_id",
        "start_time",
        "team_id",
        "opponent_id",
        "is_radiant",
        "won",
        recent_winrate(window).alias("recent_winrate"),
        rest_days().alias("days_since_last_match"),
        played_before().alias("matches_played_before"),
    )


def paired(long: DataFrame, *names: str) -> DataFrame:
    """One row per contest with radiant_x and dire_x of each name, from two rows."""
    aggs = [
        F.max(F.when(F.col("is_radiant") == side, F.col(n))).alias(f"{word}_{n}")
        for n in names
        for word, side in (("radiant", True), ("dire", False))
    ]
    return long.groupBy("match_id").agg(*aggs)


def head_to_head(matches: DataFrame, years: int | None = None) -> DataFrame:
    """Earlier meetings of the same two teams and the radiant side's share of wins in them; null, not
    a half, if they never met. ``years`` bounds how long ago, by calendar days."""
    low, high = F.least("radiant_team_id", "dire_team_id"), F.greatest("radiant_team_id", "dire_team_id")
    day = F.date_diff(F.col("start_time").cast("date"), F.lit("1970-01-01").cast("date"))
    rows = matches.select(
        "match_id", "start_time", "radiant_team_id", low.alias("low"), high.alias("high"), day.alias("day"),
        F.when(F.col("radiant_win"), F.col("radiant_team_id")).otherwise(F.col("dire_team_id")).alias("winner"),
    )
    pair = W.partitionBy("low", "high")
    if years is None:
        frame = pair.orderBy("start_time", "match_id").rowsBetween(W.unboundedPreceding, -1)
    else:
        frame = pair.orderBy("day").rangeBetween(-365 * years, -1)
    low_won = (F.col("winner") == F.col("low")).cast("int").cast("double")
    share = F.avg(low_won).over(frame)
    return rows.select(
        "match_id",
        F.count(F.lit(1)).over(frame).alias("meetings"),
        F.when(F.col("radiant_team_id") == F.col("low"), share).otherwise(1 - share).alias("radiant_share"),
    )


def by_version(matches: DataFrame) -> DataFrame:
    """Contests and win rate of a team before this one within the contest's version (``patch_id``);
    the rate falls back to the last ten results."""
    w = W.partitionBy("team_id", "patch_id").orderBy("start_time", "match_id").rowsBetween(W.unboundedPreceding, -1)
    long = team_centric(matches, "patch_id").withColumn("recent10", recent_winrate(10))
    return long.select(
        "match_id",
        "team_id",
        F.count(F.lit(1)).over(w).alias("patch_matches"),
        F.coalesce(F.avg(won()).over(w), "recent10").alias("patch_winrate"),
    )
