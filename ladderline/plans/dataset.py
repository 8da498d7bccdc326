"""Feature set 0: one row per professional contest with all that was known of both sides before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderline.operators.elo import rated
from ladderline.operators.teams import FORM_WINDOW, paired, team_centric
from ladderline.plans.features import team_features

VERSION = "v0_baseline"
CONFIG = {"rating_engine": "elo_k32_base1000", "recent_form_window": FORM_WINDOW}
#: The dataset's columns, in order.
COLUMNS = [
    "match_id", "as_of_timestamp", "radiant_team_id", "dire_team_id", "radiant_elo", "dire_elo", "elo_difference",
    "radiant_recent_winrate", "dire_recent_winrate", "recent_winrate_difference", "radiant_days_since_last_match",
    "dire_days_since_last_match", "radiant_matches_played_before", "dire_matches_played_before", "radiant_win",
]


def feature_set_0(matches: DataFrame, k: float = 32.0, base: float = 1000.0, window: int = FORM_WINDOW) -> DataFrame:
    names = ("recent_winrate", "days_since_last_match", "matches_played_before")
    form = paired(team_features(window).computed(team_centric(matches), names), *names)
    rows = rated(matches, k, base).join(form, "match_id")
    rows = rows.withColumns(
        {
            "as_of_timestamp": F.col("start_time"),
            "radiant_elo": F.col("radiant_pre"),
            "dire_elo": F.col("dire_pre"),
            "elo_difference": F.col("radiant_pre") - F.col("dire_pre"),
            "recent_winrate_difference": F.col("radiant_recent_winrate") - F.col("dire_recent_winrate"),
        }
    )
    return rows.select(*COLUMNS)


def bounded(matches: DataFrame, first=None, last=None) -> DataFrame:
    """Optional date bounds, both inclusive."""
    if first is not None:
        matches = matches.where(F.col("start_time") >= F.lit(first))
    return matches if last is None else matches.where(F.col("start_time") <= F.lit(last))


def long_features(dataset: DataFrame, version: str = VERSION) -> DataFrame:
    """Two rows per contest; the dire side's differences are negated, null staying null."""

    def side(word: str, radiant: bool):
        sign = 1 if radiant else -1
        f = F.struct(
            F.col(f"{word}_elo").alias("elo"),
            (sign * F.col("elo_difference")).alias("elo_difference"),
            F.col(f"{word}_recent_winrate").alias("recent_winrate"),
            (sign * F.col("recent_winrate_difference")).alias("recent_winrate_difference"),
            F.col(f"{word}_days_since_last_match").alias("days_since_last_match"),
            F.col(f"{word}_matches_played_before").alias("matches_played_before"),
            F.lit(radiant).alias("is_radiant"),
        )
        return F.struct(F.col(f"{word}_team_id").alias("team_id"), F.to_json(f, {"ignoreNullFields": "false"}).alias("features"))

    both = F.array(side("radiant", True), side("dire", False))
    return dataset.select("match_id", F.inline(both), F.lit(version).alias("feature_set_version"), F.col("as_of_timestamp").alias("as_of"))


def time_split(start_time, validation, test):
    """train before validation, validation before test, test from there on."""
    return F.when(start_time < F.lit(validation), "train").when(start_time < F.lit(test), "validation").otherwise("test")
