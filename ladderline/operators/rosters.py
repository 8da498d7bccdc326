"""Lineups, roster periods and draft history.

Children are (match_id, start_time, team_id, account_id) or hero rows. A lineup is the sorted array of
distinct accounts of a side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_team():
    return W.partitionBy("team_id").orderBy("start_time", "match_id")


def lineups(players: DataFrame) -> DataFrame:
    """One row per side: its lineup and how many of its accounts are unknown."""
    return players.groupBy("match_id", "start_time", "team_id").agg(
        F.sort_array(F.collect_set("account_id")).alias("lineup"), F.count_if(F.col("account_id").isNull()).alias("unknown")
    )


def roster_tenure(sides: DataFrame, within: int = 30) -> DataFrame:
    """Contests before this one by the same lineup of the team, days since the lineup last changed, and
    whether that is at most ``within`` days ago. A team's first lineup counts as a change."""
    same = W.partitionBy("team_id", "lineup").orderBy("start_time", "match_id").rowsBetween(W.unboundedPreceding, -1)
    changed = F.coalesce(F.lag("lineup").over(by_team()) != F.col("lineup"), F.lit(True))
    rows = sides.withColumn("changed_at", F.when(changed, F.col("start_time")))
    since = F.last("changed_at", ignorenulls=True).over(by_team())
    days = F.date_diff(F.col("start_time").cast("date"), since.cast("date"))
    return rows.select(
        "match_id", "team_id",
        F.count(F.lit(1)).over(same).alias("roster_matches"), days.alias("days_since_change"), (days <= within).alias("changed_recently"),
    )


def stand_ins(sides: DataFrame, recent: int = 5) -> DataFrame:
    """Accounts of a side that none of the team's ``recent`` contests before had; null without any."""
    past = F.array_distinct(F.flatten(F.collect_list("lineup").over(by_team().rowsBetween(-recent, -1))))
    before = F.count(F.lit(1)).over(by_team().rowsBetween(-recent, -1))
    n = F.when(before > 0, F.size(F.array_except("lineup", past)))
    return sides.select("match_id", "team_id", n.alias("stand_ins"), (n > 0).alias("has_stand_in"))


def majority_stand_ins(sides: DataFrame, recent: int = 10) -> DataFrame:
    """Accounts of a side outside the team's majority lineup, which are those that played more than half of
    its ``recent`` contests before; null without any. One recent contest doesn't make a member."""
    frame = by_team().rowsBetween(-recent, -1)
    rows = sides.withColumns({"past_": F.flatten(F.collect_list("lineup").over(frame)), "n_": F.count(F.lit(1)).over(frame)})
    seldom = lambda x: 2 * F.size(F.filter("past_", lambda y: y == x)) <= F.col("n_")
    n = F.when(F.col("n_") > 0, F.size(F.filter("lineup", seldom)))
    return rows.select("match_id", "team_id", n.alias("stand_ins"), (n > 0).alias("has_stand_in"))


def roster_periods(players: DataFrame, absent: int = 3) -> DataFrame:
    """Membership rebuilt from played lineups: (team_id, account_id, valid_from, valid_to, matches).

    An account stays a member over gaps of up to ``absent`` of its team's contests (stand-ins don't
    close a period); a longer gap closes it at the member's last contest before. The last period is open
    if the account played in the team's last ``absent`` contests.
    """
    team = players.select("match_id", "start_time", "team_id").distinct()
    team = team.withColumn("no", F.row_number().over(by_team()))
    team = team.withColumn("last_no", F.max("no").over(W.partitionBy("team_id")))
    rows = players.where("account_id is not null").select("match_id", "team_id", "account_id").distinct()
    rows = rows.join(team, ["match_id", "team_id"])
    w = W.partitionBy("team_id", "account_id").orderBy("no")
    rows = rows.withColumn("opens", (F.coalesce(F.col("no") - F.lag("no").over(w), F.lit(absent + 2)) > absent + 1).cast("int"))
    rows = rows.withColumn("period", F.sum("opens").over(w))
    grouped = rows.groupBy("team_id", "account_id", "period").agg(
        F.min("start_time").alias("valid_from"), F.max("start_time").alias("last_seen"),
        F.count("*").alias("matches"), F.max("no").alias("n"), F.first("last_no").alias("last_no"),
    )
    ended = F.when(F.col("n") + absent < F.col("last_no"), F.col("last_seen"))
    return grouped.select("team_id", "account_id", "valid_from", ended.alias("valid_to"), "matches")


def overlaps(periods: DataFrame) -> DataFrame:
    """Periods of an account in a team that begin before an earlier one has ended."""
    w = W.partitionBy("team_id", "account_id").orderBy("valid_from", F.col("valid_to").asc_nulls_last())
    before = F.lag(F.coalesce("valid_to", F.lit("9999-12-31").cast("timestamp_ntz"))).over(w)
    return periods.withColumn("before_", before).where("before_ > valid_from").drop("before_")


#: How far a period is trusted by what tells of it.
CONFIDENCE = {"both": 1.0, "events": 0.8, "lineups": 0.6}


def _event_periods(events: DataFrame) -> DataFrame:
    """(team_id, account_id, valid_from, valid_to) between joining and leaving. Told twice counts once; who
    leaves without having joined has no period."""
    w = W.partitionBy("team_id", "account_id").orderBy("changed_at", "change_type")
    turns = events.where(F.col("change_type").isin("joined", "left")).withColumn("last_", F.lag("change_type").over(w))
    turns = turns.where("last_ is null or last_ <> change_type").withColumn("valid_to", F.lead("changed_at").over(w))
    return turns.where("change_type = 'joined'").select("team_id", "account_id", F.col("changed_at").alias("valid_from"), "valid_to")


def merged_periods(events: DataFrame, observed: DataFrame) -> DataFrame:
    """Membership told by roster ``events`` (team_id, account_id, changed_at, change_type) and seen in played
    lineups (:func:`roster_periods`): team_id, account_id, valid_from, valid_to (null: open), source (both,
    events or lineups), confidence. Periods of an account in a team don't overlap.

    A sweep: both kinds begin and end at points; between two of an account's points in order, running sums
    say which kinds hold. Neighbours that say the same are one period. One partitioning, no range join.
    """
    open_ = F.lit("9999-12-31").cast("timestamp_ntz")

    def points(periods: DataFrame, kind: str) -> DataFrame:
        # a contest alone is a period without length: it holds for the microsecond it is seen at
        end = F.greatest(F.coalesce("valid_to", open_), F.col("valid_from") + F.expr(f"interval {int(kind == 'seen')} microsecond"))
        ends = F.array(F.struct(F.col("valid_from").alias("at"), F.lit(1).alias("step")), F.struct(end.alias("at"), F.lit(-1).alias("step")))
        steps = [(F.col("step") if k == kind else F.lit(0)).alias(k) for k in ("told", "seen")]
        return periods.select("team_id", "account_id", F.inline(ends)).select("team_id", "account_id", "at", *steps)

    both = points(_event_periods(events), "told").unionByName(points(observed.select("team_id", "account_id", "valid_from", "valid_to"), "seen"))
    both = both.groupBy("team_id", "account_id", "at").agg(F.sum("told").alias("told"), F.sum("seen").alias("seen"))
    w = W.partitionBy("team_id", "account_id").orderBy("at")
    held = both.select("team_id", "account_id", "at", F.lead("at").over(w).alias("until"), (F.sum("told").over(w) > 0).alias("told"), (F.sum("seen").over(w) > 0).alias("seen"))
    held = held.where("until is not null").withColumn("source", F.when(F.col("told") & F.col("seen"), "both").when(F.col("told"), "events").when(F.col("seen"), "lineups"))
    held = held.withColumn("fresh", F.coalesce(~F.col("source").eqNullSafe(F.lag("source").over(w)), F.lit(True)).cast("int"))
    runs = held.withColumn("run", F.sum("fresh").over(w)).where("source is not null")
    out = runs.groupBy("team_id", "account_id", "run").agg(F.min("at").alias("valid_from"), F.max("until").alias("until"), F.first("source").alias("source"))
    trust = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    return out.select("team_id", "account_id", "valid_from", F.nullif("until", open_).alias("valid_to"), "source", trust[F.col("source")].alias("confidence"))


def roster_contradictions(events: DataFrame, players: DataFrame) -> DataFrame:
    """team_id, account_id, at, problem: contests played after leaving (a stand-in may), and accounts that
    leave what they haven't joined."""
    w = W.partitionBy("team_id", "account_id").orderBy("changed_at", "change_type")
    turns = events.where(F.col("change_type").isin("joined", "left"))
    lost = turns.withColumn("last_", F.lag("change_type").over(w)).where("last_ is null and change_type = 'left'")
    lost = lost.select("team_id", "account_id", F.col("changed_at").alias("at"), F.lit("left without having joined").alias("problem"))
    told = events.select("team_id", "account_id", F.col("changed_at").alias("at"), F.col("change_type").alias("last_"), F.lit(0).alias("played"))
    seen = players.where("account_id is not null").select("team_id", "account_id", F.col("start_time").alias("at"), F.lit(None).cast("string").alias("last_"), F.lit(1).alias("played")).distinct()
    line = W.partitionBy("team_id", "account_id").orderBy("at", "played").rowsBetween(W.unboundedPreceding, 0)
    both = told.unionByName(seen).withColumn("state", F.last("last_", ignorenulls=True).over(line)).where("played = 1 and state = 'left'")
    return lost.unionByName(both.select("team_id", "account_id", "at", F.lit("played after leaving").alias("problem")))


def roster_at(periods: DataFrame, at: Column) -> DataFrame:
    """Members at a time: valid_from <= at < valid_to, or open."""
    return periods.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def shared_lineups(sides: DataFrame, share: float = 0.8) -> DataFrame:
    """Adjacent contests of different teams whose lineups overlap by more than ``share``: candidates for
    one organisation under two ids, never merged. Equi-joined on accounts: each account's contests in
    order give adjacent pairs, so no account's contests are paired with all others."""
    each = sides.select("match_id", "start_time", "team_id", F.size("lineup").alias("n"), F.explode("lineup").alias("account_id"))
    w = W.partitionBy("account_id").orderBy("start_time", "match_id", "team_id")
    pairs = each.select(
        "team_id", "match_id", "n", F.lag("team_id").over(w).alias("from_team"), F.lag("match_id").over(w).alias("from_match")
    ).where("from_team <> team_id and from_match <> match_id")
    met = pairs.groupBy("from_team", "from_match", "team_id", "match_id").agg(F.count("*").alias("shared"), F.first("n").alias("n"))
    return met.where(F.col("shared") > share * F.col("n")).select("from_team", "from_match", "team_id", "match_id", "shared")


def player_experience(players: DataFrame) -> DataFrame:
    """Mean contests that a side's known accounts played before; null if all are unknown. An account that
    is listed twice in a contest played it once."""
    w = W.partitionBy("account_id").orderBy("start_time", "match_id").rowsBetween(W.unboundedPreceding, -1)
    known = players.where("account_id is not null").select("match_id", "start_time", "team_id", "account_id").distinct()
    career = known.select("match_id", "start_time", "account_id").distinct().withColumn("career", F.count(F.lit(1)).over(w))
    n = known.join(career.drop("start_time"), ["match_id", "account_id"])
    mean = n.groupBy("match_id", "team_id").agg(F.avg("career").alias("mean_career"))
    return players.select("match_id", "team_id").distinct().join(mean, ["match_id", "team_id"], "left")


def individual_form(players: DataFrame, metric: str, recent: int = 10) -> DataFrame:
    """Mean over a side's known accounts of how they did in their ``recent`` contests before, each as
    ``metric`` over the median of its role in the quarter before that contest; null if nothing is known.

    players: match_id, start_time, team_id, account_id, role and ``metric``. Medians come from counts by
    value, so no group is larger than a metric has values.
    """
    quarter = F.date_trunc("quarter", F.col("start_time"))
    rows = players.select("match_id", "start_time", "team_id", "account_id", "role", F.col(metric).cast("double").alias("value"), quarter.alias("quarter"))
    counts = rows.where("value is not null").groupBy("role", "quarter", "value").agg(F.count("*").alias("n"))
    medians = counts.groupBy("role", "quarter").agg(F.percentile("value", 0.5, F.col("n")).alias("median"))
    medians = medians.select("role", (F.col("quarter") + F.expr("INTERVAL 3 MONTHS")).alias("quarter"), "median")
    known = rows.where("account_id is not null").join(medians, ["role", "quarter"], "left")
    known = known.groupBy("match_id", "start_time", "team_id", "account_id").agg(
        F.sum(F.col("value") / F.nullif("median", F.lit(0.0))).alias("sum"), F.count(F.col("value") / F.nullif("median", F.lit(0.0))).alias("n")
    )
    one = known.groupBy("match_id", "start_time", "account_id").agg((F.sum("sum") / F.nullif(F.sum("n"), F.lit(0))).alias("did"))
    w = W.partitionBy("account_id").orderBy("start_time", "match_id").rowsBetween(-recent, -1)
    form = one.select("match_id", "account_id", F.avg("did").over(w).alias("form"))
    mean = known.join(form, ["match_id", "account_id"]).groupBy("match_id", "team_id").agg(F.avg("form").alias("individual_form"))
    return players.select("match_id", "team_id").distinct().join(mean, ["match_id", "team_id"], "left")


def hero_pool(picks: DataFrame, recent: int = 10) -> DataFrame:
    """Distinct heroes that a team picked in its ``recent`` contests before."""
    per = picks.where("is_pick").groupBy("match_id", "start_time", "team_id").agg(F.collect_set("hero_id").alias("heroes"))
    past = F.collect_list("heroes").over(by_team().rowsBetween(-recent, -1))
    return per.select("match_id", "team_id", F.size(F.array_distinct(F.flatten(past))).alias("hero_pool"))


def hero_winrates(picks: DataFrame) -> DataFrame:
    """Picks and win rate per hero and version; picks: hero_id, patch_id, is_pick, won."""
    won = F.col("won").cast("int").cast("double")
    return picks.where("is_pick").groupBy("hero_id", "patch_id").agg(F.count("*").alias("picks"), F.avg(won).alias("winrate"))


def _days_before(*keys: str):
    """Rows of the same keys on earlier days; needs the column ``day``."""
    return W.partitionBy(*keys).orderBy("day").rangeBetween(W.unboundedPreceding, -1)


def _day() -> Column:
    return F.date_diff(F.col("start_time").cast("date"), F.lit("1970-01-01").cast("date"))


def draft_strength(picks: DataFrame) -> DataFrame:
    """Draft stage only: mean over a side's picks of the hero's win rate within the version before this
    contest (0.5 for a hero without one), and the same over its bans (null without bans)."""
    w = _days_before("hero_id", "patch_id")
    did = F.when(F.col("is_pick"), F.col("won").cast("int").cast("double"))
    rows = picks.withColumn("day", _day()).withColumn("rate", F.coalesce(F.avg(did).over(w), F.lit(0.5)))
    mean = lambda which: F.avg(F.when(which, F.col("rate")))
    return rows.groupBy("match_id", "team_id").agg(
        mean(F.col("is_pick")).alias("draft_strength"), mean(~F.col("is_pick")).alias("ban_strength")
    )


def matchup_advantage(picks: DataFrame) -> DataFrame:
    """Draft stage only: sum over a side's picks and the other's of how far above a half the hero won
    against that hero on earlier days. Pairs are made within a contest, whose draft is short."""
    mine = picks.where("is_pick").select("match_id", "start_time", "team_id", "hero_id", "won")
    other = mine.select("match_id", F.col("team_id").alias("against"), F.col("hero_id").alias("other_hero"))
    pairs = mine.join(other, "match_id").where("team_id <> against").withColumn("day", _day())
    rate = F.avg(F.col("won").cast("int").cast("double")).over(_days_before("hero_id", "other_hero"))
    gain = F.coalesce(rate - 0.5, F.lit(0.0))
    return pairs.withColumn("gain", gain).groupBy("match_id", "team_id").agg(F.sum("gain").alias("matchup_advantage"))


def hero_comfort(picks: DataFrame) -> DataFrame:
    """Draft stage only: mean over a side's picks of how often their known accounts had that hero on earlier
    days, and mean of their win rates with it (over those that had). picks with account_id."""
    rows = picks.where("is_pick and account_id is not null").withColumn("day", _day())
    w = _days_before("account_id", "hero_id")
    rows = rows.withColumns({"games": F.count(F.lit(1)).over(w), "rate": F.avg(F.col("won").cast("int").cast("double")).over(w)})
    return rows.groupBy("match_id", "team_id").agg(F.avg("games").alias("comfort_games"), F.avg("rate").alias("comfort_winrate"))


def first_picks(picks: DataFrame) -> DataFrame:
    """Which team picked first in each contest, and the share of its earlier contests in which it did."""
    first = picks.where("is_pick").groupBy("match_id", "start_time").agg(F.min_by("team_id", "ord").alias("first_team"))
    sides = picks.select("match_id", "start_time", "team_id").distinct().join(first, ["match_id", "start_time"])
    did = (F.col("team_id") == F.col("first_team")).cast("int").cast("double")
    return sides.select("match_id", "team_id", (F.col("team_id") == F.col("first_team")).alias("picks_first"), F.avg(did).over(by_team().rowsBetween(W.unboundedPreceding, -1)).alias("first_pick_share"))


def with_organization(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """``rows`` with organization_id: what a confirmed alias says of the team, else the team's own id.
    aliases: team_id, organization_id, confirmed_at; the last confirmed one of a team counts."""
    last = F.struct("confirmed_at", "organization_id")
    said = aliases.where("confirmed_at is not null").groupBy("team_id").agg(F.max(last)["organization_id"].alias("organization_id"))
    return rows.join(said, "team_id", "left").withColumn("organization_id", F.coalesce("organization_id", "team_id"))
