"""Reads for a service: team form, upcoming contests, forecasts as of a cutoff, and the logs they write."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ladderline.functions import confidence, days_between, expected_score
from ladderline.operators.elo import BASE, current_ratings, rated, rating_log
from ladderline.operators.teams import FORM_WINDOW, recent_winrate, team_centric
from ladderline.plans.dataset import COLUMNS
from ladderline.plans.models import EloRule, Learned, Model, attributed
from ladderline.sources.store import Store


class NotFound(LookupError):
    """404"""


class Conflict(ValueError):
    """409"""


class Unavailable(RuntimeError):
    """503"""


def form_series(matches: DataFrame, team_id: int) -> DataFrame:
    """A team's ratings after each contest and its form over ten, by time."""
    log = rating_log(rated(matches)).where(F.col("team_id") == team_id).select("match_id", "team_id", F.col("rating_after").alias("elo_after"))
    form = team_centric(matches).withColumn("recent_winrate_10", recent_winrate(10)).where(F.col("team_id") == team_id)
    both = form.select("match_id", "start_time", "team_id", "recent_winrate_10").join(log, ["match_id", "team_id"])
    return both.select("match_id", "start_time", "elo_after", "recent_winrate_10").orderBy("start_time", "match_id")


def upcoming(matches: DataFrame, now: str, after: tuple[str, int] | None = None, tier: str | None = None, limit: int = 20) -> DataFrame:
    """Contests from ``now`` on, by keyset pages: ``after`` is the last (start_time, match_id) seen."""
    rows = matches.where(F.col("start_time") >= F.lit(now).cast("timestamp_ntz"))
    if tier is not None:
        rows = rows.where(F.col("league_tier") == tier)
    if after is not None:
        rows = rows.where(F.struct("start_time", "match_id") > F.struct(F.lit(after[0]).cast("timestamp_ntz").alias("start_time"), F.lit(after[1]).cast("long").alias("match_id")))
    return rows.orderBy("start_time", "match_id").limit(limit)


def match(matches: DataFrame, match_id: int):
    row = matches.where(F.col("match_id") == match_id).first()
    if row is None:
        raise NotFound(f"no contest {match_id}")
    return row


def team(teams: DataFrame, team_id: int):
    row = teams.where(F.col("team_id") == team_id).first()
    if row is None:
        raise NotFound(f"no team {team_id}")
    return row


def predict(matches: DataFrame, cutoff: str, model_version: str = "elo_rule/v0_baseline") -> DataFrame:
    """Forecasts of all contests from ``cutoff`` on with what was known before it, with the evidence and
    a confidence class; the shape of the prediction log."""
    at = F.lit(cutoff).cast("timestamp_ntz")
    now = current_ratings(rating_log(rated(matches.where(F.col("start_time") < at))))
    next_ = matches.where(F.col("start_time") >= at).select("match_id", "start_time", "radiant_team_id", "dire_team_id")
    for side in ("radiant", "dire"):
        r = now.select(F.col("team_id").alias(f"{side}_team_id"), F.col("rating").alias(f"{side}_elo"))
        next_ = next_.join(r, f"{side}_team_id", "left").withColumn(f"{side}_elo", F.coalesce(f"{side}_elo", F.lit(BASE)))
    p = expected_score(F.col("radiant_elo"), F.col("dire_elo"))
    out = next_.withColumn("probability", p)
    why = F.to_json(F.struct(F.struct("radiant_elo", "dire_elo", (F.col("radiant_elo") - F.col("dire_elo")).alias("elo_difference")).alias("contribution")))
    return out.select("match_id", "start_time", "radiant_team_id", "dire_team_id", "probability", confidence(F.col("probability")).alias("confidence"), why.alias("explanation"), at.alias("data_cutoff"), F.lit(model_version).alias("model"))


def standing(matches: DataFrame, cutoff: str, window: int = FORM_WINDOW) -> DataFrame:
    """What is known of each team before ``cutoff``: rating, form over its last contests, how many, the last one."""
    past = matches.where((F.col("start_time") < F.lit(cutoff).cast("timestamp_ntz")) & F.col("radiant_win").isNotNull())
    now = current_ratings(rating_log(rated(past)))
    newest = W.partitionBy("team_id").orderBy(F.desc("start_time"), F.desc("match_id"))
    rows = team_centric(past).withColumn("back", F.row_number().over(newest))
    form = rows.groupBy("team_id").agg(
        F.avg(F.when(F.col("back") <= window, F.col("won").cast("int").cast("double"))).alias("recent_winrate"),
        F.count("*").alias("matches_played_before"), F.max("start_time").alias("last_match"),
    )
    return form.join(now, "team_id").withColumnRenamed("rating", "elo")


def upcoming_features(matches: DataFrame, cutoff: str) -> DataFrame:
    """The dataset's columns for contests from ``cutoff`` on, as of then; a team not seen before has the base
    rating and nulls."""
    rows = matches.where(F.col("start_time") >= F.lit(cutoff).cast("timestamp_ntz")).select("match_id", F.col("start_time").alias("as_of_timestamp"), "radiant_team_id", "dire_team_id", "radiant_win")
    now = standing(matches, cutoff)
    for s in ("radiant", "dire"):
        one = now.select(F.col("team_id").alias(f"{s}_team_id"), *[F.col(c).alias(f"{s}_{c}") for c in ("elo", "recent_winrate", "matches_played_before", "last_match")])
        rows = rows.join(one, f"{s}_team_id", "left").withColumns({
            f"{s}_elo": F.coalesce(f"{s}_elo", F.lit(BASE)), f"{s}_matches_played_before": F.coalesce(f"{s}_matches_played_before", F.lit(0)),
            f"{s}_days_since_last_match": days_between(F.col("as_of_timestamp"), F.col(f"{s}_last_match")),
        })
    rows = rows.withColumns({"elo_difference": F.col("radiant_elo") - F.col("dire_elo"), "recent_winrate_difference": F.col("radiant_recent_winrate") - F.col("dire_recent_winrate")})
    return rows.select(*COLUMNS)


def register_fitted(store: Store, model: Model, name: str, version: str, path: str, train: DataFrame, now: str, active: bool = True) -> int:
    """Saves a fitted model under ``path`` and registers it with the means of its training rows."""
    if isinstance(model, EloRule):
        model.save(store.spark, path)
        config = {"kind": "elo_rule", "path": path}
    else:
        model.save(path)
        means = train.na.fill(0, subset=model.features).agg(*[F.avg(f).alias(f) for f in model.features]).first().asDict()
        config = {"kind": "learned", "path": path, "means": means}
    return register_model(store, name, version, json.dumps(config), json.dumps(model.evaluate(train)), now, active)


def forecast(store: Store, matches: DataFrame, cutoff: str) -> DataFrame:
    """Forecasts of all contests from ``cutoff`` on by the registry's active model, whichever that is, from
    what was known before, with the parts that each feature has in the score; the shape of the log."""
    row = active_model(store.read("models"))
    config = json.loads(row.config)
    if config["kind"] not in ("elo_rule", "learned"):
        raise Unavailable(f"no model of the kind {config['kind']}")
    model = EloRule.load(store.spark, config["path"]) if config["kind"] == "elo_rule" else Learned.load(config["path"])
    out = attributed(model, upcoming_features(matches, cutoff), config.get("means"))
    why = F.to_json(F.struct("scale", "baseline", "contributions"))
    return out.select(
        "match_id", F.col("as_of_timestamp").alias("start_time"), "radiant_team_id", "dire_team_id", F.col("p").alias("probability"), confidence(F.col("p")).alias("confidence"),
        why.alias("explanation"), F.lit(cutoff).cast("timestamp_ntz").alias("data_cutoff"), F.lit(f"{row.name}/{row.version}").alias("model"), F.lit(row.model_id).alias("model_id"),
    )


def active_model(registry: DataFrame):
    """The one active row of a model registry (name, version, is_active)."""
    twice = registry.groupBy("name", "version").count().where("count > 1")
    if not twice.isEmpty():
        raise Conflict("a model version is registered twice")
    rows = registry.where("is_active").limit(2).collect()
    if not rows:
        raise Unavailable("no model is active")
    if len(rows) > 1:
        raise Conflict("more than one model is active")
    return rows[0]


def log_ratings(store: Store, matches: DataFrame, now: str) -> None:
    """What each contest made of its teams' ratings; the same contests again change nothing but the time."""
    rows = rating_log(rated(matches)).drop("start_time").withColumn("calculated_at", F.lit(now).cast("timestamp"))
    store.merge("team_ratings", rows.dropDuplicates(["team_id", "match_id"]))


def log_predictions(store: Store, forecasts: DataFrame, model_id: int, now: str) -> None:
    """Adds the rows of :func:`predict` or :func:`forecast` to the log; a contest forecast again at another
    time gets another row. Ids follow from contest, model and time, so a write that is tried again makes the
    same rows."""
    rows = forecasts.select("match_id", "radiant_team_id", "dire_team_id", "probability", "explanation", F.col("data_cutoff").cast("timestamp").alias("data_cutoff"))
    rows = rows.withColumns({"prediction_id": F.sha2(F.concat_ws("/", "match_id", F.lit(str(model_id)), F.lit(now)), 256), "model_id": F.lit(model_id).cast("long"), "predicted_at": F.lit(now).cast("timestamp")})
    store.append("predictions", rows)


def register_model(store: Store, name: str, version: str, config: str, metrics: str, now: str, active: bool = False) -> int:
    """A new row of the registry and its id. A name and version come once; with ``active`` this becomes
    the one active model."""
    known = store.read("models")  # a row per trained model
    if not known.where((F.col("name") == name) & (F.col("version") == version)).isEmpty():
        raise Conflict(f"{name} {version} is registered")
    model_id = (known.agg(F.max("model_id")).first()[0] or 0) + 1
    new = known.sparkSession.range(1).select(
        F.lit(model_id).cast("long").alias("model_id"), F.lit(name).alias("name"), F.lit(version).alias("version"), F.lit(config).alias("config"),
        F.lit(metrics).alias("metrics"), F.lit(active).alias("is_active"), F.lit(now).cast("timestamp").alias("created_at"),
    )
    if active:
        store.write("models", known.withColumn("is_active", F.lit(False)).unionByName(new))
    else:
        store.append("models", new)
    return model_id
