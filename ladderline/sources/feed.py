"""The match feed: paged lists, leagues, details and reference files, read into DataFrames."""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderline import schemas
from ladderline.functions import content_hash
from ladderline.sources.http import PermanentHttpError


def file_feed(folder: str):
    """A ``get(path, params)`` over files: pages by cursor, details by id, else 404."""

    def load(path: str):
        if not os.path.exists(path):
            raise PermanentHttpError(404)
        with open(path) as f:
            return json.load(f)

    pages = [load(p) for p in sorted(glob.glob(f"{folder}/page*.json"))]

    def get(path: str, params: dict):
        if path == "proMatches":
            less = params.get("less_than_match_id")
            if less is None:
                return pages[0] if pages else []
            return next((b for a, b in zip(pages, pages[1:]) if a and min(r["match_id"] for r in a) == less), [])
        return load(f"{folder}/{path}.json")

    return get


def pages(get: Callable[[str, dict], list[dict]], since: datetime) -> Iterator[tuple[dict, list[dict]]]:
    """(params, rows) of the newest-first list, by cursor; ends with an empty page or once a page's oldest
    row lies before ``since`` (ids are only roughly in order of time, so rows alone can't end it)."""
    start, params = since.replace(tzinfo=since.tzinfo or UTC).timestamp(), {}
    while True:
        rows = get("proMatches", params)
        yield params, rows
        if not rows or min(r["start_time"] for r in rows) < start:
            return
        params = {"less_than_match_id": min(r["match_id"] for r in rows)}


def raw_frame(spark: SparkSession, responses: list[tuple[str, dict, object]], fetched_at: datetime, source: str = "feed") -> DataFrame:
    """Fetched responses as raw records: bodies in a canonical text, parameters without secrets."""
    rows = [
        (source, endpoint, {k: str(x) for k, x in params.items() if k != "api_key"}, json.dumps(body, sort_keys=True), fetched_at)
        for endpoint, params, body in responses
    ]
    raw = spark.createDataFrame(rows, "source string, endpoint string, request_params map<string,string>, response_body string, fetched_at timestamp")
    return raw.withColumn("content_hash", content_hash(F.col("response_body")))


def matches(raw: DataFrame, leagues: DataFrame, since: datetime, until: datetime) -> DataFrame:
    """List rows in [since, until) with their league's tier; a league that isn't there leaves it null."""
    body = F.from_json("response_body", f"array<struct<{_fields(schemas.MATCHES_WIRE)}>>")
    pos = raw.where("endpoint = 'proMatches'").select(F.posexplode(body).alias("pos", "m"), F.col("request_params"))
    rows = pos.select("m.*", F.coalesce(F.try_element_at("request_params", F.lit("less_than_match_id")).cast("long"), F.lit(2**62)).alias("page"), "pos")
    rows = rows.withColumn("start_time", F.timestamp_seconds("start_time")).withColumnRenamed("leagueid", "league_id")
    rows = rows.where((F.col("start_time") >= F.lit(since)) & (F.col("start_time") < F.lit(until)))
    position = F.struct(-F.col("page"), F.col("pos"))
    rows = rows.withColumn("position", position).drop("page", "pos")
    return rows.join(leagues.select("league_id", F.col("tier").alias("league_tier")), "league_id", "left")


def leagues(raw: DataFrame) -> DataFrame:
    body = F.from_json("response_body", f"array<struct<{_fields(schemas.LEAGUES_WIRE)}>>")
    rows = raw.where("endpoint = 'leagues'").select(F.inline(body))
    return rows.select(F.col("leagueid").alias("league_id"), "name", "tier").dropDuplicates(["league_id"])


def details(raw: DataFrame) -> DataFrame:
    body = F.from_json("response_body", _struct(schemas.DETAIL_WIRE))
    return raw.where("endpoint like 'matches/%'").select(body.alias("d")).select("d.*")


def picks_bans(details: DataFrame) -> DataFrame:
    """None for a null list; the feed's order is kept."""
    return details.select("match_id", F.inline("picks_bans")).select(
        "match_id", F.col("order").cast("short").alias("ord"), "is_pick", "hero_id", F.col("team").cast("short").alias("team")
    )


def match_players(details: DataFrame) -> DataFrame:
    """Sides by the feed's slot (radiant below 128), teams by side, missing counts 0. Slots are numbered
    anew per side, radiant from 0 and dire from 128, in the feed's order."""
    from pyspark.sql import Window as W

    rows = details.select("match_id", "radiant_team_id", "dire_team_id", F.posexplode("players").alias("pos", "p"))
    rad = F.col("p.player_slot") < 128
    rows = rows.withColumn("is_radiant", rad)
    slot = F.row_number().over(W.partitionBy("match_id", "is_radiant").orderBy("pos")) - 1 + F.when(F.col("is_radiant"), 0).otherwise(128)
    return rows.select(
        "match_id", slot.cast("short").alias("player_slot"), "p.account_id",
        F.when(F.col("is_radiant"), F.col("radiant_team_id")).otherwise(F.col("dire_team_id")).alias("team_id"),
        "is_radiant", "p.hero_id", *[F.coalesce(f"p.{c}", F.lit(0)).alias(c) for c in schemas.STATS],
    )


def heroes(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object from id to hero."""
    kind = "map<string, struct<id: int, name: string, localized_name: string, primary_attr: string, attack_type: string, roles: array<string>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("key", "h"))
    return rows.select(F.col("h.id").alias("hero_id"), "h.name", "h.localized_name", "h.primary_attr", "h.attack_type", "h.roles")


def patches(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of (id, name, date), by time."""
    rows = spark.read.schema("name string, date string, id int").json(path, multiLine=True)
    return rows.select(F.col("id").alias("patch_id"), "name", F.to_timestamp("date").alias("released_at")).orderBy("released_at")


def _fields(ddl: str) -> str:
    return ", ".join(": ".join(x.split(" ", 1)) for x in _split(ddl))


def _struct(ddl: str) -> str:
    return f"struct<{_fields(ddl)}>"


def _split(ddl: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(ddl[at:i].strip())
            at = i + 1
    return [*out, ddl[at:].strip()]
