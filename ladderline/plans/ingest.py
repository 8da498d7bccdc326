"""A load: feed -> raw log -> normalised, validated, versioned -> keyed tables, with a checkpoint."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime
from itertools import batched, chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderline.operators import asof, records
from ladderline.sources import feed
from ladderline.sources.http import PermanentHttpError, TransientHttpError
from ladderline.sources.store import Store


@dataclass
class Result:
    fetched: int = 0
    upserted: int = 0
    skipped: int = 0
    duplicates: int = 0
    raw_written: int = 0
    raw_seen_before: int = 0
    rejected: int = 0
    details_asked: int = 0
    issues: list[str] = field(default_factory=list)


def checkpoint(store: Store):
    """Where the last successful load ended; loads that found nothing keep the one before."""
    ok = store.read("ingestion_runs").where("status = 'success' and checkpoint is not null")
    return ok.agg(F.max_by("checkpoint", "finished_at")).first()[0]


def sync_reference(store: Store, heroes: DataFrame, patches: DataFrame) -> tuple[int, int]:
    store.merge("heroes", heroes)
    store.merge("patches", patches)
    return heroes.count(), patches.count()


def run(
    store: Store, get: Callable[[str, dict], object], since: datetime, until: datetime, now: datetime, limit: int | None = None, clock: Callable[[], datetime] | None = None,
    every: int = 100,
) -> Result:
    """A run is written down as ``running`` first, then as what became of it; failures are raised again.
    Responses are landed ``every`` at a time."""
    run_id, clock = uuid.uuid4().hex, clock or (lambda: now)
    began = clock()
    _log(store, run_id, "running", 0, None, None, began, None)
    try:
        result, end = _run(store, get, since, until, now, limit, every)
        _log(store, run_id, "success", result.upserted, end, None, began, clock())
        return result
    except Exception as e:
        _log(store, run_id, "failed", 0, None, str(e)[:500], began, clock())
        raise


def _log(store: Store, run_id: str, status: str, items: int, end, error, began: datetime, ended: datetime | None) -> None:
    """Puts the run's row in place of the one it has (one row per run: a small table)."""
    schema = "run_id string, source string, status string, items int, checkpoint timestamp, error string, started_at timestamp, finished_at timestamp"
    row = store.spark.createDataFrame([(run_id, "feed", status, items, end, error, began, ended)], schema)
    if ended is None:
        store.append("ingestion_runs", row)
    else:
        store.write("ingestion_runs", store.read("ingestion_runs").where(F.col("run_id") != run_id).unionByName(row))


def _landed(store: Store, responses: Iterable[tuple[str, dict, object]], now: datetime, out: Result, every: int) -> DataFrame:
    """Raw rows of ``responses``. They are landed as they come, ``every`` at a time, so a run that dies keeps
    what it was given; of each one only its hash stays here, the bodies are read back from the log."""
    asked = []
    for some in batched(responses, every):
        batch = feed.raw_frame(store.spark, list(some), now).persist()
        fresh = records.raw_appended(store.read("raw_responses"), batch).persist()
        new = fresh.count()
        out.raw_written, out.raw_seen_before = out.raw_written + new, out.raw_seen_before + len(some) - new
        if new:
            store.append("raw_responses", fresh)
        asked += batch.select("endpoint", "content_hash", "request_params").collect()
        fresh.unpersist()
        batch.unpersist()
    known = store.spark.createDataFrame(asked, "endpoint string, content_hash string, request_params map<string,string>")
    return known.join(store.read("raw_responses").drop("request_params"), ["endpoint", "content_hash"])


def _details(get: Callable[[str, dict], object], ids: Iterable[int], out: Result):
    """A request each; a contest without a detail is loaded without children, and that is said."""
    for match_id in ids:
        out.details_asked += 1
        try:
            yield f"matches/{match_id}", {}, get(f"matches/{match_id}", {})
        except (PermanentHttpError, TransientHttpError, ValueError) as e:
            out.issues.append(f"contest {match_id} has no detail: {e}")


def _run(store, get, since, until, now, limit, every):
    out = Result()
    listed = [("leagues", {}, get("leagues", {}))]
    batch = _landed(store, chain(listed, (("proMatches", params, rows) for params, rows in feed.pages(get, since))), now, out, every).persist()

    leagues = feed.leagues(batch)
    rows = records.normalized(feed.matches(batch, leagues, since, until))
    out.fetched = rows.count()
    if limit is not None and out.fetched > limit:
        rows = rows.orderBy("start_time", "position").limit(limit)
    rows = asof.version_of(rows, store.read("patches")).withColumns({"source": F.lit("feed"), "ingested_at": F.lit(now)}).persist()
    out.duplicates = records.repeats(rows, ["match_id"], ["position"]).count()
    good = records.accepted(rows.withColumn("start_time", F.col("start_time").cast("timestamp_ntz")), F.lit(now).cast("timestamp_ntz")).select("match_id")
    good = good.distinct().persist()
    out.skipped = rows.count() - rows.join(good, "match_id", "left_semi").count()
    rows = rows.join(good, "match_id", "left_semi")

    # details of what is left only; those that a run landed since the last good one, and then died, are there
    wanted = good.select("match_id", F.concat(F.lit("matches/"), "match_id").alias("endpoint"))
    last_good = store.read("ingestion_runs").where("status = 'success'").agg(F.max("started_at").alias("t")).first()["t"] or datetime(1970, 1, 1)
    landed = store.read("raw_responses").where(F.col("fetched_at") > F.lit(last_good)).join(wanted.join(store.read("matches").select("match_id"), "match_id", "left_anti"), "endpoint", "left_semi")
    landed = landed.groupBy("endpoint").agg(F.max_by("response_body", "fetched_at").alias("response_body")).persist()
    ask = wanted.join(landed, "endpoint", "left_anti").select("match_id").orderBy("match_id").toLocalIterator()
    found = _landed(store, _details(get, (r["match_id"] for r in ask), out), now, out, every)
    detail = feed.details(landed.unionByName(found.select("endpoint", "response_body"))).persist()
    # children take their teams from the list row, which wins over the detail
    sides = records.collapsed(rows.select("match_id", "radiant_team_id", "dire_team_id", "position"), ["match_id"], F.col("position"))
    detail = detail.drop("radiant_team_id", "dire_team_id").join(sides.drop("position"), "match_id")
    players, picks = feed.match_players(detail), feed.picks_bans(detail)
    heroes = store.read("heroes")
    both = players.select("match_id", "hero_id").unionByName(picks.select("match_id", "hero_id"))
    bad = records.rejected_by_reference(both, "hero_id", heroes, "hero_id", "match_id").persist()
    out.rejected = bad.count()
    keep = lambda df: df.join(bad, "match_id", "left_anti")
    rows, players, picks = keep(rows).persist(), keep(players), keep(picks)

    seen = {"first_seen": F.lit(now), "last_seen": F.lit(now)}
    one = F.lit(None).cast("string")
    teams = rows.select("position", F.inline(F.array(*[F.struct(F.col(f"{s}_team_id").alias("team_id"), F.col(f"{s}_name").alias("name")) for s in ("radiant", "dire")])))
    teams = records.collapsed(teams.where("team_id is not null"), ["team_id"], F.col("position")).drop("position")
    store.merge("teams", teams.withColumns({**seen, "organization_id": F.lit(None).cast("long"), "tag": one}))
    store.merge("leagues", leagues)
    matches = records.collapsed(rows.drop("released_at"), ["match_id"], F.col("position"), ["start_time", "radiant_team_id", "dire_team_id"])
    store.merge("matches", matches)
    known = players.where("account_id is not null").select("account_id").distinct()
    store.merge("players", known.withColumns({**seen, "name": one}))
    store.merge("match_players", players)
    store.merge("picks_bans", picks)
    out.upserted = rows.count()
    last = rows.agg(F.max("start_time") + F.expr("interval 1 microsecond")).first()[0]
    for held in (batch, good, landed, detail, bad, rows):
        held.unpersist()
    return out, last
