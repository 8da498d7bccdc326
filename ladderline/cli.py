"""Command line: ``python -m ladderline.cli ingest|dataset|profile|check --store DIR ...``.

``ingest`` reads a feed laid out as JSON files under ``--feed`` (``leagues.json``, ``page*.json`` newest
first, ``matches/<id>.json``, ``heroes.json``, ``patches.json``); with ``--source live`` leagues, pages
and details come from the service of the settings, and ``--feed`` holds only the two reference files.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import UTC, datetime

from ladderline.sources.feed import file_feed
from ladderline.sources.health import service_report, source_report


def _feed(a):
    """What ``--source`` names: files under ``--feed``, or the service of the settings."""
    if a.source == "files":
        return file_feed(a.feed)
    from ladderline.sources.http import live_feed
    from ladderline.sources.settings import Settings

    return live_feed(Settings.of(os.environ))


def _utc(text: str) -> datetime:
    t = datetime.fromisoformat(text)
    return t if t.tzinfo is None else t.astimezone(UTC).replace(tzinfo=None)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="ladderline")
    p.add_argument("command", choices=["ingest", "dataset", "profile", "check"])
    p.add_argument("--store", default="store")
    p.add_argument("--feed")
    p.add_argument("--source", choices=["files", "live"], default="files")
    p.add_argument("--limit", type=int, default=100)
    p.add_argument("--since", type=_utc)
    p.add_argument("--until", type=_utc)
    p.add_argument("--sample", type=int, help="contest whose draft check looks at")
    p.add_argument("--no-persist", action="store_true")
    a = p.parse_args(args)

    if a.command == "check":
        get = _feed(a)
        report = source_report(get, a.sample) + (service_report(get) if a.source == "live" else [])
        print(json.dumps({"checks": report}))
        return int(any(c["status"] == "FAILED" for c in report))

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from ladderline.plans import dataset, ingest, models
    from ladderline.operators import profile
    from ladderline.sources import feed
    from ladderline.sources.settings import Settings, since
    from ladderline.sources.store import Store

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store, settings = Store(spark, a.store), Settings.of(os.environ)
    now = datetime.now(UTC).replace(tzinfo=None)
    if a.command == "ingest":
        ingest.sync_reference(store, feed.heroes(spark, f"{a.feed}/heroes.json"), feed.patches(spark, f"{a.feed}/patches.json"))
        start = since(a.since, ingest.checkpoint(store), settings.data_start_date, now)
        clock = lambda: datetime.now(UTC).replace(tzinfo=None)
        done = ingest.run(store, _feed(a), start, a.until or now, now, a.limit, clock)
        print(json.dumps(done.__dict__))
        return 0
    m = store.read("matches").join(store.read("leagues").select("league_id", "tier"), "league_id", "left")
    m = m.where(F.col("tier").isin("premium", "professional") & F.col("radiant_team_id").isNotNull() & F.col("dire_team_id").isNotNull())
    data = dataset.feature_set_0(dataset.bounded(m, settings.min_match_date, settings.data_end_date))
    if a.command == "dataset":
        if not a.no_persist:
            config = spark.createDataFrame([(dataset.VERSION, json.dumps(dataset.CONFIG), now)], "feature_set_version string, config string, created_at timestamp")
            store.merge("feature_sets", config)
            store.merge("match_features", dataset.long_features(data))
        print(json.dumps({"version": dataset.VERSION, "rows": data.count()}))
        return 0
    profile.null_fractions(data).show(50, False)
    profile.class_balance(data, "radiant_win").show()
    profile.describe(data, *[c for c in data.columns if c.endswith(("elo", "difference", "winrate"))]).show(50, False)
    models.sanity_fit(data).show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
