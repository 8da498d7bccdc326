"""The paged match feed as a data source of Spark's own: ``spark.read.format("contest_feed")``.

Options: ``folder`` (a feed laid out as JSON files) or ``feed`` (``module:function`` that gives a
``get(path, params)``), and for streams ``since``, where the first one begins. A batch read takes its
bounds from the filters on ``start_time`` and asks only for the pages that they need; a stream's offset
is the load's checkpoint, one microsecond after the latest contest it has given.

A feed is one cursor under one rate limit, so it is one partition; what comes of it is spread by Spark.
Spark 4.1 keeps the bounds that it pushed with the loaded frame: one that was read with a filter gives
the same rows when it is read again without any. Load anew for another read.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, SimpleDataSourceStreamReader

from ladderline import schemas
from ladderline.sources.feed import file_feed, pages

FIRST = datetime(1970, 1, 1)
LAST = datetime(9999, 1, 1)
COLUMNS = [c.split(" ") for c in schemas.MATCHES_WIRE.split(", ")]
SCHEMA = ", ".join(f"{'league_id' if n == 'leagueid' else n} {'timestamp' if n == 'start_time' else t}" for n, t in COLUMNS) + ", page long, pos int"


def _getter(options) -> Callable[[str, dict], object]:
    if "folder" in options:
        return file_feed(options["folder"])
    if "feed" not in options:
        raise ValueError("name the feed by the option folder or feed")
    module, _, name = options["feed"].partition(":")
    return getattr(importlib.import_module(module), name)()


def _naive(t: datetime) -> datetime:
    return t if t.tzinfo is None else t.astimezone(UTC).replace(tzinfo=None)


def _rows(get: Callable[[str, dict], object], since: datetime, until: datetime) -> Iterator[tuple]:
    """List rows in [since, until), page by page; ``page`` is the cursor, the newest page has the largest."""
    for params, rows in pages(get, since):
        for pos, r in enumerate(rows):
            t = datetime.fromtimestamp(r["start_time"], UTC)
            if since <= t.replace(tzinfo=None) < until:
                told = [t if n == "start_time" else r.get(n) for n, _ in COLUMNS]
                yield (*told, int(params.get("less_than_match_id", 1 << 62)), pos)


class _Batch(DataSourceReader):
    def __init__(self, options):
        self.options, self.since, self.until = options, FIRST, LAST

    def pushFilters(self, filters):
        """Takes the bounds on start_time, gives back what Spark has to look at itself."""
        step = timedelta(microseconds=1)
        for f in filters:
            bound = isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("start_time",)
            if not bound or not isinstance(f.value, datetime):
                yield f
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.since = max(self.since, _naive(f.value) + step * isinstance(f, GreaterThan))
            else:
                self.until = min(self.until, _naive(f.value) + step * isinstance(f, LessThanOrEqual))

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        return _rows(_getter(self.options), self.since, self.until)


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.get, self.begin = _getter(options), options.get("since", FIRST.isoformat())

    def initialOffset(self) -> dict:
        return {"since": self.begin}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = list(_rows(self.get, datetime.fromisoformat(start["since"]), LAST))  # what came since the last batch
        at = 2  # start_time among the columns
        end = max((_naive(r[at]) + timedelta(microseconds=1) for r in rows), default=None)
        return iter(rows), {"since": end.isoformat()} if end else start

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return _rows(self.get, datetime.fromisoformat(start["since"]), datetime.fromisoformat(end["since"]))

    def commit(self, end: dict) -> None:
        return None


class ContestFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "contest_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(self.options)


def register(spark) -> None:
    """Makes ``contest_feed`` known to a session and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ContestFeed)
