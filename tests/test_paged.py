"""The paged feed as a data source: bounds that reach it, pages that are asked for, streams that go on."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ladderline.plans import ingest
from ladderline.sources import feed, http, paged
from ladderline.sources.store import Store
from tests.test_sources import NOW
from tests.test_sources import feed as made_feed

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture
def folder(tmp_path):
    """Two pages of seven contests, newest first, three days apart; every page that is read leaves a trace."""
    get, root = made_feed(), tmp_path / "feed"
    root.mkdir()
    first = get("proMatches", {})
    (root / "page1.json").write_text(json.dumps(first))
    (root / "page2.json").write_text(json.dumps(get("proMatches", {"less_than_match_id": first[-1]["match_id"]})))
    return str(root)


@pytest.fixture
def asked(folder, tmp_path, monkeypatch, request):
    """A module that gives the folder's feed and writes down what it was asked."""
    log = tmp_path / "asked.txt"
    name = f"noted_{abs(hash(request.node.name))}"
    (tmp_path / f"{name}.py").write_text(
        "from ladderline.sources.feed import file_feed\n"
        "def feed():\n"
        f"    get = file_feed({folder!r})\n"
        "    def noted(path, params):\n"
        f"        open({str(log)!r}, 'a').write(path + json.dumps(params) + '\\n')\n"
        "        return get(path, params)\n"
        "    return noted\n"
        "import json\n"
    )
    monkeypatch.syspath_prepend(str(tmp_path))
    seen = lambda: log.read_text().splitlines() if log.exists() else []
    seen.feed = f"{name}:feed"
    return seen


def by_feed(spark, folder, since, until):
    """The same contests by the load's own reader."""
    get = feed.file_feed(folder)
    raw = feed.raw_frame(spark, [("leagues", {}, [])] + [("proMatches", p, r) for p, r in feed.pages(get, since)], NOW)
    rows = feed.matches(raw, feed.leagues(raw), since, until)
    return sorted((r.match_id, r.start_time, r.radiant_name, r.radiant_win) for r in rows.collect())


@pytest.mark.parametrize(("since", "until"), [(DAY, NOW), (DAY + dt.timedelta(days=6), DAY + dt.timedelta(days=30)), (DAY + dt.timedelta(days=39), NOW)])
def test_rows_of_the_feed(spark, folder, since, until):
    paged.register(spark)
    rows = spark.read.format("contest_feed").option("folder", folder).load()
    some = rows.where((F.col("start_time") >= F.lit(since)) & (F.col("start_time") < F.lit(until)))
    got = sorted((r.match_id, r.start_time, r.radiant_name, r.radiant_win) for r in some.collect())
    assert got == by_feed(spark, folder, since, until) and got
    assert spark.read.format("contest_feed").option("folder", folder).load().count() == 14


def test_bounds_reach_the_source():
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

    reader = paged._Batch({"folder": "x"})
    other = EqualTo(("match_id",), 5)
    t = dt.datetime(2024, 1, 5, tzinfo=dt.UTC)
    assert list(reader.pushFilters([GreaterThan(("start_time",), t), other, LessThanOrEqual(("start_time",), t)])) == [other]
    assert (reader.since, reader.until) == (dt.datetime(2024, 1, 5, 0, 0, 0, 1), dt.datetime(2024, 1, 5, 0, 0, 0, 1))
    with pytest.raises(ValueError, match="name the feed"):
        paged._getter({})


def test_only_the_pages_in_question_are_asked_for(spark, asked, tmp_path):
    from ladderline.sources.paged import _Batch

    for since, pages in ((DAY + dt.timedelta(days=30), 1), (DAY, 3)):
        before = len(asked())
        reader = _Batch({"feed": asked.feed})
        reader.since = since
        assert len(list(reader.read(None))) == sum(DAY + dt.timedelta(days=3 * i) >= since for i in range(14))
        assert len(asked()) - before == pages


def test_a_stream_asks_for_nothing_twice(spark, folder, tmp_path):
    paged.register(spark)
    out = f"{tmp_path}/out"

    def drain():
        rows = spark.readStream.format("contest_feed").option("folder", folder).option("since", DAY.isoformat()).load()
        q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/cp").start()
        q.processAllAvailable()
        q.stop()
        return sorted(r.match_id for r in spark.read.parquet(out).collect())

    assert drain() == list(range(7001, 7015))
    pages = [json.loads(open(f"{folder}/page{i}.json").read()) for i in (1, 2)]
    new = lambda m: dict(pages[0][0], match_id=m, start_time=pages[0][0]["start_time"] + 86400)
    # a contest that would be new on the second page tells if that page is asked for again
    for i, rows in enumerate(([new(7020), *pages[0]], [*pages[1], new(6000)])):
        with open(f"{folder}/page{i + 1}.json", "w") as f:
            json.dump(rows, f)
    assert drain() == [*range(7001, 7015), 7020]  # a new query over the same checkpoint, as after a restart
    assert drain() == [*range(7001, 7015), 7020]


def test_details_are_landed_as_they_come(spark, tmp_path):
    store, get, calls = Store(spark, str(tmp_path)), made_feed(), []
    heroes = spark.createDataFrame([(i, "h", "H", "str", "Melee", ["x"]) for i in range(1, 12)], "hero_id int, name string, localized_name string, primary_attr string, attack_type string, roles array<string>")
    patches = spark.createDataFrame([(54, "7.35", dt.datetime(2023, 12, 1))], "patch_id int, name string, released_at timestamp")
    ingest.sync_reference(store, heroes, patches)

    def dies(path, params):
        if path == "matches/7006":
            raise RuntimeError("killed")
        calls.append(path)
        return get(path, params)

    with pytest.raises(RuntimeError, match="killed"):
        ingest.run(store, dies, DAY, NOW, NOW, every=2)
    landed = {r.endpoint for r in store.read("raw_responses").collect() if r.endpoint.startswith("matches/")}
    assert landed == {f"matches/{m}" for m in range(7001, 7005)} and store.read("matches").count() == 0
    calls.clear()

    def again(path, params):
        calls.append(path)
        if path == "matches/7008":
            raise ValueError("no JSON")
        return get(path, params)

    done = ingest.run(store, again, DAY, NOW, NOW + dt.timedelta(hours=1), every=3)
    assert not landed & set(calls) and done.details_asked == 10  # what was landed isn't asked for again
    assert [x.split()[1] for x in done.issues] == [str(m) for m in range(7008, 7015)] and "no JSON" in done.issues[0]
    assert store.read("matches").count() == 13 and store.read("match_players").count() == 60


def test_a_body_that_ends_too_early_is_asked_for_again():
    from http.client import IncompleteRead

    told = [IncompleteRead(b"["), (200, {}, "[1]")]

    def transport(url, params, timeout):
        a = told.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    assert http.HttpClient(transport, sleep=lambda s: None).get_json("u") == [1]
