"""Pools that are found, ratings mended from the earliest change on, and ratings of a resumed stream."""

import datetime as dt
import os
import random
import subprocess
import sys

import pytest

from ladderline.operators import elo, pools
from ladderline.plans import ratings as book
from ladderline.sources.store import Store
from ladderline.streaming import ratings as live

START = dt.datetime(2020, 1, 1)
SCHEMA = "match_id long, start_time timestamp_ntz, radiant_team_id long, dire_team_id long, radiant_win boolean"


def season(n, seed=1, worlds=4, days=3):
    """Contests of several worlds of six teams that never meet."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        world = rng.randrange(worlds)
        r, d = rng.sample(range(6), 2)
        out.append((i, START + dt.timedelta(days=days * i, hours=rng.randrange(24)), 10 * world + r, 10 * world + d, rng.random() < 0.5))
    return out


def walked(rows):
    now, out = {}, {}
    for m, _, r, d, won in sorted(rows, key=lambda x: (x[1], x[0])):
        a, b = now.get(r, 1000.0), now.get(d, 1000.0)
        now[r], now[d] = elo.elo_step(a, b, won)
        out[m] = (a, b, now[r], now[d])
    return out


def got(df):
    return {r.match_id: (r.radiant_pre, r.dire_pre, r.radiant_post, r.dire_post) for r in df.collect()}


def components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    least = {}
    for x in parent:
        least[root(x)] = min(x, least.get(root(x), x))
    return {x: least[root(x)] for x in parent}


@pytest.mark.parametrize("few", [100_000, 0])
@pytest.mark.parametrize("kind", ["random", "path", "star", "loops"])
def test_components(spark, kind, few):
    rng = random.Random(kind)
    order = rng.sample(range(64), 64)
    edges = {
        "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(130)],
        "path": list(zip(order, order[1:])),
        "star": [(5, x) for x in range(40)],
        "loops": [(3, 3), (7, 8), (8, 7), (7, 8)],
    }[kind]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in pools.components(df, few).collect()} == components(edges)


def test_pools_that_are_found_give_the_same_ratings_in_several_tasks(spark):
    rows = season(200)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(elo.rated(df)) == got(elo.rated(df, pool=None)) == walked(rows)
    assert len({r.pool for r in pools.team_pools(df).collect()}) == 4
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert elo.rated(df).select(F.spark_partition_id().alias("task")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_contests_without_an_outcome_or_a_team_are_not_rated(spark):
    rows = season(40)
    spoilt = [(900, START, 0, 1, None), (901, START, None, 1, True), (902, START, 0, None, True)]
    df = spark.createDataFrame(rows + spoilt, SCHEMA)
    assert got(elo.rated(df)) == walked(rows)
    assert elo.glicko2(df).count() == elo.ranked(df).count() == 40
    assert elo.rated(df.limit(0)).collect() == []


def test_ratings_may_begin_from_a_state(spark):
    rows = season(60, worlds=2)
    first, rest = rows[:35], rows[35:]
    now = {}
    for m, v in walked(first).items():
        now[rows[m][2]], now[rows[m][3]] = v[2], v[3]
    state = spark.createDataFrame([(t, r, t // 10 * 10) for t, r in now.items()], "team_id long, rating double, pool long")
    df = spark.createDataFrame([(*r, r[2] // 10 * 10) for r in rest], SCHEMA + ", pool long")
    assert got(elo.rated(df, pool="pool", initial=state)) == {m: v for m, v in walked(rows).items() if m >= 35}


def test_a_late_contest_at_any_place(spark, tmp_path):
    rows = season(24, seed=3, worlds=2, days=12)
    for late in range(0, 24, 3):
        store = Store(spark, f"{tmp_path}/{late}")
        some = [r for r in rows if r[0] != late]
        assert book.update(store, spark.createDataFrame(some, SCHEMA)) == 23
        n = book.update(store, spark.createDataFrame(rows, SCHEMA))
        month = rows[late][1].strftime("%Y-%m")
        same = [r for r in rows if r[1].strftime("%Y-%m") >= month and r[2] // 10 == rows[late][2] // 10]
        assert n == len(same) < 24 or late < 3  # its own pool, from its month on
        assert got(store.read("contest_ratings")) == walked(rows)


def test_a_change_a_loss_and_pools_that_meet(spark, tmp_path):
    store, rows = Store(spark, str(tmp_path)), season(60, seed=5, worlds=3, days=9)
    book.update(store, spark.createDataFrame(rows, SCHEMA))
    assert book.update(store, spark.createDataFrame(rows, SCHEMA)) == 0
    before = {p.name for p in (tmp_path / "contest_ratings").glob("written_=*")}
    rows[40] = (*rows[40][:4], not rows[40][4])
    book.update(store, spark.createDataFrame(rows, SCHEMA))
    assert got(store.read("contest_ratings")) == walked(rows)
    new = {p.name for p in (tmp_path / "contest_ratings").glob("written_=*")} - before
    months = {p.name[6:] for v in new for p in (tmp_path / "contest_ratings" / v).glob("part_=*")}
    assert min(months) == rows[40][1].strftime("%Y-%m")
    del rows[20]
    book.update(store, spark.createDataFrame(rows, SCHEMA))
    assert got(store.read("contest_ratings")) == walked(rows)
    rows.append((500, START + dt.timedelta(days=200), 1, 11, True))  # two pools become one
    book.update(store, spark.createDataFrame(rows, SCHEMA))
    assert got(store.read("contest_ratings")) == walked(rows)
    rows += [(501, START + dt.timedelta(days=2000), 1, 2, True)]
    assert book.update(store, spark.createDataFrame(rows, SCHEMA)) == 1
    assert got(store.read("contest_ratings")) == walked(rows)


def test_a_crash_between_the_tables_is_mended(spark, tmp_path, monkeypatch):
    store, rows = Store(spark, str(tmp_path)), season(40, seed=6, worlds=2, days=9)
    book.update(store, spark.createDataFrame(rows[:30], SCHEMA))
    replace = Store.replace

    def crash(self, table, *rest):
        if table == "contest_ratings":
            raise OSError("gone")
        replace(self, table, *rest)

    monkeypatch.setattr(Store, "replace", crash)
    with pytest.raises(OSError):
        book.update(store, spark.createDataFrame(rows, SCHEMA))
    monkeypatch.undo()
    book.update(store, spark.createDataFrame(rows, SCHEMA))
    assert got(store.read("contest_ratings")) == walked(rows)


RUN = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from ladderline.streaming import ratings
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", {root!r}).getOrCreate())
rows = spark.readStream.schema({schema!r}).parquet({folder!r})
ratings.rate_stream(rows, {root!r} + "/ratings", "40 days", "pool")
"""


def test_a_stream_goes_on_after_each_restart(spark, tmp_path):
    rows = season(60, seed=8, worlds=2)
    late, lost = rows[30], rows[2]  # one within 40 days of the latest, one far behind
    parts = [[r for r in rows[:25] if r != lost], [r for r in rows[25:40] if r != late], [late, lost, *rows[40:]]]
    schema = SCHEMA.replace("timestamp_ntz", "timestamp") + ", pool long"
    folder, root, seen = f"{tmp_path}/in", str(tmp_path), []
    for i, part in enumerate(parts):
        df = spark.createDataFrame([(*r, r[2] // 10) for r in part], SCHEMA + ", pool long")
        df.withColumn("start_time", df.start_time.cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)
        code = RUN.format(repo=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), root=root, folder=folder, schema=schema)
        subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, timeout=300)
        so_far = [r for p in parts[: i + 1] for r in p if r != lost]
        assert got(live.ratings(spark, f"{root}/ratings")) == walked(so_far)
        seen.append(got(live.ratings(spark, f"{root}/ratings")))
    follow = [r[0] for r in rows[31:40] if r[2] // 10 == late[2] // 10]
    assert any(seen[1][m] != seen[2][m] for m in follow)  # the late one changed what follows it
    assert 0 < live.told(spark, f"{root}/ratings").where("closed").count() < 60
    assert [r.match_id for r in live.missed(spark, f"{root}/ratings").collect()] == [lost[0]]
    store = Store(spark, f"{root}/store")
    book.update(store, live.ratings(spark, f"{root}/ratings").select(*book.CONTEST))
    assert book.update(store, live.contests(spark, f"{root}/ratings")) == sum(r[2] // 10 == lost[2] // 10 for r in rows)
    assert got(store.read("contest_ratings")) == walked(rows)


def test_a_batch_closes_what_it_has_passed(spark, tmp_path):
    """No later batch can precede these, so they are neither told twice nor kept as open."""
    rows = season(80, seed=9, worlds=2)
    last = max(r[1] for r in rows)
    df = spark.createDataFrame([(*r, r[2] // 10) for r in rows], SCHEMA + ", pool long")
    df.withColumn("start_time", df.start_time.cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA.replace("timestamp_ntz", "timestamp") + ", pool long").parquet(f"{tmp_path}/in")
    live.rate_stream(stream, f"{tmp_path}/out", "20 days", "pool")
    told = spark.read.parquet(f"{tmp_path}/out/told")
    assert got(live.ratings(spark, f"{tmp_path}/out")) == walked(rows) and told.count() == 80
    assert {r.match_id for r in told.where("not closed").collect()} == {r[0] for r in rows if r[1] >= last - dt.timedelta(days=20)}


def test_streams_take_files_one_after_the_other(spark, tmp_path):
    from pyspark.sql import functions as F

    from ladderline.streaming import streams

    schema = "event_id long, user_id long, event_type string, value double, ts timestamp_ntz, props string"
    folder, seen, merged, all_ = f"{tmp_path}/events", f"{tmp_path}/a", f"{tmp_path}/b", []
    for i in range(3):
        rows = [(10 * i + k, k % 4, "x", float(10 * i + k), START + dt.timedelta(hours=10 * i + k), f"p{(10 * i + k) % 13}") for k in range(10)]
        all_ += rows
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        once = streams.deduplicated(spark, folder, seen)
        last = streams.merged_stream(spark, folder, merged)
        assert once.count() == once.distinct().count() == len({r[5] for r in all_})
        want = {u: (max((r for r in all_ if r[1] == u))[3], min(r[4] for r in all_ if r[1] == u)) for u in range(4)}
        assert {r.user_id: (r.value, r.first_seen) for r in last.collect()} == want
    assert len(list((tmp_path / "b").glob("table-*"))) == 3
    bounded = streams.deduplicated(spark, folder, f"{tmp_path}/c", "1 hour")
    assert bounded.select(F.countDistinct("content_hash")).first()[0] == 13
