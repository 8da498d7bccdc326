import datetime as dt
import random

from ladderline.plans import replay
from ladderline.sources.store import Store

DAY = dt.datetime(2024, 1, 1)
MATCH = "match_id long, start_time timestamp, duration int, radiant_team_id long, dire_team_id long, radiant_win boolean, league_id long, patch_id int, series_id long, series_type short, source string, ingested_at timestamp"


def rows_of(spark, numbers):
    rng = random.Random(1)
    made = [(i, DAY + dt.timedelta(days=i), 100, *rng.sample(range(5), 2), rng.random() < 0.5, 1, None, None, None, "feed", DAY) for i in range(40)]
    some = [made[i] for i in numbers]
    stats = [0] * 11
    players = [(m[0], s, 10 * m[3 if s < 128 else 4] + (m[0] + s) % 6, m[3 if s < 128 else 4], s < 128, 1, *stats[:11]) for m in some for s in (0, 1, 2, 128, 129, 130)]
    kind = "match_id long, player_slot int, account_id long, team_id long, is_radiant boolean, hero_id int, kills int, deaths int, assists int, gold_per_min int, xp_per_min int, last_hits int, denies int, level int, hero_damage int, tower_damage int, hero_healing int"
    return spark.createDataFrame(some, MATCH), spark.createDataFrame(players, kind)


def loaded(store, spark, numbers):
    matches, players = rows_of(spark, numbers)
    store.merge("matches", matches)
    store.merge("match_players", players)


def seen(df):
    return sorted(map(repr, df.collect()))


def test_two_times(spark, tmp_path):
    now = [DAY + dt.timedelta(days=31)]
    store, stopped = Store(spark, f"{tmp_path}/a", lambda: now[0]), Store(spark, f"{tmp_path}/b")
    on_time, late = [i for i in range(30) if i != 12], [12, *range(30, 40)]
    loaded(store, spark, on_time)
    loaded(stopped, spark, on_time)
    now[0] += dt.timedelta(days=20)
    loaded(store, spark, late)
    before = str(DAY + dt.timedelta(days=30))
    then = seen(replay.as_known(store, before, DAY + dt.timedelta(days=40)))
    assert then == seen(replay.as_known(stopped, before)) and len(then) == 5
    today = seen(replay.as_known(store, before))  # the late contest had been played by then, but wasn't known
    assert today != then
    whole = Store(spark, f"{tmp_path}/c")
    loaded(whole, spark, range(30))
    assert today == seen(replay.as_known(whole, before))
    assert replay.as_known(store, before, DAY).collect() == []
