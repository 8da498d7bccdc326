"""Ratings, ranks, models and streams against plain Python; the store and loads when something breaks."""

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from ladderline.operators import asof, elo, metrics, teams
from ladderline.plans import ingest, models, serving
from ladderline.sources import http
from ladderline.sources.settings import Settings
from ladderline.sources.store import Store
from tests.test_sources import NOW, feed

SCHEMA = "match_id long, start_time timestamp_ntz, radiant_team_id long, dire_team_id long, radiant_win boolean"
START = dt.datetime(2020, 1, 1)


@pytest.fixture(scope="module")
def history():
    rng = random.Random(3)
    rows = []
    for m in range(160):
        r, d = rng.sample(range(1, 9), 2)
        rows.append((m, START + dt.timedelta(days=rng.randrange(400), hours=m % 24), r, d, rng.random() < 0.55))
    return sorted(rows, key=lambda x: (x[1], x[0]))


@pytest.fixture(scope="module")
def matches(spark, history):
    return spark.createDataFrame(random.Random(4).sample(history, len(history)), SCHEMA).repartition(3)


def walk(history):
    """(match, radiant, dire, win, ratings before) in order."""
    now = {}
    for m, t, r, d, w in history:
        yield m, t, r, d, w, dict(now)
        a, b = now.get(r, 1000.0), now.get(d, 1000.0)
        now[r], now[d] = elo.elo_step(a, b, w)


def test_ranks_and_wins_against_the_first(matches, history):
    place = lambda now, t: 1 + sum(x > now[t] for x in now.values()) if t in now else None
    want = {m: (place(now, r), place(now, d)) for m, _, r, d, _, now in walk(history)}
    assert {r.match_id: (r.radiant_rank, r.dire_rank) for r in elo.ranked(matches).collect()} == want
    got = models.against_top(matches, top=3, least=2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    past, share = {}, {}
    for m, _, r, d, w in history:
        for team, won, rank in ((r, w, want[m][1]), (d, not w, want[m][0])):
            seen = past.setdefault(team, [])
            share[m, team] = (sum(seen) / len(seen) if len(seen) >= 2 else None, len(seen))
        for team, won, rank in ((r, w, want[m][1]), (d, not w, want[m][0])):
            if rank is not None and rank <= 3:
                past[team].append(float(won))
    assert {(r.match_id, r.team_id): (r.vs_top_winrate, r.vs_top_meetings) for r in got.collect()} == {k: (None if s is None else pytest.approx(s), n) for k, (s, n) in share.items()}


def test_pools_are_rated_apart(spark, history):
    rows = [(m, t, r + 100 * p, d + 100 * p, w, p) for p in (0, 1, 2) for m, t, r, d, w in history]
    got = elo.rated(spark.createDataFrame(rows, SCHEMA + ", pool long"), pool="pool").collect()
    want = {m: (now.get(r, 1000.0), now.get(d, 1000.0)) for m, _, r, d, _, now in walk(history)}
    assert len(got) == len(rows) and all((r.radiant_pre, r.dire_pre) == pytest.approx(want[r.match_id]) for r in got)


def test_trend_opponents_and_exponential_form(matches, history):
    before, elos = {}, {}
    for m, _, r, d, _, now in walk(history):
        for t, o in ((r, d), (d, r)):
            before.setdefault(t, []).append((m, now.get(t, 1000.0)))
            elos[m, t] = now.get(o, 1000.0)
    want = {(m, t): x - seen[i - 5][1] if i >= 5 else None for t, seen in before.items() for i, (m, x) in enumerate(seen)}
    got = {(r.match_id, r.team_id): r.elo_delta for r in elo.elo_trend(elo.rating_log(elo.rated(matches))).collect()}
    assert got == {k: None if x is None else pytest.approx(x) for k, x in want.items()}
    past, share, form = {}, {}, {}
    for m, _, r, d, w in history:
        for t, won in ((r, w), (d, not w)):
            seen = past.setdefault(t, [])
            share[m, t] = sum(x * e for x, e in seen) / sum(e for _, e in seen) if seen else None
            form[m, t] = 0.5
            for x, _ in seen:
                form[m, t] = 0.05 * x + 0.95 * form[m, t]
            seen.append((float(won), elos[m, t]))
    got = {(r.match_id, r.team_id): r.adjusted_winrate for r in models.opponent_adjusted(matches).collect()}
    assert got == {k: None if x is None else pytest.approx(x) for k, x in share.items()}
    long = teams.team_centric(matches)
    got = {(r.match_id, r.team_id): r.ema for r in long.select("match_id", "team_id", teams.ema_form(0.05).alias("ema")).collect()}
    assert got == {k: pytest.approx(x, abs=1e-12) for k, x in form.items()}


def test_glicko_by_the_published_example(spark):
    """One player of 1500, 200, 0.06 in the paper; here each contest is a period, so the first step is checked."""
    rows = [(1, START, 1, 2, True), (2, START + dt.timedelta(days=1), 1, 3, False)]
    a, b = elo.glicko2(spark.createDataFrame(rows, SCHEMA)).orderBy("match_id").collect()
    assert (a.radiant_rating, a.radiant_rd, a.dire_rating, a.dire_rd) == pytest.approx((1500, 350, 1500, 350))
    phi = 350 / 173.7178
    g = 1 / math.sqrt(1 + 3 * phi**2 / math.pi**2)
    v = 4 / g**2
    new = 1 / math.sqrt(1 / (phi**2 + 0.06**2) + 1 / v)
    assert b.radiant_rating == pytest.approx(1500 + 173.7178 * new**2 * g / 2, abs=0.1) and b.radiant_rd == pytest.approx(173.7178 * new, abs=0.1)


def test_glicko_with_certain_and_upset_contests():
    """States in which 9 million orders stopped the fold (no expectation, then no exponent left), and others far off."""
    for us, them, won in [
        ((0.020889237843491393, 0.9523855960987926, 0.38988224718761455), (49.06788751044777, 10.020051565494505), False),
        ((-34.50774718526327, 7.432595570993623, 3.1429340299093367), (-0.9059864282762327, 1.105977537668029), True),
        ((900.0, 2.0, 0.06), (-900.0, 1.0), True), ((900.0, 2.0, 0.06), (-900.0, 1.0), False), ((1e9, 2.0, 1e100), (-1e9, 1.0), False),
    ]:
        mu, phi, sigma = elo.glicko2_step(*us, *them, won)
        assert all(math.isfinite(x) for x in (mu, phi, sigma)) and 0 < phi <= elo.UNRATED and sigma > 0
        assert (mu >= us[0]) if won else (mu <= us[0])
    rng = random.Random(2)
    for _ in range(500):
        (mu, phi, sigma), (mu2, phi2), won = (rng.gauss(0, 2), rng.uniform(0.2, 1.5), rng.uniform(0.03, 0.1)), (rng.gauss(0, 2), rng.uniform(0.2, 2)), rng.random() < 0.5
        g = 1 / math.sqrt(1 + 3 * phi2**2 / math.pi**2)
        e = 1 / (1 + math.exp(-g * (mu - mu2)))
        v = 1 / (g * g * e * (1 - e))
        new, deviation, volatility = elo.glicko2_step(mu, phi, sigma, mu2, phi2, won)
        y, t = 2 * math.log(volatility), phi**2 + v + volatility**2
        root = volatility**2 * ((v * g * (won - e)) ** 2 - t) / (2 * t * t) - (y - 2 * math.log(sigma)) / 0.25
        assert abs(root) < 1e-5  # the volatility is the root it is meant to be
        assert deviation == pytest.approx(1 / math.sqrt(1 / (phi**2 + volatility**2) + 1 / v)) and new == pytest.approx(mu + deviation**2 * g * (won - e))


def test_roc_auc_and_bootstrap(spark):
    rng = random.Random(5)
    rows = [(i, round(rng.random(), 3), rng.random() < 0.4) for i in range(500)] + [(500, 1.0, True), (501, 0.0, False)]
    df = spark.createDataFrame(rows, "match_id long, p double, won boolean")
    pos, neg = ([p for _, p, w in rows if w == x] for x in (True, False))
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert metrics.roc_auc(df).first()[0] == pytest.approx(want)
    got = [r.brier for r in metrics.bootstrap(df, times=40).collect()]
    brier = [(p - w) ** 2 for _, p, w in rows]
    mean = sum(brier) / len(brier)
    spread = math.sqrt(sum((x - mean) ** 2 for x in brier)) / len(brier)
    assert len(got) == 40 and abs(sum(got) / 40 - mean) < spread and 0.5 * spread < math.sqrt(sum((x - mean) ** 2 for x in got) / 40) < 2 * spread


def test_versions_up_to_any_date(spark):
    cal = spark.createDataFrame([(1, dt.datetime(2020, 1, 1)), (2, dt.datetime(2020, 1, 1, 12)), (3, dt.datetime(2150, 1, 1))], "patch_id int, released_at timestamp_ntz")
    at = [dt.datetime(2019, 12, 31), dt.datetime(2020, 1, 1, 11), dt.datetime(2020, 1, 1, 12), dt.datetime(2149, 12, 31), dt.datetime(2300, 5, 5), None]
    m = spark.createDataFrame([(i, t) for i, t in enumerate(at)], "match_id int, start_time timestamp_ntz")
    for most in (1, 10**6):
        found = asof.version_of(m, cal, most)
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
        assert [r.patch_id for r in found.orderBy("match_id").collect()] == [None, 1, 2, 2, 3, None]
    assert asof.version_of(m.limit(0), cal).count() == 0


def test_models_on_a_clear_difference(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        x = rng.gauss(0, 200)
        rows.append((i, START + dt.timedelta(days=i), 1000 + x, 1000.0, x, rng.random() < 1 / (1 + 10 ** (-x / 200))))
    data = spark.createDataFrame(rows, "match_id long, as_of_timestamp timestamp_ntz, radiant_elo double, dire_elo double, elo_difference double, radiant_win boolean")
    from pyspark.ml.classification import LogisticRegression

    others = [c for c in models.Learned(LogisticRegression()).features if c not in data.columns]
    data = data.withColumns({c: F.lit(0.0) for c in others})
    fit = models.sanity_fit(data).first()
    assert fit.n == 300 and fit.sign == "positive" and fit.accuracy > 0.7
    assert models.sanity_fit(data.limit(3)).first().accuracy is None
    rounds = models.rolling_retrain(data, every_days=90).orderBy("cutoff").collect()
    assert [r.cutoff for r in rounds] == [START + dt.timedelta(days=x) for x in (90, 180, 270)] and sum(r.n for r in rounds) == 210
    assert all(r.accuracy > 0.6 for r in rounds)
    f = data.select("match_id", F.col("as_of_timestamp").alias("start_time"), F.least(F.greatest(1 / (1 + F.exp(-F.col("elo_difference") / 400)), F.lit(0.01)), F.lit(0.99)).alias("p"), F.col("radiant_win").alias("won"))
    got = models.calibrated(f, "2020-03-01", "2020-08-01").collect()
    loss = lambda k: -sum(math.log(max(1e-9, r[k] if r.won else 1 - r[k])) for r in got)
    assert len(got) == sum(r[1] >= dt.datetime(2020, 8, 1) for r in rows) and loss("platt") < loss("raw")


def test_rating_series_of_a_team(matches, history):
    team = history[0][2]
    got = serving.form_series(matches, team).collect()
    assert len(got) == sum(team in (r, d) for _, _, r, d, _ in history)


def leagues(spark, *names):
    return spark.createDataFrame([(i, n, "premium") for i, n in enumerate(names)], "league_id long, name string, tier string")


def test_a_crash_before_the_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    store.merge("leagues", leagues(spark, "a", "b"))

    def crash(*args):
        raise OSError("gone")

    monkeypatch.setattr(Store, "_point_to", crash)
    with pytest.raises(OSError):
        store.merge("leagues", leagues(spark, "x", "y", "z"))
    monkeypatch.undo()
    assert sorted(r.name for r in store.read("leagues").collect()) == ["a", "b"]
    store.merge("leagues", leagues(spark, "c"))
    assert sorted(r.name for r in store.read("leagues").collect()) == ["b", "c"]
    for p in (tmp_path / "leagues").glob("*manifest-*"):
        p.unlink()
    with pytest.raises(RuntimeError):
        store.read("leagues")


def test_appends_leave_what_is_there(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for n in "abc":
        store.append("leagues", leagues(spark, n))
        before = {p: p.stat().st_mtime_ns for p in (tmp_path / "leagues").glob("written_=*/part_=*/*.parquet")}
    store.append("leagues", leagues(spark, "d"))
    assert len(before) == 3
    assert store.read("leagues").count() == 4 and all(p.stat().st_mtime_ns == t for p, t in before.items())


def test_details_are_asked_for_what_is_loaded(spark, tmp_path):
    asked, get = [], feed()
    store = Store(spark, str(tmp_path))

    def counted(path, params):
        asked.append(path)
        if path == "matches/7004":
            assert store.read("ingestion_runs").where("status = 'running' and finished_at is null").count() == 1
        return get(path, params)

    times = iter([NOW, NOW + dt.timedelta(minutes=5)])
    done = ingest.run(store, counted, dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20), NOW, limit=3, clock=lambda: next(times))
    assert sorted(x for x in asked if x.startswith("matches/")) == ["matches/7003", "matches/7004", "matches/7005"]
    run = store.read("ingestion_runs").collect()
    assert len(run) == 1 and run[0].status == "success" and run[0].finished_at - run[0].started_at == dt.timedelta(minutes=5)
    assert done.fetched == 5


def test_the_live_feed_asks_the_service(spark):
    calls, pauses = [], []

    def transport(url, params, timeout):
        calls.append((url, params, timeout))
        return (429, {"Retry-After": "2"}, b"") if len(calls) == 1 else (200, {}, json.dumps([1]).encode())

    get = http.live_feed(Settings(feed_base_url="https://example.org/api/", feed_api_key="k", request_timeout=7.0), transport, pauses.append)
    assert get("proMatches", {"less_than_match_id": 5}) == [1]
    assert calls[-1] == ("https://example.org/api/proMatches", {"less_than_match_id": 5, "api_key": "k"}, 7.0) and 2.0 in pauses
    with pytest.raises(ValueError):
        http.live_feed(Settings())


def test_models_are_saved_and_loaded(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegression

    rows = spark.createDataFrame([(float(x), 0.1 * x, x > 3) for x in range(8)], "elo_difference double, recent_winrate_difference double, radiant_win boolean")
    model = models.Learned(LogisticRegression(regParam=0.1))
    with pytest.raises(RuntimeError):
        model.save(f"{tmp_path}/none")
    model.fit(rows).save(f"{tmp_path}/m")
    again = models.Learned.load(f"{tmp_path}/m")
    assert again.features == model.features and again.fitted
    assert [r.p for r in again.predict(rows).collect()] == [r.p for r in model.predict(rows).collect()]


def test_logs_and_registry(spark, matches, history, tmp_path):
    store = Store(spark, f"{tmp_path}/db")
    for now in ("2021-01-01", "2021-01-02"):
        serving.log_ratings(store, matches, now)
    log = store.read("team_ratings").collect()
    assert len(log) == 2 * len(history) and {r.calculated_at.day for r in log} == {2}
    assert sum(r.rating_after - r.rating_before for r in log) == pytest.approx(0, abs=1e-6)
    cutoff = str(history[120][1])
    one = serving.register_model(store, "elo_rule", "v0", "{}", "{}", "2021-01-01", active=True)
    serving.register_model(store, "elo_rule", "v1", "{}", "{}", "2021-01-02")
    assert serving.active_model(store.read("models")).version == "v0"
    two = serving.register_model(store, "elo_rule", "v2", "{}", "{}", "2021-01-03", active=True)
    assert serving.active_model(store.read("models")).model_id == two == 3 and one == 1
    with pytest.raises(serving.Conflict):
        serving.register_model(store, "elo_rule", "v1", "{}", "{}", "2021-01-04")
    for now in ("2021-01-01", "2021-01-02"):
        serving.log_predictions(store, serving.predict(matches, cutoff), two, now)
    said = store.read("predictions").collect()
    assert len({r.prediction_id for r in said}) == len(said) == 2 * sum(h[1] >= history[120][1] for h in history)
    assert all(0 < r.probability < 1 and r.data_cutoff == history[120][1] for r in said)
    with pytest.raises(serving.NotFound):
        serving.team(store.read("teams"), 1)


def test_stand_ins_of_a_majority_lineup(spark):
    from ladderline.operators import rosters

    sides = [(i, START + dt.timedelta(days=i), 1, [1, 2, 3] if i != 4 else [1, 2, 9]) for i in range(6)] + [(6, START + dt.timedelta(days=6), 1, [1, 2, 9])]
    df = spark.createDataFrame(sides, "match_id long, start_time timestamp_ntz, team_id long, lineup array<long>")
    got = {r.match_id: r.stand_ins for r in rosters.majority_stand_ins(df).collect()}
    assert got == {0: None, 1: 0, 2: 0, 3: 0, 4: 1, 5: 0, 6: 1}  # one recent contest makes no member
    assert {r.match_id: r.stand_ins for r in rosters.stand_ins(df).collect()}[6] == 0


def test_latest_confirmed_organisation_counts(spark):
    from ladderline.operators import rosters

    aliases = [(1, 50, START), (1, 60, START + dt.timedelta(days=1)), (2, 70, None)]
    a = spark.createDataFrame(aliases, "team_id long, organization_id long, confirmed_at timestamp_ntz")
    got = rosters.with_organization(spark.createDataFrame([(1,), (2,), (3,)], "team_id long"), a).collect()
    assert {r.team_id: r.organization_id for r in got} == {1: 60, 2: 2, 3: 3}
