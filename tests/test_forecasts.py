"""Forecasts by the active model and what they are made of; reads of a service; roster events and lineups."""

import datetime as dt
import json
import math
import random

import pytest
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier

from ladderline.operators import elo, rosters
from ladderline.plans import dataset, models, serving
from ladderline.sources.store import Store

START = dt.datetime(2021, 1, 1)
SCHEMA = "match_id long, start_time timestamp_ntz, radiant_team_id long, dire_team_id long, radiant_win boolean"
CUTOFF = str(START + dt.timedelta(days=100))


@pytest.fixture(scope="module")
def history():
    rng = random.Random(9)
    rows = []
    for i in range(240):
        r, d = rng.sample(range(8), 2)
        rows.append((i, START + dt.timedelta(hours=12 * i), r, d, rng.random() < 1 / (1 + math.exp(0.4 * (d - r)))))
    return [*rows, (900, START + dt.timedelta(days=150), 3, 77, None)]  # not played yet, against a team never seen


@pytest.fixture(scope="module")
def matches(spark, history):
    return spark.createDataFrame(history, SCHEMA)


@pytest.fixture(scope="module")
def data(matches):
    return dataset.feature_set_0(matches).persist()


FEATURES = ("elo_difference", "recent_winrate_difference", "radiant_matches_played_before")


@pytest.mark.parametrize("kind", ["elo_rule", "linear", "forest", "boosted"])
def test_parts_sum_to_the_score(data, kind):
    model = {
        "elo_rule": lambda: models.EloRule(),
        "linear": lambda: models.Learned(LogisticRegression(regParam=0.01), FEATURES),
        "forest": lambda: models.Learned(RandomForestClassifier(numTrees=5, maxDepth=4, seed=1), FEATURES),
        "boosted": lambda: models.Learned(GBTClassifier(maxIter=4, maxDepth=3, seed=1), FEATURES),
    }[kind]().fit(data)
    means = {"elo_difference": 3.5, "recent_winrate_difference": -0.25}
    rows = models.attributed(model, data, means).collect()
    assert len(rows) == 240
    for r in rows:
        score = r.baseline + sum(r.contributions.values())
        want = r.p if r.scale == "probability" else math.log(r.p / (1 - r.p))
        assert score == pytest.approx(want, abs=1e-9)
        assert set(r.contributions) <= set(FEATURES)
    assert len({tuple(r.contributions.values()) for r in rows}) > 5
    if kind == "linear":
        w = dict(zip(FEATURES, model.model.coefficients.toArray()))
        r = rows[50]
        assert r.contributions["elo_difference"] == pytest.approx(w["elo_difference"] * (r.elo_difference - 3.5))


def plain_standing(history, cutoff):
    ratings, results = {}, {}
    for _, t, r, d, won in history:
        if won is not None and str(t) < cutoff:
            a, b = ratings.get(r, 1000.0), ratings.get(d, 1000.0)
            ratings[r], ratings[d] = elo.elo_step(a, b, won)
            results.setdefault(r, []).append((won, t))
            results.setdefault(d, []).append((not won, t))
    return ratings, results


def test_features_as_of_the_cutoff(matches, history):
    ratings, results = plain_standing(history, CUTOFF)
    rows = {r.match_id: r for r in serving.upcoming_features(matches, CUTOFF).collect()}
    assert set(rows) == {h[0] for h in history if str(h[1]) >= CUTOFF} and 900 in rows
    for m, t, r, d, _ in history:
        if m in rows:
            x = rows[m]
            assert (x.radiant_elo, x.dire_elo) == pytest.approx((ratings.get(r, 1000.0), ratings.get(d, 1000.0)))
            last = [w for w, _ in results.get(d, [])][-5:]
            assert x.dire_recent_winrate == (pytest.approx(sum(last) / len(last)) if last else None)
            assert x.radiant_matches_played_before == len(results.get(r, []))
            assert x.radiant_days_since_last_match == pytest.approx((t - results[r][-1][1]).total_seconds() / 86400)
    assert rows[900].dire_recent_winrate is None and rows[900].dire_elo == 1000.0


def test_whichever_model_is_active_forecasts(spark, matches, data, history, tmp_path):
    store = Store(spark, f"{tmp_path}/db")
    with pytest.raises(serving.Unavailable):
        serving.forecast(store, matches, CUTOFF)
    train = data.where(data.as_of_timestamp < CUTOFF)
    serving.register_fitted(store, models.EloRule().fit(None), "elo_rule", "v0", f"{tmp_path}/elo", train, "2021-05-01")
    by_rule = {r.match_id: r for r in serving.forecast(store, matches, CUTOFF).collect()}
    ratings, _ = plain_standing(history, CUTOFF)
    for m, t, r, d, _ in history:
        if m in by_rule:
            p = 1 / (1 + 10 ** ((ratings.get(d, 1000.0) - ratings.get(r, 1000.0)) / 400))
            assert by_rule[m].probability == pytest.approx(p) and by_rule[m].model == "elo_rule/v0"
    same = {r.match_id: r.probability for r in serving.predict(matches.where("radiant_win is not null"), CUTOFF).collect()}
    assert {m: pytest.approx(p) for m, p in same.items()} == {m: r.probability for m, r in by_rule.items() if m != 900}
    learned = models.Learned(LogisticRegression(regParam=0.01), FEATURES).fit(train)
    two = serving.register_fitted(store, learned, "logistic", "v1", f"{tmp_path}/lr", train, "2021-05-02")
    rows = serving.forecast(store, matches, CUTOFF).collect()
    assert len(rows) == len(by_rule) and {r.model for r in rows} == {"logistic/v1"} and {r.model_id for r in rows} == {two}
    want = {r.match_id: r.p for r in learned.predict(serving.upcoming_features(matches, CUTOFF)).collect()}
    for r in rows:
        why = json.loads(r.explanation)
        assert r.probability == pytest.approx(want[r.match_id])
        assert why["baseline"] + sum(why["contributions"].values()) == pytest.approx(math.log(r.probability / (1 - r.probability)), abs=1e-9)
    for _ in range(2):  # a write that is tried again makes the same rows
        serving.log_predictions(store, serving.forecast(store, matches, CUTOFF), two, "2021-05-03")
    assert store.read("predictions").select("prediction_id").distinct().count() == len(rows)


def test_upcoming_by_pages_and_one_match(matches, history):
    tiers = matches.withColumn("league_tier", matches.match_id.cast("string").substr(-1, 1))
    later = sorted((t, m) for m, t, *_ in history if str(t) >= CUTOFF)
    seen, after = [], None
    while True:
        page = serving.upcoming(tiers, CUTOFF, after, limit=7).collect()
        if not page:
            break
        assert len(page) <= 7
        seen += [(r.start_time, r.match_id) for r in page]
        after = (str(page[-1].start_time), page[-1].match_id)
    assert seen == later
    assert [r.match_id for r in serving.upcoming(tiers, CUTOFF, tier="3", limit=3).collect()] == [m for _, m in later if m % 10 == 3][:3]
    assert serving.match(matches, 17).radiant_team_id == history[17][2]
    with pytest.raises(serving.NotFound, match="no contest 5000"):
        serving.match(matches, 5000)


def test_series_of_a_team(matches, history):
    now, form, want = {}, [], []
    for m, t, r, d, won in history[:-1]:
        a, b = now.get(r, 1000.0), now.get(d, 1000.0)
        now[r], now[d] = elo.elo_step(a, b, won)
        if 3 in (r, d):
            want.append((m, now[3], sum(form[-10:]) / len(form[-10:]) if form else None))
            form.append(won == (r == 3))
    got = [(r.match_id, r.elo_after, r.recent_winrate_10) for r in serving.form_series(matches.where("radiant_win is not null"), 3).collect()]
    assert got == [(m, pytest.approx(e), pytest.approx(f) if f is not None else None) for m, e, f in want]


DAY = lambda n: START + dt.timedelta(days=n)
EVENTS = "team_id long, account_id long, changed_at timestamp_ntz, change_type string, source string"


def test_events_and_lineups_become_periods_that_do_not_overlap(spark):
    rng = random.Random(3)
    events = [(t, a, DAY(rng.randrange(60)), rng.choice(["joined", "left", "stand_in"]), "wiki") for t in (1, 2) for a in range(12) for _ in range(rng.randrange(6))]
    observed = []
    for t in (1, 2):
        for a in range(3, 15):
            at = 0
            for _ in range(rng.randrange(4)):
                at += rng.randrange(1, 12)
                end = at + rng.randrange(12)
                observed.append((t, a, DAY(at), DAY(end) if rng.random() < 0.8 else None))
                if observed[-1][3] is None:
                    break
                at = end + 1
    df = rosters.merged_periods(spark.createDataFrame(events, EVENTS), spark.createDataFrame(observed, "team_id long, account_id long, valid_from timestamp_ntz, valid_to timestamp_ntz"))
    got = df.collect()
    assert rosters.overlaps(df.withColumn("matches", df.confidence)).count() == 0
    told = {}
    for t, a in {e[:2] for e in events}:
        since = None
        for _, _, at, kind, _ in sorted(e for e in events if e[:2] == (t, a) and e[3] != "stand_in"):
            if kind == "joined" and since is None:
                since = at
            elif kind == "left" and since is not None:
                told.setdefault((t, a), []).append((since, at))
                since = None
        if since is not None:
            told.setdefault((t, a), []).append((since, DAY(9999)))
    tick = dt.timedelta(microseconds=1)
    for t, a in {(e[0], e[1]) for e in [*events, *observed]}:
        mine = sorted((r.valid_from, r.valid_to or DAY(9999), r.source) for r in got if (r.team_id, r.account_id) == (t, a))
        assert all(x[2] != y[2] or x[1] < y[0] for x, y in zip(mine, mine[1:]))
        for n in range(80):
            for at in (DAY(n), DAY(n) + dt.timedelta(hours=12)):
                e = any(f <= at < u for f, u in told.get((t, a), []))
                o = any(x[2] <= at < max(x[3] or DAY(9999), x[2] + tick) for x in observed if x[:2] == (t, a))
                want = {(True, True): "both", (True, False): "events", (False, True): "lineups", (False, False): None}[e, o]
                assert next((s for f, u, s in mine if f <= at < u), None) == want, (t, a, at)


def test_contradictions_are_told(spark):
    events = [(1, 5, DAY(10), "joined", ""), (1, 5, DAY(20), "left", ""), (1, 5, DAY(30), "stand_in", ""), (1, 6, DAY(3), "left", ""), (1, 7, DAY(3), "joined", "")]
    played = [(i, DAY(n), 1, a) for i, (n, a) in enumerate([(12, 5), (25, 5), (31, 5), (1, 6), (4, 6), (9, 7), (9, None), (25, 5)])]
    got = rosters.roster_contradictions(spark.createDataFrame(events, EVENTS), spark.createDataFrame(played, "match_id long, start_time timestamp_ntz, team_id long, account_id long"))
    assert sorted((r.account_id, r.at, r.problem) for r in got.collect()) == [
        (5, DAY(25), "played after leaving"), (6, DAY(3), "left without having joined"), (6, DAY(4), "played after leaving"),
    ]
