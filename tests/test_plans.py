"""Declared features, comparison of models, and exact quantiles, each against plain Python."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ladderline.operators import metrics, profile, teams
from ladderline.plans import dataset
from ladderline.plans.features import FeatureSpec, LeakedFeature, Registry, draft_features, team_features

START = dt.datetime(2021, 1, 1)
SCHEMA = "match_id long, start_time timestamp_ntz, radiant_team_id long, dire_team_id long, radiant_win boolean"


@pytest.fixture(scope="module")
def matches(spark):
    rng = random.Random(2)
    rows = [(i, START + dt.timedelta(hours=7 * i), *rng.sample(range(9), 2), rng.random() < 0.5) for i in range(150)]
    return spark.createDataFrame(rows, SCHEMA)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_a_set_of_features_takes_one_exchange(matches):
    long = teams.team_centric(matches)
    names = ["form_trend", "recent_winrate", "days_since_last_match", "matches_played_before", "ema_form", "winrate", "is_rested"]
    made = team_features().computed(long, names)
    assert made.columns == [*long.columns, *names] and exchanges(made) == 1
    want = long.select("match_id", "team_id", teams.recent_winrate().alias("recent_winrate"), (teams.recent_winrate() - teams.recent_winrate(20)).alias("form_trend"), teams.winrate_before().alias("winrate"))
    got = made.select(*want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert [w for w, _ in team_features().waves(names)] == [("team_id",)] + [()] * (len(team_features().waves(names)) - 1)
    assert exchanges(dataset.feature_set_0(matches.where("match_id < 0"))) >= 1


def test_the_dataset_is_made_from_declared_features(matches):
    rows = {r.match_id: r for r in dataset.feature_set_0(matches).collect()}
    long = {(r.match_id, r.is_radiant): r for r in teams.form_features(matches).collect()}
    for m, r in rows.items():
        assert (r.radiant_recent_winrate, r.dire_recent_winrate) == (long[m, True].recent_winrate, long[m, False].recent_winrate)
        assert (r.radiant_days_since_last_match, r.dire_matches_played_before) == (long[m, True].days_since_last_match, long[m, False].matches_played_before)


def test_what_is_not_known_yet_is_refused(matches):
    rows = teams.team_centric(matches).withColumn("draft_winrate", F.lit(0.6))
    r = draft_features()
    for name in ("draft_strength", "draft_edge"):  # the second is made from the first
        with pytest.raises(LeakedFeature):
            r.computed(rows, [name])
        assert name in r.computed(rows, [name], stage="draft").columns
    assert r.computed(rows, ["winrate"]).count() == 300


def test_declarations_that_do_not_hold():
    one = lambda name, *inputs: FeatureSpec(name, lambda: F.lit(1), inputs, window=())
    r = Registry()
    r.add(one("a", "b"), one("b", "c"), one("c", "a"))
    with pytest.raises(ValueError, match="circle"):
        r.ordered(["a"])
    with pytest.raises(KeyError, match="no feature"):
        r.ordered(["x"])
    with pytest.raises(ValueError, match="twice"):
        r.add(one("a"))
    with pytest.raises(ValueError, match="no such stage"):
        FeatureSpec("d", lambda: F.lit(1), stage="after")


def test_nulls_and_missing_inputs(matches, spark):
    r = Registry()
    r.add(FeatureSpec("form", teams.recent_winrate, ("won",), nulls="zero_and_flag"))
    got = r.computed(teams.team_centric(matches), ["form"])
    assert got.where("form_is_missing").count() == 9 == got.where("form_is_missing and form = 0").count()
    with pytest.raises(KeyError, match="form needs won"):
        r.computed(matches, ["form"])
    assert {x.name: x.nulls for x in r.described(spark).collect()} == {"form": "zero_and_flag"}


@pytest.fixture(scope="module")
def forecasts(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        skill = rng.random()
        rows.append((i, round(min(max(skill + rng.gauss(0, 0.15), 0.0), 1.0), 2), round(min(max(skill + rng.gauss(0, 0.4), 0.0), 1.0), 2), rng.random() < skill))
    return rows, spark.createDataFrame(rows, "match_id long, p double, q double, won boolean")


def test_delong(forecasts):
    rows, df = forecasts
    r = metrics.delong(df).first()
    won, lost = [x for x in rows if x[3]], [x for x in rows if not x[3]]
    beats = lambda a, b: 1.0 if a > b else 0.5 if a == b else 0.0
    v10 = np.array([[np.mean([beats(x[k], y[k]) for y in lost]) for x in won] for k in (1, 2)])
    v01 = np.array([[np.mean([beats(x[k], y[k]) for x in won]) for y in lost] for k in (1, 2)])
    c = np.cov(v10) / len(won) + np.cov(v01) / len(lost)
    variance = c[0, 0] + c[1, 1] - 2 * c[0, 1]
    assert r.auc_p == pytest.approx(v10[0].mean()) and r.auc_q == pytest.approx(v10[1].mean())
    assert r.variance == pytest.approx(variance) and r.z == pytest.approx((r.auc_p - r.auc_q) / math.sqrt(variance))
    assert r.low < r.difference < r.high and r.z > 2
    assert metrics.roc_auc(df).first()[0] == pytest.approx(r.auc_p)
    same = metrics.delong(df.withColumn("q", F.col("p"))).first()
    assert same.difference == 0 and same.variance == 0


def test_paired_bootstrap(forecasts):
    rows, df = forecasts
    r = metrics.paired_bootstrap(df, times=400).first()
    gap = np.array([(p - w) ** 2 - (q - w) ** 2 for _, p, q, w in rows])
    assert r.difference == pytest.approx(gap.mean()) and r.replicates == 400
    sd = gap.std() / math.sqrt(len(gap))
    assert r.low == pytest.approx(gap.mean() - 1.96 * sd, abs=0.4 * sd) and r.high == pytest.approx(gap.mean() + 1.96 * sd, abs=0.4 * sd)
    assert r.better > 0.95 and tuple(metrics.paired_bootstrap(df, times=400).first()) == tuple(r)


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_quantiles_are_exact(spark, accuracy):
    rng = random.Random(4)
    columns = {
        "normal": [rng.gauss(0, 1) for _ in range(3000)],
        "ties": [float(rng.choice([1, 1, 1, 2, 5])) for _ in range(3000)],
        "holes": [None if rng.random() < 0.5 else rng.random() for _ in range(3000)],
        "two": [3.0, 8.0] + [None] * 2998,
        "one": [4.0] + [None] * 2999,
        "none": [None] * 3000,
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).repartition(4)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    found, seen = profile.quantiles(df, list(columns), shares, accuracy)
    got = {(r.column, r.share): r.value for r in found.collect()}
    for c, values in columns.items():
        there = [v for v in values if v is not None]
        assert seen[c]["n"] == len(there)
        for p in shares:
            assert got.get((c, p)) == (pytest.approx(np.quantile(there, p), abs=1e-12) if there else None), (c, p)


def test_description_in_two_scans(spark):
    df = spark.createDataFrame([(float(i % 7), i, None if i % 3 else "x") for i in range(100)], "a double, b long, c string")
    rows = {r.column: r for r in profile.describe(df, "a", "b").collect()}
    assert (rows["b"].p25, rows["b"].p50, rows["b"].p75, rows["b"].n) == (24.75, 49.5, 74.25, 100) and rows["a"].max == 6.0
    assert {tuple(r) for r in profile.shape(df).collect()} == {("a", 100, 7), ("b", 100, 100), ("c", 100, 1)}
    assert {tuple(r) for r in profile.shape(df.limit(0)).collect()} == {("a", 0, 0), ("b", 0, 0), ("c", 0, 0)}
    none = profile.describe(df.limit(0), "a", "b").collect()
    assert sorted((r.column, r.n, r.p50) for r in none) == [("a", 0, None), ("b", 0, None)]
