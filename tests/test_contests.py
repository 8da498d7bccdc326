"""Golden rows, and what must hold of any history: nothing sees its own or a later outcome."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ladderline.operators import asof, elo, metrics, records, teams
from ladderline.plans import dataset, models

# match, day, radiant, dire, radiant_win -> elos, form, rest days, played
GOLDEN = [
    (7001, "2024-01-01", 100, 200, False, 1000, 1000, None, None, None, None, 0, 0),
    (7002, "2024-01-04", 400, 300, True, 1000, 1000, None, None, None, None, 0, 0),
    (7003, "2024-01-07", 100, 300, True, 984, 984, 0, 0, 6, 3, 1, 1),
    (7004, "2024-01-10", 400, 200, False, 1016, 1016, 1, 1, 6, 9, 1, 1),
    (7005, "2024-01-13", 100, 400, True, 1000, 1000, 0.5, 0.5, 6, 3, 2, 2),
    (7006, "2024-01-16", 300, 200, True, 968, 1032, 0, 1, 9, 6, 2, 2),
    (7007, "2024-01-19", 100, 200, False, 1016, 1013.085581, 0.666667, 0.666667, 6, 3, 3, 3),
    (7008, "2024-01-22", 400, 300, True, 984, 986.914419, 0.333333, 0.333333, 9, 6, 3, 3),
    (7009, "2024-01-25", 100, 300, True, 999.865789, 970.780208, 0.5, 0.25, 6, 3, 4, 4),
    (7010, "2024-01-28", 400, 200, False, 1000.134211, 1029.219792, 0.5, 0.75, 6, 9, 4, 4),
    (7011, "2024-01-31", 100, 400, True, 1014.529469, 985.470531, 0.6, 0.4, 6, 3, 5, 5),
    (7012, "2024-02-03", 300, 200, True, 956.116528, 1043.883472, 0.2, 0.8, 9, 6, 5, 5),
]
SCHEMA = "match_id long, start_time timestamp_ntz, radiant_team_id long, dire_team_id long, radiant_win boolean"


def frame(spark, rows):
    return spark.createDataFrame([(r[0], dt.datetime.fromisoformat(r[1]), r[2], r[3], r[4]) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def golden(spark):
    return frame(spark, GOLDEN)


def test_feature_set_matches_the_golden_rows(golden):
    got = dataset.feature_set_0(golden)
    assert got.columns == dataset.COLUMNS
    names = [
        "radiant_elo", "dire_elo", "radiant_recent_winrate", "dire_recent_winrate", "radiant_days_since_last_match",
        "dire_days_since_last_match", "radiant_matches_played_before", "dire_matches_played_before",
    ]
    for row, want in zip(got.orderBy("match_id").collect(), GOLDEN):
        assert [row[n] for n in names] == [w if w is None else pytest.approx(w, abs=1e-6) for w in want[5:]]


def test_backtest_metrics_and_final_ratings(golden):
    m = metrics.summary(models.backtest(golden)).first()
    assert (m.accuracy, m.log_loss, m.brier) == (pytest.approx(0.5), pytest.approx(0.714942, abs=1e-6), pytest.approx(0.260564, abs=1e-6))
    now = {r.team_id: r.rating for r in elo.current_ratings(elo.rating_log(elo.rated(golden))).collect()}
    assert now == {100: pytest.approx(1029.194367), 200: pytest.approx(1023.925489), 300: pytest.approx(976.074511), 400: pytest.approx(970.805633)}


def test_pools_that_are_found_change_nothing(golden):
    assert sorted(map(repr, elo.rated(golden).collect())) == sorted(map(repr, elo.rated(golden, pool=None).collect()))


def rows_by_id(df):
    return {r.match_id: r for r in df.collect()}


@pytest.mark.parametrize("k", range(12))
def test_an_outcome_changes_later_rows_only(spark, golden, k):
    base = rows_by_id(dataset.feature_set_0(golden))
    flipped = [(*r[:4], r[4] != (i == k)) for i, r in enumerate(GOLDEN)]
    for m, row in rows_by_id(dataset.feature_set_0(frame(spark, flipped))).items():
        if m < GOLDEN[k][0]:
            assert row == base[m]
        elif m == GOLDEN[k][0]:
            assert row[:-1] == base[m][:-1] and row.radiant_win != base[m].radiant_win
    short = rows_by_id(dataset.feature_set_0(frame(spark, GOLDEN[: k + 1])))
    assert all(base[m] == row for m, row in short.items())


def test_input_order_does_not_matter(spark, golden):
    assert rows_by_id(dataset.feature_set_0(frame(spark, GOLDEN[::-1]))) == rows_by_id(dataset.feature_set_0(golden))


def test_long_features_negate_the_dire_side(golden):
    import json

    rows = dataset.long_features(dataset.feature_set_0(golden)).collect()
    by = {(r.match_id, json.loads(r.features)["is_radiant"]): json.loads(r.features) for r in rows}
    assert len(rows) == 24 and by[7006, True]["elo_difference"] == -64 and by[7006, False]["elo_difference"] == 64
    assert by[7001, False]["recent_winrate_difference"] is None


def test_a_merge_twice_is_a_merge_once(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, name string, first int")
    batch = spark.createDataFrame([(2, "x", 99, 0), (2, None, 98, 1), (3, "c", 30, 0)], "id int, name string, first int, pos int")
    new = records.collapsed(batch, ["id"], F.col("pos"), ["first"]).select("id", "name", "first")
    once = records.merged(old, new, ["id"], ["first"])
    assert sorted(map(tuple, once.collect())) == [(1, "a", 10), (2, None, 20), (3, "c", 30)]
    assert records.merged(once, new, ["id"], ["first"]).exceptAll(once).isEmpty()


def test_a_large_calendar_gives_the_same_versions(spark, golden):
    cal = spark.createDataFrame([(1, dt.datetime(2024, 1, 5)), (2, dt.datetime(2024, 1, 20))], "patch_id int, released_at timestamp_ntz")
    small, large = (asof.version_of(golden, cal, most).select("match_id", "patch_id") for most in (10, 1))
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))


def test_probabilities_are_of_a_whole(golden):
    p = models.EloRule().fit(golden).predict(dataset.feature_set_0(golden))
    other = p.selectExpr("dire_elo radiant_elo", "radiant_elo dire_elo", "match_id", "p q")
    both = models.EloRule().fit(golden).predict(other)
    assert both.where(F.abs(F.col("p") + F.col("q") - 1) > 1e-12).isEmpty()
    with pytest.raises(RuntimeError):
        models.EloRule().predict(golden)


def test_empty_metrics(golden):
    m = metrics.summary(models.backtest(golden).limit(0)).first()
    assert (m.accuracy, m.log_loss, m.brier, m.n) == (0.0, 0.0, 0.0, 0)
    with pytest.raises(ValueError):
        models.EloRule().fit(golden).evaluate(dataset.feature_set_0(golden).limit(0))


def test_teams_that_never_met(golden):
    h = rows_by_id(teams.head_to_head(golden))
    assert h[7001].meetings == 0 and h[7001].radiant_share is None and h[7007].meetings == 1 and h[7007].radiant_share == 0.0
