"""Rolling retraining: all fits at once, with the results of fits one by one."""

import datetime as dt
import math
import random

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from ladderline.plans import models

START = dt.datetime(2020, 1, 1)
SCHEMA = "as_of_timestamp timestamp_ntz, radiant_elo double, dire_elo double, elo_difference double, recent_winrate_difference double, radiant_win boolean"


def contests(spark, n, won, days=1.0):
    rng, rows = random.Random(3), []
    for i in range(n):
        x = rng.gauss(0, 200)
        form = rng.choice([None, -0.4, 0.0, 0.2]) if i else 0.6
        rows.append((START + dt.timedelta(days=i * days), 1000 + x, 1000.0, x, form, won(i, x, rng)))
    return spark.createDataFrame(rows, SCHEMA)


def likely(i, x, rng):
    return i < 25 or rng.random() < 1 / (1 + 10 ** (-x / 200))  # one outcome only at first


def jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_jobs_do_not_grow_with_the_number_of_fits(spark):
    data = contests(spark, 300, likely).coalesce(2).persist()
    few = jobs(spark, "few fits", lambda: models.rolling_retrain(data, every_days=100).collect())
    many = jobs(spark, "many fits", lambda: models.rolling_retrain(data, every_days=10).collect())
    assert many < few + 15  # a fit alone takes about that many


def test_results_are_those_of_fits_one_by_one(spark):
    data = contests(spark, 300, likely).coalesce(2).persist()
    got = {r.cutoff: r for r in models.rolling_retrain(data, every_days=20).collect()}
    assert sorted(got) == [START + dt.timedelta(days=x) for x in range(40, 300, 20)]  # no fit at day 20
    for days in (40, 160, 280):
        cut, end = (F.lit(START + dt.timedelta(days=x)).cast("timestamp_ntz") for x in (days, days + 20))
        at = F.col("as_of_timestamp")
        one = models.Learned(LogisticRegression(maxIter=500, tol=1e-14)).fit(data.where(at < cut))
        want = one.evaluate(data.where((at >= cut) & (at < end)))
        r = got[START + dt.timedelta(days=days)]
        assert r.n == 20 and r.accuracy == want["accuracy"]
        assert (r.log_loss, r.brier) == pytest.approx((want["log_loss"], want["brier"]), abs=1e-6)


def test_cutoffs_are_exact_to_the_moment(spark):
    data = contests(spark, 81, lambda i, x, rng: i % 2 == 0, days=0.25)  # the last one is day 20, a cutoff
    got = {r.cutoff: r.n for r in models.rolling_retrain(data, every_days=10).collect()}
    assert got == {START + dt.timedelta(days=10): 40, START + dt.timedelta(days=20): 1}


def test_classes_that_can_be_parted_and_constant_features(spark):
    data = contests(spark, 100, lambda i, x, rng: x > 0).withColumn("recent_winrate_difference", F.lit(0.1))
    got = models.rolling_retrain(data, every_days=30).collect()
    assert len(got) == 3 and all(math.isfinite(r.log_loss) and r.accuracy > 0.9 for r in got)


def test_without_rows_or_with_one_outcome_there_is_no_round(spark):
    assert models.rolling_retrain(contests(spark, 0, likely)).collect() == []
    assert models.rolling_retrain(contests(spark, 200, lambda i, x, rng: True)).collect() == []
