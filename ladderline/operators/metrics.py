"""Forecast metrics as aggregates over rows (p, won)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CLIP = 1e-15
ROC_BINS = 10_000


def _y() -> Column:
    return F.col("won").cast("int").cast("double")


def accuracy() -> Column:
    return F.avg(((F.col("p") >= 0.5) == F.col("won")).cast("int"))


def log_loss() -> Column:
    p = F.least(F.greatest(F.col("p"), F.lit(CLIP)), F.lit(1 - CLIP))
    return F.avg(-(_y() * F.ln(p) + (1 - _y()) * F.ln(1 - p)))


def brier() -> Column:
    return F.avg(F.pow(F.col("p") - _y(), F.lit(2.0)))


def summary(rows: DataFrame, *by: str) -> DataFrame:
    """accuracy, log_loss, brier and n; 0.0 each for no rows."""
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    return rows.groupBy(*by).agg(zero(accuracy(), "accuracy"), zero(log_loss(), "log_loss"), zero(brier(), "brier"), F.count("*").alias("n"))


def sliced(rows: DataFrame, first: str, second: str) -> DataFrame:
    """By each of two columns and in all; a null slice value where the column doesn't cut."""
    g = rows.groupingSets([[first], [second], []], first, second)
    return g.agg(accuracy().alias("accuracy"), log_loss().alias("log_loss"), brier().alias("brier"), F.count("*").alias("n"))


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.avg("p").alias("mean_p"), F.avg(_y()).alias("share_won"), F.count("*").alias("n"))


def roc_auc(rows: DataFrame) -> DataFrame:
    """Rank-sum with mid-ranks for ties. Counts per distinct forecast come first. These are ordered
    within each of ``ROC_BINS`` ranges of forecasts, and what lies below a range is a sum over ranges."""
    per = rows.groupBy("p").agg(F.sum(_y()).alias("pos"), F.count("*").alias("n"))
    per = per.withColumn("bin", F.floor(F.col("p") * ROC_BINS))
    bins = per.groupBy("bin").agg(F.sum("n").alias("m"))  # at most ROC_BINS rows and one
    base = F.coalesce(F.sum("m").over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base")
    per = per.join(F.broadcast(bins.select("bin", base)), "bin")
    line = W.partitionBy("bin").orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    below = F.col("base") + F.coalesce(F.sum("n").over(line), F.lit(0))
    ranked = per.select("pos", "n", (below + (F.col("n") + 1) / 2).alias("rank"))
    t = ranked.agg(F.sum(F.col("pos") * F.col("rank")).alias("s"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return t.select(((F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))).alias("roc_auc"))


def confusion(rows: DataFrame) -> DataFrame:
    said, y = F.col("p") >= 0.5, F.col("won")
    t = rows.agg(F.count_if(said & y).alias("tp"), F.count_if(said & ~y).alias("fp"), F.count_if(~said & y).alias("fn"))
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / (F.col("tp") + F.col("fn"))
    return t.select(precision.alias("precision"), recall.alias("recall"), (2 * precision * recall / (precision + recall)).alias("f1"))


def _placed(rows: DataFrame, p: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the share of the other class that a row's forecast is right of (ties half).
    Counts per distinct forecast are ordered within ranges, as for :func:`roc_auc`; no row meets another."""
    per = rows.groupBy(p).agg(F.sum(_y()).alias("pos_"), F.sum(1 - _y()).alias("neg_")).withColumn("bin_", F.floor(F.col(p) * ROC_BINS))
    bins = per.groupBy("bin_").agg(F.sum("pos_").alias("p_"), F.sum("neg_").alias("n_"))  # at most ROC_BINS rows and one
    before, all_ = W.orderBy("bin_").rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    sums = [F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"{c}base") for c in ("p_", "n_")]
    per = per.join(F.broadcast(bins.select("bin_", *sums, *[F.sum(c).over(all_).alias(f"{c}all") for c in ("p_", "n_")])), "bin_")
    line = W.partitionBy("bin_").orderBy(p).rowsBetween(W.unboundedPreceding, -1)
    below = lambda c, base: F.col(base) + F.coalesce(F.sum(c).over(line), F.lit(0.0)) + F.col(c) / 2
    per = per.select(p, (below("neg_", "n_base") / F.col("n_all")).alias("over_"), (1 - below("pos_", "p_base") / F.col("p_all")).alias("under_"))
    return rows.join(per, p).withColumn(name, F.when(F.col("won"), F.col("over_")).otherwise(F.col("under_"))).drop("over_", "under_")


def delong(rows: DataFrame) -> DataFrame:
    """Of rows (p, q, won) one row: both AUCs, their difference, its variance by DeLong's placements, z and
    the 95 % interval. The two AUCs are of the same rows, so their covariance is in the variance; z is null
    where that is zero."""
    both = _placed(_placed(rows, "p", "vp"), "q", "vq").withColumn("d", F.col("vp") - F.col("vq"))
    won, lost = F.col("won"), ~F.col("won")
    of = lambda c, when: F.when(when, F.col(c))
    t = both.agg(
        F.avg(of("vp", won)).alias("auc_p"), F.avg(of("vq", won)).alias("auc_q"),
        (F.try_divide(F.var_samp(of("d", won)), F.count_if(won)) + F.try_divide(F.var_samp(of("d", lost)), F.count_if(lost))).alias("variance"),
    )
    gap, sd = F.col("auc_p") - F.col("auc_q"), F.sqrt("variance")
    return t.select("auc_p", "auc_q", gap.alias("difference"), "variance", F.try_divide(gap, sd).alias("z"), (gap - 1.959963984540054 * sd).alias("low"), (gap + 1.959963984540054 * sd).alias("high"))


def poisson_weight(key: str, replicate: Column) -> Column:
    """How often a row is in a replicate: Poisson of mean one, by a hash, so a rerun agrees."""
    u = F.pmod(F.xxhash64(key, replicate), F.lit(1_000_000)) / 1_000_000
    weight, total, term = F.lit(0), 0.0, 2.718281828459045**-1
    for k in range(1, 8):
        total += term
        weight = weight + (u > total).cast("int")
        term /= k
    return weight


def _replicated(rows: DataFrame, key: str, times: int) -> DataFrame:
    each = rows.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(times))))
    return each.withColumn("w", poisson_weight(key, F.col("replicate"))).where("w > 0")


def bootstrap(rows: DataFrame, key: str = "match_id", times: int = 50) -> DataFrame:
    """Brier score of ``times`` Poisson bootstrap replicates; weights come from hashes, so it is one pass."""
    loss = F.pow(F.col("p") - _y(), F.lit(2.0))
    return _replicated(rows, key, times).groupBy("replicate").agg((F.sum(F.col("w") * loss) / F.sum("w")).alias("brier"))


def paired_bootstrap(rows: DataFrame, key: str = "match_id", times: int = 200, level: float = 0.95) -> DataFrame:
    """Of rows (key, p, q, won) one row: the Brier score of p less that of q, its percentile interval over
    replicates that weigh both forecasts of a row alike, and the share of replicates where p is better.
    The interval is of ``times`` numbers."""
    gap = F.pow(F.col("p") - _y(), F.lit(2.0)) - F.pow(F.col("q") - _y(), F.lit(2.0))
    per = _replicated(rows, key, times).groupBy("replicate").agg((F.sum(F.col("w") * gap) / F.sum("w")).alias("gap"))
    tail = (1 - level) / 2
    spread = per.agg(F.percentile("gap", [tail, 1 - tail]).alias("q"), F.avg((F.col("gap") < 0).cast("int")).alias("better"), F.count("*").alias("replicates"))
    return rows.agg(F.avg(gap).alias("difference")).crossJoin(F.broadcast(spread)).select("difference", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "better", "replicates")
