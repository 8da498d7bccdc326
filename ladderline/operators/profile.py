"""Profiles of tables: null shares, balance, description, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def null_fractions(df: DataFrame) -> DataFrame:
    """(column, fraction) for every column, in one pass."""
    sums = df.agg(*[F.coalesce(F.avg(F.col(c).isNull().cast("int")), F.lit(0.0)).alias(c) for c in df.columns])
    return sums.unpivot([], sums.columns, "column", "fraction")


def shape(df: DataFrame) -> DataFrame:
    """(column, rows, distinct) for every column: rows of the table and values of the column, null apart.
    One scan and one shuffle for all columns; values are told apart by their text."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns])
    values = df.select(F.inline(cells)).groupBy("column", "value").agg(F.count("*").alias("n"))
    found = values.groupBy("column").agg(F.sum("n").alias("rows"), F.count("value").alias("distinct"))
    names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")  # an empty table has its columns all the same
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return names.join(found, "column", "left").select("column", zero("rows"), zero("distinct"))


def class_balance(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("total")).alias("share"))  # one row


#: Ranks that a bracket may lie beside a quantile: rows / ACCURACY.
ACCURACY = 10_000


def quantiles(df: DataFrame, columns: list[str], shares: list[float], accuracy: int = ACCURACY) -> tuple[DataFrame, dict]:
    """Exact interpolated quantiles: (column, share, value), and the first scan's figures of each column.

    The first scan brackets each quantile of all columns by Spark's quantile sketch, whose rank error is
    known. The second counts what lies below a bracket and the values inside, a few in ``accuracy`` of the
    rows, and selects among these.
    """
    near = sorted({min(max(p + by, 0.0), 1.0) for p in shares for by in (-2 / accuracy, 2 / accuracy)})
    value = lambda c: F.col(f"`{c}`").cast("double")
    figures = lambda c: F.struct(
        F.count(value(c)).alias("n"), F.avg(value(c)).alias("mean"), F.stddev_samp(value(c)).alias("std"), F.min(value(c)).alias("min"), F.max(value(c)).alias("max"),
        F.percentile_approx(value(c), near, accuracy).alias("near"),
    )
    first = df.agg(*[figures(c).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    seen = {c: first[f"c{i}"] for i, c in enumerate(columns)}
    cells, asked = [], []
    for c in columns:
        if not seen[c]["n"]:
            continue
        at = dict(zip(near, seen[c]["near"]))
        for p in shares:
            lo, hi = (at[min(max(p + by, 0.0), 1.0)] for by in (-2 / accuracy, 2 / accuracy))
            v = value(c)
            side = F.when(v < lo, -1).when(v > hi, 1).when(v.isNotNull(), 0)
            inside = F.when((v >= lo) & (v <= hi), v)
            cells.append(F.struct(F.lit(c).alias("column"), F.lit(p).alias("share"), side.alias("side"), inside.alias("inside"), v.alias("v")))
            asked.append((c, p, float(p * (seen[c]["n"] - 1))))
    spark = df.sparkSession
    if not cells:
        return spark.createDataFrame([], "column string, share double, value double"), seen
    counts = df.select(F.inline(F.array(*cells))).where("side is not null").groupBy("column", "share", "side", "inside")
    counts = counts.agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    w = W.partitionBy("column", "share").orderBy("side", "inside")  # the values inside a bracket
    upto = F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0))
    ranked = counts.withColumn("last", upto - 1).withColumn("first", F.col("last") - F.col("n") + 1)
    both = ranked.join(F.broadcast(spark.createDataFrame(asked, "column string, share double, at double")), ["column", "share"])
    # what lies beside a bracket is known by its nearest value: the greatest below, the least above
    held = lambda rank: F.max(F.when((F.col("first") <= rank) & (rank <= F.col("last")), F.when(F.col("side") < 0, F.col("most")).otherwise(F.col("least"))))
    low, high = held(F.floor("at")), held(F.ceil("at"))
    part = F.first("at") - F.floor(F.first("at"))
    return both.groupBy("column", "share").agg((low + (high - low) * part).alias("value")), seen


def describe(df: DataFrame, *columns: str) -> DataFrame:
    """count, mean, std, min, quartiles and max of each column: two scans, however many columns."""
    found, seen = quantiles(df, list(columns), [0.25, 0.5, 0.75])
    rows = [(c, s["n"], s["mean"], s["std"], s["min"], s["max"]) for c, s in seen.items()]
    base = df.sparkSession.createDataFrame(rows, "column string, n long, mean double, std double, min double, max double")
    wide = found.groupBy("column").agg(*[F.max(F.when(F.col("share") == p, F.col("value"))).alias(f"p{int(100 * p)}") for p in (0.25, 0.5, 0.75)])
    return base.join(wide, "column", "left").select("column", "n", "mean", "std", "min", "p25", "p50", "p75", "max")


def coverage(matches: DataFrame, key, name: str) -> DataFrame:
    return matches.groupBy(key.alias(name)).agg(
        F.count("*").alias("n"), F.countDistinct("radiant_team_id").alias("teams"), F.avg(F.col("radiant_win").cast("int")).alias("radiant_share")
    )


def missing_counters(matches: DataFrame, players: DataFrame, picks: DataFrame) -> DataFrame:
    """One row: contests, those without a tier, version, player rows or draft rows."""
    has_p = players.select("match_id").distinct().withColumn("p_", F.lit(True))
    has_d = picks.select("match_id").distinct().withColumn("d_", F.lit(True))
    m = matches.join(has_p, "match_id", "left").join(has_d, "match_id", "left")
    none = lambda c: F.count_if(F.col(c).isNull())
    return m.agg(
        F.count("*").alias("matches"), none("league_tier").alias("without_tier"), none("patch_id").alias("without_patch"),
        none("p_").alias("without_players"), none("d_").alias("without_draft"),
    )
