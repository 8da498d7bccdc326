"""Normalising, validating and merging rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ladderline.functions import clean, is_pro

EARLIEST = "2011-01-01 00:00:00"


def normalized(matches: DataFrame) -> DataFrame:
    """Team names cleaned; whatever else there is stays."""
    return matches.withColumns({c: clean(F.col(c)) for c in ("radiant_name", "dire_name") if c in matches.columns})


def issues(now: Column) -> Column:
    """Array of (field, problem, severity): errors block a contest, warnings do not."""

    def issue(when: Column, field: str, problem: str, severity: str) -> Column:
        return F.when(when, F.struct(F.lit(field).alias("field"), F.lit(problem).alias("problem"), F.lit(severity).alias("severity")))

    c, r, d = F.col, F.col("radiant_team_id"), F.col("dire_team_id")
    return F.array_compact(
        F.array(
            issue(c("radiant_win").isNull(), "radiant_win", "missing", "error"),
            issue(r.isNotNull() & d.isNotNull() & (r == d), "teams", "same team on both sides", "error"),
            issue((c("start_time") < F.lit(EARLIEST).cast("timestamp_ntz")) | (c("start_time") > now), "start_time", "out of range", "error"),
            issue(c("duration") <= 0, "duration", "not positive", "error"),
            issue(r.isNull() | d.isNull(), "teams", "a team is missing", "warning"),
            issue(~is_pro(c("league_tier")), "league_tier", "not professional", "warning"),
            issue(c("patch_id").isNull(), "patch_id", "missing", "warning"),
        )
    )


def validation_issues(matches: DataFrame, now: Column) -> DataFrame:
    return matches.select("match_id", F.inline(issues(now)))


def accepted(matches: DataFrame, now: Column) -> DataFrame:
    return matches.where(~F.exists(issues(now), lambda x: x["severity"] == "error"))


def repeats(rows: DataFrame, key: list[str], position: list[str]) -> DataFrame:
    """Every occurrence of a key but the first, in input order."""
    w = W.partitionBy(*key).orderBy(*position)
    return rows.withColumn("occurrence", F.row_number().over(w)).where("occurrence > 1")


def collapsed(batch: DataFrame, key: list[str], position: Column, keep_first: list[str] = ()) -> DataFrame:
    """One row per key: the last occurrence's values, but the first's for ``keep_first``. Aggregates by
    position combine on the map side, so a key that repeats without end is no task's burden."""
    aggs = [
        (F.min_by if c in keep_first else F.max_by)(c, position).alias(c) for c in batch.columns if c not in key and c not in ("position_",)
    ]
    return batch.groupBy(*key).agg(*aggs)


def merged(existing: DataFrame, batch: DataFrame, key: list[str], keep_first: list[str] = ()) -> DataFrame:
    """Keyed merge of a collapsed batch: a null of the batch overwrites, ``keep_first`` columns of
    existing rows stay."""
    old, new = existing.alias("old"), batch.alias("new")
    both = old.join(new, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in key], "full_outer")
    is_new, is_old = F.col(f"new.{key[0]}").isNotNull(), F.col(f"old.{key[0]}").isNotNull()
    cols = []
    for c in existing.columns:
        if c in key:
            cols.append(F.coalesce(f"old.{c}", f"new.{c}").alias(c))
        elif c in keep_first:
            cols.append(F.when(is_old, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c))
        else:
            cols.append(F.when(is_new, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c))
    return both.select(*cols)


def raw_appended(existing: DataFrame, batch: DataFrame, key: tuple[str, ...] = ("source", "endpoint", "content_hash")) -> DataFrame:
    """The rows of a batch that an append-only log does not hold yet, each key once."""
    return batch.dropDuplicates(list(key)).join(existing.select(*key), list(key), "left_anti")


def earliest(matches: DataFrame, n: int) -> DataFrame:
    return matches.orderBy("start_time", "match_id").limit(n)


def rejected_by_reference(children: DataFrame, key: str, reference: DataFrame, ref_key: str, owner: str) -> DataFrame:
    """Owners with a child whose key the reference lacks; all their tables go without them."""
    known = reference.select(F.col(ref_key).alias(key))
    return children.where(F.col(key).isNotNull()).join(known, key, "left_anti").select(owner).distinct()


def violations(table: DataFrame, primary: list[str], not_null: list[str] = (), references: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """(check, n) for each constraint that a table breaks."""
    spark = table.sparkSession
    parts = [table.groupBy(*primary).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("primary key").alias("check"), "n")]
    parts += [table.where(F.col(c).isNull()).agg(F.count("*").alias("n")).select(F.lit(f"not null {c}").alias("check"), "n") for c in not_null]
    for c, (ref, k) in (references or {}).items():
        lost = table.where(F.col(c).isNotNull()).join(ref.select(F.col(k).alias(c)).distinct(), c, "left_anti")
        parts.append(lost.agg(F.count("*").alias("n")).select(F.lit(f"foreign key {c}").alias("check"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("n > 0") if parts else spark.createDataFrame([], "check string, n long")
