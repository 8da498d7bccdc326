"""Mixing sources to target weights by Sainte-Lague apportionment.

Sizes are words. The whole mix is divided into blocks of equal size, and blocks are given to
sources by highest quotients ``target / (2 * seats + 1)``. Sources whose targets are under
``fine_below`` blocks would come out by chance so; they share blocks of one word among themselves,
which is bounded work, since their targets are small. In the same way each source's blocks are given
to its shards (a seeded hash of the document deals a source's documents to as many shards as it needs
at ``shard_words`` each; many shards go by groups of ``group_shards`` first). A shard lays its
documents end to end in seeded order and cuts this stream into equal blocks (a word more or less). A
quota of q blocks over n takes every block ``q // n`` times and a seeded choice of ``q % n`` blocks
once more, so no block and no document is taken more than ``max_repeats`` times. Every decision
depends on ids, sizes and the seed alone: reruns agree.

What reaches the driver: the table of sources with their sizes and targets, which is the mix's own
configuration (a row per source; more than ``most_sources`` are an error). Quotas per shard are rows of
a table and are made in groups of at most ``group_shards`` rows, or as many groups.

Cases: a null text has size 0 and is never taken; a null source is a source and comes last; sources
of size 0 get the target 0; repeated rows are documents of their own, and so are rows that share a
doc_id or have none; an empty table gives an empty result; further columns, whatever their names,
are ignored or carried along.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ladderline.llm.common import one_of_each, stored, table, with_row_ids, words

BLOCK_WORDS = 64
SHARD_WORDS = 500_000
GROUP_SHARDS = 4096
FINE_BELOW = 1000
MOST_SOURCES = 100_000
MAX_REPEATS = 3
WEIGHTS = (5.0, 2.0, 1.0)
SEED = 2026


def capped_targets(sizes: Sequence[float], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Share ``total`` by weight; what is above ``most`` times the size is shared again by weight."""
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        if weight <= 0:
            break
        over = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / weight
            break
        for i in over:
            target[i] = most * float(sizes[i])
        left -= sum(target[i] for i in over)
        open_ -= set(over)
    return target


def sainte_lague(votes: Sequence[float], seats: int, most: Sequence[int] | None = None) -> list[int]:
    """Seats by highest quotients votes / (2 s + 1), ties to the earlier; none gets more than its ``most``.

    A divisor found by bisection gives all but a few seats at once; the last ones go by a heap of quotients.
    """
    v = np.asarray(votes, dtype=float)
    cap = np.full(len(v), np.iinfo(np.int64).max) if most is None else np.asarray(most, dtype=np.int64)
    cap = np.where(v > 0, cap, 0)
    seats = int(min(seats, cap.astype(float).sum())) if len(v) else 0
    if seats <= 0:
        return [0] * len(v)

    def at(divisor: float) -> np.ndarray:
        # seats whose quotient is above the divisor: (2 s - 1) * divisor < votes
        return np.minimum(np.maximum(np.ceil((v / divisor + 1) / 2) - 1, 0), cap).astype(np.int64)

    low, high = 0.0, float(v.max()) + 1
    for _ in range(200):
        mid = (low + high) / 2
        if mid <= 0 or mid in (low, high):
            break
        low, high = (low, mid) if at(mid).sum() <= seats else (mid, high)
    got = at(high)
    heap = [(-v[i] / (2 * got[i] + 1), i) for i in range(len(v)) if got[i] < cap[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < cap[i]:
            heapq.heappush(heap, (-v[i] / (2 * got[i] + 1), i))
    return [int(x) for x in got]


def source_table(
    sizes: list[tuple[str | None, int]], weights: Sequence[float], most: int, block: int, shard_words: int = SHARD_WORDS, fine_below: int = FINE_BELOW
) -> list[tuple]:
    """(source, source_size, target, block, blocks, shards) from (source, size); sources by code point, null last."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    size = [x[1] for x in order]
    target = capped_targets(size, [weights[i % len(weights)] for i in range(len(order))], sum(size), most)
    fine = [t < fine_below * block for t in target]
    out = []
    quota = {}
    for is_fine, words_ in ((True, 1), (False, block)):
        some = [i for i, f in enumerate(fine) if f == is_fine]
        seats = sainte_lague([target[i] for i in some], round(sum(target[i] for i in some) / words_))
        quota |= {i: (words_, n) for i, n in zip(some, seats)}
    for i, (source, n) in enumerate(order):
        out.append((source, int(n), float(target[i]), *quota[i], max(1, -(-int(n) // shard_words))))
    return out


def _apportioned(cells: DataFrame, keys: list[str], by: str) -> DataFrame:
    """``cells`` with ``quota``: their part of ``seats`` (one number for all rows of ``keys``), by ``words``,
    at most ``cap`` each, ties in order of ``by``."""

    def share(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(by)
        p["quota"] = sainte_lague(p["words"].tolist(), int(p["seats"].iloc[0]), p["cap"].tolist())
        return p

    schema = StructType([*cells.schema, StructField("quota", LongType())])
    return cells.groupBy(*keys).applyInPandas(share, schema)


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    most: int = MAX_REPEATS,
    block: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
    group_shards: int = GROUP_SHARDS,
    fine_below: int = FINE_BELOW,
    most_sources: int = MOST_SOURCES,
) -> DataFrame:
    """``docs``: doc_id, source, text, and what else there is. One row per document: doc_id, id (see
    :func:`with_row_ids`), source, size, source_size, target, taken, and how it is taken: ``times`` whole
    and once more the words of ``spans``.

    ``taken`` counts the words that the mix takes of a document, repeats counted.
    """
    spark = docs.sparkSession
    row = F.col("row")
    size = F.regexp_count(F.coalesce(row["text"], F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    rows = with_row_ids(docs, ("source",))
    sized = stored(rows.select("id", row["doc_id"].alias("doc_id"), row["source"].alias("source"), size.alias("size")), "sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(most_sources + 1).collect()
    if len(per_source) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    plan = source_table([(r["source"], int(r["n"])) for r in per_source], weights, most, block, shard_words, fine_below)
    schema = "plan_source string, source_size long, target double, block long, blocks long, shards long"
    sources = F.broadcast(spark.createDataFrame(plan, schema))  # at most most_sources rows
    key = F.xxhash64(F.lit(seed), "id").alias("key")
    dealt = sized.join(sources, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    dealt = dealt.withColumn("key", key).withColumn("shard", F.pmod("key", "shards"))
    cells = dealt.groupBy("source", "shard", "block", "blocks").agg(F.sum("size").alias("words"))
    n_blocks = F.greatest(F.lit(1), F.round(F.col("words") / F.col("block"))).cast("long")
    cells = cells.withColumns({"n_blocks": n_blocks, "group": F.floor(F.col("shard") / group_shards)})
    if max((p[5] for p in plan), default=1) > group_shards:  # groups of shards first, each a bounded table
        cells = stored(cells, "cells")
        groups = cells.groupBy("source", "group", "blocks").agg(F.sum("words").alias("words"), (most * F.sum("n_blocks")).alias("cap"))
        groups = _apportioned(groups.withColumnRenamed("blocks", "seats"), ["source"], "group")
        groups = groups.select(F.col("source").alias("g_source"), F.col("group").alias("g"), F.col("quota").alias("seats"))
        cells = cells.join(groups, F.col("source").eqNullSafe(F.col("g_source")) & (F.col("group") == F.col("g"))).drop("g_source", "g")
    else:
        cells = cells.withColumn("seats", F.col("blocks"))
    cells = cells.select("source", "shard", "group", "words", "n_blocks", "seats", (most * F.col("n_blocks")).alias("cap"))
    quotas = _apportioned(cells, ["source", "group"], "shard")
    q = quotas.select(F.col("source").alias("q_source"), F.col("shard").alias("q_shard"), "words", "n_blocks", "quota")
    # a shard's documents in seeded order; the window's partitions hold shard_words or so each
    line = W.partitionBy("source", "shard").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.withColumn("at", F.coalesce(F.sum("size").over(line), F.lit(0).cast("long")))
    both = placed.join(q, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")))
    n, quota = F.col("n_blocks"), F.col("quota")
    # block b holds the shard's words from b * words div n on; it is chosen once more if its place in a
    # seeded permutation of the shard's blocks is below quota % n
    offset = F.pmod(F.xxhash64(F.lit(seed), F.lit("blocks"), F.col("shard"), F.col("source")), n)
    both = both.withColumns({"stride": _coprime(n), "offset": offset, "whole": F.greatest(F.col("words"), F.lit(1))})
    some = F.col("size") > 0
    both = both.withColumns({"b0": F.expr("((at + 1) * n_blocks - 1) div whole"), "b1": F.expr("((at + size) * n_blocks - 1) div whole")})
    chosen = F.filter(F.sequence("b0", "b1"), lambda b: F.pmod(b * F.col("stride") + F.col("offset"), n) < F.pmod(quota, n))

    def words_in(b: Column) -> Column:
        begin = lambda x: F.floor(x * F.col("words") / n)
        start = F.greatest(F.col("at"), begin(b)) - F.col("at")
        stop = F.least(F.col("at") + F.col("size"), begin(b + 1)) - F.col("at")
        return F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"))

    both = both.withColumn("spans", F.when(some, F.transform(chosen, words_in)).otherwise(F.array()))
    both = both.withColumn("times", F.when(some, F.floor(quota / n)).otherwise(F.lit(0)).cast("long"))
    extra = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    taken = (F.col("times") * F.col("size") + extra).cast("long").alias("taken")
    return both.select("doc_id", "id", "source", "size", "source_size", "target", taken, "times", "spans")


def mixed_documents(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """``docs`` as the plan of :func:`mix` takes them: ``times`` whole copies of each, and one with the
    words of its chosen blocks. Each row goes by its own plan; rows alike in doc_id, text and source are
    as many as their plans."""
    rows = one_of_each(with_row_ids(docs, ("source",)))
    both = plan.where("taken > 0").select("id", "times", "spans").join(rows, "id")
    text = F.col("row")["text"]
    whole = F.when(F.col("times") > 0, F.array_repeat(text, F.col("times").cast("int"))).otherwise(F.array())
    # the words once, not for every span
    cut = lambda w: F.flatten(F.transform("spans", lambda s: F.slice(w, s["start"] + 1, s["stop"] - s["start"])))
    parts = F.get(F.transform(F.array(words(text)), cut), F.lit(0))
    extra = F.when(F.size("spans") > 0, F.array(F.array_join(parts, " "))).otherwise(F.array())
    out = both.select("row", F.explode(F.concat(whole, extra)).alias("cut"))
    row = F.col("row").withField("text", F.col("cut"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("cut").cast(docs.schema["n_chars"].dataType))
    return out.select(row.alias("row")).select("row.*")


#: Fixed primes; the first that does not divide n is a stride through all residues mod n.
STRIDES = (7919, 104_729, 1_299_709, 15_485_863)


def _coprime(n):
    c = F.lit(1).cast("long")
    for p in reversed(STRIDES):
        c = F.when(n % p != 0, F.lit(p).cast("long")).otherwise(c)
    return c


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
