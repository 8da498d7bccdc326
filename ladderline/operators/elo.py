"""Ratings that walk forward through contests in order (start_time, match_id).

Each step depends on both teams' last steps, so a pool (teams that meet directly or through others) is
one ordered stream. Pools are independent and run in parallel; unless a column names them, they are
found. A pool's narrow columns are sorted by Spark and folded batch by batch: a task holds the teams'
ratings and one batch, never the history. Contests without an outcome, or without both teams, are not
rated.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ladderline.operators.pools import with_pools

K_FACTOR, BASE = 32.0, 1000.0
RATED = "match_id long, start_time timestamp_ntz, radiant_team_id long, dire_team_id long, radiant_win boolean, radiant_pre double, dire_pre double, radiant_post double, dire_post double"


def elo_step(r: float, d: float, radiant_win: bool, k: float = K_FACTOR) -> tuple[float, float]:
    e = 1.0 / (1.0 + 10.0 ** ((d - r) / 400.0))
    s = 1.0 if radiant_win else 0.0
    return r + k * (s - e), d + k * ((1.0 - s) - (1.0 - e))


FOUND = "pools that are found"


def _in_order(matches: DataFrame, pool: str | None, initial: DataFrame | None) -> DataFrame:
    """Contests of each pool together and in order, behind the ratings that its teams begin with."""
    ready = matches.where("radiant_win is not null and radiant_team_id is not null and dire_team_id is not null")
    if pool == FOUND:
        ready, pool = with_pools(ready, "pool_"), "pool_"
    rows = ready.select(
        (F.col(pool) if pool else F.lit(0)).alias("pool_"), F.col("match_id").cast("long"), F.col("start_time").cast("timestamp_ntz"),
        F.col("radiant_team_id").cast("long"), F.col("dire_team_id").cast("long"), "radiant_win", F.lit(None).cast("double").alias("begins_at"),
    )
    if initial is not None:
        none = lambda kind: F.lit(None).cast(kind)
        rows = rows.unionByName(initial.select(
            (F.col(pool) if pool else F.lit(0)).alias("pool_"), none("long").alias("match_id"), none("timestamp_ntz").alias("start_time"),
            F.col("team_id").cast("long").alias("radiant_team_id"), none("long").alias("dire_team_id"), none("boolean").alias("radiant_win"), F.col("rating").alias("begins_at"),
        ))
    return rows.repartition("pool_").sortWithinPartitions("pool_", F.asc_nulls_first("start_time"), "match_id")


def _folded(matches: DataFrame, pool: str | None, start: Callable[[], Callable], added: list[str], schema: str, initial: DataFrame | None = None) -> DataFrame:
    """``start()`` begins a pool and gives its step: (radiant, dire, radiant_win) -> the ``added`` columns.
    With ``initial`` ratings (team_id, rating and the pool's column) the step is called with these first,
    as (team, rating)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step, current = None, None
        for p in batches:
            out, begins = [], p["begins_at"].notna().to_numpy()
            for pool_, r, d, won, begin, at in zip(p["pool_"], p["radiant_team_id"], p["dire_team_id"], p["radiant_win"], begins, p["begins_at"]):
                if step is None or pool_ != current:
                    step, current = start(), pool_
                if begin:
                    step(r, at)
                else:
                    out.append(step(r, int(d), won))
            p = p[~begins].copy()
            p[added] = pd.DataFrame(out, index=p.index, columns=added)
            yield p[[c.split()[0] for c in schema.split(", ")]]

    return _in_order(matches, pool, initial).mapInPandas(run, schema)


def rated(matches: DataFrame, k: float = K_FACTOR, base: float = BASE, pool: str | None = FOUND, initial: DataFrame | None = None, named: bool = False) -> DataFrame:
    """Each contest with both ratings before and after it. ``pool``: column of independent pools (FOUND:
    they are found, None: all is one); ``initial``: ratings (team_id, rating, pool) that teams begin with;
    ``named``: also the pool, as a number pool_."""

    def start():
        now: dict[int, float] = {}

        def step(r, d, won=None):
            if won is None:
                now[r] = d
                return None
            a, b = now.get(r, base), now.get(d, base)
            x, y = elo_step(a, b, won, k)
            now[r] = x
            now[d] = y  # a team against itself: the dire side is written last
            return a, b, x, y

        return step

    return _folded(matches, pool, start, ["radiant_pre", "dire_pre", "radiant_post", "dire_post"], RATED + ", pool_ long" * named, initial)


def ranked(matches: DataFrame, k: float = K_FACTOR, base: float = BASE, pool: str | None = FOUND) -> DataFrame:
    """match_id, radiant_rank, dire_rank: each side's place by rating before the contest, among the teams
    of its pool that had played by then (equal ratings share a place); null for a team that hadn't.

    The fold keeps the ratings sorted, so a contest costs two searches, and no contest is held against
    all teams.
    """

    def start():
        now: dict[int, float] = {}
        order: list[float] = []

        def put(team, rating):
            if team in now:
                del order[bisect_left(order, now[team])]
            insort(order, rating)
            now[team] = rating

        def step(r, d, won):
            place = [len(order) - bisect_right(order, now[t]) + 1 if t in now else None for t in (r, d)]
            x, y = elo_step(now.get(r, base), now.get(d, base), won, k)
            put(r, x)
            put(d, y)
            return place

        return step

    return _folded(matches, pool, start, ["radiant_rank", "dire_rank"], "match_id long, radiant_rank long, dire_rank long")


def rating_log(ratings: DataFrame, k: float = K_FACTOR, version: str = "elo_k32_base1000") -> DataFrame:
    """One row per team and contest: rating before and after."""
    sides = F.array(
        F.struct(F.col("radiant_team_id").alias("team_id"), F.col("radiant_pre").alias("rating_before"), F.col("radiant_post").alias("rating_after")),
        F.struct(F.col("dire_team_id").alias("team_id"), F.col("dire_pre").alias("rating_before"), F.col("dire_post").alias("rating_after")),
    )
    return ratings.select("match_id", "start_time", F.inline(sides), F.lit(k).alias("k_factor"), F.lit(version).alias("engine_version"))


def current_ratings(log: DataFrame) -> DataFrame:
    return log.groupBy("team_id").agg(F.max_by("rating_after", F.struct("start_time", "match_id")).alias("rating"))


def elo_trend(log: DataFrame, back: int = 5) -> DataFrame:
    """Rating before a contest less the one ``back`` contests earlier."""
    w = W.partitionBy("team_id").orderBy("start_time", "match_id")
    return log.select("match_id", "team_id", (F.col("rating_before") - F.lag("rating_before", back).over(w)).alias("elo_delta"))


#: Deviation (over 173.7178) of a team that hasn't played; none is above it, as in Glickman's rules.
UNRATED = 350 / 173.7178


def glicko2_step(mu: float, phi: float, sigma: float, mu2: float, phi2: float, won: bool, tau: float = 0.5) -> tuple[float, float, float]:
    """A team's rating, deviation and volatility after a contest with (mu2, phi2).

    Whatever the ratings, no number overflows: variances are held over e ** |x|, and an expectation that
    rounds to 0 or 1 is never divided by. |x| counts up to 300 (some 52,000 points).
    """
    g = 1 / math.sqrt(1 + 3 * phi2**2 / math.pi**2)
    x = max(-300.0, min(300.0, g * (mu - mu2)))
    far, a = abs(x), 2 * math.log(sigma)
    small = math.exp(-far)  # the smaller of the two odds
    upset = (x < 0) == won
    miss = (1.0 if upset else small) / (1 + small)  # by how much the expectation was off
    v = ((1 + small) / g) ** 2  # this, phi ** 2, delta ** 2 and e ** y are held over e ** far
    q, delta = v + phi**2 * small, v / small if upset else v * small

    def f(y: float) -> float:
        e = math.exp(y - far)
        return e / (q + e) * (delta / (q + e) - 1) / 2 - (y - a) / tau**2

    lo, steps = a, 0
    if delta > q:
        hi = math.log(delta - q) + far
    else:
        hi = a - tau
        while f(hi) < 0:
            hi -= tau
    flo, fhi = f(lo), f(hi)
    while abs(hi - lo) > 1e-6:
        c = lo + (lo - hi) * flo / (fhi - flo) if steps < 200 else (lo + hi) / 2  # where f is too steep, halves
        fc = f(c)
        if fc * fhi <= 0:
            lo, flo = hi, fhi
        elif steps < 200:
            flo /= 2
        hi, fhi = c, fc
        steps += 1
    sigma = math.exp(lo / 2)
    new = min(1 / math.sqrt((1 / math.hypot(phi, sigma)) ** 2 + small / v), UNRATED)
    return mu + new**2 * g * (miss if won else -miss), new, sigma


def glicko2(matches: DataFrame, tau: float = 0.5, pool: str | None = FOUND) -> DataFrame:
    """Glicko-2 ratings and deviations before each contest, a rating period per contest."""
    schema = "match_id long, radiant_rating double, radiant_rd double, dire_rating double, dire_rd double"

    def start():
        now: dict[int, tuple[float, float, float]] = {}

        def step(r, d, won):
            a, b = now.get(r, (0.0, UNRATED, 0.06)), now.get(d, (0.0, UNRATED, 0.06))
            now[r], now[d] = glicko2_step(*a, *b[:2], bool(won), tau), glicko2_step(*b, *a[:2], not won, tau)
            return 1500 + 173.7178 * a[0], 173.7178 * a[1], 1500 + 173.7178 * b[0], 173.7178 * b[1]

        return step

    return _folded(matches, pool, start, ["radiant_rating", "radiant_rd", "dire_rating", "dire_rd"], schema)
