"""The contest queries by name, and the SQL that each must agree with.

A walk through ratings is a fold over the ordered list of contests in SQL. Queries without SQL (models,
bootstrap, volatility) are tested against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ladderline.functions import clean, confidence, is_pro
from ladderline.operators import asof, elo, metrics, pools, profile, records, rosters, teams
from ladderline.plans import dataset, models, replay, serving
from ladderline.plans import views as v
from ladderline.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CONTESTS = """contests AS (SELECT o_orderkey match_id, o_orderdate start_time, o_custkey % 25 radiant_team_id,
 (o_custkey % 25 + 1 + o_orderkey % 24) % 25 dire_team_id, o_totalprice > 200000 radiant_win,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'premium' WHEN '2-HIGH' THEN 'professional' ELSE 'amateur' END league_tier,
 o_orderpriority league_id FROM orders)"""
TEAMS = """tc AS (SELECT match_id, start_time, radiant_team_id team_id, dire_team_id opponent_id, true is_radiant, radiant_win won FROM contests
 UNION ALL SELECT match_id, start_time, dire_team_id, radiant_team_id, false, NOT radiant_win FROM contests)"""
VERSIONS = """versions AS (SELECT date_trunc('quarter', o_orderdate)::TIMESTAMP released_at,
 row_number() OVER (ORDER BY date_trunc('quarter', o_orderdate)::TIMESTAMP) patch_id FROM (SELECT DISTINCT date_trunc('quarter', o_orderdate)::TIMESTAMP o_orderdate FROM orders)),
 versioned AS (SELECT c.*, x.patch_id, x.released_at FROM contests c ASOF LEFT JOIN versions x ON c.start_time >= x.released_at)"""
CHILDREN = """children AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) rn FROM lineitem)"""
PLAYERS = """players AS (SELECT match_id, start_time, CASE WHEN rn % 2 = 1 THEN radiant_team_id ELSE dire_team_id END team_id, rn % 2 = 1 is_radiant, rn,
 l_suppkey account_id, l_quantity kills FROM children JOIN contests ON l_orderkey = match_id)"""
PICKS = """picks AS (SELECT match_id, start_time, patch_id, CASE WHEN rn % 2 = 1 THEN radiant_team_id ELSE dire_team_id END team_id, rn ord, l_partkey hero_id,
 l_returnflag <> 'R' is_pick, CASE WHEN rn % 2 = 1 THEN radiant_win ELSE NOT radiant_win END won FROM children JOIN versioned ON l_orderkey = match_id)"""
SIDES = """sides AS (SELECT match_id, start_time, team_id, list_sort(list_distinct(list(account_id))) lineup FROM players GROUP BY ALL)"""
FORECASTS = """f AS (SELECT match_id, start_time, league_tier, 0.5::DOUBLE + (radiant_team_id - dire_team_id) / 60::DOUBLE p, radiant_win won FROM contests)"""
BY_TEAM = "PARTITION BY team_id ORDER BY start_time, match_id"


def elo_sql(contests: str, teams: int = 25) -> str:
    """Views ``elo`` (each of ``contests``, numbered, with both ratings before and after) and ``log`` (a row
    per team): a fold whose state is the list of all ratings."""
    gain = "32 * (x.s - 1 / (1 + pow(10, (acc.e[x.d] - acc.e[x.r]) / 400)))"
    loss = "32 * ((1 - x.s) - (1 - 1 / (1 + pow(10, (acc.e[x.d] - acc.e[x.r]) / 400))))"
    return f"""ordered AS (SELECT *, row_number() OVER (ORDER BY start_time, match_id) n FROM {contests}),
 fold AS (SELECT list_reduce(list({{'r': radiant_team_id + 1, 'd': dire_team_id + 1, 's': radiant_win::INT::DOUBLE, 'e': []::DOUBLE[], 'o': []::DOUBLE[]}} ORDER BY n),
  lambda acc, x: {{'r': x.r, 'd': x.d, 's': x.s, 'e': list_transform(acc.e, lambda v, i: CASE WHEN i = x.r THEN v + {gain} WHEN i = x.d THEN v + {loss} ELSE v END),
  'o': list_concat(acc.o, [acc.e[x.r], acc.e[x.d]])}},
  {{'r': 0, 'd': 0, 's': 0.0, 'e': list_transform(range({teams}), lambda v: 1000.0::DOUBLE), 'o': []::DOUBLE[]}}) f FROM ordered),
 pre AS (SELECT ordered.*, f.o[2 * n - 1] radiant_pre, f.o[2 * n] dire_pre FROM ordered, fold),
 elo AS (SELECT *, 1 / (1 + pow(10, (dire_pre - radiant_pre) / 400)) p, radiant_pre + 32 * (radiant_win::INT - 1 / (1 + pow(10, (dire_pre - radiant_pre) / 400))) radiant_post,
  dire_pre + 32 * ((1 - radiant_win::INT) - (1 - 1 / (1 + pow(10, (dire_pre - radiant_pre) / 400)))) dire_post FROM pre),
 log AS (SELECT match_id, start_time, n, radiant_team_id team_id, dire_team_id opponent_id, true is_radiant, radiant_win won, radiant_pre rating_before, radiant_post rating_after, dire_pre opponent_elo FROM elo
  UNION ALL SELECT match_id, start_time, n, dire_team_id, radiant_team_id, false, NOT radiant_win, dire_pre, dire_post, radiant_pre FROM elo)"""


PRO = "pro AS (SELECT * FROM contests WHERE league_tier IN ('premium', 'professional'))"
ELO = f"{PRO}, {elo_sql('pro')}"
LOSS = """avg(CASE WHEN (p >= 0.5) = won THEN 1.0 ELSE 0.0 END)::DOUBLE"""
LOG = """avg(-(CASE WHEN won THEN ln(p) ELSE ln(1 - p) END))"""
BRIER = """avg(pow(p - (CASE WHEN won THEN 1 ELSE 0 END), 2))"""


def query(oracle: str | None = None, *ctes: str):
    """Register a function under its name, with its SQL over the named views."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = (f"WITH {', '.join(ctes)} " if ctes else "") + oracle
        return f

    return add


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


# Point-in-time features


@query("SELECT * FROM tc", CONTESTS, TEAMS)
def team_centric(spark, d):
    return teams.team_centric(v.contests(spark, d))


@query(f"SELECT match_id, team_id, round(avg(won::INT) OVER ({BY_TEAM} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) recent_winrate FROM tc", CONTESTS, TEAMS)
def recent_form5(spark, d):
    return teams.team_centric(v.contests(spark, d)).select("match_id", "team_id", F.round(teams.recent_winrate(), 6).alias("recent_winrate"))


@query(f"SELECT match_id, team_id, round(date_diff('microsecond', lag(start_time) OVER ({BY_TEAM}), start_time) / 86400000000::DOUBLE, 6) days_since_last_match, date_diff('microsecond', lag(start_time) OVER ({BY_TEAM}), start_time) <= 0 back_to_back FROM tc", CONTESTS, TEAMS)
def rest_days(spark, d):
    rows = teams.team_centric(v.contests(spark, d)).withColumn("rest", teams.rest_days())
    return rows.select("match_id", "team_id", F.round("rest", 6).alias("days_since_last_match"), (F.col("rest") <= 0).alias("back_to_back"))


@query(f"SELECT match_id, team_id, count(*) OVER ({BY_TEAM} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) matches_played_before FROM tc", CONTESTS, TEAMS)
def played_before(spark, d):
    return teams.team_centric(v.contests(spark, d)).select("match_id", "team_id", teams.played_before().alias("matches_played_before"))


@query("SELECT match_id, start_time, radiant_team_id, dire_team_id, radiant_win, league_id, league_tier FROM contests WHERE league_tier IN ('premium', 'professional')", CONTESTS)
def pro_matches(spark, d):
    return v.pro_contests(spark, d)


@query(f"SELECT match_id, team_id, round(avg(won::INT) OVER ({BY_TEAM} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) winrate FROM tc", CONTESTS, TEAMS)
def winrate_alltime(spark, d):
    return teams.team_centric(v.contests(spark, d)).select("match_id", "team_id", F.round(teams.winrate_before(), 6).alias("winrate"))


@query(
    f"""SELECT match_id, team_id, round(avg(won::INT) OVER ({BY_TEAM} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 6) recent_winrate_10,
 round(avg(won::INT) OVER ({BY_TEAM} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 6) recent_winrate_20,
 count(*) OVER ({BY_TEAM} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) < 20 insufficient_history FROM tc""",
    CONTESTS, TEAMS,
)
def form_10_20(spark, d):
    n = F.count(F.lit(1)).over(teams.by_team().rowsBetween(-20, -1))
    return teams.team_centric(v.contests(spark, d)).select(
        "match_id", "team_id", F.round(teams.recent_winrate(10), 6).alias("recent_winrate_10"),
        F.round(teams.recent_winrate(20), 6).alias("recent_winrate_20"), (n < 20).alias("insufficient_history"),
    )


@query(
    f"""SELECT match_id, team_id, round(coalesce(list_reduce(list_prepend(0.5::DOUBLE, list(won::INT::DOUBLE) OVER ({BY_TEAM} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 lambda a, x: 0.3 * x + 0.7 * a), 0.5), 6) ema FROM tc""",
    CONTESTS, TEAMS,
)
def ema_form(spark, d):
    return teams.team_centric(v.contests(spark, d)).select("match_id", "team_id", F.round(teams.ema_form(), 6).alias("ema"))


@query(
    """SELECT match_id, n meetings, round(CASE WHEN radiant_team_id = lo THEN s ELSE 1 - s END, 6) radiant_share FROM (
 SELECT *, count(*) OVER w n, avg(lo_won::INT) OVER w s FROM (SELECT *, least(radiant_team_id, dire_team_id) lo, greatest(radiant_team_id, dire_team_id) hi,
 (CASE WHEN radiant_win THEN radiant_team_id ELSE dire_team_id END) = least(radiant_team_id, dire_team_id) lo_won FROM contests)
 WINDOW w AS (PARTITION BY lo, hi ORDER BY start_time, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    CONTESTS,
)
def h2h(spark, d):
    return teams.head_to_head(v.contests(spark, d)).select("match_id", "meetings", F.round("radiant_share", 6).alias("radiant_share"))


@query(
    """SELECT match_id, n meetings, round(CASE WHEN radiant_team_id = lo THEN s ELSE 1 - s END, 6) radiant_share FROM (
 SELECT *, count(*) OVER w n, avg(lo_won::INT) OVER w s FROM (SELECT *, least(radiant_team_id, dire_team_id) lo, greatest(radiant_team_id, dire_team_id) hi,
 date_diff('day', DATE '1970-01-01', start_time::DATE) dd,
 (CASE WHEN radiant_win THEN radiant_team_id ELSE dire_team_id END) = least(radiant_team_id, dire_team_id) lo_won FROM contests)
 WINDOW w AS (PARTITION BY lo, hi ORDER BY dd RANGE BETWEEN 730 PRECEDING AND 1 PRECEDING))""",
    CONTESTS,
)
def h2h_2y(spark, d):
    return teams.head_to_head(v.contests(spark, d), 2).select("match_id", "meetings", F.round("radiant_share", 6).alias("radiant_share"))


# Versions and intervals


@query("SELECT match_id, patch_id, released_at FROM versioned", CONTESTS, VERSIONS)
def patch_asof(spark, d):
    return v.versioned(spark, d).select("match_id", "patch_id", "released_at")


@query("SELECT match_id, date_diff('day', released_at::DATE, start_time::DATE)::INT patch_age FROM versioned", CONTESTS, VERSIONS)
def patch_age(spark, d):
    age = F.date_diff(F.col("start_time").cast("date"), F.col("released_at").cast("date"))
    return v.versioned(spark, d).select("match_id", age.alias("patch_age"))


@query(
    """SELECT match_id, team_id, count(*) OVER w patch_matches, round(coalesce(avg(won::INT) OVER w, avg(won::INT) OVER t), 6) patch_winrate
 FROM (SELECT tc.*, patch_id FROM tc JOIN versioned USING (match_id))
 WINDOW w AS (PARTITION BY team_id, patch_id ORDER BY start_time, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
 t AS (PARTITION BY team_id ORDER BY start_time, match_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""",
    CONTESTS, TEAMS, VERSIONS,
)
def patch_winrate(spark, d):
    return teams.by_version(v.versioned(spark, d)).select("match_id", "team_id", "patch_matches", F.round("patch_winrate", 6).alias("patch_winrate"))


@query(
    """SELECT match_id, team_id, max(o) other_match FROM (SELECT a.match_id, a.team_id, b.match_id o, row_number() OVER (PARTITION BY a.match_id, a.team_id ORDER BY b.start_time DESC, b.match_id DESC) k
 FROM tc a LEFT JOIN tc b ON a.team_id = b.team_id AND b.start_time < a.start_time) WHERE k = 1 GROUP BY 1, 2""",
    CONTESTS, TEAMS,
)
def last_match_asof(spark, d):
    long = teams.team_centric(v.contests(spark, d)).select("match_id", "team_id", "start_time")
    past = long.select("team_id", F.struct("start_time", "match_id").alias("at"), "start_time", F.col("match_id").alias("other_match"))
    latest = past.groupBy("team_id", "start_time").agg(F.max_by("other_match", "at").alias("other_match"))
    return asof.last_before(long, latest, "team_id", "start_time", "start_time", "other_match").select("match_id", "team_id", "other_match")


# Validation and records


@query(
    """SELECT match_id, unnest(x).field field, unnest(x).problem problem, unnest(x).severity severity FROM (SELECT match_id, list_filter([
 CASE WHEN radiant_win IS NULL THEN {'field': 'radiant_win', 'problem': 'missing', 'severity': 'error'} END,
 CASE WHEN radiant_team_id = dire_team_id THEN {'field': 'teams', 'problem': 'same team on both sides', 'severity': 'error'} END,
 CASE WHEN start_time < TIMESTAMP '2011-01-01' OR start_time > TIMESTAMP '2014-01-01' THEN {'field': 'start_time', 'problem': 'out of range', 'severity': 'error'} END,
 CASE WHEN duration <= 0 THEN {'field': 'duration', 'problem': 'not positive', 'severity': 'error'} END,
 CASE WHEN radiant_team_id IS NULL OR dire_team_id IS NULL THEN {'field': 'teams', 'problem': 'a team is missing', 'severity': 'warning'} END,
 CASE WHEN league_tier NOT IN ('premium', 'professional') THEN {'field': 'league_tier', 'problem': 'not professional', 'severity': 'warning'} END,
 CASE WHEN patch_id IS NULL THEN {'field': 'patch_id', 'problem': 'missing', 'severity': 'warning'} END], lambda z: z IS NOT NULL) x
 FROM (SELECT match_id, start_time + INTERVAL 5000 DAY start_time, radiant_win, nullif(radiant_team_id, 7) radiant_team_id, CASE WHEN match_id % 50 = 0 THEN nullif(radiant_team_id, 7) ELSE dire_team_id END dire_team_id,
 match_id % 100 - 3 duration, league_tier, CASE WHEN match_id % 9 <> 0 THEN patch_id END patch_id FROM versioned))""",
    CONTESTS, VERSIONS,
)
def validation_issues(spark, d):
    return records.validation_issues(_with_faults(spark, d), F.lit("2014-01-01").cast("timestamp_ntz"))


def _with_faults(spark, d):
    m, r = v.versioned(spark, d), F.nullif("radiant_team_id", F.lit(7))
    return m.withColumns(
        {
            "start_time": F.col("start_time") + F.expr("INTERVAL 5000 DAY"),  # from 2005 on, across the floor
            "dire_team_id": F.when(F.col("match_id") % 50 == 0, r).otherwise(F.col("dire_team_id")),
            "radiant_team_id": r,
            "duration": F.col("match_id") % 100 - 3,
            "patch_id": F.when(F.col("match_id") % 9 != 0, F.col("patch_id")),
        }
    )


@query(
    """SELECT match_id FROM (SELECT match_id, start_time + INTERVAL 5000 DAY start_time, nullif(radiant_team_id, 7) r, CASE WHEN match_id % 50 = 0 THEN nullif(radiant_team_id, 7) ELSE dire_team_id END e, match_id % 100 - 3 n FROM versioned)
 WHERE r = e OR start_time < TIMESTAMP '2011-01-01' OR start_time > TIMESTAMP '2030-01-01' OR n <= 0""",
    CONTESTS, VERSIONS,
)
def blocking_matches(spark, d):
    rows = _with_faults(spark, d)
    good = records.accepted(rows, F.lit("2030-01-01").cast("timestamp_ntz")).select("match_id")
    return rows.select("match_id").join(good, "match_id", "left_anti")


@query("SELECT l_orderkey, l_linenumber, occurrence FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY rn)::INT occurrence FROM children) WHERE occurrence > 1", CHILDREN)
def batch_duplicates(spark, d):
    return records.repeats(v.children(spark, d), ["l_orderkey", "l_linenumber"], ["rn"]).select("l_orderkey", "l_linenumber", "occurrence")


@query(r"SELECT c_custkey, nullif(trim(c_mktsegment), '') a, nullif(regexp_replace(' ' || chr(9) || c_name || chr(10) || ' ', '^\s+|\s+$', '', 'g'), '') b, nullif(trim('  '), '') c FROM customer")
def clean_strings(spark, d):
    c = v.table(spark, d, "customer")
    padded = F.concat(F.lit(" \t"), F.col("c_name"), F.lit("\n "))
    return c.select("c_custkey", clean(F.col("c_mktsegment")).alias("a"), clean(padded).alias("b"), clean(F.lit("  ")).alias("c"))


@query("SELECT DISTINCT 'feed' source, event_type endpoint, sha256(props) content_hash FROM events WHERE sha256(props) >= '8'")
def raw_dedup(spark, d):
    batch = v.raw_records(spark, d)
    return records.raw_appended(batch.where("content_hash < '8'"), batch).select("source", "endpoint", "content_hash")


@query(
    """SELECT l_orderkey, l_linenumber, max_by(l_partkey, rn) l_partkey, max_by(l_quantity, rn) l_quantity FROM children GROUP BY 1, 2
 UNION ALL SELECT DISTINCT l_orderkey, l_linenumber + 100, 0, -1 FROM children WHERE l_orderkey % 2 = 0""",
    CHILDREN,
)
def upsert_last_wins(spark, d):
    batch = v.children(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "rn")
    new = records.collapsed(batch, ["l_orderkey", "l_linenumber"], F.col("rn")).drop("rn")
    # the table holds half of the keys with other values, and as many keys that the batch doesn't have
    held = new.where("l_orderkey % 2 = 0").withColumns({"l_partkey": F.lit(0).cast(new.schema["l_partkey"].dataType), "l_quantity": F.lit(-1).cast(new.schema["l_quantity"].dataType)})
    others = held.withColumn("l_linenumber", (F.col("l_linenumber") + 100).cast(new.schema["l_linenumber"].dataType))
    return records.merged(held.unionByName(others), new, ["l_orderkey", "l_linenumber"])


@query(
    """SELECT coalesce(o.match_id, n.match_id) match_id, CASE WHEN o.match_id IS NOT NULL THEN o.start_time ELSE n.start_time END start_time,
 CASE WHEN n.match_id IS NOT NULL THEN n.radiant_win ELSE o.radiant_win END radiant_win
 FROM (SELECT * FROM contests WHERE match_id % 3 <> 0) o FULL JOIN (SELECT match_id, start_time + INTERVAL 1 DAY start_time, NOT radiant_win radiant_win FROM contests WHERE match_id % 2 = 0) n ON o.match_id = n.match_id""",
    CONTESTS,
)
def keep_first_columns(spark, d):
    m = v.contests(spark, d).select("match_id", "start_time", "radiant_win")
    new = m.where("match_id % 2 = 0").select("match_id", (F.col("start_time") + F.expr("interval 1 day")).alias("start_time"), (~F.col("radiant_win")).alias("radiant_win"))
    return records.merged(m.where("match_id % 3 <> 0"), new, ["match_id"], keep_first=["start_time"])


@query("SELECT max(start_time) + INTERVAL 1 MICROSECOND checkpoint, count(*) n FROM contests", CONTESTS)
def latest_checkpoint(spark, d):
    return v.contests(spark, d).agg((F.max("start_time") + F.expr("interval 1 microsecond")).alias("checkpoint"), F.count("*").alias("n"))


@query("SELECT match_id, start_time FROM contests ORDER BY start_time, match_id LIMIT 100", CONTESTS)
def earliest_n(spark, d):
    return records.earliest(v.contests(spark, d), 100).select("match_id", "start_time")


@query("SELECT DISTINCT l_orderkey match_id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 45)")
def fk_rejects(spark, d):
    known = v.table(spark, d, "part").where("p_size <= 45")
    rows = v.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("match_id"), F.col("l_partkey").alias("hero_id"))
    return records.rejected_by_reference(rows, "hero_id", known, "p_partkey", "match_id")


@query("SELECT 'primary key' \"check\", count(*) n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) HAVING count(*) > 0 UNION ALL SELECT 'foreign key l_orderkey', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') HAVING count(*) > 0")
def constraint_checks(spark, d):
    o = v.table(spark, d, "orders").where("o_orderstatus <> 'F'")
    return records.violations(v.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey"], {"l_orderkey": (o, "o_orderkey")})


@query("SELECT event_id, endpoint, k FROM (SELECT event_id, event_type endpoint, json_extract_string(props, '$.k')::BIGINT k FROM events)")
def json_extract(spark, d):
    k = F.from_json("body", "k bigint")["k"]
    return v.raw_records(spark, d).select(F.col("position").alias("event_id"), "endpoint", k.alias("k"))


@query("SELECT doc_id, sha256(text) content_hash FROM documents")
def content_hashes(spark, d):
    from ladderline.functions import content_hash

    return v.table(spark, d, "documents").select("doc_id", content_hash(F.col("text")).alias("content_hash"))


@query("SELECT match_id, CASE WHEN start_time < TIMESTAMP '1998-01-01' THEN 'train' WHEN start_time < TIMESTAMP '2000-01-01' THEN 'validation' ELSE 'test' END part FROM contests", CONTESTS)
def time_split(spark, d):
    ts = lambda x: F.lit(x).cast("timestamp_ntz")
    return v.contests(spark, d).select("match_id", dataset.time_split(F.col("start_time"), ts("1998-01-01"), ts("2000-01-01")).alias("part"))


@query(f"SELECT team_id, count(*) matches, round(avg(won::INT), 6) winrate, max(start_time) last_match FROM tc WHERE start_time < TIMESTAMP '1999-01-01' GROUP BY 1", CONTESTS, TEAMS)
def replay_cutoff(spark, d):
    rows = teams.team_centric(v.contests(spark, d)).where(F.col("start_time") < F.lit("1999-01-01").cast("timestamp_ntz"))
    return rows.groupBy("team_id").agg(F.count("*").alias("matches"), F.round(F.avg(teams.won()), 6).alias("winrate"), F.max("start_time").alias("last_match"))


# Children, lineups, drafts


@query("SELECT match_id, rn, team_id, is_radiant, account_id, kills, (row_number() OVER (PARTITION BY match_id, is_radiant ORDER BY rn) - 1 + CASE WHEN is_radiant THEN 0 ELSE 128 END)::INT slot FROM players", CONTESTS, CHILDREN, PLAYERS)
def slots(spark, d):
    w = W.partitionBy("match_id", "is_radiant").orderBy("rn")
    slot = F.row_number().over(w) - 1 + F.when(F.col("is_radiant"), 0).otherwise(128)
    return v.players(spark, d).select("match_id", "rn", "team_id", "is_radiant", "account_id", "kills", slot.alias("slot"))


@query("SELECT match_id, ord, team_id, hero_id, is_pick, patch_id FROM picks", CONTESTS, VERSIONS, CHILDREN, PICKS)
def picks_bans(spark, d):
    return v.picks(spark, d).select("match_id", "ord", "team_id", "hero_id", "is_pick", "patch_id")


@query("SELECT match_id, team_id, array_to_string(lineup, '-') roster_key, len(lineup)::INT accounts FROM sides", CONTESTS, CHILDREN, PLAYERS, SIDES)
def roster_key(spark, d):
    s = rosters.lineups(v.players(spark, d))
    return s.select("match_id", "team_id", F.array_join(F.col("lineup").cast("array<string>"), "-").alias("roster_key"), F.size("lineup").alias("accounts"))


@query(
    f"""SELECT match_id, team_id, count(*) OVER (PARTITION BY team_id, lineup ORDER BY start_time, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) roster_matches,
 date_diff('day', last_value(c IGNORE NULLS) OVER ({BY_TEAM} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DATE, start_time::DATE)::INT days_since_change, days_since_change <= 30 changed_recently
 FROM (SELECT *, CASE WHEN lag(lineup) OVER ({BY_TEAM}) = lineup THEN NULL ELSE start_time END c FROM sides)""",
    CONTESTS, CHILDREN, PLAYERS, SIDES,
)
def roster_tenure(spark, d):
    return rosters.roster_tenure(rosters.lineups(v.players(spark, d)))


@query(
    f"""SELECT match_id, team_id, CASE WHEN n > 0 THEN len(list_filter(lineup, lambda x: NOT list_contains(past, x)))::INT END stand_ins,
 CASE WHEN n > 0 THEN len(list_filter(lineup, lambda x: NOT list_contains(past, x))) > 0 END has_stand_in
 FROM (SELECT *, flatten(list(lineup) OVER ({BY_TEAM} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) past, count(*) OVER ({BY_TEAM} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) n FROM sides)""",
    CONTESTS, CHILDREN, PLAYERS, SIDES,
)
def stand_in(spark, d):
    return rosters.stand_ins(rosters.lineups(v.players(spark, d)))


@query(
    f"""SELECT match_id, team_id, CASE WHEN n > 0 THEN len(list_filter(lineup, lambda x: 2 * len(list_filter(past, lambda y: y = x)) <= n))::INT END stand_ins, stand_ins > 0 has_stand_in
 FROM (SELECT *, flatten(list(lineup) OVER ({BY_TEAM} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) past, count(*) OVER ({BY_TEAM} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) n FROM sides)""",
    CONTESTS, CHILDREN, PLAYERS, SIDES,
)
def majority_stand_in(spark, d):
    return rosters.majority_stand_ins(rosters.lineups(v.players(spark, d)))


@query(
    "SELECT match_id, team_id, coalesce(1000 + n_regionkey, team_id) organization_id FROM tc LEFT JOIN nation ON n_nationkey = team_id AND n_regionkey < 2",
    CONTESTS, TEAMS,
)
def organization_override(spark, d):
    confirmed = F.lit("2020-01-01").cast("timestamp_ntz").alias("confirmed_at")
    aliases = v.table(spark, d, "nation").where("n_regionkey < 2").select(F.col("n_nationkey").cast("long").alias("team_id"), (F.col("n_regionkey") + 1000).cast("long").alias("organization_id"), confirmed)
    return rosters.with_organization(teams.team_centric(v.contests(spark, d)).select("match_id", "team_id"), aliases).select("match_id", "team_id", "organization_id")


ROSTERS = f"""team AS (SELECT *, max(no) OVER (PARTITION BY team_id) last_no FROM (SELECT *, row_number() OVER ({BY_TEAM}) no FROM (SELECT DISTINCT match_id, start_time, team_id FROM players))),
 member AS (SELECT DISTINCT team_id, account_id, start_time, no, last_no FROM players JOIN team USING (match_id, start_time, team_id)),
 period AS (SELECT *, sum(o) OVER (PARTITION BY team_id, account_id ORDER BY no) g FROM (SELECT *, CASE WHEN no - lag(no) OVER (PARTITION BY team_id, account_id ORDER BY no) <= 4 THEN 0 ELSE 1 END o FROM member)),
 roster AS (SELECT team_id, account_id, min(start_time) valid_from, CASE WHEN max(no) + 3 < max(last_no) THEN max(start_time) END valid_to, count(*) matches FROM period GROUP BY team_id, account_id, g)"""


@query("SELECT * FROM roster", CONTESTS, CHILDREN, PLAYERS, ROSTERS)
def roster_periods(spark, d):
    return rosters.roster_periods(v.players(spark, d))


TOLD = """told AS (SELECT team_id, account_id, min(valid_from) - INTERVAL 10 DAY changed_at, 'joined' change_type FROM roster WHERE account_id % 3 < 2 GROUP BY ALL
 UNION ALL SELECT team_id, account_id, min(valid_from) + INTERVAL 200 DAY, 'left' FROM roster WHERE account_id % 3 = 0 GROUP BY ALL)"""


def _told(spark, d):
    """Roster events made from the played lineups: an account in three joins and leaves, one joins, one is never told of."""
    first = rosters.roster_periods(v.players(spark, d)).groupBy("team_id", "account_id").agg(F.min("valid_from").alias("f"))
    event = lambda at, kind: F.struct((F.col("f") + F.expr(at)).alias("changed_at"), F.lit(kind).alias("change_type"))
    joined, left = event("interval -10 days", "joined"), event("interval 200 days", "left")
    all_ = F.when(F.col("account_id") % 3 == 0, F.array(joined, left)).when(F.col("account_id") % 3 == 1, F.array(joined))
    return first.select("team_id", "account_id", F.inline(all_))


@query(
    """SELECT team_id, account_id, min(pt) valid_from, nullif(max(until), TIMESTAMP '9999-12-31') valid_to, first(source) source, CASE first(source) WHEN 'both' THEN 1.0 WHEN 'events' THEN 0.8 ELSE 0.6 END::DOUBLE confidence
 FROM (SELECT *, sum(fresh) OVER (PARTITION BY team_id, account_id ORDER BY pt) run FROM (SELECT *, (source IS DISTINCT FROM lag(source) OVER (PARTITION BY team_id, account_id ORDER BY pt) OR row_number() OVER (PARTITION BY team_id, account_id ORDER BY pt) = 1)::INT fresh FROM state)) WHERE source IS NOT NULL GROUP BY team_id, account_id, run""",
    CONTESTS, CHILDREN, PLAYERS, ROSTERS, TOLD,
    """spans AS (SELECT j.team_id, j.account_id, j.changed_at f, coalesce(l.changed_at, TIMESTAMP '9999-12-31') t, 1 told, 0 seen FROM told j LEFT JOIN told l ON l.team_id = j.team_id AND l.account_id = j.account_id AND l.change_type = 'left' WHERE j.change_type = 'joined'
 UNION ALL SELECT team_id, account_id, valid_from, greatest(coalesce(valid_to, TIMESTAMP '9999-12-31'), valid_from + INTERVAL 1 MICROSECOND), 0, 1 FROM roster)""",
    "marks AS (SELECT team_id, account_id, pt, sum(told) told, sum(seen) seen FROM (SELECT team_id, account_id, f pt, told, seen FROM spans UNION ALL SELECT team_id, account_id, t, -told, -seen FROM spans) GROUP BY ALL)",
    """state AS (SELECT team_id, account_id, pt, until, CASE WHEN a > 0 AND b > 0 THEN 'both' WHEN a > 0 THEN 'events' WHEN b > 0 THEN 'lineups' END source FROM (SELECT *, lead(pt) OVER w until, sum(told) OVER w a, sum(seen) OVER w b FROM marks WINDOW w AS (PARTITION BY team_id, account_id ORDER BY pt)) WHERE until IS NOT NULL)""",
)
def roster_merged(spark, d):
    return rosters.merged_periods(_told(spark, d), rosters.roster_periods(v.players(spark, d)))


@query(
    "SELECT DISTINCT p.team_id, p.account_id, p.start_time \"at\", 'played after leaving' problem FROM players p JOIN told l ON l.team_id = p.team_id AND l.account_id = p.account_id AND l.change_type = 'left' AND p.start_time >= l.changed_at",
    CONTESTS, CHILDREN, PLAYERS, ROSTERS, TOLD,
)
def roster_contradictions(spark, d):
    return rosters.roster_contradictions(_told(spark, d), v.players(spark, d))


@query("SELECT team_id, count(*) members FROM roster WHERE valid_from <= TIMESTAMP '1998-06-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1998-06-01') GROUP BY 1", CONTESTS, CHILDREN, PLAYERS, ROSTERS)
def roster_at_date(spark, d):
    at = F.lit("1998-06-01").cast("timestamp_ntz")
    return rosters.roster_at(rosters.roster_periods(v.players(spark, d)), at).groupBy("team_id").agg(F.count("*").alias("members"))


@query("SELECT team_id, account_id, valid_from FROM (SELECT *, lag(coalesce(valid_to, TIMESTAMP '9999-12-31')) OVER (PARTITION BY team_id, account_id ORDER BY valid_from, valid_to NULLS LAST) b FROM (SELECT team_id, account_id, valid_from, valid_to FROM roster UNION ALL SELECT team_id, account_id, valid_from + INTERVAL 10 DAY, valid_to FROM roster WHERE account_id % 3 = 0)) WHERE b > valid_from", CONTESTS, CHILDREN, PLAYERS, ROSTERS)
def period_overlap(spark, d):
    own = rosters.roster_periods(v.players(spark, d)).select("team_id", "account_id", "valid_from", "valid_to")
    late = own.where("account_id % 3 = 0").withColumn("valid_from", F.col("valid_from") + F.expr("INTERVAL 10 DAY"))
    return rosters.overlaps(own.unionByName(late)).select("team_id", "account_id", "valid_from")


@query(
    """SELECT from_team, from_match, team_id, match_id, shared FROM (SELECT from_team, from_match, team_id, match_id, count(*) shared, max(n) n FROM (
 SELECT team_id, match_id, n, lag(team_id) OVER w from_team, lag(match_id) OVER w from_match FROM (SELECT match_id, start_time, team_id, len(lineup) n, unnest(lineup) a FROM sides)
 WINDOW w AS (PARTITION BY a ORDER BY start_time, match_id, team_id)) WHERE from_team <> team_id AND from_match <> match_id GROUP BY 1, 2, 3, 4) WHERE shared > 0.8 * n""",
    CONTESTS, CHILDREN, PLAYERS, SIDES,
)
def lineup_overlap(spark, d):
    return rosters.shared_lineups(rosters.lineups(v.players(spark, d)))


@query(
    """SELECT match_id, team_id, round(avg(c), 6) mean_career FROM (SELECT DISTINCT match_id, team_id, account_id FROM players)
 JOIN (SELECT match_id, account_id, count(*) OVER (PARTITION BY account_id ORDER BY start_time, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) c
 FROM (SELECT DISTINCT match_id, start_time, account_id FROM players)) USING (match_id, account_id) GROUP BY 1, 2""",
    CONTESTS, CHILDREN, PLAYERS,
)
def player_experience(spark, d):
    return rosters.player_experience(v.players(spark, d)).select("match_id", "team_id", F.round("mean_career", 6).alias("mean_career"))


@query(
    """SELECT match_id, team_id, round(avg(form), 6) individual_form FROM (SELECT DISTINCT match_id, team_id, account_id FROM players)
 JOIN (SELECT match_id, account_id, avg(did) OVER (PARTITION BY account_id ORDER BY start_time, match_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) form
 FROM (SELECT match_id, start_time, account_id, avg(kills / mid) did FROM players LEFT JOIN (SELECT (rn + 1) // 2 part, date_trunc('quarter', start_time) + INTERVAL 3 MONTH q, median(kills) mid FROM players GROUP BY 1, 2)
 ON part = (rn + 1) // 2 AND q = date_trunc('quarter', start_time) GROUP BY 1, 2, 3)) USING (match_id, account_id) GROUP BY 1, 2""",
    CONTESTS, CHILDREN, PLAYERS,
)
def individual_form(spark, d):
    players = v.players(spark, d).withColumn("role", F.floor((F.col("rn") + 1) / 2))
    return rosters.individual_form(players, "kills").select("match_id", "team_id", F.round("individual_form", 6).alias("individual_form"))


@query(
    f"""SELECT match_id, team_id, coalesce(len(list_distinct(flatten(list(heroes) OVER ({BY_TEAM} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)))), 0)::INT hero_pool
 FROM (SELECT match_id, start_time, team_id, list_distinct(list(hero_id)) heroes FROM picks WHERE is_pick GROUP BY ALL)""",
    CONTESTS, VERSIONS, CHILDREN, PICKS,
)
def hero_pool(spark, d):
    return rosters.hero_pool(v.picks(spark, d))


@query("SELECT hero_id, patch_id, count(*) picks, round(avg(won::INT), 6) winrate FROM picks WHERE is_pick GROUP BY 1, 2", CONTESTS, VERSIONS, CHILDREN, PICKS)
def hero_patch_winrate(spark, d):
    return rosters.hero_winrates(v.picks(spark, d)).select("hero_id", "patch_id", "picks", F.round("winrate", 6).alias("winrate"))


@query(
    """SELECT match_id, team_id, round(avg(coalesce(r, 0.5)) FILTER (is_pick), 6) draft_strength, round(avg(coalesce(r, 0.5)) FILTER (NOT is_pick), 6) ban_strength
 FROM (SELECT match_id, team_id, is_pick, avg(CASE WHEN is_pick THEN won::INT END) OVER (PARTITION BY hero_id, patch_id
 ORDER BY date_diff('day', DATE '1970-01-01', start_time::DATE) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) r FROM picks) GROUP BY 1, 2""",
    CONTESTS, VERSIONS, CHILDREN, PICKS,
)
def draft_strength(spark, d):
    return rosters.draft_strength(v.picks(spark, d)).select("match_id", "team_id", *r6("draft_strength", "ban_strength"))


@query(
    """SELECT match_id, team_id, round(sum(coalesce(r - 0.5, 0)), 6) matchup_advantage FROM (SELECT a.match_id, a.team_id, avg(a.won::INT) OVER (PARTITION BY a.hero_id, b.hero_id
 ORDER BY date_diff('day', DATE '1970-01-01', a.start_time::DATE) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) r
 FROM picks a JOIN picks b ON a.match_id = b.match_id AND a.team_id <> b.team_id WHERE a.is_pick AND b.is_pick) GROUP BY 1, 2""",
    CONTESTS, VERSIONS, CHILDREN, PICKS,
)
def matchup_advantage(spark, d):
    return rosters.matchup_advantage(v.picks(spark, d)).select("match_id", "team_id", *r6("matchup_advantage"))


@query(
    """SELECT match_id, team_id, round(avg(g), 6) comfort_games, round(avg(r), 6) comfort_winrate FROM (SELECT match_id, team_id, count(*) OVER w g, avg(won::INT) OVER w r
 FROM picks JOIN (SELECT match_id, rn ord, account_id % 20 account_id FROM players) USING (match_id, ord) WHERE is_pick
 WINDOW w AS (PARTITION BY account_id, hero_id % 10 ORDER BY date_diff('day', DATE '1970-01-01', start_time::DATE) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) GROUP BY 1, 2""",
    CONTESTS, VERSIONS, CHILDREN, PLAYERS, PICKS,
)
def hero_comfort(spark, d):
    who = v.players(spark, d).select("match_id", F.col("rn").alias("ord"), (F.col("account_id") % 20).alias("account_id"))
    picks = v.picks(spark, d).withColumn("hero_id", F.col("hero_id") % 10).join(who, ["match_id", "ord"])
    return rosters.hero_comfort(picks).select("match_id", "team_id", *r6("comfort_games", "comfort_winrate"))


@query(
    f"""SELECT match_id, team_id, team_id = f picks_first, round(avg((team_id = f)::INT) OVER ({BY_TEAM} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 12) first_pick_share
 FROM (SELECT DISTINCT match_id, start_time, team_id, f FROM picks JOIN (SELECT match_id, min_by(team_id, ord) f FROM picks WHERE is_pick GROUP BY 1) USING (match_id))""",
    CONTESTS, VERSIONS, CHILDREN, PICKS,
)
def draft_order(spark, d):
    return rosters.first_picks(v.picks(spark, d)).select("match_id", "team_id", "picks_first", F.round("first_pick_share", 12).alias("first_pick_share"))


# Metrics and profiles


@query(f"SELECT round({LOSS}, 6) accuracy, round({LOG}, 6) log_loss, round({BRIER}, 6) brier, count(*) n FROM f", CONTESTS, FORECASTS)
def forecast_metrics(spark, d):
    return metrics.summary(v.forecasts(spark, d)).select(*r6("accuracy", "log_loss", "brier"), "n")


@query(f"SELECT league_tier, y, round({LOSS}, 6) accuracy, round({LOG}, 6) log_loss, round({BRIER}, 6) brier, count(*) n FROM (SELECT *, year(start_time)::INT y FROM f) GROUP BY GROUPING SETS ((league_tier), (y), ())", CONTESTS, FORECASTS)
def metrics_by_slice(spark, d):
    rows = v.forecasts(spark, d).withColumn("y", F.year("start_time"))
    return metrics.sliced(rows, "league_tier", "y").select("league_tier", "y", *r6("accuracy", "log_loss", "brier"), "n")


@query("SELECT least(floor(p * 10), 9)::INT bin, round(avg(p), 6) mean_p, round(avg(won::INT), 6) share_won, count(*) n FROM f GROUP BY 1", CONTESTS, FORECASTS)
def calibration_bins(spark, d):
    return metrics.calibration(v.forecasts(spark, d)).select("bin", *r6("mean_p", "share_won"), "n")


@query(
    """SELECT round((sum(CASE WHEN won THEN r END) - sum(won::INT) * (sum(won::INT) + 1) / 2.0) / (sum(won::INT)::DOUBLE * (count(*) - sum(won::INT))), 6) roc_auc
 FROM (SELECT won, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 r FROM f)""",
    CONTESTS, FORECASTS,
)
def roc_auc(spark, d):
    return metrics.roc_auc(v.forecasts(spark, d)).select(*r6("roc_auc"))


def _two_forecasts(spark, d):
    """The ratings' forecasts p and the stand-in's q of the same contests."""
    q = v.forecasts(spark, d).select("match_id", F.col("p").alias("q"))
    return models.backtest(v.pro_contests(spark, d)).select("match_id", "p", "won").join(q, "match_id")


_PLACE = "CASE WHEN won THEN (sum((NOT won)::INT) OVER (ORDER BY {0} RANGE UNBOUNDED PRECEDING) - sum((NOT won)::INT) OVER (PARTITION BY {0}) / 2.0) / n ELSE (m - sum(won::INT) OVER (ORDER BY {0} RANGE UNBOUNDED PRECEDING) + sum(won::INT) OVER (PARTITION BY {0}) / 2.0) / m END v{0}"


@query(
    """SELECT round(a, 6) auc_p, round(b, 6) auc_q, round(a - b, 6) difference, round(s, 9) variance, round((a - b) / sqrt(s), 4) z, round(a - b - 1.959963984540054 * sqrt(s), 6) low, round(a - b + 1.959963984540054 * sqrt(s), 6) high
 FROM (SELECT avg(vp) FILTER (won) a, avg(vq) FILTER (won) b, var_samp(vp - vq) FILTER (won) / count(*) FILTER (won) + var_samp(vp - vq) FILTER (NOT won) / count(*) FILTER (NOT won) s FROM placed)""",
    CONTESTS, ELO, "two AS (SELECT p, 0.5 + (radiant_team_id - dire_team_id) / 60 q, radiant_win won FROM elo)",
    "sizes AS (SELECT count(*) FILTER (won) m, count(*) FILTER (NOT won) n FROM two)",
    f"placed AS (SELECT won, {_PLACE.format('p')}, {_PLACE.format('q')} FROM two, sizes)",
)
def model_comparison(spark, d):
    return metrics.delong(_two_forecasts(spark, d)).select(*r6("auc_p", "auc_q", "difference"), F.round("variance", 9).alias("variance"), F.round("z", 4).alias("z"), *r6("low", "high"))


@query()
def model_bootstrap(spark, d):
    return metrics.paired_bootstrap(_two_forecasts(spark, d))


@query("SELECT round(t / (t + f)::DOUBLE, 6) \"precision\", round(t / (t + n)::DOUBLE, 6) recall, round(2 * t / (2 * t + f + n)::DOUBLE, 6) f1 FROM (SELECT sum((p >= 0.5 AND won)::INT) t, sum((p >= 0.5 AND NOT won)::INT) f, sum((p < 0.5 AND won)::INT) n FROM f)", CONTESTS, FORECASTS)
def precision_recall(spark, d):
    return metrics.confusion(v.forecasts(spark, d)).select(*r6("precision", "recall", "f1"))


@query("SELECT CASE WHEN abs(p - 0.5) < 0.07 THEN 'low' WHEN abs(p - 0.5) < 0.20 THEN 'medium' ELSE 'high' END confidence, count(*) n FROM f GROUP BY 1", CONTESTS, FORECASTS)
def confidence_buckets(spark, d):
    return v.forecasts(spark, d).groupBy(confidence(F.col("p")).alias("confidence")).agg(F.count("*").alias("n"))


@query("SELECT year(start_time)::INT \"year\", count(*) n, count(DISTINCT radiant_team_id) teams, round(avg(radiant_win::INT), 6) radiant_share FROM contests GROUP BY 1", CONTESTS)
def coverage_year(spark, d):
    return _rounded(profile.coverage(v.contests(spark, d), F.year("start_time"), "year"))


@query("SELECT patch_id, count(*) n, count(DISTINCT radiant_team_id) teams, round(avg(radiant_win::INT), 6) radiant_share FROM versioned GROUP BY 1", CONTESTS, VERSIONS)
def coverage_patch(spark, d):
    return _rounded(profile.coverage(v.versioned(spark, d), F.col("patch_id"), "patch_id"))


@query("SELECT league_id, count(*) n, count(DISTINCT radiant_team_id) teams, round(avg(radiant_win::INT), 6) radiant_share FROM contests GROUP BY 1", CONTESTS)
def coverage_league(spark, d):
    return _rounded(profile.coverage(v.contests(spark, d), F.col("league_id"), "league_id"))


def _rounded(df):
    return df.withColumn("radiant_share", F.round("radiant_share", 6))


@query("SELECT count(*) matches, sum((league_tier IS NULL)::INT)::BIGINT without_tier, sum((patch_id IS NULL)::INT)::BIGINT without_patch, sum((match_id NOT IN (SELECT l_orderkey FROM lineitem))::INT)::BIGINT without_players, sum((match_id NOT IN (SELECT l_orderkey FROM lineitem))::INT)::BIGINT without_draft FROM versioned", CONTESTS, VERSIONS)
def missing_counters(spark, d):
    return profile.missing_counters(v.versioned(spark, d), v.players(spark, d), v.picks(spark, d))


@query(f"SELECT 'recent_winrate' \"column\", round(avg((r IS NULL)::INT), 6) fraction FROM (SELECT avg(won::INT) OVER ({BY_TEAM} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) r FROM tc) UNION ALL SELECT 'team_id', 0.0", CONTESTS, TEAMS)
def null_fractions(spark, d):
    rows = teams.form_features(v.contests(spark, d)).select("team_id", "recent_winrate")
    return profile.null_fractions(rows).select("column", F.round("fraction", 6).alias("fraction"))


@query("SELECT unnest(['match_id', 'team_id', 'won']) \"column\", unnest([count(*), count(*), count(*)]) \"rows\", unnest([count(DISTINCT match_id), count(DISTINCT team_id), count(DISTINCT won)]) \"distinct\" FROM tc", CONTESTS, TEAMS)
def shape(spark, d):
    return profile.shape(teams.team_centric(v.contests(spark, d)).select("match_id", "team_id", "won"))


@query("SELECT radiant_win, count(*) n, round(count(*) / sum(count(*)) OVER (), 6) share FROM contests GROUP BY 1", CONTESTS)
def class_balance(spark, d):
    return profile.class_balance(v.contests(spark, d), "radiant_win").withColumn("share", F.round("share", 6))


@query("SELECT 'o_totalprice' \"column\", count(o_totalprice) n, round(avg(o_totalprice), 4) mean, round(stddev_samp(o_totalprice), 4) std, min(o_totalprice) \"min\", round(quantile_cont(o_totalprice, 0.25), 4) p25, round(quantile_cont(o_totalprice, 0.5), 4) p50, round(quantile_cont(o_totalprice, 0.75), 4) p75, max(o_totalprice) \"max\" FROM orders")
def describe(spark, d):
    out = profile.describe(v.table(spark, d, "orders"), "o_totalprice")
    return out.select("column", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std")], "min", *[F.round(c, 4).alias(c) for c in ("p25", "p50", "p75")], "max")


@query("SELECT date_trunc('year', start_time)::TIMESTAMP \"year\", count(*) n FROM contests WHERE league_tier IN ('premium', 'professional') GROUP BY 1", CONTESTS)
def pro_per_year(spark, d):
    m = v.contests(spark, d).where(is_pro(F.col("league_tier")))
    return m.groupBy(F.date_trunc("year", "start_time").cast("timestamp_ntz").alias("year")).agg(F.count("*").alias("n")).orderBy("year")


@query(f"SELECT match_id, team_id, r IS NULL recent_winrate_is_missing, t IS NULL days_since_last_match_is_missing, coalesce(league_tier, 'unknown') league_tier, CASE (match_id % 4) WHEN 0 THEN 'bo1' WHEN 1 THEN 'bo3' WHEN 2 THEN 'bo5' ELSE 'unknown' END bo_type FROM (SELECT tc.*, league_tier, avg(won::INT) OVER (PARTITION BY team_id ORDER BY tc.start_time, tc.match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) r, lag(tc.start_time) OVER (PARTITION BY team_id ORDER BY tc.start_time, tc.match_id) t FROM tc JOIN contests USING (match_id))", CONTESTS, TEAMS)
def context_and_missing(spark, d):
    from ladderline.functions import missing_flags

    rows = teams.form_features(v.contests(spark, d)).join(v.contests(spark, d).select("match_id", "league_tier"), "match_id")
    kinds = F.create_map(*[F.lit(x) for kv in {0: "bo1", 1: "bo3", 2: "bo5"}.items() for x in kv])
    bo = F.coalesce(F.try_element_at(kinds, (F.col("match_id") % 4).cast("int")), F.lit("unknown"))
    return rows.select("match_id", "team_id", *missing_flags("recent_winrate", "days_since_last_match"), F.coalesce("league_tier", F.lit("unknown")).alias("league_tier"), bo.alias("bo_type"))


# Ratings and what is built on them


def _pro_ratings(spark, d):
    return elo.rated(v.pro_contests(spark, d))


RATINGS = ("radiant_pre", "dire_pre", "radiant_post", "dire_post")
BY_N = "PARTITION BY team_id ORDER BY n"


@query(f"SELECT match_id, start_time, radiant_team_id, dire_team_id, radiant_win, {', '.join(f'round({c}, 6) {c}' for c in RATINGS)} FROM elo", CONTESTS, ELO)
def elo_fold(spark, d):
    return _pro_ratings(spark, d).select("match_id", "start_time", "radiant_team_id", "dire_team_id", "radiant_win", *r6(*RATINGS))


@query("SELECT count(DISTINCT t) teams, (count(DISTINCT t) * 1000)::DOUBLE total FROM (SELECT unnest([radiant_team_id, dire_team_id]) t FROM contests WHERE league_tier IN ('premium', 'professional'))", CONTESTS)
def elo_conservation(spark, d):
    now = elo.current_ratings(elo.rating_log(_pro_ratings(spark, d)))
    return now.agg(F.count("*").alias("teams"), F.round(F.sum("rating"), 3).alias("total"))


@query("SELECT team_id, round(max_by(rating_after, n), 6) rating FROM log GROUP BY 1", CONTESTS, ELO)
def current_ratings(spark, d):
    return elo.current_ratings(elo.rating_log(_pro_ratings(spark, d))).select("team_id", *r6("rating"))


@query(f"SELECT match_id, team_id, round(rating_before - lag(rating_before, 5) OVER ({BY_N}), 6) elo_delta FROM log", CONTESTS, ELO)
def elo_delta5(spark, d):
    return elo.elo_trend(elo.rating_log(_pro_ratings(spark, d))).select("match_id", "team_id", *r6("elo_delta"))


#: Contests within 125 worlds of eight teams, a world for each nation and market segment.
WORLDS = """worlds AS (SELECT o_orderkey match_id, o_orderdate start_time, w * 8 + o_custkey % 8 radiant_team_id, w * 8 + (o_custkey % 8 + 1 + o_orderkey % 7) % 8 dire_team_id, o_totalprice > 200000 radiant_win, w world
 FROM (SELECT *, c_nationkey * 5 + CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END w FROM orders JOIN customer ON o_custkey = c_custkey))"""
WORLD_ELO = """seq AS (SELECT *, row_number() OVER (PARTITION BY world ORDER BY start_time, match_id) n FROM worlds),
 walk AS (SELECT DISTINCT world, 0::BIGINT n, list_transform(range(8), lambda v: 1000.0::DOUBLE) e, NULL::BIGINT match_id, NULL::DOUBLE a, NULL::DOUBLE b FROM worlds
 UNION ALL SELECT world, s.n, list_transform(w.e, lambda v, i: CASE i WHEN s.radiant_team_id % 8 + 1 THEN v + 32 * (s.radiant_win::INT - 1 / (1 + pow(10, (w.e[s.dire_team_id % 8 + 1] - w.e[s.radiant_team_id % 8 + 1]) / 400)))
 WHEN s.dire_team_id % 8 + 1 THEN v + 32 * ((1 - s.radiant_win::INT) - (1 - 1 / (1 + pow(10, (w.e[s.dire_team_id % 8 + 1] - w.e[s.radiant_team_id % 8 + 1]) / 400)))) ELSE v END),
 s.match_id, w.e[s.radiant_team_id % 8 + 1], w.e[s.dire_team_id % 8 + 1] FROM walk w JOIN seq s USING (world) WHERE s.n = w.n + 1)"""


@query(
    """SELECT a team_id, min(b) pool FROM reach GROUP BY 1""",
    "RECURSIVE " + WORLDS,
    "met AS (SELECT DISTINCT radiant_team_id a, dire_team_id b FROM worlds UNION SELECT dire_team_id, radiant_team_id FROM worlds)",
    "reach AS (SELECT DISTINCT a, a b FROM met UNION SELECT r.a, m.b FROM reach r JOIN met m ON r.b = m.a)",
)
def team_pools(spark, d):
    return pools.team_pools(v.worlds(spark, d))


@query("SELECT match_id, round(a, 6) radiant_pre, round(b, 6) dire_pre FROM walk WHERE match_id IS NOT NULL", "RECURSIVE " + WORLDS, WORLD_ELO)
def elo_by_pool(spark, d):
    return elo.rated(v.worlds(spark, d)).select("match_id", *r6("radiant_pre", "dire_pre"))


@query(
    """SELECT t.team_id, round(elo, 6) elo, round(w, 6) recent_winrate, k matches_played_before, last_match, array_to_string(lineup, '-') lineup
 FROM (SELECT team_id, max_by(rating_after, n) elo, count(*) k, max(start_time) last_match, avg(won::INT) FILTER (back <= 5) w FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY n DESC) back FROM log WHERE start_time < TIMESTAMP '1999-01-01') GROUP BY 1) t
 LEFT JOIN (SELECT team_id, lineup FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY start_time DESC, match_id DESC) r FROM sides WHERE start_time < TIMESTAMP '1999-01-01') WHERE r = 1) l ON l.team_id = t.team_id""",
    CONTESTS, CHILDREN, PLAYERS, SIDES, elo_sql("contests"),
)
def state_asof(spark, d):
    out = replay.replayed(v.contests(spark, d), v.players(spark, d), "1999-01-01")
    lineup = F.array_join(F.col("lineup").cast("array<string>"), "-").alias("lineup")
    return out.select("team_id", *r6("elo", "recent_winrate"), "matches_played_before", "last_match", lineup)


@query()
def glicko2(spark, d):
    return elo.glicko2(v.pro_contests(spark, d))


@query(
    """SELECT e.match_id, e.start_time as_of_timestamp, e.radiant_team_id, e.dire_team_id, round(radiant_pre, 6) radiant_elo, round(dire_pre, 6) dire_elo, round(radiant_pre - dire_pre, 6) elo_difference,
 round(a.w, 6) radiant_recent_winrate, round(b.w, 6) dire_recent_winrate, round(a.w - b.w, 6) recent_winrate_difference, round(a.rest, 6) radiant_days_since_last_match, round(b.rest, 6) dire_days_since_last_match,
 a.k radiant_matches_played_before, b.k dire_matches_played_before, e.radiant_win FROM elo e JOIN form a ON a.match_id = e.match_id AND a.is_radiant JOIN form b ON b.match_id = e.match_id AND NOT b.is_radiant""",
    CONTESTS, ELO,
    f"""form AS (SELECT match_id, is_radiant, avg(won::INT) OVER ({BY_N} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) w, date_diff('microsecond', lag(start_time) OVER ({BY_N}), start_time) / 86400000000::DOUBLE rest,
 count(*) OVER ({BY_N} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) k FROM log)""",
)
def feature_set_0(spark, d):
    rows = dataset.feature_set_0(v.pro_contests(spark, d))
    return rows.withColumns({c: F.round(c, 6) for c, t in rows.dtypes if t == "double"})


@query()
def match_features_long(spark, d):
    return dataset.long_features(dataset.feature_set_0(v.pro_contests(spark, d)))


@query("SELECT match_id, start_time, round(radiant_pre, 6) radiant_pre, round(dire_pre, 6) dire_pre, round(p, 6) p, radiant_win won FROM elo", CONTESTS, ELO)
def backtest_records(spark, d):
    return models.backtest(v.pro_contests(spark, d)).select("match_id", "start_time", *r6("radiant_pre", "dire_pre", "p"), "won")


@query(f"SELECT round({LOSS}, 6) accuracy, round({LOG}, 6) log_loss, round({BRIER}, 6) brier, count(*) n FROM (SELECT p, radiant_win won FROM elo)", CONTESTS, ELO)
def backtest_metrics(spark, d):
    return metrics.summary(models.backtest(v.pro_contests(spark, d))).select(*r6("accuracy", "log_loss", "brier"), "n")


@query()
def metric_bootstrap(spark, d):
    return metrics.bootstrap(v.forecasts(spark, d))


@query(
    f"SELECT match_id, team_id, round(sum(won::INT * opponent_elo) OVER ({BY_N} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / sum(opponent_elo) OVER ({BY_N} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) adjusted_winrate FROM log",
    CONTESTS, ELO,
)
def opp_adjusted(spark, d):
    return models.opponent_adjusted(v.pro_contests(spark, d)).select("match_id", "team_id", *r6("adjusted_winrate"))


@query(
    f"""SELECT match_id, team_id, round(CASE WHEN k >= 3 THEN w / k END, 6) vs_top_winrate, coalesce(k, 0) vs_top_meetings FROM (SELECT match_id, team_id,
 count(CASE WHEN place <= 20 THEN 1 END) OVER ({BY_N} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) k, sum(CASE WHEN place <= 20 THEN won::INT END) OVER ({BY_N} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) w
 FROM log LEFT JOIN places USING (match_id, opponent_id))""",
    CONTESTS, ELO,
    """each AS (SELECT e.match_id, e.n, t.team_id FROM elo e, (SELECT DISTINCT team_id FROM log) t),
 held AS (SELECT each.match_id, each.team_id, l.rating_after rating FROM each ASOF JOIN log l ON l.team_id = each.team_id AND l.n < each.n),
 places AS (SELECT a.match_id, a.team_id opponent_id, 1 + (SELECT count(*) FROM held b WHERE b.match_id = a.match_id AND b.rating > a.rating) place FROM held a JOIN log l ON l.match_id = a.match_id AND l.team_id = a.team_id)""",
)
def vs_top20(spark, d):
    return models.against_top(v.pro_contests(spark, d)).select("match_id", "team_id", *r6("vs_top_winrate"), "vs_top_meetings")


@query(
    "SELECT tc.match_id, tc.team_id, tc.start_time, round(r.rating, 6) rating FROM tc ASOF LEFT JOIN (SELECT team_id, start_time, max_by(rating_after, match_id) rating FROM log GROUP BY ALL) r ON r.team_id = tc.team_id AND r.start_time < tc.start_time",
    CONTESTS, TEAMS, ELO,
)
def rating_asof(spark, d):
    log = elo.rating_log(_pro_ratings(spark, d)).groupBy("team_id", "start_time").agg(F.max_by("rating_after", "match_id").alias("rating"))
    long = teams.team_centric(v.contests(spark, d)).select("match_id", "team_id", "start_time")
    return asof.last_before(long, log, "team_id", "start_time", "start_time", "rating").select("match_id", "team_id", "start_time", *r6("rating"))


@query()
def sanity_fit(spark, d):
    return models.sanity_fit(dataset.feature_set_0(v.pro_contests(spark, d)))


@query()
def model_line_up(spark, d):
    return models.line_up(dataset.feature_set_0(v.pro_contests(spark, d)))


@query()
def rolling_retrain(spark, d):
    return models.rolling_retrain(dataset.feature_set_0(v.pro_contests(spark, d)), every_days=90)


@query()
def calibrated_forecasts(spark, d):
    return models.calibrated(models.backtest(v.pro_contests(spark, d)), "1998-01-01", "2000-01-01")


@query(
    f"SELECT match_id, start_time, elo_after, recent_winrate_10 FROM (SELECT match_id, start_time, team_id, round(rating_after, 6) elo_after, round(avg(won::INT) OVER ({BY_N} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 6) recent_winrate_10 FROM log) WHERE team_id = 3",
    CONTESTS, ELO,
)
def form_series(spark, d):
    return serving.form_series(v.pro_contests(spark, d), 3).select("match_id", "start_time", *r6("elo_after", "recent_winrate_10"))


@query(
    """SELECT e.match_id, e.start_time, e.radiant_team_id, e.dire_team_id, round(1 / (1 + pow(10, (coalesce(b.r, 1000) - coalesce(a.r, 1000)) / 400)), 6) probability,
 CASE WHEN abs(1 / (1 + pow(10, (coalesce(b.r, 1000) - coalesce(a.r, 1000)) / 400)) - 0.5) < 0.07 THEN 'low' WHEN abs(1 / (1 + pow(10, (coalesce(b.r, 1000) - coalesce(a.r, 1000)) / 400)) - 0.5) < 0.20 THEN 'medium' ELSE 'high' END confidence,
 round(coalesce(a.r, 1000) - coalesce(b.r, 1000), 4) elo_difference FROM elo e LEFT JOIN known a ON a.team_id = e.radiant_team_id LEFT JOIN known b ON b.team_id = e.dire_team_id WHERE e.start_time >= TIMESTAMP '2000-01-01'""",
    CONTESTS, ELO, "known AS (SELECT team_id, max_by(rating_after, n) r FROM log WHERE start_time < TIMESTAMP '2000-01-01' GROUP BY 1)",
)
def predictions(spark, d):
    out = serving.predict(v.pro_contests(spark, d), "2000-01-01")
    why = F.get_json_object("explanation", "$.contribution.elo_difference").cast("double")
    return out.select("match_id", "start_time", "radiant_team_id", "dire_team_id", *r6("probability"), "confidence", F.round(why, 4).alias("elo_difference"))


# Streams: the same results from micro-batches


@query("SELECT DISTINCT 'feed' source, event_type endpoint, sha256(props) content_hash FROM events")
def stream_raw_dedup(spark, d):
    return streams.deduplicated(spark, f"{d}/events.parquet")


@query("SELECT user_id, max_by(event_type, event_id) event_type, max_by(value, event_id) value, min_by(ts, event_id) first_seen FROM events GROUP BY 1")
def stream_merge(spark, d):
    return streams.merged_stream(spark, f"{d}/events.parquet")


@query(f"SELECT match_id, start_time, radiant_team_id, dire_team_id, radiant_win, {', '.join(f'round({c}, 6) {c}' for c in RATINGS)} FROM elo", CONTESTS, elo_sql("contests"))
def stream_elo(spark, d):
    return streams.rated_stream(spark, f"{d}/orders.parquet").select("match_id", "start_time", "radiant_team_id", "dire_team_id", "radiant_win", *r6(*RATINGS))
