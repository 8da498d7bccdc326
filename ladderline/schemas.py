"""The tables and the wire format, declared once."""

from __future__ import annotations

from dataclasses import dataclass, field

TABLES = {
    "organizations": "organization_id long, name string, created_at timestamp",
    "teams": "team_id long, organization_id long, name string, tag string, first_seen timestamp, last_seen timestamp",
    "players": "account_id long, name string, first_seen timestamp, last_seen timestamp",
    "team_roster_periods": "id long, team_id long, account_id long, valid_from timestamp, valid_to timestamp, source string, confidence double",
    "leagues": "league_id long, name string, tier string",
    "patches": "patch_id int, name string, released_at timestamp",
    "heroes": "hero_id int, name string, localized_name string, primary_attr string, attack_type string, roles array<string>",
    "matches": "match_id long, start_time timestamp, duration int, radiant_team_id long, dire_team_id long, radiant_win boolean, league_id long, patch_id int, series_id long, series_type short, source string, ingested_at timestamp",
    "match_players": "match_id long, player_slot short, account_id long, team_id long, is_radiant boolean, hero_id int, kills int, deaths int, assists int, gold_per_min int, xp_per_min int, last_hits int, denies int, level int, hero_damage int, tower_damage int, hero_healing int",
    "picks_bans": "match_id long, ord short, is_pick boolean, hero_id int, team short",
    "team_ratings": "team_id long, match_id long, rating_before double, rating_after double, k_factor double, engine_version string, calculated_at timestamp",
    "feature_sets": "feature_set_version string, config string, created_at timestamp",
    "match_features": "match_id long, team_id long, feature_set_version string, as_of timestamp, features string",
    "models": "model_id long, name string, version string, config string, metrics string, is_active boolean, created_at timestamp",
    "predictions": "prediction_id string, match_id long, model_id long, radiant_team_id long, dire_team_id long, predicted_at timestamp, data_cutoff timestamp, probability double, explanation string",
    "raw_responses": "source string, endpoint string, request_params map<string,string>, response_body string, content_hash string, fetched_at timestamp",
    "contest_ratings": "match_id long, start_time timestamp_ntz, radiant_team_id long, dire_team_id long, radiant_win boolean, radiant_pre double, dire_pre double, radiant_post double, dire_post double",
    "rating_states": "month string, team_id long, rating double",
    "ingestion_runs": "run_id string, source string, status string, items int, checkpoint timestamp, error string, started_at timestamp, finished_at timestamp",
}


@dataclass(frozen=True)
class Merge:
    """A table's key, and the columns whose first value stays."""

    key: list[str]
    keep_first: list[str] = field(default_factory=list)


MERGES = {
    "teams": Merge(["team_id"], ["organization_id", "first_seen"]),
    "players": Merge(["account_id"], ["first_seen"]),
    "leagues": Merge(["league_id"]),
    "patches": Merge(["patch_id"]),
    "heroes": Merge(["hero_id"]),
    "matches": Merge(["match_id"], ["start_time", "radiant_team_id", "dire_team_id", "source", "ingested_at"]),
    "match_players": Merge(["match_id", "player_slot"], ["is_radiant"]),
    "picks_bans": Merge(["match_id", "ord"]),
    "team_ratings": Merge(["team_id", "match_id"]),
    "feature_sets": Merge(["feature_set_version"], ["config", "created_at"]),
    "match_features": Merge(["match_id", "team_id", "feature_set_version"]),
    "models": Merge(["name", "version"]),
}

#: Contests whose children share a partition, by blocks of ids; partitions of tables of people and teams.
CONTESTS_A_BLOCK, BUCKETS = 10_000_000, 16
_BLOCK = f"match_id div {CONTESTS_A_BLOCK}"
#: The partition of a row, as SQL; other tables are one partition. Ids grow with time, so a load touches
#: the newest blocks. Values are letters, digits, dots, dashes and underscores only.
LAYOUT = {
    "raw_responses": "concat(regexp_replace(source, '[^A-Za-z0-9-]', '_'), '.', date_format(fetched_at, 'yyyy-MM-dd'))",
    "matches": "year(start_time)",
    "match_players": _BLOCK,
    "picks_bans": _BLOCK,
    "match_features": _BLOCK,
    "team_ratings": _BLOCK,
    "teams": f"pmod(xxhash64(team_id), {BUCKETS})",
    "players": f"pmod(xxhash64(account_id), {BUCKETS})",
    "predictions": "date_format(predicted_at, 'yyyy-MM')",
    "contest_ratings": "date_format(start_time, 'yyyy-MM')",
    "rating_states": "month",
}
#: Tables whose partition follows from their key: a key that is there already is in the batch's partitions.
LAID_OUT_BY_KEY = {"match_players", "picks_bans", "match_features", "team_ratings", "teams", "players"}

LEAGUES_WIRE = "leagueid long, ticket string, banner string, tier string, name string"
MATCHES_WIRE = "match_id long, duration int, start_time long, radiant_team_id long, radiant_name string, dire_team_id long, dire_name string, leagueid long, league_name string, series_id long, series_type short, radiant_score int, dire_score int, radiant_win boolean, version int"
_PLAYER = "account_id: bigint, player_slot: int, hero_id: int, kills: int, deaths: int, assists: int, gold_per_min: int, xp_per_min: int, last_hits: int, denies: int, level: int, hero_damage: int, tower_damage: int, hero_healing: int"
DETAIL_WIRE = f"match_id long, radiant_team_id long, dire_team_id long, picks_bans array<struct<is_pick: boolean, hero_id: int, team: int, order: int>>, players array<struct<{_PLAYER}>>"
STATS = [x.split(":")[0].strip() for x in _PLAYER.split(",")][3:]
