import datetime as dt
import json

import pytest

from ladderline.plans import ingest
from ladderline.sources import http
from ladderline.sources.settings import Settings, since
from ladderline.sources.store import Store

NOW = dt.datetime(2024, 3, 1)


def client(*answers, retries=4):
    told, slept = list(answers), []

    def transport(url, params, timeout):
        a = told.pop(0) if len(told) > 1 else told[0]
        if a is None:
            raise OSError
        return a

    return http.HttpClient(transport, max_retries=retries, sleep=slept.append), slept


def test_server_errors_are_tried_again():
    c, slept = client((503, {}, ""), None, (200, {}, "[1]"))
    assert c.get_json("u") == [1] and slept == [1, 2]
    c, slept = client((500, {}, ""))
    with pytest.raises(http.TransientHttpError):
        c.get_json("u")
    assert slept == [1, 2, 4]


def test_client_errors_and_bad_bodies_are_not():
    c, slept = client((404, {}, ""))
    with pytest.raises(http.PermanentHttpError) as e:
        c.get_json("u")
    assert e.value.status_code == 404 and slept == []
    with pytest.raises(ValueError):
        client((200, {}, "nope"))[0].get_json("u")


def test_waits_as_long_as_asked():
    c, slept = client((429, {"Retry-After": "0.05"}, ""), (200, {}, "{}"))
    assert c.get_json("u") == {} and slept == [0.05]
    assert http.retry_after("soon") is None


def test_rate_limit():
    slept = []
    r = http.RateLimiter(60, clock=lambda: 0.0, sleep=slept.append)
    r.wait(), r.wait(), r.wait()
    assert slept == [1.0, 2.0]
    with pytest.raises(ValueError):
        http.RateLimiter(0)


def test_settings():
    s = Settings.of({"TRAIN_START": "2023-01-01", "TEST_START": "2024-01-01", "RATE_LIMIT": "10", "RAW_DATA_ENABLED": "no", "MAX_RETRIES": ""})
    assert (s.rate_limit_per_min, s.raw_data_enabled, s.max_retries) == (10, False, 4)
    with pytest.raises(ValueError):
        Settings.of({"TRAIN_START": "2024-01-01", "VALIDATION_START": "2024-01-01"})
    assert since(None, None, None, NOW) == NOW - dt.timedelta(days=365)


def feed():
    """14 contests in two pages; details of the first eight."""
    leagues = [{"leagueid": 5000, "tier": "premium", "name": "A"}, {"leagueid": 5001, "tier": "amateur", "name": "B"}]
    teams = [100, 200, 300, 400]
    rows = []
    for i in range(14):
        r, d = teams[i % 4], teams[(i + 1 + i % 2) % 4]
        day = dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(days=3 * i)
        rows.append({"match_id": 7001 + i, "duration": 1800, "start_time": int(day.timestamp()), "radiant_team_id": r, "radiant_name": f" T{r} ", "dire_team_id": d, "dire_name": f"T{d}", "leagueid": 5001 if i > 11 else 5000, "league_name": "L", "radiant_win": i % 2 == 0})
    newest = rows[::-1]

    def detail(m):
        players = [{"account_id": None if (m, k) == (7001, 4) else 10 * k + m % 3, "player_slot": k if k < 5 else 123 + k, "hero_id": 1 + k} for k in range(10)]
        picks = None if m == 7002 else [{"is_pick": True, "hero_id": 1, "team": 0, "order": 0}, {"is_pick": False, "hero_id": 2, "team": 1, "order": 1}]
        if m == 7003:
            players[0]["hero_id"] = 999
        return {"match_id": m, "players": players, "picks_bans": picks, "radiant_team_id": -1}

    def get(path, params):
        if path == "leagues":
            return leagues
        if path == "proMatches":
            less = params.get("less_than_match_id", 1 << 60)
            return [r for r in newest if r["match_id"] < less][:7]
        m = int(path.rpartition("/")[2])
        if m > 7008:
            raise http.PermanentHttpError(404)
        return detail(m)

    return get


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    heroes = spark.createDataFrame([(i, "h", "H", "str", "Melee", ["x"]) for i in range(1, 12)], "hero_id int, name string, localized_name string, primary_attr string, attack_type string, roles array<string>")
    patches = spark.createDataFrame([(54, "7.35", dt.datetime(2023, 12, 1)), (55, "7.36", dt.datetime(2024, 2, 20))], "patch_id int, name string, released_at timestamp")
    assert ingest.sync_reference(store, heroes, patches) == (11, 2)
    first = ingest.run(store, feed(), dt.datetime(2024, 1, 1), NOW, NOW)
    return store, first


def test_a_load(loaded):
    store, first = loaded
    assert (first.fetched, first.skipped, first.rejected, first.upserted, first.raw_written) == (14, 0, 1, 13, 12)
    assert store.read("matches").count() == 13 and store.read("teams").count() == 4 and store.read("leagues").count() == 2
    assert {r.patch_id for r in store.read("matches").collect()} == {54}
    assert store.read("match_players").count() == 70 and store.read("picks_bans").count() == 12
    assert {r.name for r in store.read("teams").collect()} == {"T100", "T200", "T300", "T400"}
    slots = sorted(r.player_slot for r in store.read("match_players").where("match_id = 7001").collect())
    assert slots == [0, 1, 2, 3, 4, 128, 129, 130, 131, 132]
    assert ingest.checkpoint(store) == dt.datetime(2024, 2, 9, 0, 0, 0, 1)


def test_a_second_load_changes_nothing(loaded):
    store, _ = loaded
    before = {t: store.read(t).drop("last_seen") for t in ("matches", "teams", "match_players", "picks_bans")}
    before = {t: sorted(map(repr, df.collect())) for t, df in before.items()}
    again = ingest.run(store, feed(), dt.datetime(2024, 1, 1), NOW, NOW)
    assert again.raw_written == 0
    assert before == {t: sorted(map(repr, store.read(t).drop("last_seen").collect())) for t in before}
    none = ingest.run(store, feed(), ingest.checkpoint(store), NOW, NOW + dt.timedelta(hours=1))
    assert none.fetched == 0 and ingest.checkpoint(store) == dt.datetime(2024, 2, 9, 0, 0, 0, 1)


def test_a_failed_load_is_written_down(loaded):
    store, _ = loaded

    def broken(path, params):
        raise http.TransientHttpError("down")

    with pytest.raises(http.TransientHttpError):
        ingest.run(store, broken, dt.datetime(2024, 1, 1), NOW, NOW)
    assert store.read("ingestion_runs").where("status = 'failed' and error = 'down'").count() == 1


def test_secrets_are_not_stored(spark):
    from ladderline.sources import feed as f

    raw = f.raw_frame(spark, [("leagues", {"api_key": "s", "page": 1}, [1])], NOW).first()
    assert raw.request_params == {"page": "1"} and len(raw.content_hash) == 64 and json.loads(raw.response_body) == [1]


def test_command_line(spark, tmp_path, capsys):
    from ladderline import cli

    get, root = feed(), tmp_path / "feed"
    (root / "matches").mkdir(parents=True)
    rows = get("proMatches", {})
    for name, body in {"leagues": get("leagues", {}), "page1": rows, "page2": get("proMatches", {"less_than_match_id": rows[-1]["match_id"]}), "matches/7001": get("matches/7001", {})}.items():
        (root / f"{name}.json").write_text(json.dumps(body))
    hero = {str(i): {"id": i, "name": "h", "localized_name": "H", "primary_attr": "str", "attack_type": "Melee", "roles": ["x"]} for i in range(1, 12)}
    (root / "heroes.json").write_text(json.dumps(hero))
    (root / "patches.json").write_text(json.dumps([{"name": "7.35", "date": "2023-12-01T00:00:00Z", "id": 54}]))
    store = ["--store", str(tmp_path / "store"), "--feed", str(root)]
    assert cli.main(["check", *store]) == 0
    assert cli.main(["ingest", *store, "--since", "2024-01-01", "--until", "2024-03-01"]) == 0
    assert cli.main(["dataset", *store]) == 0
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [c["status"] for c in out[0]["checks"]] == ["VERIFIED", "VERIFIED", "SKIPPED"] and out[1]["upserted"] == 14 and out[2]["rows"] == 12
    assert Store(spark, str(tmp_path / "store")).read("match_features").count() == 24


def test_source_report():
    from ladderline.sources.health import source_report

    row = dict.fromkeys(["match_id", "start_time", "duration", "radiant_team_id", "radiant_name", "dire_team_id", "dire_name", "leagueid", "league_name", "radiant_win"], 1)
    pages = {None: [row | {"match_id": 9}, row | {"match_id": 7}], 7: [row | {"match_id": 3}]}
    draft = {"picks_bans": [{"is_pick": True, "hero_id": 1, "team": 0, "order": 0, "more": 1}]}

    def get(path, params):
        return draft if path == "matches/9" else pages[params.get("less_than_match_id")]

    status = lambda r: [c["status"] for c in r]
    report = source_report(get, 9)
    assert status(report) == ["VERIFIED"] * 3 and (report[0]["least_id"], report[0]["greatest_id"]) == (7, 9)
    assert status(source_report(get)) == ["VERIFIED", "VERIFIED", "SKIPPED"]
    del draft["picks_bans"][0]["team"]
    assert source_report(get, 9)[2]["missing"] == ["team"]
    pages[7][0]["match_id"] = 8  # a page that isn't older
    assert status(source_report(get)) == ["VERIFIED", "FAILED", "SKIPPED"]
    pages[None] = []
    assert status(source_report(get)) == ["FAILED", "SKIPPED", "SKIPPED"]

    def broken(path, params):
        raise OSError("gone")

    assert source_report(broken)[0] == {"check": "list", "status": "FAILED", "error": "OSError: gone"}


def test_service_report():
    from ladderline.sources.health import service_report

    told = {"status": {"ok": 1}, "explorer": {"rows": [{"year": "2021-01-01T00:00:00Z", "match_count": "5"}, {"year": "2019-01-01T00:00:00Z", "match_count": 7}]}}
    up, history = service_report(lambda path, params: told[path])
    assert up["status"] == history["status"] == "VERIFIED" and (history["first_year"], history["years"], history["contests"]) == ("2019", 2, 12)
    told["explorer"] = {"rows": []}
    assert [c["status"] for c in service_report(lambda path, params: told[path])] == ["VERIFIED", "FAILED"]
    told["explorer"] = {"err": "syntax"}
    assert service_report(lambda path, params: told[path])[1]["error"] == "ValueError: syntax"


def test_requests_say_who_asks(monkeypatch):
    import io
    import urllib.request

    asked = []

    class Answer(io.BytesIO):
        status, headers = 200, {}

    monkeypatch.setattr(urllib.request, "urlopen", lambda r, timeout: asked.append(r) or Answer(b"[]"))
    get = http.live_feed(Settings(feed_base_url="https://example.org", contact_email="a@b.org"))
    assert get("leagues", {}) == [] and asked[0].get_header("User-agent") == "ladderline (a@b.org)"
