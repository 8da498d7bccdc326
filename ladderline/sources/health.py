"""Is a source fit to load from? Each check says VERIFIED, FAILED or SKIPPED, with what it saw."""

from __future__ import annotations

import time
from collections.abc import Callable

#: What a list row and a draft row must hold.
LIST_FIELDS = {"match_id", "duration", "start_time", "radiant_team_id", "radiant_name", "dire_team_id", "dire_name", "leagueid", "league_name", "radiant_win"}
DRAFT_FIELDS = {"is_pick", "hero_id", "team", "order"}


def _checked(name: str, look: Callable[[], dict | None]) -> dict:
    """``look`` gives what it saw, with "missing" where something is; None if there is nothing to look at."""
    begin = time.monotonic()
    try:
        seen = look()
    except Exception as e:  # whatever a source does wrong belongs in the report
        return {"check": name, "status": "FAILED", "error": f"{type(e).__name__}: {e}"}
    if seen is None:
        return {"check": name, "status": "SKIPPED"}
    took = round((time.monotonic() - begin) * 1000, 1)
    return {"check": name, "status": "FAILED" if seen.get("missing") else "VERIFIED", "latency_ms": took, **seen}


#: Professional contests a year, as the service is asked for them: one request instead of all pages.
HISTORY = """SELECT date_trunc('year', to_timestamp(m.start_time)) AS year, count(*) AS match_count FROM matches m JOIN leagues l ON l.leagueid = m.leagueid
 WHERE l.tier IN ('premium', 'professional') GROUP BY 1 ORDER BY 1"""


def service_report(get: Callable[[str, dict], object]) -> list[dict]:
    """Checks that only a service can answer: that it is up, and how far its history goes."""

    def up() -> dict:
        return {"fields": sorted(get("status", {}))}

    def history() -> dict:
        told = get("explorer", {"sql": HISTORY})
        if told.get("err"):
            raise ValueError(told["err"])
        rows = told.get("rows") or []
        return {"missing": [] if rows else ["rows"], "years": len(rows), "first_year": min((str(r["year"])[:4] for r in rows), default=None), "contests": sum(int(r["match_count"]) for r in rows)}

    return [_checked("status", up), _checked("history", history)]


def source_report(get: Callable[[str, dict], object], sample: int | None = None) -> list[dict]:
    """Checks of the list, of its paging by id, and of the draft of the contest ``sample`` (skipped without)."""
    first: list[dict] = []

    def listed() -> dict:
        first.extend(get("proMatches", {}))
        ids = [r["match_id"] for r in first if "match_id" in r]
        lost = LIST_FIELDS.difference(*first[:1]) if first else LIST_FIELDS
        return {"missing": sorted(lost), "rows": len(first), "least_id": min(ids, default=None), "greatest_id": max(ids, default=None)}

    def paged() -> dict | None:
        ids = [r["match_id"] for r in first if "match_id" in r]
        if not ids:
            return None
        older = get("proMatches", {"less_than_match_id": min(ids)})
        return {"missing": sorted(r["match_id"] for r in older if r["match_id"] >= min(ids)), "rows": len(older)}

    def draft() -> dict | None:
        if sample is None:
            return None
        rows = get(f"matches/{sample}", {}).get("picks_bans") or []
        return {"missing": sorted(DRAFT_FIELDS.difference(*rows[:1])) if rows else sorted(DRAFT_FIELDS), "rows": len(rows)}

    return [_checked("list", listed), _checked("paging", paged), _checked("draft", draft)]
