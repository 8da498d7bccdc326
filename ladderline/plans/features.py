"""Declared features, and a planner that computes a set of them with one exchange per partitioning.

A feature says what it is made from (columns of the team-centric rows, or other features), which window
it looks through, at which stage of a contest it is known, and what becomes of a null. The planner
orders features by what they need, computes all that look through one window partitioning in one
select, and refuses what isn't known yet: a feature of the draft, or one made from it, has no place in
a set that is read before the match.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderline.operators import teams

#: Stages in the order in which they come.
STAGES = ("pre_match", "draft")
#: What becomes of a null: it stays, or is a zero with a flag beside it.
NULLS = ("keep", "zero_and_flag")


@dataclass(frozen=True)
class FeatureSpec:
    name: str
    make: Callable[[], Column]
    inputs: tuple[str, ...] = ()
    version: str = "v0"
    stage: str = "pre_match"
    #: The columns that its window is partitioned by; () for one that looks at its own row only.
    window: tuple[str, ...] = ("team_id",)
    nulls: str = "keep"

    def __post_init__(self) -> None:
        if self.stage not in STAGES or self.nulls not in NULLS:
            raise ValueError(f"{self.name}: no such stage or rule for nulls")


class LeakedFeature(ValueError):
    """A feature that isn't known at the stage it is asked for."""


@dataclass
class Registry:
    specs: dict[str, FeatureSpec] = field(default_factory=dict)

    def add(self, *specs: FeatureSpec) -> None:
        for s in specs:
            if self.specs.get(s.name, s) != s:
                raise ValueError(f"{s.name} is declared twice")
            self.specs[s.name] = s

    def ordered(self, names: Iterable[str]) -> list[FeatureSpec]:
        """The features and all that they need, each after what it is made from."""
        out: list[FeatureSpec] = []
        under_way: list[str] = []

        def visit(name: str) -> None:
            spec = self.specs.get(name)
            if spec is None or spec in out:  # a column of the rows, or there already
                return
            if name in under_way:
                raise ValueError(f"{' -> '.join([*under_way, name])} is a circle")
            under_way.append(name)
            for i in spec.inputs:
                visit(i)
            under_way.pop()
            out.append(spec)

        for name in names:
            if name not in self.specs:
                raise KeyError(f"no feature {name}")
            visit(name)
        return out

    def waves(self, names: Iterable[str]) -> list[tuple[tuple[str, ...], list[FeatureSpec]]]:
        """(window, features) in the order of computing: a feature goes with the others of its window as
        soon as what it needs is there, so a window comes again only where something lies between."""
        todo, done, out = self.ordered(names), set(), []
        while todo:
            ready = [s for s in todo if all(i in done or i not in self.specs for i in s.inputs)]
            last = out[-1][0] if out else None
            window = next((s.window for s in ready if s.window in (last, ())), ready[0].window)
            now = [s for s in ready if s.window in (window, ())]
            out.append((window, now))
            done |= {s.name for s in now}
            todo = [s for s in todo if s.name not in done]
        return out

    def computed(self, rows: DataFrame, names: Iterable[str], stage: str = "pre_match") -> DataFrame:
        """``rows`` with the features ``names``; what only helped to make them is dropped."""
        names = list(names)
        for s in self.ordered(names):
            if STAGES.index(s.stage) > STAGES.index(stage):
                raise LeakedFeature(f"{s.name} is known at the stage {s.stage}, not at {stage}")
            lost = [i for i in s.inputs if i not in self.specs and i not in rows.columns]
            if lost:
                raise KeyError(f"{s.name} needs {', '.join(lost)}")
        out, kept = rows, list(rows.columns)
        for _, specs in self.waves(names):
            out = out.withColumns({s.name: s.make() for s in specs})
        for s in map(self.specs.get, names):
            kept.append(s.name)
            if s.nulls == "zero_and_flag":
                out = out.withColumn(f"{s.name}_is_missing", F.col(s.name).isNull()).na.fill(0, [s.name])
                kept.append(f"{s.name}_is_missing")
        return out.select(*kept)

    def described(self, spark) -> DataFrame:
        """A row per feature, for the store's table of feature sets."""
        rows = [(s.name, s.version, s.stage, list(s.inputs), list(s.window), s.nulls) for s in self.specs.values()]
        return spark.createDataFrame(rows, "name string, version string, stage string, inputs array<string>, window array<string>, nulls string")


def team_features(window: int = teams.FORM_WINDOW) -> Registry:
    """The features of a team's own history, over team-centric rows."""
    base = ("team_id", "start_time", "match_id")
    r = Registry()
    r.add(
        FeatureSpec("recent_winrate", lambda: teams.recent_winrate(window), (*base, "won")),
        FeatureSpec("recent_winrate_10", lambda: teams.recent_winrate(10), (*base, "won")),
        FeatureSpec("recent_winrate_20", lambda: teams.recent_winrate(20), (*base, "won")),
        FeatureSpec("winrate", teams.winrate_before, (*base, "won")),
        FeatureSpec("ema_form", teams.ema_form, (*base, "won")),
        FeatureSpec("days_since_last_match", teams.rest_days, base),
        FeatureSpec("matches_played_before", teams.played_before, base),
        FeatureSpec("form_trend", lambda: F.col("recent_winrate") - F.col("recent_winrate_20"), ("recent_winrate", "recent_winrate_20"), window=()),
        FeatureSpec("is_rested", lambda: F.col("days_since_last_match") > 7, ("days_since_last_match",), window=()),
    )
    return r


def draft_features() -> Registry:
    """What is known only once heroes are picked."""
    r = team_features()
    r.add(
        FeatureSpec("draft_strength", lambda: F.col("draft_winrate"), ("draft_winrate",), stage="draft", window=()),
        FeatureSpec("draft_edge", lambda: F.col("draft_strength") - F.col("winrate"), ("draft_strength", "winrate"), window=()),
    )
    return r
