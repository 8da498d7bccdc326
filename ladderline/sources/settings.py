"""Settings from a mapping of names to texts (the environment, say); empty means the default."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date, datetime, timedelta

TRUE = ("1", "true", "yes", "on")


@dataclass(frozen=True)
class Settings:
    data_start_date: date | None = None
    data_end_date: date | None = None
    min_match_date: date | None = None
    train_start: date | None = None
    validation_start: date | None = None
    test_start: date | None = None
    feed_base_url: str = ""
    feed_api_key: str = ""
    rate_limit_per_min: int = 55
    request_timeout: float = 20.0
    max_retries: int = 4
    raw_data_enabled: bool = True
    contact_email: str = ""
    retrain_interval_days: int = 90

    def __post_init__(self) -> None:
        cuts = [x for x in (self.train_start, self.validation_start, self.test_start) if x is not None]
        if any(a >= b for a, b in zip(cuts, cuts[1:])):
            raise ValueError("train, validation and test must begin one after the other")
        if self.min_match_date and self.data_start_date and self.min_match_date < self.data_start_date:
            raise ValueError("min_match_date lies before data_start_date")

    @classmethod
    def of(cls, env: Mapping[str, str]) -> Settings:
        kinds = {"date": date.fromisoformat, "int": int, "float": float, "bool": lambda x: x.strip().lower() in TRUE, "str": str}
        found = {}
        for name, f in cls.__dataclass_fields__.items():
            text = env.get(name.upper(), "") or (env.get("RATE_LIMIT", "") if name == "rate_limit_per_min" else "")
            if text.strip():
                found[name] = kinds[f.type.split(" ")[0]](text.strip())
        return cls(**found)


def since(explicit: datetime | None, checkpoint: datetime | None, configured: date | None, now: datetime) -> datetime:
    """Where a load begins: as asked, else after the checkpoint, else as configured, else a year back."""
    if explicit or checkpoint:
        return explicit or checkpoint
    return datetime(configured.year, configured.month, configured.day) if configured else now - timedelta(days=365)
