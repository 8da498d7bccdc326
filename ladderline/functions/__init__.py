"""Column functions of the contest domain (JVM-side, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tiers that count as professional.
PRO_TIERS = ("premium", "professional")
MICROS_PER_DAY = 86_400_000_000


def clean(text: Column) -> Column:
    """Without white space at both ends; empty becomes null."""
    return F.nullif(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit(""))


def is_pro(tier: Column) -> Column:
    """A null tier is not professional."""
    return F.coalesce(tier.isin(*PRO_TIERS), F.lit(False))


def content_hash(body: Column) -> Column:
    """sha256 of a canonical text (JSON of a struct whose fields are in a fixed order)."""
    return F.sha2(body.cast("string"), 256)


def without_secrets(params: Column, secrets: tuple[str, ...] = ("api_key",)) -> Column:
    return F.map_filter(params, lambda k, v: ~k.isin(*secrets))


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(float(MICROS_PER_DAY))


def expected_score(rating: Column, other: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (other - rating) / 400))


def confidence(p: Column) -> Column:
    """How far a probability is from even: below 0.07 low, below 0.20 medium, else high."""
    d = F.abs(p - 0.5)
    return F.when(d < 0.07, "low").when(d < 0.20, "medium").otherwise("high")


def missing_flags(*names: str) -> list[Column]:
    return [F.col(n).isNull().alias(f"{n}_is_missing") for n in names]
