"""Scores of a record as Column expressions; ``now`` is always a given literal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekeep import schema as S

DAY_US = 86_400_000_000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parsed(text: Column | str) -> Column:
    """A timestamp from ISO text; null where it can't be read."""
    return col(text).try_cast("timestamp")


def days_between(then: Column | str, now: Column) -> Column:
    """Days from ``then`` to ``now`` as a double, never negative; 0 for null."""
    us = F.timestamp_diff("MICROSECOND", col(then), now)
    return F.coalesce(F.greatest(us.cast("double") / F.lit(float(DAY_US)), F.lit(0.0)), F.lit(0.0))


def reference_time() -> Column:
    """The latest of the confirmation, update and creation."""
    return F.greatest("last_confirmed", "updated_at", "created_at")


def freshness(days: Column, decay: float = S.DECAY) -> Column:
    return F.lit(S.FRESHNESS_FLOOR) + F.lit(1.0 - S.FRESHNESS_FLOOR) * F.exp(F.lit(-decay) * days)


def access_score(count: Column | str) -> Column:
    c = col(count)
    return F.when(c <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.log(c.cast("double") + 1.0) / F.log(F.lit(float(S.ACCESS_FULL)))))


def mapped(column: Column | str, values: dict, default) -> Column:
    out = F.lit(default)
    for key, value in values.items():
        out = F.when(col(column) == key, F.lit(value)).otherwise(out)
    return out


def confidence_score(confidence: Column | str = "confidence") -> Column:
    return mapped(confidence, S.CONFIDENCE_WEIGHT, 0.0)


def confidence_rank(confidence: Column | str = "confidence") -> Column:
    return mapped(confidence, S.CONFIDENCE_RANK, 0)


def normalised_weights(weights: dict[str, float] | None = None) -> dict[str, float]:
    """Negative weights become 0 and the rest sum to 1; all zero: the defaults."""
    given = {k: max(0.0, float((weights or S.WEIGHTS).get(k, 0.0))) for k in S.WEIGHTS}
    total = sum(given.values())
    return {k: v / total for k, v in given.items()} if total else dict(S.WEIGHTS)


def composite(relevance: Column, now: Column, weights: dict[str, float] | None = None, decay: float = S.DECAY) -> Column:
    """The weighted sum of relevance, freshness, access and confidence of a record."""
    w = normalised_weights(weights)
    fresh = freshness(days_between(reference_time(), now), decay)
    return relevance * w["relevance"] + fresh * w["freshness"] + access_score("access_count") * w["access"] + confidence_score() * w["confidence"]


def dormant(now: Column, days: int = S.DORMANT_DAYS) -> Column:
    return days_between("last_accessed", now) >= days


def deprecation_suggested(now: Column, days: int = S.DEPRECATE_DAYS) -> Column:
    return F.col("last_confirmed").isNotNull() & (days_between("last_confirmed", now) >= days)


def _plural(n: Column, unit: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {unit} ago").otherwise(f" {unit}s ago"))


def relative_age(then: Column | str, now: Column) -> Column:
    """``just now`` ... ``3 years ago``."""
    days = days_between(then, now)
    minutes, hours = F.floor(days * 1440.0), F.floor(days * 24.0)
    return (
        F.when(days * 1440.0 < 2, "just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" minutes ago")))
        .when(hours < 24, _plural(hours, "hour"))
        .when(days < 7, _plural(F.floor(days), "day"))
        .when(days < 60, _plural(F.floor(days / 7), "week"))
        .when(days < 365, _plural(F.floor(days / 30), "month"))
        .otherwise(_plural(F.floor(days / 365), "year"))
    )


def age_label(now: Column) -> Column:
    """The age, with the update's age behind it where that differs and is later."""
    base, update = relative_age("created_at", now), relative_age(reference_time(), now)
    return F.when((reference_time() > F.col("created_at")) & (base != update), F.concat(base, F.lit(" (updated "), update, F.lit(")"))).otherwise(base)


def health(now: Column) -> Column:
    """Freshness, access and confidence alone, from the first timestamp that is set."""
    days = days_between(F.coalesce("last_confirmed", "updated_at", "created_at"), now)
    return (freshness(days) * 0.1 + access_score("access_count") * 0.1 + confidence_score() * 0.35) / 0.55
