"""Age and freshness on two scales; every "now" is an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400


def age_seconds(then: Column, as_of: Column) -> Column:
    return F.unix_timestamp(as_of) - F.unix_timestamp(then)


def age_days(then: Column, as_of: Column) -> Column:
    """Whole days, rounded towards earlier."""
    return F.floor(age_seconds(then, as_of) / DAY)


def display_level(then: Column, as_of: Column) -> Column:
    """fresh up to 7 whole days, recent up to 30, stale up to 90, outdated beyond; unknown without a time."""
    days = age_days(then, as_of)
    return F.when(then.isNull(), "unknown").when(days <= 7, "fresh").when(days <= 30, "recent").when(days <= 90, "stale").otherwise("outdated")


def cache_status(then: Column, as_of: Column, pinned: Column | None = None) -> Column:
    """fresh under 7 days, stale under 30, outdated beyond or never checked; pinned rows stay fresh."""
    seconds = age_seconds(then, as_of)
    status = F.when(then.isNull(), "outdated").when(seconds < 7 * DAY, "fresh").when(seconds < 30 * DAY, "stale").otherwise("outdated")
    return status if pinned is None else F.when(pinned, "fresh").otherwise(status)


def _plural(n: Column, unit: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {unit} ago")).otherwise(F.lit(f" {unit}s ago")))


def age_text(then: Column, as_of: Column) -> Column:
    """``just now`` up to ``n years ago``."""
    seconds = age_seconds(then, as_of)
    days = F.floor(seconds / DAY)
    minutes, hours = F.floor(seconds / 60), F.floor(seconds / 3600)
    weeks, months, years = F.floor(days / 7), F.floor(days / 30), F.floor(days / 365)
    return (
        F.when(then.isNull(), "unknown")
        .when(seconds < 60, "just now")
        .when(seconds < 3600, _plural(minutes, "minute"))
        .when(days < 1, _plural(hours, "hour"))
        .when(days < 7, _plural(days, "day"))
        .when(days < 30, _plural(weeks, "week"))
        .when(days < 365, _plural(months, "month"))
        .otherwise(_plural(years, "year"))
    )


def should_update(then: Column, as_of: Column, limit_days: int = 90) -> Column:
    return F.coalesce(age_days(then, as_of) > limit_days, F.lit(True))


def parse_time(text: Column) -> Column:
    """Time of four written forms, else null."""
    forms = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in forms))
