"""Time, number and map functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_of(seconds: Column) -> Column:
    """The UTC day's first second."""
    return seconds - seconds % 86400


def hour_of_week(seconds: Column, zone: str = "America/Los_Angeles") -> Column:
    """0 to 167 from Sunday midnight in a zone."""
    local = F.from_utc_timestamp(F.timestamp_seconds(seconds), zone)
    return (F.dayofweek(local) - 1) * 24 + F.hour(local)


def rfc3339(seconds: Column) -> Column:
    """UTC text; empty where there is no time (null or 0)."""
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, "").otherwise(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def local_or_rfc(text: Column, zone: str = "America/Los_Angeles", pattern: str = "yyyy-MM-dd'T'HH:mm:ss") -> Column:
    """A stamp with an offset as it is, one without in a zone's local time; null where neither reads."""
    zoned = F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text))
    return F.coalesce(zoned, F.to_utc_timestamp(F.try_to_timestamp(text, F.lit(pattern)), zone))


def flexible_number(json: Column, path: str) -> Column:
    """A number that may be quoted; null when absent or unreadable."""
    return F.get_json_object(json, path).try_cast("double")


def converted(unit: Column, value: Column) -> Column:
    """Metric values by unit code: m/s to km/h, Fahrenheit to Celsius, feet to metres, inches to millimetres."""
    u = F.lower(unit)
    return F.when(u.contains("m_s-1"), value * 3.6).when(u.contains("degf"), (value - 32) * 5 / 9).when(u.contains("[ft"), value * 0.3048).when(u.contains("[in"), value * 25.4).otherwise(value)


def trimmed_degree(v: Column) -> Column:
    return F.round(v * 1e5) / 1e5


def freshness(age: Column, ttl: int) -> Column:
    """fresh, stale up to twice the time to live, then very stale."""
    return F.when(age <= ttl, "fresh").when(age <= 2 * ttl, "stale").otherwise("very stale")


def span_end(status: Column, observed: Column, expires: Column, now: Column) -> Column:
    end = F.when(status.isin("RESOLVED", "EXPIRED", "CANCELLED"), observed).otherwise(now)
    return F.least(end, F.coalesce(expires, end))


def public_map(m: Column, hidden: list[str]) -> Column:
    """Without internal keys and blank values."""
    return F.map_filter(m, lambda k, v: ~k.isin(*hidden) & (F.trim(v) != ""))


def seconds_or_null(stamp: Column) -> Column:
    """Whole seconds of a timestamp, cut; null for none and for the zero time."""
    return F.nullif(F.unix_seconds(stamp.cast("timestamp")), F.lit(0).cast("bigint"))


def stamp_or_null(seconds: Column) -> Column:
    """The timestamp of seconds; 0 and null are no time."""
    return F.timestamp_seconds(F.nullif(seconds, F.lit(0).cast("bigint")))


def whole(v: Column) -> Column:
    """The nearest whole number, halves away from zero; null stays."""
    return F.round(v, 0).cast("int")


def tenth(v: Column) -> Column:
    return F.round(v, 1)


def weak_tag(version: Column, *parts: Column) -> Column:
    """A weak validator of a list: the same for the same version and parameters, in their order."""
    return F.concat(F.lit('W/"'), version, F.lit("-"), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 16), F.lit('"'))


def window_seconds(said: Column, most_days: int = 400) -> Column:
    """Seconds of a span like 90m, 24h or 7d, at most so many days; null for what does not read or is not positive."""
    n, unit = F.regexp_extract(said, "^([0-9]+)([smhd])$", 1).try_cast("bigint"), F.regexp_extract(said, "^([0-9]+)([smhd])$", 2)
    size = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
    return F.when(n > 0, F.least(n * size, F.lit(most_days * 86400)))
