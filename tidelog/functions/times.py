"""Whole-second times: epoch units, time quality, local time in a zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower edges of the bands of milli-, micro- and nanoseconds; the last accepted second.
MILLIS, MICROS, NANOS, LATEST = 10**11, 10**14, 10**17, 4_102_444_800


def epoch_seconds(raw: Column) -> Column:
    """Seconds of an epoch of unknown unit; null for negative values, dates as digits, and times past 2100."""
    n = raw.cast("long")
    date = n.between(19_000_101, 21_001_231) & F.floor(n / 100 % 100).between(1, 12) & (n % 100).between(1, 31)
    per = F.when(n < MILLIS, F.lit(1)).when(n < MICROS, F.lit(10**3)).when(n < NANOS, F.lit(10**6)).otherwise(F.lit(10**9)).cast("long")
    seconds = (n - n % per) / per
    return F.when((n >= 0) & ~date & (seconds <= LATEST), seconds.cast("long"))


# Zone suffixes that always mean UTC, and those that name several zones.
UTC_ZONES = ("Z", "UTC", "GMT", "UCT", "ZULU")
AMBIGUOUS_ZONES = ("EST", "EDT", "CST", "CDT", "MST", "MDT", "PST", "PDT", "BST", "IST", "CET", "CEST")
_STAMP = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[T ]([0-9]{2}:[0-9]{2}:[0-9]{2})(?:[.,][0-9]+)? ?"


def explicit_time(raw: Column) -> tuple[Column, Column]:
    """Whole seconds of an epoch in digits, or of a date and time with an offset or a UTC suffix, and why not: explicit, unresolved_local, or none.

    A number is taken first; a fraction behind its seconds is cut off.
    """
    epoch = F.when(F.trim(raw).rlike(r"^[0-9]{1,19}(?:\.[0-9]+)?$"), epoch_seconds(F.regexp_extract(F.trim(raw), r"^([0-9]+)", 1).try_cast("long")))
    local = F.try_to_timestamp(F.concat_ws(" ", F.regexp_extract(raw, _STAMP, 1), F.regexp_extract(raw, _STAMP, 2)), F.lit("yyyy-MM-dd HH:mm:ss"))
    rest = F.regexp_replace(F.trim(raw), _STAMP, "")
    sign = F.when(rest.startswith("-"), -1).otherwise(1)
    offset = r"^[+-]([01][0-9]|2[0-3]):?([0-5][0-9])$"
    shift = sign * (F.regexp_extract(rest, offset, 1).try_cast("long") * 3600 + F.regexp_extract(rest, offset, 2).try_cast("long") * 60)
    whole = F.trim(raw).rlike(_STAMP) & local.isNotNull()
    seconds = F.when(epoch.isNotNull(), epoch).when(whole & F.upper(rest).isin(*UTC_ZONES), F.unix_seconds(local)).when(whole & rest.rlike(offset), F.unix_seconds(local) - shift)
    open_ = whole & ((rest == "") | F.upper(rest).isin(*AMBIGUOUS_ZONES))
    return seconds, F.when(seconds.isNotNull(), "explicit").when(open_, "unresolved_local").otherwise("none")


def rfc3339(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def calendar_text(value: Column) -> Column:
    """A time as C prints it (Sun Jun 15 12:00:00 2025), trimmed, if its day of the month and of the week exist; it names no zone, so it is no instant."""
    v = F.trim(value)
    parts = r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun) (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) +(\d{1,2}) (\d{2}:\d{2}:\d{2}) (\d{4})$"
    month = F.lpad(((F.instr(F.lit("JanFebMarAprMayJunJulAugSepOctNovDec"), F.regexp_extract(v, parts, 2)) + 2) / 3).cast("int").cast("string"), 2, "0")
    day = F.concat_ws("-", F.regexp_extract(v, parts, 5), month, F.lpad(F.regexp_extract(v, parts, 3), 2, "0"))
    at = F.try_to_timestamp(F.concat(day, F.lit(" "), F.regexp_extract(v, parts, 4)), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.when(v.rlike(parts) & (F.length(v) <= 64) & (F.date_format(at, "EEE") == F.regexp_extract(v, parts, 1)), v)


def recency(age_days: Column, half_life: Column | float = 90.0) -> Column:
    """1 for now, a half after the half-life; ages below 0 count as 0."""
    return 1 / (1 + F.greatest(age_days, F.lit(0)) / half_life)


def valid_at(start: Column, end: Column, now: Column) -> Column:
    """start <= now < end, where a null bound is open."""
    return F.coalesce(start <= now, F.lit(True)) & F.coalesce(now < end, F.lit(True))


def quality(total: Column, wall: Column) -> Column:
    return F.when((total == 0) | (wall == 0), "order_only").when(total == wall, "wall").otherwise("mixed")


def local_to_utc(local: Column, zone: str) -> tuple[Column, Column]:
    """UTC instant of a local time, and resolved, gap or fold; gaps and folds have no instant."""
    utc = F.to_utc_timestamp(local, zone)
    hour = F.expr("interval 1 hour")
    twice = (F.from_utc_timestamp(utc + hour, zone) == local) | (F.from_utc_timestamp(utc - hour, zone) == local)
    reason = F.when(F.from_utc_timestamp(utc, zone) != local, "gap").when(twice, "fold").otherwise("resolved")
    return F.when(reason == "resolved", utc), reason
