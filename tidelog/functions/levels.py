"""Log levels: one vocabulary, a severity rank, and the five series of timelines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of each level.
SPELLINGS = {
    "trace": ["trace", "trc"],
    "debug": ["debug", "dbg", "debug1", "debug2", "debug3", "debug4", "debug5", "fine", "finer", "finest"],
    "info": ["info", "information", "informational", "config"],
    "notice": ["notice"],
    "log": ["log"],
    "warn": ["warn", "warning"],
    "error": ["error", "err", "severe"],
    "critical": ["critical", "crit"],
    "alert": ["alert"],
    "fatal": ["fatal", "panic"],
    "emergency": ["emergency", "emerg"],
}
# Severity ranks (0 where not listed) and timeline series (4 where not listed).
RANKS = {"emergency": 5, "alert": 5, "fatal": 5, "critical": 5, "error": 4, "warn": 3, "info": 2, "notice": 2, "log": 2, "debug": 1, "trace": 1}
BANDS = {"fatal": 0, "critical": 0, "crit": 0, "severe": 0, "error": 0, "err": 0, "warning": 1, "warn": 1, "info": 2, "notice": 2, "debug": 3, "trace": 3}
SERIES = ("error", "warn", "info", "debug", "other")


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def normalize(raw: Column) -> Column:
    """The vocabulary's level; unknown words pass in lower case, blank and null become unknown."""
    word = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    known = _lookup({s: level for level, all_ in SPELLINGS.items() for s in all_}, word)
    return F.when(word == "", "unknown").otherwise(F.coalesce(known, word))


def severity(raw: Column) -> Column:
    return F.coalesce(_lookup(RANKS, normalize(raw)), F.lit(0))


def band(level: Column) -> Column:
    """Index into SERIES."""
    return F.coalesce(_lookup(BANDS, F.lower(level)), F.lit(4))


# Documented severity tokens as numbers of the OpenTelemetry scale.
OTEL = {"trace": 1, "debug": 5, "info": 9, "notice": 10, "warn": 13, "warning": 13, "error": 17, "critical": 18, "alert": 19, "fatal": 21, "emergency": 24}


def otel_severity(token: Column) -> Column:
    """1 to 24 for documented tokens, null for others."""
    known = F.create_map(*(F.lit(x) for pair in OTEL.items() for x in pair))
    return F.element_at(known, F.lower(F.trim(token)))
