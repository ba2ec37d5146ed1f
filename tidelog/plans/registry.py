"""Queries by name, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analyses, cases, events, lines, reviews, streams, texts, triage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = events.QUERIES | texts.QUERIES | cases.QUERIES | analyses.QUERIES | lines.QUERIES | triage.QUERIES | streams.QUERIES | reviews.QUERIES
ORACLES: dict[str, str] = events.ORACLES | texts.ORACLES | cases.ORACLES | analyses.ORACLES | lines.ORACLES | triage.ORACLES | streams.ORACLES | reviews.ORACLES
