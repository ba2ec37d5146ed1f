"""Local times in named zones, by a table of the zones' offsets over time."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The years whose instants are resolved.
FIRST_YEAR, LAST_YEAR = 1970, 2100
_OFFSETS = "zone string, from_utc long, until_utc long, offset long, abbreviation string"


def _periods(zone: str, first: int, last: int) -> list[tuple[str, int, int, int, str]]:
    """The periods of one offset and abbreviation: (zone, first second, second after the last, offset, abbreviation)."""
    info = ZoneInfo(zone)
    at = lambda second: datetime.fromtimestamp(second, UTC).astimezone(info)
    told = lambda second: (int(at(second).utcoffset().total_seconds()), at(second).tzname())
    begin, end = int(datetime(first, 1, 1, tzinfo=UTC).timestamp()), int(datetime(last + 1, 1, 1, tzinfo=UTC).timestamp())
    out, now, since, step = [], told(begin), begin, int(timedelta(days=7).total_seconds())
    for second in range(begin, end, step):
        later = min(second + step, end - 1)
        if told(later) == now:
            continue
        low, high = second, later
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if told(mid) == now else (low, mid)
        out.append((zone, since, high, *now))
        now, since = told(high), high
    return [*out, (zone, since, end, *now)]


def offsets(spark: SparkSession, zones: list[str], first: int = FIRST_YEAR, last: int = LAST_YEAR) -> DataFrame:
    """zone, from_utc, until_utc (exclusive), offset, abbreviation of named zones: a few hundred rows a zone, so as many as the zones declared."""
    return spark.createDataFrame([p for z in sorted(set(zones)) for p in _periods(z, first, last)], _OFFSETS)


def resolved(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """key, ts, offset, reason of `rows` (key: unique, local: seconds of the local calendar as if it were UTC, zone, abbreviation or null).

    A local time may fall in no period of its zone (gap), in one, or in several (fold). What is
    written behind it decides a fold if it names just one of the periods; if it names none of
    them the reason is mismatch. A zone that `table` has not is unknown_zone, a time outside of
    its years out_of_range, a null time no_time. Only resolved times have ts and offset. Times meet periods by zone and year.
    """
    year = lambda second: F.floor(second / 31_557_600)
    spans = table.select(F.col("zone").alias("_zone"), (F.col("from_utc") + F.col("offset")).alias("_from"), (F.col("until_utc") + F.col("offset")).alias("_until"), F.col("offset").alias("_offset"), F.col("abbreviation").alias("_name"))
    spans = spans.withColumn("_year", F.explode(F.sequence(year(F.col("_from")), year(F.col("_until") - 1))))
    asked = rows.select(key, "local", "zone", "abbreviation")
    met = asked.join(spans, (F.col("zone") == F.col("_zone")) & (year(F.col("local")) == F.col("_year")) & (F.col("local") >= F.col("_from")) & (F.col("local") < F.col("_until")), "left")
    agrees = F.col("_offset").isNotNull() & (F.col("abbreviation").isNull() | (F.upper("abbreviation") == F.upper("_name")))
    found = met.groupBy(key).agg(
        F.first("local").alias("local"), F.first("zone").alias("zone"), F.first("abbreviation").alias("abbreviation"), F.count("_offset").alias("n"), F.count_if(agrees).alias("named"), F.min(F.when(agrees, F.col("_offset"))).alias("offset")
    )
    known = table.groupBy(F.col("zone").alias("_known")).agg(F.min(F.col("from_utc") + F.col("offset")).alias("_least"), F.max(F.col("until_utc") + F.col("offset")).alias("_most"))
    told = found.join(known, F.col("zone") == F.col("_known"), "left")
    reason = (
        F.when(F.col("local").isNull(), "no_time").when(F.col("_known").isNull(), "unknown_zone").when((F.col("local") < F.col("_least")) | (F.col("local") >= F.col("_most")), "out_of_range").when(F.col("n") == 0, "gap").when(F.col("named") == 1, "resolved")
        .when(F.col("named") > 1, "fold").otherwise("mismatch")
    )
    done = F.col("reason") == "resolved"
    return told.withColumn("reason", reason).select(key, F.when(done, F.col("local") - F.col("offset")).alias("ts"), F.when(done, F.col("offset")).alias("offset"), "reason")


def preview(results: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """source, reason, n: what a declaration of zones would resolve, by the source of each key, before anything is changed."""
    return results.join(source, key).groupBy("source", "reason").agg(F.count("*").alias("n"))
