"""The wide event table, and tables that are read as one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by hash of their keys over as many tasks as the session shuffles into. A file of few row groups is read by few tasks, too few for much work on each row."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def event_view(raw: DataFrame) -> DataFrame:
    """seq, ts (whole seconds), level, service, host, template_id, trace_id, message, source, value of a click-stream table.

    ts is null where the time is; all else follows its inputs' nulls.
    """
    k = F.get_json_object("props", "$.k")
    ts = F.unix_seconds(F.col("ts").cast("timestamp"))
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "warn").when(F.col("event_type") == "view", "debug").otherwise("info")
    user = F.col("user_id").cast("string")
    return raw.select(
        F.col("event_id").alias("seq"), ts.alias("ts"), level.alias("level"), F.col("event_type").alias("service"), F.concat(F.lit("h"), (F.col("user_id") % 4).cast("string")).alias("host"),
        k.cast("long").alias("template_id"), F.concat(F.lit("u"), user, F.lit("-"), F.floor(ts / 86400).cast("string")).alias("trace_id"),
        F.concat("event_type", F.lit(" k="), k, F.lit(" user="), user).alias("message"), F.concat(F.lit("src"), (F.col("user_id") % 8).cast("string")).alias("source"), "value",
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_view(table(spark, sf_dir, "events"))
