"""Log files: logical records, line formats, and their fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.levels import normalize

_STAMP = r"^(?:\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d|\d{4}/\d\d/\d\d )"
_PAIR = r'([A-Za-z_][\w.]*)=("(?:[^"\\]|\\.)*"|[^\s"]*)'


def lines(spark: SparkSession, path: str) -> DataFrame:
    """source, line_no and line of every text file under a path. Files are read whole, one row each, so line numbers need no shuffle."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).withColumn("source", F.col("_metadata.file_path"))
    return files.select("source", F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("line_no", "line"))


def records(rows: DataFrame) -> DataFrame:
    """Logical records of (source, line_no, line): a line with a time stamp or JSON object starts one, others continue it."""
    starts = F.col("line").rlike(_STAMP) | F.col("line").rlike(r"^\s*\{.*\}\s*$") | F.col("line").rlike(r"^[a-z_]+=")
    order = Window.partitionBy("source").orderBy("line_no")
    numbered = rows.withColumn("record", F.sum(F.when(starts, 1).otherwise(0)).over(order))
    grouped = numbered.groupBy("source", "record").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return grouped.select("source", "record", F.array_join(F.col("l.line"), "\n").alias("text"), F.size("l").alias("n_lines"))


def line_format(text: Column) -> Column:
    return (
        F.when(text.rlike(r"^\s*\{[\s\S]*\}\s*$"), "json").when(text.rlike(r"^<\d{1,3}>"), "syslog").when(F.size(F.regexp_extract_all(text, F.lit(_PAIR), F.lit(1))) >= 2, "logfmt").when(text.rlike(_STAMP), "stamped").otherwise("plain")
    )


def logfmt(text: Column) -> Column:
    """Keys and values of a line; of repeated keys the first counts."""
    keys, values = (F.regexp_extract_all(text, F.lit(_PAIR), F.lit(i)) for i in (1, 2))
    bare = F.transform(values, lambda v: F.regexp_replace(v, r'^"([\s\S]*)"$', "$1"))
    pairs = F.arrays_zip(keys.alias("key"), bare.alias("value"))
    first = F.filter(F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), p["value"].alias("value"), i.alias("i"))), lambda p: F.array_position(keys, p["key"]) == p["i"] + 1)
    return F.map_from_entries(F.transform(first, lambda p: F.struct(p["key"], p["value"])))


def fields(rows: DataFrame) -> DataFrame:
    """`rows` with format, level, message, service and trace_id of `text`; a line that has none is its own message."""
    t, pairs = F.col("text"), F.col("_pairs")
    is_json, is_pairs = F.col("format") == "json", F.col("format") == "logfmt"
    json = lambda *names: F.coalesce(*(F.get_json_object(t, f"$.{n}") for n in names))
    pair = lambda *names: F.coalesce(*(pairs[n] for n in names))
    either = lambda *names: F.when(is_json, json(*names)).when(is_pairs, pair(*names))
    out = rows.withColumn("format", line_format(t)).withColumn("_pairs", F.when(F.col("format") == "logfmt", logfmt(t)))
    spoken = F.nullif(F.regexp_extract(t, r"(?i)\b(trace|debug|info|notice|warn|warning|error|critical|fatal)\b", 1), F.lit(""))
    level = normalize(F.coalesce(either("level", "severity", "lvl"), spoken))
    return out.select(*rows.columns, "format", level.alias("level"), F.coalesce(either("message", "msg", "log"), t).alias("message"), either("service", "app", "component").alias("service"), either("trace_id", "traceId", "trace").alias("trace_id"))
