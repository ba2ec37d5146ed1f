"""Files, feeds and documents of JSON: chunks of text, groups of rolled files, path patterns, checked events."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The size of a chunk in characters, the lines two chunks share, and the depth a document may have.
CHUNK_CHARS, OVERLAP, JSON_DEPTH = 2400, 4, 32


def _chunked(text: str) -> Iterator[tuple[int, int, str]]:
    """First line, last line (from 1, inclusive) and text of each chunk."""
    lines = [x.removesuffix("\r") for x in text.split("\n")]
    if lines[-1] == "":
        lines.pop()
    at = 0
    while at < len(lines):
        size, stop, nice = 0, at, 0
        while stop < len(lines) and (stop == at or size + len(lines[stop]) + 1 <= CHUNK_CHARS):
            size += len(lines[stop]) + 1
            stop += 1
            if lines[stop - 1].startswith("#") or not lines[stop - 1].strip():
                nice = stop
        if stop < len(lines) and nice > at + 1:
            stop = nice
        body = "\n".join(lines[at:stop])
        if body.strip():
            yield at + 1, stop, body
        if stop >= len(lines):
            return
        at = max(at + 1, stop - OVERLAP)


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, text in zip(batch["path"], batch["text"], strict=True):
            yield pd.DataFrame([(path, *c) for c in _chunked(text or "")], columns=["path", "start_line", "end_line", "text"])


def chunks(files: DataFrame) -> DataFrame:
    """path, start_line, end_line, text of the chunks of `files` (path, text).

    A chunk takes lines up to CHUNK_CHARS characters, at least one, and ends behind its
    last heading or blank line if that is not its first; the next begins OVERLAP lines
    before its end. Blank chunks and null texts give nothing. One row is a whole file.
    """
    return files.select(F.col("path").cast("string").alias("path"), "text").mapInPandas(_chunks, "path string, start_line int, end_line int, text string")


def with_files(parts: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks with what is known of their file; chunks of unknown files go."""
    return parts.join(files, "path")


def feed_items(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """One row an item of RSS feeds: title, link, snippet without markup; items without a title or link go. Other columns of `feeds` stay."""
    from ..functions.text import without_markup

    parsed = feeds.withColumn("channel", F.from_xml(F.col(xml), "channel struct<item array<struct<title string, link string, description string>>>")["channel"])
    items = parsed.select(*(c for c in feeds.columns if c != xml), F.posexplode(F.col("channel.item")).alias("place", "item"))
    rows = items.select(*(c for c in items.columns if c != "item"), F.trim("item.title").alias("title"), F.trim("item.link").alias("link"), without_markup(F.coalesce("item.description", F.lit(""))).alias("snippet"))
    return rows.where("title <> '' and link <> ''")


def path_pattern(pattern: str) -> str:
    """The regular expression, for '/' + identity, of a bounded path pattern: * and ? within a segment, ** for any number of segments.

    A pattern that is absolute, steps upwards, or is empty in a segment is an error.
    """
    parts = pattern.split("/")
    if not pattern or pattern.startswith("/") or set("\\\0") & set(pattern) or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"no relative path pattern: {pattern!r}")
    inside = {"*": "[^/]*", "?": "[^/]"}
    return "^" + "".join("(?:/[^/]*)*" if p == "**" else "/" + "".join(inside.get(c) or re.escape(c) for c in p) for p in parts) + "$"


def profiled(items: DataFrame, groups: dict[str, str]) -> DataFrame:
    """identity and the group whose path pattern it matches; null for none, `ambiguous` for several."""
    hits = F.array_compact(F.array(*(F.when(F.concat(F.lit("/"), "identity").rlike(path_pattern(p)), F.lit(g)) for g, p in groups.items())))
    return items.select("identity", F.when(F.size(hits) > 1, "ambiguous").otherwise(F.get(hits, 0)).alias("group"))


def rolled_stem(identity: Column) -> Column:
    """The path of the file that a rolled one was: without numbers, compression, and a date with or without a time; null for others."""
    leaf = F.regexp_extract(identity, r"([^/]*)$", 1)
    folder = F.regexp_extract(identity, r"^(.*/)?[^/]*$", 1)
    core = F.regexp_replace(leaf, r"(?<=.)(?:\.(?:\d{1,4}|(?i:gz|bz2|xz|zst))){1,2}$", "")
    # The separator of a date or time is the same twice.
    stamp = r"(?:\d{8}|\d{4}([-_])\d{2}\%d\d{2})(?:[-_.Tt](?:\d{6}|\d{2}([-_:])\d{2}\%d\d{2})(?:[.,]\d+)?)?"
    behind, before = r"^([^/]*?\.[^/]*?)[-.]" + stamp % (2, 3) + "$", r"^(.+?)[-_]+" + stamp % (2, 3) + r"(\.[^.]+)$"
    head = F.regexp_replace(F.regexp_extract(core, before, 1), r"(?<=.)\.\d{1,10}$", "")
    stem = F.when(core.rlike(behind), F.regexp_extract(core, behind, 1)).when(core.rlike(before), F.concat(head, F.regexp_extract(core, before, 4))).when((core != leaf) & core.contains("."), core)
    return F.concat(folder, stem)


def rolled_groups(files: DataFrame) -> DataFrame:
    """Groups of rolled files (identity, format) of one stem and all of one format: stem, format, members in order, n.

    A file that is not rolled joins the group that bears its name. A stem with a single
    member or with two formats is no group.
    """
    rows = files.where("format is not null").withColumn("stem", rolled_stem(F.col("identity")))
    stems = rows.where("stem is not null").select(F.col("stem").alias("identity")).distinct()
    current = rows.where("stem is null").join(stems, "identity", "left_semi").withColumn("stem", F.col("identity"))
    members = rows.where("stem is not null").unionByName(current)
    found = members.groupBy("stem").agg(F.min("format").alias("format"), F.max("format").alias("_most"), F.array_join(F.sort_array(F.collect_list("identity")), ",").alias("members"), F.count("*").alias("n"))
    return found.where((F.col("n") > 1) & (F.col("format") == F.col("_most"))).drop("_most")


def json_depth(raw: Column) -> Column:
    """How deep objects and arrays are nested in valid JSON; 0 for a scalar."""
    brackets = F.regexp_replace(F.regexp_replace(raw, r'"(?:[^"\\]++|\\.)*+"', ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, c: Column) -> Column:
        now = s["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(F.filter(F.split(brackets, ""), lambda c: c != ""), start, step)["most"]


def duplicate_keys(raw: Column) -> Column:
    """Whether an object of valid JSON names a key twice, escapes decoded; null for what is no JSON. Spark's own parser keeps one of them, its variant refuses both."""
    return F.when(F.get_json_object(raw, "$").isNotNull(), F.try_parse_json(raw).isNull())


def canonical_json(raw: Column) -> Column:
    """JSON without blanks and with the keys of each object in order; null for what is no JSON or has a key twice.

    Spark's variant writes numbers anew. A document with a number that does not survive that, by
    its digits or its exponent, keeps the text of its numbers instead.
    """
    return F.coalesce(F.to_json(F.try_parse_json(F.when(~raw.rlike(_LOSSY), raw))), F.pandas_udf(_exact, "string")(F.when(raw.rlike(_LOSSY), raw)))


#: More digits than a double or a long keeps, or an exponent of two digits or more.
_LOSSY = r"[0-9][0-9.]{14,}|[0-9.][eE][+-]?[0-9]{2,}"


class _Number(str):
    """The text of a number."""


def _written(x) -> str:
    if isinstance(x, _Number):
        return str(x)
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_written(x[k])}" for k in sorted(x)) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(_written, x)) + "]"
    return json.dumps(x, ensure_ascii=False)


def _once_each(pairs: list) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("a key twice")
    return dict(pairs)


def _no_constant(name: str):
    raise ValueError(name)


def _exact(raw: pd.Series) -> pd.Series:
    def one(text):
        try:
            return None if text is None else _written(json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_no_constant, object_pairs_hook=_once_each))
        except (ValueError, RecursionError):
            return None

    return raw.map(one)


def export_lines(events: DataFrame) -> DataFrame:
    """source and a line of JSON, keys in order, for each event: a time of its own (wall) or its place only (order)."""
    from ..functions.times import rfc3339

    wall = F.col("ts").isNotNull()
    time = F.struct(F.when(wall, "wall").otherwise("order").alias("basis"), rfc3339(F.col("ts")).alias("instant"), F.when(wall, "source_explicit").otherwise("order_only").alias("resolution"))
    line = F.to_json(F.struct(F.col("message").alias("body"), F.struct(F.col("level").alias("raw")).alias("severity"), F.col("seq").alias("sourceSeq"), time.alias("time")))
    return events.select("source", "seq", line.alias("line"))


def write_export(events: DataFrame, path: str) -> None:
    """A folder of JSON lines for each source; Spark's committer publishes files of finished tasks only."""
    export_lines(events).repartition("source").sortWithinPartitions("source", "seq").select("source", "line").write.partitionBy("source").mode("errorifexists").text(path)


_EVENT = "sourceSeq long, time struct<resolution string, basis string, instant string, localText string, resolvedTimezone string>, severity struct<raw string, canonical int, confidence string, provenance string>, traceId string, spanId string"
_RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})$"


def checked_events(lines: DataFrame) -> DataFrame:
    """source, seq and the codes of what is wrong in normalised event lines (source, line_no, line); `seq` is null where a line is no JSON.

    Numbers of a source must follow each other without a gap from line to line. Lines
    are compared with the one before within blocks of line numbers and at their borders,
    so no source is sorted by one task.
    """
    rows = lines.select("source", "line_no", "line", F.from_json("line", _EVENT).alias("e"), F.floor(F.col("line_no") / 10_000).alias("block"))
    rows = rows.withColumn("seq", F.col("e.sourceSeq"))
    inside = Window.partitionBy("source", "block").orderBy("line_no")
    edge = Window.partitionBy("source").orderBy("block")
    borders = rows.groupBy("source", "block").agg(F.max(F.struct("line_no", "seq")).alias("tail")).select("source", "block", F.lag("tail.seq").over(edge).alias("earlier"))
    rows = rows.join(borders, ["source", "block"]).withColumn("expected", F.coalesce(F.lag("seq").over(inside), F.when(F.row_number().over(inside) == 1, F.col("earlier"))) + 1)
    t, s = (lambda c: F.col(f"e.time.{c}")), (lambda c: F.col(f"e.severity.{c}"))
    resolution, certain = t("resolution"), t("resolution").isin("source_explicit", "producer_resolved")
    resolved = resolution == "producer_resolved"
    blank = F.coalesce(F.trim(t("localText")) == "", F.lit(True))
    raised = {
        "sequence_not_contiguous": F.col("expected") != F.col("seq"),
        "instant_malformed": certain & ~t("instant").rlike(_RFC3339),
        "instant_not_permitted": ~certain & t("instant").isNotNull(),
        "instant_required": certain & t("instant").isNull(),
        "local_text_required": resolution.isin("producer_resolved", "unresolved") & blank,
        "time_basis_inconsistent": ((resolution == "order_only") & t("localText").isNotNull()) | (t("basis").isin("wall") != certain),
        "resolved_timezone_invalid": resolved != F.coalesce(t("resolvedTimezone").rlike(r"^(?:UTC|[A-Z][A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)+)$"), F.lit(False)),
        "severity_number_out_of_range": ~s("canonical").between(0, 24),
        "severity_provenance_inconsistent": ((s("provenance") == "source_declared") & (s("confidence") != "high")) | ((s("provenance") == "schema_mapped") & (s("confidence") == "low"))
        | ((s("provenance") == "text_inferred") & (s("confidence") != "low")) | ((s("provenance") == "absent") & F.coalesce(s("raw"), s("canonical").cast("string")).isNotNull()),
        "trace_identifier_malformed": ~F.col("e.traceId").rlike("^(?!0{32})[0-9a-f]{32}$") | ~F.coalesce(F.col("e.spanId"), F.lit("1" * 16)).rlike("^(?!0{16})[0-9a-f]{16}$"),
        "depth_exceeded": json_depth(F.col("line")) > JSON_DEPTH,
    }
    codes = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in raised.items())))
    codes = F.when(F.col("e").isNull() | resolution.isNull(), F.array(F.lit("malformed_line"))).otherwise(codes)
    return rows.select("source", "line_no", "seq", F.array_join(F.sort_array(codes), ",").alias("codes"))
