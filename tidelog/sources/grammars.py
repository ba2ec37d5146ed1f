"""Reviewed line grammars: a declared layout, checked, compiled to one pattern, and applied to the lines of a source.

A grammar is a time stamp of fixed tokens, then slots, the message last. What is declared is
all there is: no grammar holds code or a pattern of its own. Lines that begin no record join the
record before them, if the grammar says so; where several grammars fit a source equally well
none is chosen.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .events import dealt

# Tokens of a time stamp, slots, patterns of paths, characters of a name, bytes of a line, lines that join a record.
MAX_TOKENS, MAX_SLOTS, MAX_PATTERNS, MAX_NAME, MAX_LINE_BYTES, MAX_CONTINUED = 24, 16, 32, 128, 64 * 1024, 512
#: Lines of a block in which records are looked for at a time.
BLOCK = 65_536

_TOKENS = {
    "year": r"(?<year>[0-9]{4})", "month": r"(?<month>0[1-9]|1[0-2])", "day": r"(?<day>0[1-9]|[12][0-9]|3[01])", "hour": r"(?<hour>[01][0-9]|2[0-3])", "minute": r"(?<minute>[0-5][0-9])",
    "second": r"(?<second>[0-5][0-9]|60)", "millis": r"[0-9]{3}", "micros": r"[0-9]{6}", "offset": r"(?<offset>[Zz]|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])",
}


@dataclass(frozen=True)
class LineGrammar:
    """`time` is a tuple of token names and literal characters (one each, as ``"=x"``); `layout` of slots: "space", "level",
    "message", ("literal", text), ("logger", open, close), ("thread", open, close), the brackets None or both given."""

    format_id: str
    version: int
    time: tuple[str, ...]
    layout: tuple
    continued: bool = True
    priority: int = 0
    paths: tuple[str, ...] = ()
    zone: str | None = None

    @property
    def timed(self) -> bool:
        """Whether its times are instants; without an offset they are local and need a declared zone."""
        return "offset" in self.time


def problems(g: LineGrammar) -> list[str]:
    """What is wrong with a grammar, in order; none if it may be used."""
    found = set()
    if not g.format_id.strip() or len(g.format_id) > MAX_NAME:
        found.add("identifier_invalid")
    if g.version < 1:
        found.add("version_invalid")
    tokens = [t for t in g.time if not t.startswith("=")]
    n = {t: tokens.count(t) for t in _TOKENS}
    if not g.time or len(g.time) > MAX_TOKENS or set(tokens) - set(_TOKENS) or any(len(t) != 2 for t in g.time if t.startswith("=")):
        found.add("timestamp_invalid")
    else:
        if any(n[t] != 1 for t in ("year", "month", "day", "hour", "minute")):
            found.add("timestamp_incomplete")
        part = n["millis"] + n["micros"]
        if max(n["second"], n["offset"], part) > 1 or (part and not n["second"]):
            found.add("timestamp_invalid")
    kinds = [s if isinstance(s, str) else s[0] for s in g.layout]
    if not kinds or len(kinds) > MAX_SLOTS or set(kinds) - {"space", "level", "message", "literal", "logger", "thread"}:
        found.add("layout_invalid")
    else:
        if kinds.count("message") != 1 or kinds[-1] != "message":
            found.add("message_misplaced")
        if any(kinds.count(k) > 1 for k in ("level", "logger", "thread")):
            found.add("slot_twice")
        for s in g.layout:
            if not isinstance(s, str) and (s[0] == "literal" and not s[1] or s[0] != "literal" and (s[1] is None) != (s[2] is None)):
                found.add("layout_invalid")
    if len(g.paths) > MAX_PATTERNS or any(not p or p.startswith("/") or ".." in p.split("/") for p in g.paths):
        found.add("path_invalid")
    if g.zone is not None and g.zone not in available_timezones():
        found.add("zone_invalid")
    return sorted(found)


def pattern(g: LineGrammar) -> str:
    """The pattern of a line that begins a record; groups are numbered by `groups`."""
    wrong = problems(g)
    if wrong:
        raise ValueError(f"{g.format_id}: {', '.join(wrong)}")
    out = "^(?<stamp>" + "".join(re.escape(t[1]) if t.startswith("=") else _TOKENS[t] for t in g.time) + ")"
    for s in g.layout:
        kind = s if isinstance(s, str) else s[0]
        if kind == "space":
            out += r"[ \t]++"
        elif kind == "literal":
            out += re.escape(s[1])
        elif kind == "message":
            out += r"[ \t]*+(?<message>[\s\S]*)$"
        elif kind == "level" or s[1] is None:
            out += rf"(?<{kind}>\S++)"
        else:
            out += rf"{re.escape(s[1])}(?<{kind}>[^{re.escape(s[2])}]*+){re.escape(s[2])}"
    return out


def groups(g: LineGrammar) -> dict[str, int]:
    return {name: i + 1 for i, name in enumerate(re.findall(r"\(\?<([a-z]+)>", pattern(g)))}


def _day(g: LineGrammar, line: Column) -> Column:
    """The day of a line that matches, from its stamp alone; null for a day that is none."""
    at = groups(g)
    stamp = "^(" + "".join(re.escape(t[1]) if t.startswith("=") else _TOKENS[t] for t in g.time) + ")"
    return F.try_to_date(F.concat_ws("-", *(F.regexp_extract(line, stamp, at[name]) for name in ("year", "month", "day"))), "yyyy-MM-dd")


def begins(g: LineGrammar, line: Column) -> Column:
    """Whether a line begins a record."""
    return (F.octet_length(line) <= MAX_LINE_BYTES) & line.rlike(pattern(g)) & _day(g, line).isNotNull()


def read(g: LineGrammar, line: Column) -> Column:
    """Struct of stamp, ts, level, logger, thread, message of a line, null if it begins no record: no match, a day that is none, or too long."""
    p, at = pattern(g), groups(g)
    part = lambda name: F.regexp_extract(line, p, at[name]) if name in at else F.lit(None).cast("string")
    day = _day(g, line)
    number = lambda name: F.coalesce(part(name).try_cast("long"), F.lit(0))
    local = F.unix_date(day).cast("long") * 86_400 + number("hour") * 3600 + number("minute") * 60 + number("second")
    offset = part("offset")
    shift = F.when(F.length(offset) == 6, F.when(offset.startswith("-"), -1).otherwise(1) * (F.substring(offset, 2, 2).try_cast("long") * 3600 + F.substring(offset, 5, 2).try_cast("long") * 60)).otherwise(0)
    ts = local - shift if g.timed else F.lit(None).cast("long")
    return F.when(begins(g, line), F.struct(part("stamp").alias("stamp"), ts.alias("ts"), part("level").alias("level"), part("logger").alias("logger"), part("thread").alias("thread"), part("message").alias("message")))


def _marked(rows: DataFrame, g: LineGrammar, reading: Callable[[LineGrammar, Column], Column] = read) -> DataFrame:
    """Each line with what it reads as (null if it begins no record), the record it joins (start), and its place among the lines that join it."""
    line = F.coalesce(F.col("line"), F.lit(""))
    # Dealt first, then read: files of few row groups are read by few tasks.
    lines = dealt(rows.select("source", F.col("line_no").cast("long").alias("line_no"), line.alias("line"), F.floor(F.col("line_no").cast("long") / BLOCK).alias("block")), "source", "block")
    lines = lines.withColumn("read", reading(g, F.col("line")))
    is_long = F.octet_length("line") > MAX_LINE_BYTES
    lines = lines.withColumn("joins", (F.col("read").isNull() & ~is_long & F.lit(g.continued)).cast("long"))
    within = Window.partitionBy("source", "block").orderBy("line_no")
    lines = lines.withColumn("run", F.sum("joins").over(within))
    # Records cross blocks: the last start before a block, and how many lines have joined by then, from one row a block.
    start = F.when(F.col("read").isNotNull(), F.struct("line_no", "run"))
    ends = lines.groupBy("source", "block").agg(F.sum("joins").alias("n"), F.max(start).alias("s"))
    along = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = ends.withColumn("base", F.coalesce(F.sum("n").over(along), F.lit(0)))
    base = base.withColumn("earlier", F.max(F.when(F.col("s").isNotNull(), F.struct(F.col("s.line_no").alias("line_no"), (F.col("base") + F.col("s.run")).alias("run")))).over(along))
    base = base.select(F.col("source").alias("_source"), F.col("block").alias("_block"), "base", "earlier")
    here = F.max(F.when(F.col("read").isNotNull(), F.struct("line_no", "run"))).over(within)
    lines = lines.withColumn("here", here).join(base, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")))
    begun = F.when(F.col("here").isNotNull(), F.struct(F.col("here.line_no").alias("line_no"), (F.col("base") + F.col("here.run")).alias("run"))).otherwise(F.col("earlier"))
    return lines.withColumn("begun", begun).withColumns({"start": F.when(F.col("read").isNotNull() | (F.col("joins") == 1), F.col("begun.line_no")), "place": F.col("base") + F.col("run") - F.col("begun.run")})


def assembled(rows: DataFrame, g: LineGrammar) -> DataFrame:
    """source, start_line, stamp, ts, level, logger, thread, message, continuation, n_continued, lines_dropped of (source, line_no, line).

    A line that begins no record joins the one before it, at most MAX_CONTINUED of them; the
    rest is counted as dropped. What stands before a source's first record, is too long, or
    begins no record where nothing may join, belongs to none; see `unattributed`. ts is null
    for local times. Continuations are parted by line feeds.
    """
    lines = _marked(rows, g).where("start is not null")
    kept = (F.col("joins") == 1) & (F.col("place") <= MAX_CONTINUED)
    found = lines.groupBy("source", "start").agg(
        F.max("read").alias("r"), F.array_sort(F.collect_list(F.when(kept, F.struct("line_no", "line")))).alias("c"), F.count_if(kept).alias("n_continued"), F.count_if((F.col("joins") == 1) & ~kept).alias("lines_dropped")
    )
    return found.select("source", F.col("start").alias("start_line"), "r.*", F.array_join(F.transform("c", lambda x: x["line"]), "\n").alias("continuation"), "n_continued", "lines_dropped")


def unattributed(rows: DataFrame, g: LineGrammar) -> DataFrame:
    """source, line_no, line of the lines that belong to no record."""
    return _marked(rows, g).where("start is null").select("source", "line_no", "line")


def glob(path: Column, pattern: str) -> Column:
    """Whether a path, or what follows one of its slashes, is named by a pattern; * stands for anything but a slash, and a rolled file (.1, .2024-01-02, .gz) for its first."""
    body = "".join("[^/]*" if c == "*" else re.escape(c) for c in pattern)
    return path.rlike(rf"(?:^|/){body}(?:[.-][0-9][0-9-]*)?(?:\.gz)?$")


def selected(rows: DataFrame, grammars: list[LineGrammar]) -> DataFrame:
    """source, outcome (selected, conflict, no_match), format_id (of a conflict: all, by comma), version for each source of (source, line_no, line).

    A grammar fits a source if its paths name it (none named: any), it begins a record there,
    and at least half of the lines belong to its records. The highest priority wins; two that
    share it are a conflict and none is taken. Grammars with problems never fit.
    """
    sound = [g for g in grammars if not problems(g)]
    told = rows.select("source").distinct().withColumns({"outcome": F.lit("no_match"), "format_id": F.lit(None).cast("string"), "version": F.lit(None).cast("int")})
    fits = None
    for g in sound:
        named = F.lit(not g.paths)
        for p in g.paths:
            named = named | glob(F.col("source"), p)
        marked = _marked(rows.where(named), g, lambda g, line: F.when(begins(g, line), True))  # its parts are not asked for
        whole = F.col("start").isNotNull() & ((F.col("joins") == 0) | (F.col("place") <= MAX_CONTINUED))
        dropped = F.col("start").isNotNull() & ~whole
        counted = marked.groupBy("source").agg(F.count_if(F.col("read").isNotNull()).alias("records"), F.count_if(whole).alias("whole"), F.count_if(~dropped).alias("total"))
        good = counted.where("records > 0 and 2 * whole >= total").select("source", F.lit(g.format_id).alias("format_id"), F.lit(g.version).alias("version"), F.lit(g.priority).alias("priority"))
        fits = good if fits is None else fits.unionByName(good)
    if fits is None:
        return told
    best = fits.groupBy("source").agg(F.max("priority").alias("best"))
    top = fits.join(best, "source").where("priority = best").groupBy("source").agg(F.array_sort(F.collect_set("format_id")).alias("ids"), F.max("version").alias("version"), F.count("*").alias("n"))  # at most one a grammar
    one = F.col("n") == 1
    chosen = top.select("source", F.when(one, "selected").otherwise("conflict").alias("outcome"), F.array_join("ids", ",").alias("format_id"), F.when(one, F.col("version")).alias("version"))
    return chosen.unionByName(told.join(chosen, "source", "left_anti"))
