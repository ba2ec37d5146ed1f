"""Line grammars: which one a line follows, by score, and its time, level, service and message.

Every grammar is tried on every line and has a score of its own; the highest score of
those that match decides, and two that share it make the line ambiguous. A line that
fits none, or whose parts a grammar cannot read, is its own message, so no text is lost.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.levels import normalize
from ..functions.times import explicit_time
from .logs import logfmt

_TIME = r"([0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?(?: ?(?:Z|[A-Z]{3,4}|[+-][0-9]{2}:?[0-9]{2}))?)"
_WORD = r"([A-Za-z]+[0-9]?)"


@dataclass(frozen=True)
class Grammar:
    """A pattern, its score, and the groups that hold time, level, service, message and host (0: none)."""

    name: str
    score: int
    pattern: str
    time: int = 0
    level: int = 0
    service: int = 0
    message: int = 0
    host: int = 0


GRAMMARS = (
    Grammar("docker", 95, r'^\s*\{(?=[\s\S]*"log" ?:)(?=[\s\S]*"stream" ?:)[\s\S]*\}\s*$'),
    Grammar("json", 90, r"^\s*\{[\s\S]*\}\s*$"),
    Grammar("cef", 95, r"^CEF:[0-9]+\|[^|]*\|([^|]*)\|[^|]*\|[^|]*\|([^|]*)\|([0-9]+)\|", level=3, service=1, message=2),
    Grammar("rfc5424", 95, rf"^<(1[0-8][0-9]|19[01]|[1-9]?[0-9])>1 {_TIME} (\S+) (\S+) \S+ \S+ (?:-|\[[^\]]*\]) ?([\s\S]*)$", 2, 1, 4, 5, 3),
    Grammar("syslog", 90, r"^<(1[0-8][0-9]|19[01]|[1-9]?[0-9])>([A-Z][a-z]{2} [ 0-9][0-9] [0-9:]{8}) (\S+) ([^\s:\[]+)(?:\[[0-9]+\])?: ([\s\S]*)$", 0, 1, 4, 5, 3),
    Grammar("bsd_syslog", 85, r"^[A-Z][a-z]{2} [ 0-9][0-9] [0-9]{2}:[0-9]{2}:[0-9]{2} (\S+) ([^\s:\[]+)(?:\[[0-9]+\])?: ([\s\S]*)$", 0, 0, 2, 3, 1),
    Grammar("postgres", 90, rf"^{_TIME} \[[0-9]+\] (?:\S+ )?(DEBUG[1-5]|INFO|NOTICE|WARNING|LOG|ERROR|FATAL|PANIC): +([\s\S]*)$", 1, 2, 0, 3),
    Grammar("postgres_csv", 85, rf'^{_TIME},"[^"]*","[^"]*",[0-9]+,', 1),
    Grammar("wildfly", 90, r"^[0-9]{2}:[0-9]{2}:[0-9]{2},[0-9]{3} ([A-Z]+) +\[([^\]]+)\] \([^)]*\) ([\s\S]*)$", 0, 1, 2, 3),
    Grammar("elasticsearch", 90, rf"^\[{_TIME}\]\[([A-Z]+) *\]\[([^\]]+?) *\] \[[^\]]*\] ?([\s\S]*)$", 1, 2, 3, 4),
    Grammar("cri", 85, rf"^{_TIME} (?:stdout|stderr) [FP] ([\s\S]*)$", 1, 0, 0, 2),
    Grammar("logfmt", 70, r'^(?:[A-Za-z_][\w.]*=(?:"(?:[^"\\]|\\.)*"|\S*)(?: |$)){2,}'),
    Grammar("datetime", 60, rf"^{_TIME} (?:{_WORD} )?([\s\S]*)$", 1, 2, 0, 3),
)

_TIMES, _LEVELS, _SERVICES, _MESSAGES = ("ts", "timestamp", "time", "@timestamp", "@t", "eventTime"), ("level", "severity", "lvl"), ("service", "app", "component"), ("message", "msg", "log")
_HOSTS, _TRACES = ("host", "hostname", "node"), ("trace_id", "traceId", "trace")
# Levels of syslog severities 0 to 7, and of the numeric levels of JSON loggers.
_SYSLOG = ("fatal", "fatal", "fatal", "error", "warn", "info", "info", "debug")
_NUMERIC = {10: "trace", 20: "debug", 30: "info", 40: "warn", 50: "error", 60: "fatal"}


def fingerprint(text: Column) -> Column:
    """Name of the grammar with the highest score, ambiguous if two share it, plain if none matches."""
    scored = F.array_compact(F.array(*(F.when(text.rlike(g.pattern), F.struct(F.lit(g.score).alias("score"), F.lit(g.name).alias("name"))) for g in GRAMMARS)))
    best = lambda found: F.array_max(F.transform(found, lambda s: s["score"]))
    top = lambda found: F.filter(found, lambda s: s["score"] == best(found))
    named = lambda of: F.when(F.size(of) == 0, "plain").when(F.size(of) > 1, "ambiguous").otherwise(F.get(of, F.lit(0))["name"])
    # Arrays of one element, so that each step is computed once.
    return F.get(F.transform(F.transform(F.array(scored), top), named), F.lit(0))


def parsed(rows: DataFrame, text: str) -> DataFrame:
    """`rows` with format, ts (whole seconds, null unless the line says its zone), level, service, message, host and trace_id of a column.

    Only the pattern of the line's own grammar is applied for its parts. A time in digits is an
    epoch; of several names of a field the first that has a value counts, and for a time the
    first that is one. An envelope's own level counts before that of the text inside it. Null text is null in all but the format, which is plain.
    """
    t = F.col(text)
    pairs, csv = F.col("pairs__"), F.col("csv__")
    own = F.col("grammar__")
    group = lambda n: F.when(own[n] > 0, F.call_function("regexp_extract", t, own["pattern"], own[n]))
    of = lambda name: F.col("format") == name
    json = lambda names: F.coalesce(*(F.get_json_object(t, f"$['{n}']") for n in names))
    pair = lambda names: F.coalesce(*(pairs[n] for n in names))
    either = lambda names: F.when(of("json") | of("docker"), json(names)).when(of("logfmt"), pair(names))
    out = rows.withColumn("format", F.coalesce(fingerprint(t), F.lit("plain")))
    known = {g.name: F.struct(F.lit(g.pattern).alias("pattern"), *(F.lit(getattr(g, n)).alias(n) for n in ("time", "level", "service", "message", "host"))) for g in GRAMMARS}
    out = out.withColumns({"grammar__": F.try_element_at(F.create_map(*(x for n, s in known.items() for x in (F.lit(n), s))), F.col("format")), "pairs__": F.when(of("logfmt"), logfmt(t)), "csv__": F.when(of("postgres_csv"), F.from_csv(t, ", ".join(f"c{i} string" for i in range(23))))})
    message = F.coalesce(F.nullif(group("message"), F.lit("")), either(_MESSAGES), csv["c13"], t)
    number = group("level").try_cast("int")
    raw = F.coalesce(either(_LEVELS), csv["c11"], group("level"))
    cef = F.when(number >= 9, "fatal").when(number >= 7, "error").when(number >= 4, "warn").otherwise("info")
    syslog = F.element_at(F.array(*map(F.lit, _SYSLOG)), number % 8 + 1)
    banded = F.element_at(F.create_map(*(F.lit(x) for p in _NUMERIC.items() for x in p)), raw.try_cast("int"))
    inner = F.nullif(F.regexp_extract(message, r"(?i)\b(trace|debug|info|notice|warn|warning|error|critical|fatal)\b", 1), F.lit(""))
    named = F.regexp_replace(F.when(F.upper(raw) == "LOG", "info").when(F.upper(raw) == "PANIC", "fatal").otherwise(raw), "^DEBUG[1-5]$", "debug")
    level = F.when(of("cef"), cef).when((of("syslog") | of("rfc5424")) & (number <= 191), syslog).otherwise(F.coalesce(banded, normalize(F.coalesce(named, inner))))
    told = lambda names: [F.when(of("json") | of("docker"), F.get_json_object(t, f"$['{n}']")).when(of("logfmt"), pairs[n]) for n in names]
    texts = F.array_compact(F.array(*told(_TIMES), group("time")))
    first = F.get(F.array_compact(F.transform(texts, lambda x: explicit_time(x)[0])), F.lit(0))
    filled = lambda part, names: F.coalesce(F.nullif(group(part), F.lit("")), either(names))
    return out.select(*rows.columns, "format", first.alias("ts"), level.alias("level"), filled("service", _SERVICES).alias("service"), message.alias("message"), F.nullif(filled("host", _HOSTS), F.lit("-")).alias("host"), either(_TRACES).alias("trace_id"))


def joined_fragments(rows: DataFrame) -> DataFrame:
    """Container lines (source, line_no, line) as whole messages: fragments marked P join what follows up to one marked F.

    The lines of a source are put in order in one task. An open end comes as it is.
    """
    mark, body = F.regexp_extract("line", r"^\S+ (?:stdout|stderr) ([FP]) ", 1), F.regexp_replace("line", r"^\S+ (?:stdout|stderr) [FP] ", "")
    closed = F.sum((mark == "F").cast("int")).over(Window.partitionBy("source").orderBy("line_no")) - (mark == "F").cast("int")
    parts = rows.select("source", "line_no", body.alias("body"), closed.alias("record")).groupBy("source", "record").agg(F.array_sort(F.collect_list(F.struct("line_no", "body"))).alias("l"))
    return parts.select("source", "record", F.array_join(F.transform("l", lambda x: x["body"]), "").alias("text"), F.size("l").alias("fragments"))
