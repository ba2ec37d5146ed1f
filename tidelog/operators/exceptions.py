"""Exceptions in messages: envelopes, roles of lines, families, pairs of renderings, episodes of a template."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import interval_gap
from ..functions.text import LEAD, _once

# The longest prefix before [stderr], the longest thread name, and how far two renderings of one exception may be apart.
PREFIX, THREAD = 256, 96
SEQ_GAP, WALL_GAP = 512, 2
#: Seconds of the slots in which spans of time meet.
SLOTS = (60, 600, 6_000, 60_000)
THREAD_KEYS = ("thread=", "thread_id=", "threadId=", "tid=")
REQUEST_KEYS = ("request_id=", "requestId=", "correlation_id=", "correlationId=", "transaction_id=", "transactionId=", "trace_id=", "traceId=")
#: Strings of which a message with one of the keys holds one.
_THREAD_HINTS, _REQUEST_HINTS = ("thread", "tid="), ("_id=", "Id=")

_BLANKS = " \t\n\x0b\f\r"
_NAME = rf"[A-Za-z0-9_][A-Za-z0-9_./: -]{{0,{THREAD - 1}}}"


def _keyed(message: Column, keys: tuple[str, ...], hints: tuple[str, ...], stop: str, good: str, within: int) -> Column:
    """The value behind the first of `keys` that has a good one and begins early enough."""

    def behind(key: str) -> Column:
        value = _once(F.regexp_extract(message, rf"{key}([^{stop}]*)", 1), lambda v: F.when(v.rlike(good), v))
        return _once(F.instr(message, key), lambda at: F.when((at > 0) & (at <= within + 1), value))

    return F.when(reduce(or_, (message.contains(h) for h in hints)), F.coalesce(*map(behind, keys)))


def envelope(message: Column) -> Column:
    """Struct of stream, thread, request, payload, conflict, malformed of one message.

    Behind `[stderr]` a thread may stand in brackets; a bracket that holds no thread
    name is malformed and stays in the payload. Without the stream the message is its
    own payload. Threads named by a key and in brackets that differ are a conflict.
    """
    rest = _once(F.instr(message, "[stderr]"), lambda at: F.when((at > 0) & (at <= PREFIX + 1), F.ltrim(F.substr(message, at + 8))))  # null without the stream
    explicit = _keyed(message, THREAD_KEYS, _THREAD_HINTS, r"\s,\];)", rf"^[A-Za-z0-9_][A-Za-z0-9_./:-]{{0,{THREAD - 1}}}$", PREFIX)
    request = _keyed(message, REQUEST_KEYS, _REQUEST_HINTS, r"\s,\];)\"", rf"^[A-Za-z0-9_:.-]{{1,{THREAD}}}$", 4 * PREFIX)

    def parts(p: Column) -> Column:
        rest, bracket, explicit = p["rest"], p["bracket"], p["explicit"]
        inner, streamed = F.nullif(bracket, F.lit("")), rest.isNotNull()
        payload = F.when(~streamed, message).when(inner.isNotNull(), F.regexp_replace(rest, rf"^\({_NAME}\)[ \t]*", "")).otherwise(rest)
        return F.struct(
            F.when(streamed, "stderr").alias("stream"), F.coalesce(explicit, inner).alias("thread"), request.alias("request"),
            payload.alias("payload"), F.coalesce(explicit != inner, F.lit(False)).alias("conflict"), F.when(message.isNotNull(), F.coalesce(bracket == "", F.lit(False))).alias("malformed"),
        )

    # `bracket`: null if none opens, empty if it holds no name of a thread.
    opened = _once(rest, lambda r: F.struct(r.alias("rest"), F.when(r.startswith("("), F.regexp_extract(r, rf"^\(({_NAME})\)", 1)).alias("bracket"), explicit.alias("explicit")))
    return _once(opened, parts)


def line_role(line: Column) -> Column:
    """What a line of a pattern is in a stack trace: frame, cause, scaffold, header, or null."""
    return _once(F.btrim(line, F.lit(_BLANKS)), lambda x: F.when(_frame(x), "frame").when(_cause(x), "cause").when(_scaffold(x), "scaffold").when(_header(x), "header"))


# Plain searches come before patterns that cannot match without them.
def _frame(x: Column) -> Column:
    return x.startswith("at ") | x.startswith("... ") | x.contains(" at X") | (x.contains(" at ") & x.contains(".java:"))


def _cause(x: Column) -> Column:
    return ((x.contains("Caused by:") | x.contains("Suppressed:")) & x.rlike(LEAD + r"(?:Caused by:|Suppressed:)")) | x.startswith("--- End of inner exception") | x.startswith('File "')


def _scaffold(x: Column) -> Column:
    return x.startswith("Exception in thread") | x.contains("Exception wrapper") | x.startswith("Wrapped by:") | x.startswith("Nested exception")


def _header(x: Column) -> Column:
    named = _once(F.lower(x), lambda low: low.contains("exception") | low.contains("error") | low.contains("throwable"))
    return named & x.rlike(LEAD + r"(?:\S+\s+){0,7}(?i:[a-z_$][\w$]*(?:\.[\w$]+)+(?<=exception|error|throwable))[:,;)\]]*(?:\s|$)")


def below_stack(line: Column) -> Column:
    """Whether a line's role is frame or cause."""
    return _once(F.btrim(line, F.lit(_BLANKS)), lambda x: _frame(x) | _cause(x))


def pattern_role(pattern: Column) -> Column:
    """The role of a template's pattern; wildcards count as a token. Null for what has nothing of an exception."""
    bare = F.replace(F.trim(pattern), F.lit("<*>"), F.lit("X"))
    roles = F.transform(F.split(bare, "\n"), line_role)
    has = lambda name: F.coalesce(F.array_contains(F.array_compact(roles), name), F.lit(False))
    low = F.lower(bare)
    vague = low.rlike("exception|stacktrace|stack_trace|throwable") | (low.contains("[stderr]") & low.rlike(" at |caused by|error|fail"))
    return F.when(has("cause"), "cause_suppressed").when(has("scaffold"), "wrapper_scaffold").when(has("header"), "header_or_full_stack").when(has("frame"), "stack_frame").when(vague, "unknown_suspicious")


def graph(message: Column) -> Column:
    """Struct of types from the outer to the root exception, the first frame below each, the root's detail, the site, and complete."""
    typed = r"^(?:Caused by: |Suppressed: )?((?:[\w$]+\.)*[A-Z][\w$]*(?:Exception|Error|Throwable))(?::\s*(.*))?$"
    is_type = lambda x: (x.contains("Exception") | x.contains("Error") | x.contains("Throwable")) & x.rlike(typed)
    told = lambda x: F.struct(x.alias("line"), F.when(x.startswith("at "), F.when(x.rlike(r"^at \S"), False)).when(is_type(x), True).alias("type"))
    lines = F.transform(F.split(message, "\n"), lambda line: _once(F.btrim(line, F.lit(_BLANKS)), told))

    def parts(kept: Column) -> Column:
        types = F.transform(F.filter(kept, lambda x: x["type"]), lambda x: x["line"])
        # A frame is the first below a type if the line kept before it is a type.
        heads = F.filter(kept, lambda x, i: ~x["type"] & (i > 0) & F.coalesce(F.get(kept, i - 1)["type"], F.lit(False)))
        frames = F.transform(heads, lambda x: F.regexp_extract(x["line"], r"^at ([^(\s]+)", 1))
        return F.struct(F.transform(types, lambda x: F.regexp_extract(x, typed, 1)).alias("names"), frames.alias("frames"), F.get(types, F.size(types) - 1).alias("root"))

    def said(p: Column) -> Column:
        names, frames = p["names"], p["frames"]
        site = F.coalesce(F.get(frames, F.lit(0)), F.concat(F.lit("sig:"), F.get(names, F.size(names) - 1)), F.lit("unknown_site"))
        return F.struct(F.array_join(names, ">").alias("types"), F.array_join(frames, ">").alias("frames"), F.coalesce(F.regexp_extract(p["root"], typed, 2), F.lit("")).alias("root_detail"), site.alias("site"), ((F.size(names) > 0) & (F.size(frames) > 0)).alias("complete"))

    return _once(_once(F.filter(lines, lambda x: x["type"].isNotNull()), parts), said)


def families(renderings: DataFrame, top: int) -> DataFrame:
    """The `top` signatures by records (signature, kind, occurrence, records): records, renderings and occurrences, and records an occurrence with the remainder."""
    counted = renderings.groupBy("signature").agg(
        F.sum("records").alias("records"), F.sum(F.when(F.col("kind") == "wrapped", F.col("records")).otherwise(0)).alias("wrapped_records"), F.count("*").alias("renderings"), F.countDistinct("occurrence").alias("occurrences")
    )
    n = F.col("occurrences")
    counted = counted.withColumn("remainder", F.when(n > 0, F.pmod("records", F.nullif(n, F.lit(0)))).otherwise(0).cast("long"))
    each = F.when(n > 0, F.expr("records div nullif(occurrences, 0)")).otherwise(0).cast("long")
    return counted.withColumn("each", each).orderBy(F.desc("records"), "signature").limit(top)


def _near(a: DataFrame, b: DataFrame) -> DataFrame:
    """The pairs of `a` and `b` of one signature and thread that may be near in time, each once.

    Two spans meet where one holds the start of the other, so a start goes to one slot of each
    width and a span to the slots it covers, of the least width that does not cut it into many.
    """

    def clocked(rows: DataFrame, s: str, slack: int) -> DataFrame:
        x = lambda c: F.col(f"{s}.{c}")
        lone = x("thread").isNotNull() | F.coalesce(x("request"), x("trace")).isNull()
        begin, end = x("first_ts") - slack, x("last_ts") + slack
        return rows.where(x("wall") & begin.isNotNull() & end.isNotNull() & lone).select(F.col("signature").alias(f"{s}_signature"), s, x("thread").alias(f"{s}_thread"), begin.alias(f"{s}_begin"), end.alias(f"{s}_end"))

    slot = lambda t, width: F.floor(t / width)
    starts = lambda rows, s: rows.withColumn("start", F.explode(F.array(*(F.struct(F.lit(w).alias("width"), slot(F.col(f"{s}_begin"), w).alias("slot")) for w in SLOTS))))

    def spans(rows: DataFrame, s: str) -> DataFrame:
        begin, end = F.col(f"{s}_begin"), F.col(f"{s}_end")
        width = F.coalesce(*(F.when(end - begin <= w, w) for w in SLOTS), F.lit(SLOTS[-1]))
        rows = rows.withColumn("span_width", width)
        lo, hi = slot(begin, F.col("span_width")), slot(end, F.col("span_width"))
        return rows.withColumn("span_slot", F.explode(F.sequence(lo, F.greatest(lo, hi))))

    alike = (F.col("a_signature") == F.col("b_signature")) & F.col("a_thread").eqNullSafe(F.col("b_thread")) & (F.col("span_width") == F.col("start.width")) & (F.col("span_slot") == F.col("start.slot"))
    a, b = clocked(a, "a", WALL_GAP), clocked(b, "b", 0)
    later = spans(a, "a").join(starts(b, "b"), alike & F.col("b_begin").between(F.col("a_begin"), F.col("a_end")))
    earlier = spans(b, "b").join(starts(a, "a"), alike & (F.col("a_begin") > F.col("b_begin")) & (F.col("a_begin") <= F.col("b_end")))
    return later.unionByName(earlier, allowMissingColumns=True).select(F.col("a_signature").alias("signature"), "a", "b")


def paired(renderings: DataFrame) -> DataFrame:
    """Full renderings of an exception with the wrapped one that repeats it: left, right, confidence, status.

    Needs id, kind (full or wrapped), signature, source, service, host, request, trace,
    thread, first_seq, last_seq, first_ts, last_ts, wall and conflict. Two renderings of
    one signature belong together if they share a request or trace, or are at most two
    seconds apart with equal threads (strong) or with no keys at all (moderate); what
    differs in request, trace, service or host, or is in conflict, never does. They are
    brought together by equality on request, on trace, or on thread (none and no other key
    is a thread of its own) and slots of time, so no signature meets itself as a whole. A
    pair is `paired` if neither side has another candidate, else `ambiguous`.
    """
    pairs = candidates(renderings)
    lefts, rights = (pairs.groupBy(c).agg(F.count("*").alias(f"of_{c}")) for c in ("left", "right"))
    alone = (F.col("of_left") == 1) & (F.col("of_right") == 1)
    return pairs.join(lefts, "left").join(rights, "right").select("left", "right", "confidence", F.when(alone, "paired").otherwise("ambiguous").alias("status"))


def candidates(renderings: DataFrame) -> DataFrame:
    """left, right, confidence of the pairs of `paired`, each once."""
    rows = renderings.where((F.col("signature") != "") & ~F.col("conflict"))
    side = lambda kind, name: rows.where(F.col("kind") == kind).select("signature", F.struct(*(c for c in rows.columns if c != "signature")).alias(name))
    a, b = side("full", "a"), side("wrapped", "b")
    timed = _near(a, b)
    both = timed
    for key in ("request", "trace"):
        both = both.unionByName(a.withColumn("k", F.col(f"a.{key}")).join(b.withColumn("k", F.col(f"b.{key}")), ["signature", "k"]).drop("k"))
    x, y = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    no = F.lit(False)
    same, differ = (lambda c: F.coalesce(x(c) == y(c), no)), (lambda c: F.coalesce(x(c) != y(c), no))
    anchor = same("request") | same("trace")
    near = x("wall") & y("wall") & (interval_gap(x("first_ts"), x("last_ts"), y("first_ts"), y("last_ts")) <= WALL_GAP)
    far = (x("source") == y("source")) & (interval_gap(x("first_seq"), x("last_seq"), y("first_seq"), y("last_seq")) > SEQ_GAP)
    barred = differ("service") | differ("host") | differ("request") | differ("trace") | far | (differ("thread") & ((x("source") == y("source")) | ~anchor))
    timeless = ~(x("wall") & y("wall"))
    keyless = F.coalesce(x("request"), x("trace"), x("thread"), y("request"), y("trace"), y("thread")).isNull()
    confidence = F.when(barred, None).when(anchor & (timeless | near), "strong").when(near & same("thread"), "strong").when(near & keyless, "moderate")
    return both.select(x("id").alias("left"), y("id").alias("right"), confidence.alias("confidence")).where("confidence is not null").distinct()


def template_episodes(events: DataFrame, episodes: DataFrame, lane: list[str], block: int = 1000) -> DataFrame:
    """How many episodes (lane, episode, first_seq, last_seq) each template touches, each once, and how many of its events lie in none.

    Events meet the episodes of their lane by blocks of seq.
    """
    spans = episodes.withColumn("block", F.explode(F.sequence(F.floor(F.col("first_seq") / block), F.floor(F.col("last_seq") / block))))
    rows = events.select(*lane, "seq", "template_id", F.floor(F.col("seq") / block).alias("block"))
    met = rows.join(spans, [*lane, "block"]).where(F.col("seq").between(F.col("first_seq"), F.col("last_seq")))
    touched = met.groupBy("template_id").agg(F.countDistinct(F.struct(*lane, "episode")).alias("episodes"), F.count("*").alias("inside"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    total = rows.groupBy("template_id").agg(F.count("*").alias("n")).join(touched, "template_id", "left")
    return total.select("template_id", zero("episodes"), (F.col("n") - F.coalesce(F.col("inside"), F.lit(0))).alias("outside"))
