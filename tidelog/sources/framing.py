"""Logical records from physical lines, exactly, with the open record carried over from split to split.

What a line looks like is one number, computed by Spark's own expressions. Which record it
belongs to depends on the record that is open before it. Lines are range-partitioned by source
and number and cut into blocks; every block is first framed as if nothing were open. A scan over
the blocks of a source then corrects the state before each block: it follows the numbers of a
block only until its state meets the block's own, as a rule a few lines, and jumps to the end.
Texts stay in their partitions; records that cross blocks are joined from their parts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import fresh_folder, kept

# Bounds of a record, beyond which it ends with the line that crosses them.
MAX_BYTES, MAX_LINES, MAX_DEPTH = 1 << 20, 5_000, 64
BLOCK_LINES = 4_096

# Tags of server lines that add to the line before, or begin a record of their own.
_SECONDARY = ("DETAIL:", "HINT:", "STATEMENT:", "CONTEXT:", "QUERY:", "LOCATION:")
_PRIMARY = ("ERROR:", "FATAL:", "PANIC:", "WARNING:", "LOG:", "INFO:", "NOTICE:", "DEBUG")
# What makes an open record a stack.
_STACK = ("Exception", "Error:", "^Traceback", "^panic:", "^thread '", "^stack backtrace", "panicked at", " ERROR ", r" \[ERR\] ", " ERROR:")

STAMP, SECONDARY, SERVER, PANIC, BLANK, STACK, CSV, ODD, PARTIAL, FULL, BRACE = (1 << i for i in range(11))


def looks(line: Column) -> Column:
    """What a line looks like, as a sum of the flags above."""
    t = F.regexp_replace(line, r"^\s+", "")
    prefix = r"^(?=[\x00-\x7F]{4}-)[^\[]*\[[^\]]*\]\s*"
    prefixed = lambda of, tags: (F.octet_length(of) >= 30) & of.rlike(prefix + "(?i:" + "|".join(tags) + ")")
    iso = (F.octet_length(t) >= 19) & t.rlike(r"^[0-9]{4}-[\s\S]{2}-")
    slash = (F.octet_length(t) >= 10) & t.rlike(r"^[0-9]{4}/[\s\S]{2}/")
    container = lambda marks: t.rlike(rf"^\S*T\S*\s(?:stdout|stderr)\s[{marks}](?:\s|$)")
    has_prefix = (F.octet_length(t) >= 30) & t.rlike(prefix)
    flags = {
        STAMP: iso | slash | container("FP"),
        SECONDARY: F.when(has_prefix, prefixed(t, _SECONDARY)).otherwise(t.rlike("^(?i:" + "|".join(_SECONDARY) + ")")),
        SERVER: prefixed(line, _PRIMARY + _SECONDARY),
        PANIC: t.startswith("panic:"),
        BLANK: t == "",
        STACK: t.rlike("|".join(_STACK)),
        CSV: t.startswith('"') & (F.length(t) - F.length(F.replace(t, F.lit(","), F.lit(""))) >= 3),
        ODD: (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1,
        PARTIAL: container("P"),
        FULL: container("F"),
        BRACE: t.rlike(r"^\{\s*$"),
    }
    total = F.lit(0)
    for bit, is_so in flags.items():
        total += F.when(is_so, bit).otherwise(0)
    return total


#: An open record: its first line's number, whether that line has a stamp, whether it is a stack, its last line a server's, a CSV record
#: and whether in quotes, in a container's fragments; depth, in a string and behind a backslash of JSON; bytes, lines, over a bound.
State = tuple
NOTHING: State = ()


def _braces(depth: int, quoted: bool, escaped: bool, shape: str) -> tuple[int, bool, bool]:
    for ch in shape:
        if escaped:
            escaped = False
        elif quoted:
            escaped, quoted = ch == "\\", ch != '"'
        elif ch == '"':
            quoted = True
        elif ch == "{":
            depth += 1
        elif ch == "}" and depth:
            depth -= 1
    return depth, quoted, escaped


def _begun(flags: int, size: int, shape: str, at: int) -> State:
    if not size:
        return NOTHING  # an empty line opens nothing
    json_state = _braces(0, False, False, shape) if flags & BRACE else (0, False, False)
    return (at, bool(flags & STAMP), bool(flags & STACK), bool(flags & SERVER), bool(flags & CSV), bool(flags & CSV and flags & ODD), bool(flags & PARTIAL), *json_state, size, 1, False)


def step(state: State, flags: int, size: int, shape: str, at: int) -> tuple[State, bool, bool]:
    """The state after a line, whether the line begins a record (or is dropped), and whether a record ends with it."""
    if not state:
        return _begun(flags, size, shape, at), True, False
    first, stamped, stack, server, csv, quoted, partial, depth, in_string, escaped, n_bytes, n, over = state
    if over:
        return _begun(flags, size, shape, at), True, False
    ends = False
    is_quoted = quoted
    if csv and flags & ODD:
        quoted = not quoted
    if is_quoted:
        ends = not quoted
    elif partial:
        ends = bool(flags & FULL)
    elif depth:
        depth, in_string, escaped = _braces(depth, in_string, escaped, shape)
        ends = not depth
    else:
        if flags & SECONDARY and server:
            joins = True
        elif flags & STAMP or (flags & PANIC and not stack):
            joins = False
        elif stamped:
            joins = True
        else:
            joins = stack or bool(flags & BLANK and server)
        if not joins:
            return _begun(flags, size, shape, at), True, False
    if ends:
        return NOTHING, False, True
    n_bytes, n = n_bytes + 1 + size, n + 1
    over = n_bytes > MAX_BYTES or n > MAX_LINES or depth > MAX_DEPTH
    return (first, stamped, stack or bool(flags & STACK), bool(flags & SERVER), csv, quoted, partial, depth, in_string, escaped, n_bytes, n, over), False, False


_BLOCK = pa.schema([("source", pa.string()), ("part", pa.int32()), ("no", pa.int32()), ("flags", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("shapes", pa.list_(pa.string())), ("numbers", pa.list_(pa.int64())), ("lines", pa.list_(pa.string())), ("after", pa.string())])
_BLOCK_SQL = "source string, part int, no int, flags array<int>, sizes array<int>, shapes array<string>, numbers array<long>, lines array<string>, after string"
_CODES = ("flags", "sizes", "shapes", "numbers")


def _run(state: State, block: dict) -> State:
    for line in zip(*(block[c] for c in _CODES)):
        state = step(state, *line)[0]
    return state


def _blocks(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no = TaskContext.get().partitionId(), 0
        held: list[dict] = []

        def out() -> pa.RecordBatch:
            block = {c: [x[c[:-1] if c != "flags" else c] for x in held] for c in (*_CODES, "lines")}
            block |= {"source": held[0]["source"], "part": part, "no": no}
            return pa.RecordBatch.from_pylist([block | {"after": json.dumps(_run(NOTHING, block))}], schema=_BLOCK)

        size = 0
        for batch in batches:
            for x in batch.to_pylist():
                if held and (held[0]["source"] != x["source"] or len(held) >= limit or size > 8 * MAX_BYTES):
                    yield out()
                    held, no, size = [], no + 1, 0
                held.append(x)
                size += x["size"]
        if held:
            yield out()

    return run


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before each block; blocks come in order."""
    source, state = (), NOTHING
    for batch in batches:
        found = []
        for b in batch.to_pylist():
            if source != (b["source"],):
                source, state = (b["source"],), NOTHING
            found.append({"part": b["part"], "no": b["no"], "before": json.dumps(state)})
            own, after = NOTHING, tuple(json.loads(b["after"]))
            for line in zip(*(b[c] for c in _CODES)):
                if state == own:
                    state = after
                    break
                state, own = step(state, *line)[0], step(own, *line)[0]
        yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("part", pa.int32()), ("no", pa.int32()), ("before", pa.string())]))


_FRAGMENT = pa.schema([("source", pa.string()), ("first_line", pa.int64()), ("from_line", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64()), ("truncated", pa.bool_()), ("partial", pa.bool_())])
_FRAGMENT_SQL = "source string, first_line long, from_line long, text string, n_lines long, truncated boolean, partial boolean"


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each block, or the parts that lie in it."""
    for batch in batches:
        for i in range(batch.num_rows):
            b = batch.slice(i, 1).to_pylist()[0]
            state = tuple(json.loads(b["before"]))
            found: list[dict] = []
            now = {"source": b["source"], "first_line": state[0], "from_line": b["numbers"][0], "lines": [], "partial": True} if state else None

            def close(truncated: bool, partial: bool) -> None:
                if now and (now["lines"] or not partial):
                    found.append({k: now[k] for k in ("source", "first_line", "from_line")} | {"text": "\n".join(now["lines"]), "n_lines": len(now["lines"]), "truncated": truncated, "partial": partial or now["partial"]})

            for *code, number, line in zip(*(b[c] for c in _CODES), b["lines"]):
                before = state
                state, begins, ends = step(state, *code, number)
                if begins:
                    if before:
                        close(before[-1], False)
                    now = {"source": b["source"], "first_line": number, "from_line": number, "lines": [], "partial": False} if state else None
                if now:
                    now["lines"].append(line)
                if ends:
                    close(False, False)
                    now = None
            if state:
                close(state[-1], True)
            yield pa.RecordBatch.from_pylist(found, schema=_FRAGMENT)


def framed(rows: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Logical records of (source, line_no, line): source, first_line, text, n_lines, truncated.

    A line with a leading time stamp begins a record, unless a quoted CSV field, a container's
    fragments or a JSON document that began with a lone ``{`` is open, or it is a server's
    DETAIL, HINT and the like after a server's line. Any other line joins a record that began
    with a stamp or looks like a stack. A record that crosses a bound ends with that line and
    is truncated. Empty lines where nothing is open are dropped; a null line is empty. Lines
    of a source are told apart by line_no.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_folder(spark, "framing")
    bare = F.regexp_replace(F.coalesce(F.col("line"), F.lit("")), r"\r$", "")
    lines = rows.select(F.col("source").cast("string").alias("source"), F.col("line_no").cast("long").alias("number"), bare.alias("line"))
    order = [F.col("source").asc_nulls_first(), "number"]
    # Dealt first, then told what they look like: ranges are found by a pass of their own, and files of few row groups are read by few tasks.
    told = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"flags": looks(F.col("line")), "size": F.octet_length("line"), "shape": F.when(F.col("line").rlike(r'[{}"\\]'), F.regexp_replace("line", r'[^"\\{}]+', ".")).otherwise("")})
    blocks = kept(told.mapInArrow(_blocks(block_lines), _BLOCK_SQL), f"{path}/blocks")
    ordered = blocks.select("source", "part", "no", *_CODES, "after").repartition(parts, "source").sortWithinPartitions(F.col("source").asc_nulls_first(), "part", "no")
    entries = ordered.mapInArrow(_entries, "part int, no int, before string")
    pieces = kept(blocks.drop("after").join(entries, ["part", "no"]).mapInArrow(_fragments, _FRAGMENT_SQL), f"{path}/fragments")
    whole = pieces.where("not partial").select("source", "first_line", "text", "n_lines", "truncated")
    split = pieces.where("partial").groupBy("source", "first_line").agg(F.array_sort(F.collect_list(F.struct("from_line", "text", "n_lines", "truncated"))).alias("p"))  # a record's parts, at most MAX_LINES lines
    some = F.filter("p", lambda x: x["n_lines"] > 0)
    joined = split.select("source", "first_line", F.array_join(F.transform(some, lambda x: x["text"]), "\n").alias("text"), F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x["n_lines"]).alias("n_lines"), F.exists("p", lambda x: x["truncated"]).alias("truncated"))
    return whole.unionByName(joined)
