"""Logical records of a stream of lines, with the open record of each source as state, and late lines apart."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.framing import NOTHING, looks, step

_OUT = "source string, first_line long, text string, n_lines long, truncated boolean, status string"
_STATE = "open string, lines string, last long"


def _record(source: str, state: tuple, lines: list[str], truncated: bool) -> tuple:
    return (source, state[0], "\n".join(lines), len(lines), truncated, "record")


def _framed(idle: int):
    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (source,) = key
        open_, lines, last = (tuple(json.loads(state.get[0])), json.loads(state.get[1]), state.get[2]) if state.exists else (NOTHING, [], -(1 << 62))
        out: list[tuple] = []
        if state.hasTimedOut:
            if open_:
                out.append(_record(source, open_, lines, open_[-1]))
            open_, lines = NOTHING, []
            state.update((json.dumps(open_), json.dumps(lines), last))
        else:
            rows = pd.concat(list(batches), ignore_index=True).sort_values("line_no", kind="stable")
            for number, line, flags, size, shape in zip(*(rows[c] for c in ("line_no", "line", "flags", "size", "shape")), strict=True):
                if number <= last:
                    out.append((source, number, line, 1, False, "late"))
                    continue
                before, last = open_, int(number)
                open_, begins, ends = step(before, int(flags), int(size), shape, last)
                if begins:
                    if before:
                        out.append(_record(source, before, lines, before[-1]))
                    lines = []
                lines.append(line)
                if ends:
                    out.append(_record(source, before, lines, False))
                if not open_:
                    lines = []
            state.update((json.dumps(open_), json.dumps(lines), last))
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    return advance


def framed_stream(lines: DataFrame, idle_ms: int = 60_000) -> DataFrame:
    """Records of a stream of (source, line_no, line), as `framing.framed` gives them, as soon as they are closed, with status record.

    A source's open record waits for more lines, and comes out when none has come for `idle_ms`.
    A line whose number is not above those already taken is late: it joins nothing and comes as
    a row of its own with status late. State is one open record a source, bounded as records are.
    """
    bare = F.regexp_replace(F.coalesce(F.col("line"), F.lit("")), r"\r$", "")
    told = lines.where("source is not null and line_no is not null").select(F.col("source").cast("string").alias("source"), F.col("line_no").cast("long").alias("line_no"), bare.alias("line"))
    told = told.withColumns({"flags": looks(F.col("line")), "size": F.octet_length("line"), "shape": F.when(F.col("line").rlike(r'[{}"\\]'), F.regexp_replace("line", r'[^"\\{}]+', ".")).otherwise("")})
    return told.groupBy("source").applyInPandasWithState(_framed(idle_ms), _OUT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
