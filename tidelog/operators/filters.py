"""The one predicate that pages, counts, facets and timelines share."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_EXCLUDED = 256
# Bases of a time that stand for a clock.
WALL = ("explicit_wall", "resolved_local")


@dataclass(frozen=True)
class EventFilter:
    """All set clauses hold; a list means any of it, an empty one no clause. Times are half-open, sequences closed."""

    ts_from: int | None = None
    ts_to: int | None = None
    seq_from: int | None = None
    seq_to: int | None = None
    levels: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    templates: list[int] = field(default_factory=list)
    services: list[str] = field(default_factory=list)  # "" selects rows without one
    hosts: list[str] = field(default_factory=list)
    excluded_templates: list[int] = field(default_factory=list)
    trace_id: str | None = None
    keyword: str = ""
    wildcards: bool = False  # % and _ in the keyword match anything, as in LIKE
    literal: str = ""  # case counts
    pattern: str = ""
    wall_only: bool = False  # rows whose basis is a clock's

    def condition(self) -> Column:
        if len(set(self.excluded_templates)) > MAX_EXCLUDED:
            raise ValueError(f"more than {MAX_EXCLUDED} excluded templates")
        if re.search(r"\(\?(?:=|!|<)|\\(?:[1-9]|k<)", self.pattern) or len(self.pattern) > 256:
            raise ValueError("look-around, back-references and patterns of more than 256 characters are refused")
        c, out = F.col, [F.lit(True)]
        for bound, test in (
            (self.ts_from, lambda v: c("ts") >= v), (self.ts_to, lambda v: c("ts") < v), (self.seq_from, lambda v: c("seq") >= v), (self.seq_to, lambda v: c("seq") <= v), (self.trace_id, lambda v: c("trace_id") == v),
        ):
            if bound is not None:
                out.append(test(bound))
        for values, column in ((self.levels, c("level")), (self.sources, c("source")), (self.templates, c("template_id")), (self.services, F.coalesce(c("service"), F.lit(""))), (self.hosts, F.coalesce(c("host"), F.lit("")))):
            if values:
                out.append(column.isin(*values))
        if self.excluded_templates:
            out.append(~c("template_id").isin(*sorted(set(self.excluded_templates))))
        if self.keyword.strip():
            word = F.lit(self.keyword.lower())
            out.append(F.like(F.lower("message"), F.lit(f"%{self.keyword.lower()}%"), F.lit("\x00")) if self.wildcards else F.contains(F.lower("message"), word))
        if self.literal:
            out.append(F.contains(c("message"), F.lit(self.literal)))
        if self.pattern:
            out.append(c("message").rlike(self.pattern))
        if self.wall_only:
            out.append(c("basis").isin(*WALL))
        return reduce(lambda a, b: a & b, out)

    def apply(self, events: DataFrame) -> DataFrame:
        return events.where(self.condition())
