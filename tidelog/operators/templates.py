"""Templates of messages, mined from skeletons instead of from single messages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WILD = "<*>"
SIMILAR = 0.5
#: Limits that stop the work with an error, so that no message joins a wrong template.
MAX_TEMPLATES, MAX_PER_LENGTH = 25_000, 2048
#: Independent first folds of one length.
SALTS = 64


def skeleton(message: Column) -> Column:
    """Tokens between white space, commas and semicolons; a token that is long or mostly digits is a wildcard."""
    tokens = F.filter(F.split(message, r"[\s,;]+"), lambda t: t != "")
    digits = lambda t: F.length(F.regexp_replace(t, "[^0-9]", ""))
    varies = lambda t: ((digits(t) >= 2) & (digits(t) * 2 >= F.octet_length(t))) | (F.octet_length(t) > 20)
    return F.transform(tokens, lambda t: F.when(varies(t), F.lit(WILD)).otherwise(t))


class _Fold:
    """Templates of one key: each new skeleton joins the most similar one, of equals the earliest."""

    def __init__(self, width: int):
        self.codes, self.words = {WILD: 0}, [WILD]
        self.table = np.zeros((8, width), np.int64)
        self.stats: list[list] = []

    def add(self, tokens: list[str], n: int, first: int, low: int, high: int, severity: int) -> None:
        row = np.array([self.codes.setdefault(t, len(self.codes)) for t in tokens], np.int64)
        self.words.extend(t for t in tokens if self.codes[t] == len(self.words))
        held = self.table[: len(self.stats)]
        same = ((held == row) | (held == 0)).sum(axis=1) if len(held) else np.zeros(0)
        best = int(same.argmax()) if len(held) else -1
        if best >= 0 and len(row) and same[best] >= SIMILAR * len(row):
            self.table[best][held[best] != row] = 0
            s = self.stats[best]
            self.stats[best] = [s[0] + n, min(s[1], first), min(s[2], low), max(s[3], high), max(s[4], severity)]
            return
        if len(self.stats) >= MAX_PER_LENGTH:
            raise ValueError(f"more than {MAX_PER_LENGTH} templates of {len(row)} tokens")
        if len(self.stats) == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[len(self.stats)] = row
        self.stats.append([n, first, low, high, severity])

    def rows(self) -> Iterator[tuple]:
        for row, s in zip(self.table, self.stats, strict=False):
            yield [self.words[c] for c in row], *s


_COLUMNS = ["n_tokens", "salt", "tokens", "n", "first_seq", "first_ts", "last_ts", "severity"]
_SCHEMA = "n_tokens int, salt int, tokens array<string>, n long, first_seq long, first_ts long, last_ts long, severity int"


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by (n_tokens, salt, first_seq); one key's templates are held at a time."""
    key, fold = None, None

    def done() -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in fold.rows()], columns=_COLUMNS)

    for batch in batches:
        for r in batch.itertuples(index=False):
            if key != (r.n_tokens, r.salt):
                if fold:
                    yield done()
                key, fold = (r.n_tokens, r.salt), _Fold(r.n_tokens)
            fold.add(list(r.tokens), r.n, r.first_seq, r.first_ts, r.last_ts, r.severity)
    if fold:
        yield done()


def _fold(rows: DataFrame) -> DataFrame:
    return rows.select(*_COLUMNS).repartition("n_tokens", "salt").sortWithinPartitions("n_tokens", "salt", "first_seq", "tokens").mapInPandas(_folded, _SCHEMA)


def templates(events: DataFrame, severity: Column) -> DataFrame:
    """template_id, pattern, n_tokens, n, first_ts, last_ts, severity of `events` (seq, ts, message).

    Equal skeletons are counted first, so a hot message is one row after the
    shuffle. Skeletons of one length are folded in order of first appearance, in
    SALTS shares and then once more over the shares' templates: a task holds the
    templates of one key, which the limits bound, and streams the rest. Skeletons
    whose tokens agree in half of the places, wildcards included, share a template,
    and places that differ become wildcards. Ids number the templates by first
    appearance. A null message is left out; a blank one is a template without tokens.
    """
    counted = (
        events.where("message is not null")
        .groupBy(skeleton(F.col("message")).alias("tokens"))
        .agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max(severity).cast("int").alias("severity"))
        .na.fill({"first_seq": 0, "first_ts": 0, "last_ts": 0, "severity": 0})
        .withColumn("n_tokens", F.size("tokens"))
    )
    shares = _fold(counted.withColumn("salt", F.pmod(F.xxhash64("tokens"), F.lit(SALTS)).cast("int")))
    whole = _fold(shares.withColumn("salt", F.lit(0)))
    found = whole.withColumn("pattern", F.array_join("tokens", " ")).select("pattern", "n_tokens", "n", "first_seq", "first_ts", "last_ts", "severity")
    # The inventory is bounded by MAX_TEMPLATES, so one task may number it.
    ids = F.expr("row_number() over (order by first_seq, pattern) - 1")
    over = F.expr(f"assert_true(count(*) over () <= {MAX_TEMPLATES}, 'too many templates') is null")
    return found.select(ids.alias("template_id"), "pattern", "n_tokens", "n", "first_ts", "last_ts", "severity", over.alias("_ok")).where("_ok").drop("_ok")
