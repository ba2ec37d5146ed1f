"""Personal data in texts: fixed patterns, and further spans found by weak supervision.

Only DataFrame functions touch the rows. Patterns mark their matches with control
characters, and splitting at these gives positions in code points.

Further candidates are key-value pairs and national phone numbers whose value no
fixed match covers in full; where one covers a part, both spans are listed. A regex, a gazetteer and a context labeler each vote for, against or
not at all. Spark counts the vote patterns (at most PATTERNS rows, whatever the
corpus holds); expectation-maximisation over these counts estimates how reliable each
labeler is, and a logistic classifier fitted to the posteriors decides each span. Its
weights go back into the plan as a sum of columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .tables import fresh

#: Kinds of spans, in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
#: Two groups, three labelers of three votes, three lengths.
PATTERNS = 2 * 3**3 * 3

# The patterns of the contract. Possessive repeats match the same texts without deep
# recursion; a start inside a run that has already failed cannot match either, so it
# is skipped ((?<!...)) unless it follows a match (\G).
_PATTERN = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for its pattern to be tried at all.
_NEEDS = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), "phone": lambda t: t.contains("+")}
_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
_PAIR = r"(?<![A-Za-z_])[A-Za-z_]{2,}+[\"']? ?[=:] ?[\"']?[A-Za-z0-9+/_-]{8,}+"
_NATIONAL = r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9])"
_MARKS = "\x01\x02"
#: Gazetteers.
_PRIVATE_KEYS = r"(?:^|_)(?:pass(?:word|wd|code|phrase)?|pwd|token|secret|api_?key|(?:access|private|signing|encryption)_key|auth(?:orization)?|bearer|credentials?|cookie|session(?:_?id)?|pin|ssn|iban|otp)(?:_|$)"
_PLAIN_KEYS = ("http", "https", "ftp", "isbn", "version", "page", "title", "note", "ref", "see", "www")
#: Words before a key-value pair that speak of settings or of access.
_SETTING = r"(?i)(?:^|\b(?:export|set|env|config|conf|login|user|account|header|auth|access|connect|curl)\b[^\n]{0,8}|\n\s*)$"
_PHONE_WORDS = r"(?i)\b(?:tel|phone|call|fax|mobile|cell|ring|contact)\b"
_SPAN = "array<struct<start:int,end:int,match:string>>"


RUN = 256


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of `value`, which is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _found(text: Column, pattern: str) -> Column:
    """Start, end and text of each match, leftmost first, in code points."""
    parts = F.split(F.regexp_replace(text, f"({pattern})", f"{_MARKS[0]}$1{_MARKS[1]}"), f"[{_MARKS}]", -1)
    # Parts go by runs of RUN, as an array that grows by one is copied each time.
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / RUN).cast("int")), lambda i: F.slice(parts, i * RUN + 1, RUN))

    def step(s: Column, part: Column) -> Column:
        end = s["at"] + F.length(part)
        grown = F.concat(s["spans"], F.array(F.struct(s["at"].alias("start"), end.alias("end"), part.alias("match"))))
        return F.struct(end.alias("at"), (~s["inside"]).alias("inside"), F.when(s["inside"], grown).otherwise(s["spans"]).alias("spans"))

    def run(s: Column, parts: Column) -> Column:
        own = F.aggregate(parts, F.struct(s["at"].alias("at"), s["inside"].alias("inside"), F.array().cast(_SPAN).alias("spans")), step)
        return _let(own, lambda o: F.struct(o["at"].alias("at"), o["inside"].alias("inside"), F.concat(s["runs"], F.array(o["spans"])).alias("runs")))

    return F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast(f"array<{_SPAN}>").alias("runs")), run, lambda s: F.flatten(s["runs"]))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    digits = F.split(F.reverse(_digits(match)), "(?!^)(?!$)")
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d) % 10 == 0


_VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": lambda m: F.length(_digits(m)).between(13, 19) & _luhn(m),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}


def _base(text: Column, kind: str) -> Column:
    valid = F.filter(_found(text, _PATTERN[kind]), lambda s: _VALID[kind](s["match"]))
    return F.when(_NEEDS[kind](text), valid).otherwise(F.array().cast(_SPAN))


def _candidates(text: Column, base: Column) -> Column:
    """Spans that may be private besides the fixed ones, with their group and votes."""
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)

    def pair(s: Column) -> Column:
        key, value = F.lower(F.regexp_extract(s["match"], "^([A-Za-z_]+)", 1)), F.regexp_extract(s["match"], "([A-Za-z0-9+/_-]+)$", 1)
        before = F.substring(text, F.greatest(F.lit(1), s["start"] - 23), F.least(F.lit(24), s["start"]))
        mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), (s["end"] - F.length(value)).alias("value"), F.lit(0).alias("group"),
            vote(value.rlike("^[0-9A-Fa-f]{12,}$") | value.rlike("^[A-Za-z0-9+/_-]{20,}$") | (mixed & (F.length(value) >= 10)), ~value.rlike("[0-9]")).alias("regex"),
            vote(key.rlike(_PRIVATE_KEYS), key.isin(*_PLAIN_KEYS)).alias("gazetteer"), vote(s["match"].rlike("[=:] ?[\"']") | before.rlike(_SETTING), before.rlike("[?&/#]$")).alias("context"),
            F.when(F.length(value) < 12, 0).when(F.length(value) < 24, 1).otherwise(2).alias("size"),
        )

    def national(s: Column) -> Column:
        before = F.substring(text, F.greatest(F.lit(1), s["start"] - 23), F.least(F.lit(24), s["start"]))
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["start"].alias("value"), F.lit(1).alias("group"), vote(s["match"].rlike(r"^\([0-9]{3}\) [0-9]{3}-[0-9]{4}$"), s["match"].rlike("^[01]")).alias("regex"),
            vote(before.rlike(_PHONE_WORDS), F.lit(False)).alias("gazetteer"), vote(before.rlike(r"(?:^|[\s:,;])$"), before.rlike("[A-Za-z0-9]$")).alias("context"), F.lit(1).alias("size"),
        )

    none = F.array().cast("array<struct<start:int,end:int,value:int,group:int,regex:int,gazetteer:int,context:int,size:int>>")
    found = F.concat(
        F.when(text.rlike("[=:]"), F.transform(_found(text, _PAIR), pair)).otherwise(none), F.when(text.rlike("[0-9]{3}[.-][0-9]{4}"), F.transform(_found(text, _NATIONAL), national)).otherwise(none)
    )

    def covered(c: Column) -> Column:
        met = F.array_sort(F.filter(base, lambda b: (b["start"] < c["end"]) & (c["value"] < b["end"])), lambda a, b: a["start"] - b["start"])
        return F.aggregate(met, c["value"], lambda at, b: F.when(b["start"] <= at, F.greatest(at, b["end"])).otherwise(at)) >= c["end"]

    return F.filter(found, lambda c: ~covered(c))


LABELERS = ("regex", "gazetteer", "context")


def reliabilities(patterns: list[dict], rounds: int = 50) -> list[float]:
    """Posterior that each vote pattern is private, by expectation-maximisation over counts.

    `patterns` have group, the labelers' votes and n. Each labeler has, for private
    and other spans, its own chances of voting for, against and not at all; each group
    its own share of private spans.
    """
    share = {g: 0.5 for g in (0, 1)}
    chance = {(name, y): {y: 0.6, -y: 0.1, 0: 0.3} for name in LABELERS for y in (1, -1)}
    post = [0.5] * len(patterns)
    for _ in range(rounds):
        for i, p in enumerate(patterns):
            a, b = (w * math.prod(chance[name, y][p[name]] for name in LABELERS) for w, y in ((share[p["group"]], 1), (1 - share[p["group"]], -1)))
            post[i] = a / (a + b)
        for g in share:
            own = [(p["n"], q) for p, q in zip(patterns, post, strict=True) if p["group"] == g]
            share[g] = (sum(n * q for n, q in own) + 1) / (sum(n for n, _ in own) + 2)
        for name in LABELERS:
            for y in (1, -1):
                weight = [p["n"] * (q if y == 1 else 1 - q) for p, q in zip(patterns, post, strict=True)]
                total = sum(weight) + 10
                # The prior keeps a labeler's direction where nothing tells against it.
                chance[name, y] = {v: (sum(w for w, p in zip(weight, patterns, strict=True) if p[name] == v) + 10 * m) / total for v, m in ((y, 0.6), (-y, 0.1), (0, 0.3))}
    return post


def _features(p: dict) -> list[float]:
    return [1.0, float(p["group"] == 1), *(float(p[name] == v) for name in LABELERS for v in (1, -1)), float(p["size"] == 0), float(p["size"] == 2)]


def span_classifier(patterns: list[dict], posterior: list[float], rounds: int = 400) -> list[float]:
    """Weights of a logistic classifier fitted to posteriors, each pattern weighing as its logarithm of counts."""
    rows = [(_features(p), q, math.log1p(p["n"])) for p, q in zip(patterns, posterior, strict=True)]
    weights = [0.0] * len(_features({"group": 0, "size": 1} | dict.fromkeys(LABELERS, 0)))
    scale = sum(c for *_, c in rows) or 1.0
    for _ in range(rounds):
        gradient = [0.01 * w for w in weights]
        for x, q, c in rows:
            error = c / scale * (1 / (1 + math.exp(-sum(w * v for w, v in zip(weights, x, strict=True)))) - q)
            gradient = [g + error * v for g, v in zip(gradient, x, strict=True)]
        weights = [w - 1.5 * g for w, g in zip(weights, gradient, strict=True)]
    return weights


def _accepted(c: Column, weights: list[float]) -> Column:
    on = [F.lit(1.0), (c["group"] == 1).cast("double"), *((c[name] == v).cast("double") for name in LABELERS for v in (1, -1)), (c["size"] == 0).cast("double"), (c["size"] == 2).cast("double")]
    return reduce(lambda a, b: a + b, (F.lit(w) * x for w, x in zip(weights, on, strict=True))) > 0


def _clean() -> Column:
    return F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _MARKS, "\x03\x03")


def _with_spans(text: Column) -> Column:
    """Base spans and candidates of a text, computed once."""
    typed = lambda t, kind: F.transform(_base(t, kind), lambda s: F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    both = lambda t: _let(F.concat(*(typed(t, kind) for kind in BASE)), lambda base: F.struct(base.alias("base"), _candidates(t, base).alias("candidates")))
    return _let(text, both)


def _weights(found: DataFrame) -> list[float]:
    """Weights of the span classifier, from counts of the candidates' votes."""
    names = ("group", *LABELERS, "size")
    patterns = [r.asDict() for r in found.select(F.explode("candidates").alias("c")).select(*(F.col("c")[n].alias(n) for n in names)).groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect()]
    return span_classifier(patterns, reliabilities(patterns))


def _all(found: Column, weights: list[float]) -> Column:
    """Base spans and accepted candidates, in order."""
    added = F.transform(F.filter(found["candidates"], lambda c: _accepted(c, weights)), lambda c: F.struct(F.when(c["group"] == 1, 3).otherwise(4).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return F.array_sort(F.concat(found["base"], added))


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, base and spans, both arrays of (kind, start, end).

    `docs` needs doc_id and text; other columns are ignored. A null text is empty and
    has no spans. Rows are judged one by one, so repeated rows get the same spans.
    kind is a position in KINDS; start and end are code points, end exclusive. spans
    holds those of base and the ones the classifier adds, in order; they may overlap.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _with_spans(_clean()).alias("f")).select("doc_id", "f.base", "f.candidates"), "found")
    return found.select("doc_id", "base", _all(F.struct("base", "candidates"), _weights(found)).alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    names = F.array(*(F.lit(kind) for kind in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data_digest(docs: DataFrame) -> DataFrame:
    """Counts, digest and listing of the spans of each row of `docs`; n_added counts those besides the fixed patterns, n_private all."""
    found = personal_data(docs)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(count(kind) for kind in BASE), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"), F.size("spans").cast("long").alias("n_private")
    )


def without_personal_data(docs: DataFrame) -> DataFrame:
    """`docs` with each span replaced by its kind in angle brackets; n_chars, if there, follows the text.

    Spans are found twice, once to fit the classifier and once where they are
    replaced, so no text is shuffled. All other columns stay as they are.
    """
    weights = _weights(docs.select(_with_spans(_clean()).alias("f")).select("f.candidates"))
    text, names = F.col("text").cast("string"), F.array(*(F.lit(f"<{kind.upper()}>") for kind in KINDS))

    def masked(spans: Column) -> Column:
        ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

        def step(s: Column, span: Column) -> Column:
            grown = F.concat(s["out"], F.array(F.substring(text, s["at"] + 1, span["start"] - s["at"]), names[span["kind"]]))
            return F.struct(F.greatest(s["at"], span["end"]).alias("at"), F.when(span["start"] < s["at"], s["out"]).otherwise(grown).alias("out"))

        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(ordered, begin, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))

    (new,) = fresh(docs, "new_text")
    held = docs.withColumn(new, _let(_with_spans(_clean()), lambda f: _let(_all(f, weights), lambda spans: F.when(F.size(spans) > 0, masked(spans)).otherwise(text))))
    out = {"text": F.col(new), "n_chars": F.length(new).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": F.col(new)}
    return held.select(*(out[c].alias(c) if c in out else held[f"`{c}`"] for c in docs.columns))
