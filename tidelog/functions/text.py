"""Tokens, excerpts, redaction, markup and exception signatures as Columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column, longer_than: int = 1, keep: str = "") -> Column:
    """Lower-case ASCII words of more than `longer_than` characters; `keep` adds characters to words."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), f"[^a-z0-9{keep}]+")
    return F.filter(parts, lambda w: F.length(w) > longer_than)


def excerpt(text: Column, needle: str, around: int = 40, limit: int = 160) -> Column:
    """Text around the first occurrence of `needle`, with ellipses where cut."""
    at = F.instr(F.lower(text), needle.lower())
    start = F.greatest(F.lit(1), at - around)
    size = F.least(F.lit(limit), F.lit(2 * around + len(needle)))
    left = F.when(start > 1, "…").otherwise("")
    right = F.when(start + size <= F.length(text), "…").otherwise("")
    return F.when(at > 0, F.concat(left, F.substring(text, start, size), right))


def without_markup(html: Column) -> Column:
    """Visible text: scripts, styles, comments and tags go; white space is folded."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def title(html: Column) -> Column:
    found = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title\s*>", 1)
    return F.nullif(F.trim(F.regexp_replace(found, r"\s+", " ")), F.lit(""))


#: What secrets look like, and the class that stands in for them. The first group is what stands before, and stays.
_START = "(^|[^A-Za-z0-9_])"
SECRETS = (
    ("PRIVATE_KEY", r"()-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"),
    ("JWT", _START + r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}"),
    ("AWS_KEY", _START + r"(?:AKIA|ASIA)[0-9A-Z]{16}"),
    ("AWS_SECRET", r"((?i:aws_secret_access_key)[ \t=:]*)[A-Za-z0-9/+=]{30,}"),
    ("GITHUB_TOKEN", _START + r"(?:gh[pousr]_|github_pat_)[A-Za-z0-9_]{20,}"),
    ("API_KEY", _START + r"(?:sk|xai)-[A-Za-z0-9_-]{16,}"),
    ("BEARER", _START + r"[Bb][Ee][Aa][Rr][Ee][Rr][ \t]+[A-Za-z0-9._~+/-]{12,}=*"),
    ("URL_CREDENTIALS", r"(://)[^\s/:@]+:[^\s/@]+@"),
    ("ASSIGNMENT", r"((?:^|[^A-Za-z0-9_])[A-Za-z0-9_-]*(?i:token|secret|password|passwd|passphrase|credential|api[_-]?key|access[_-]?key)[\"']?[ \t]*[=:][ \t]*[\"']?)[A-Za-z0-9+/_.-]{8,}"),
)


#: What a pattern takes along behind the secret, and is put back.
AFTER = {"URL_CREDENTIALS": "@"}


#: The same matches where a run of letters, digits, _ and - is tried from its beginning only: from there all of its names are in reach.
_APPLIED = {"ASSIGNMENT": dict(SECRETS)["ASSIGNMENT"].replace("(?:^|[^A-Za-z0-9_])", "(?:^|[^A-Za-z0-9_-])", 1)}
#: Strings of which a text holds one, all parts of it, wherever a pattern matches; those in small letters whatever the text's case.
_HINTS = {
    "PRIVATE_KEY": (("-----BEGIN ", "-----END "),), "JWT": (("eyJ",),), "AWS_KEY": (("AKIA",), ("ASIA",)), "GITHUB_TOKEN": (("ghp_",), ("gho_",), ("ghu_",), ("ghs_",), ("ghr_",), ("github_pat_",)),
    "API_KEY": (("sk-",), ("xai-",)), "URL_CREDENTIALS": (("://", "@"),),
}
_LOW_HINTS = {
    "AWS_SECRET": ("aws_secret_access_key",), "BEARER": ("bearer",),
    "ASSIGNMENT": ("token", "secret", "password", "passwd", "passphrase", "credential", "apikey", "api_key", "api-key", "accesskey", "access_key", "access-key"),
}

#: What an assignment of a secret ends with, in small letters; tried before the pattern, which tries each run of letters from every length of it.
_LOW_TAIL = r"(?=[tspca])(?:token|secret|password|passwd|passphrase|credential|api[_-]?key|access[_-]?key)[\"']?[ \t]*[=:][ \t]*[\"']?[a-z0-9+/_.-]{8}"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once a row, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _may_hold(name: str, text: Column, low: Column) -> Column:
    """Whether a text can match the pattern of that name, by plain searches."""
    if name in _HINTS:
        return reduce(or_, (reduce(and_, (text.contains(part) for part in parts)) for parts in _HINTS[name]))
    named = reduce(or_, (low.contains(word) for word in _LOW_HINTS[name]))
    return named & low.rlike(_LOW_TAIL) if name == "ASSIGNMENT" else named


def _swapped(text: Column, name: str, swap: Callable[[Column], Column]) -> Column:
    hinted = lambda t: _may_hold(name, t, t) if name in _HINTS else _once(F.lower(t), lambda low: _may_hold(name, t, low))
    return _once(text, lambda t: F.when(hinted(t), swap(t)).otherwise(t))


def _replaced(text: Column, after: dict[str, str]) -> Column:
    """`text` with what the patterns match replaced by its class, one pattern after the other."""
    for name, pattern in SECRETS:
        swap = lambda t, name=name, pattern=pattern: F.regexp_replace(t, _APPLIED.get(name, pattern), f"$1[REDACTED:{name}]{after.get(name, '')}")
        text = _swapped(text, name, swap)
    return text


#: A token of letters, digits, - and _ from which it may be a secret, and the different characters it has at least.
ENTROPY_LENGTH, ENTROPY_KINDS = 32, 16
_TOKEN = r"[A-Za-z0-9_-]+|[^A-Za-z0-9_-]+"


def _random_looking(token: Column) -> Column:
    """A long token of letters and digits mixed, with many different characters."""
    mixed = (F.length(token) >= ENTROPY_LENGTH) & token.rlike("^[A-Za-z0-9_-]+$") & token.rlike("[0-9]") & token.rlike("[A-Za-z]") & ~token.contains("REDACTED")
    return F.when(mixed, F.size(F.array_distinct(F.split(token, ""))) >= ENTROPY_KINDS).otherwise(False)


def _long_tokens(text: Column) -> Column:
    return text.rlike(f"[A-Za-z0-9_-]{{{ENTROPY_LENGTH}}}")


def without_random_tokens(text: Column) -> Column:
    """Long tokens that look random give way; only texts that hold a long token are taken apart."""
    parts = lambda t: F.transform(F.regexp_extract_all(t, F.lit(_TOKEN), F.lit(0)), lambda w: F.when(_random_looking(w), "[REDACTED:HIGH_ENTROPY]").otherwise(w))
    return _once(text, lambda t: F.when(_long_tokens(t), F.array_join(parts(t), "")).otherwise(t))


def redacted(text: Column) -> Column:
    """`text` with each secret replaced by its class, patterns first, then long tokens that look random."""
    return without_random_tokens(_replaced(text, AFTER))


def secret_classes(text: Column) -> Column:
    """Classes of the secrets of a text; a random-looking token counts as such outside of the other classes.

    A stand-in never joins tokens, so a text without a long token has none behind the replacements either.
    """
    random = lambda t: F.when(_long_tokens(t), F.exists(F.regexp_extract_all(_replaced(t, {}), F.lit(_TOKEN), F.lit(0)), _random_looking))
    held = lambda t, low: [F.when(_may_hold(n, t, low) & t.rlike(_APPLIED.get(n, p)), F.lit(n)) for n, p in SECRETS]
    return _once(F.struct(text.alias("t"), F.lower(text).alias("low")), lambda x: F.array_compact(F.array(*held(x["t"], x["low"]), F.when(random(x["t"]), F.lit("HIGH_ENTROPY")))))


#: What may not be shared besides secrets, in this order, and what stands for it.
_PRIVATE = (
    ("[credential-redacted]", r"(?i)\b(?:proxy-authorization|authorization|x-api-key|api[-_ ]?key)\b\s*[:=]\s*[\"']?(?:[a-z][a-z0-9_-]*\s+)?[^\s,;}\]]+"),
    ("[endpoint-redacted]", r"(?i)\bhttps?://[^\s<>\"']+"),
    ("[local-path]/$1", r"(?<![\w.\]/])(?:[A-Za-z]:[\\/]|/(?:home|Users|root|var|tmp|etc|opt|usr|mnt|srv|private)/)(?:[^\s\"'<>|:;,()\\/]+[\\/])*([^\s\"'<>|:;,()\\/]*)"),
)


def share_safe(text: Column, identifiers: tuple[str, ...] = (), limit: int = 4000) -> Column:
    """Text without secrets, credentials, endpoints, folders of local paths and the given identifiers, whatever their case; cut at `limit` characters with an ellipsis."""
    out = redacted(text)
    for stand_in, pattern in _PRIVATE:
        out = F.regexp_replace(out, pattern, stand_in.replace("[", "\\[").replace("]", "\\]"))
    for name in identifiers:
        if name.strip():
            out = F.regexp_replace(out, "(?iu)" + re.escape(name.strip()), "[identity-redacted]")
    return _once(out, lambda t: F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("…"))).otherwise(t))


# Words that a search does without.
STOP_WORDS = (
    "who what when where which whom whose how why is are was were be been being have has had do does did the a an of in on at to for from by with about into over "
    "after before between and or but if as than that this these those any some many much most more can could would should will just please tell me you your i we they their there here"
).split()


def condensed(query: Column) -> Column:
    """The words of a question, parted by blanks, slashes and bars, without stop words."""
    bare = lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.array_join(F.filter(F.split(query, r"[\s/\\|]+"), lambda w: (bare(w) != "") & ~bare(w).isin(STOP_WORDS)), " ")


# What announces something to keep, its kind and the name of the cue, and what each kind adds to salience and confidence.
CUES = (
    ("remember that ", "fact", "explicit_remember_that"), ("remember: ", "fact", "explicit_remember_colon"), ("please remember ", "fact", "explicit_please_remember"),
    ("don't forget ", "fact", "explicit_dont_forget"), ("note that ", "fact", "explicit_note_that"), ("we decided ", "decision", "decision_we_decided"),
    ("we chose ", "decision", "decision_we_chose"), ("decision: ", "decision", "decision_label"), ("i decided ", "decision", "decision_i_decided"), ("going with ", "decision", "decision_going_with"),
    ("i prefer ", "preference", "pref_i_prefer"), ("my preference is ", "preference", "pref_my_preference"), ("i always want ", "preference", "pref_always_want"), ("please always ", "preference", "pref_please_always"),
    ("todo: ", "task", "task_todo"), ("i need to ", "task", "task_need_to"), ("remind me to ", "task", "task_remind"),
)
KINDS = {"decision": (35, 15), "preference": (28, 12), "fact": (25, 10), "task": (20, 8)}


def cues(text: Column) -> Column:
    """Structs of cue, kind and content, one for each cue of a text: what follows its first occurrence up to the end of the sentence, of 8 characters or more."""
    found = []
    for words, kind, name in CUES:
        rest = F.regexp_extract(text, r"(?is)^.*?\Q" + words + r"\E\s*([^\n.!?]*[.!?]?)", 1)
        content = F.regexp_replace(F.trim(rest), "^[\"'`]+|[\"'`]+$", "")
        content = F.when(F.length(content) > 500, F.concat(F.substring(content, 1, 500), F.lit("…"))).otherwise(content)
        found.append(F.when(F.length(content) >= 8, F.struct(F.lit(name).alias("cue"), F.lit(kind).alias("kind"), content.alias("content"))))
    return F.array_compact(F.array(*found))


def salience(kind: Column, content: Column, cue: Column) -> tuple[Column, Column]:
    """Salience and confidence of a memory in hundredths, 0 to 100: by kind, how plainly it was said, its length, and how concrete it is."""
    n, low = F.greatest(F.length(content), F.lit(1)), F.lower(content)
    base = [F.lit(15), F.lit(5)]
    for name, (s, c) in KINDS.items():
        base = [F.when(kind == name, s).otherwise(base[0]), F.when(kind == name, c).otherwise(base[1])]
    plain, decided = cue.startswith("explicit_"), cue.startswith("decision_")
    solid, vague = low.rlike("http://|https://|postgres|sqlite|port |v1|api"), low.rlike("something|maybe|i think")
    s = 30 + base[0] + F.when(plain, 15).otherwise(0) + F.when(n < 12, -10).when((n >= 20) & (n < 200), 5).otherwise(0) + F.when(solid, 5).otherwise(0) - F.when(vague, 5).otherwise(0)
    c = 45 + base[1] + F.when(plain, 20).when(decided, 10).otherwise(0) + F.when(n < 12, -15).when((n >= 20) & (n < 200), 10).when(n > 400, -5).otherwise(0) + F.when(solid, 8).otherwise(0) - F.when(vague, 12).otherwise(0)
    return tuple(F.greatest(F.lit(0), F.least(F.lit(100), x)) for x in (s, c))


def original(record: Column, limit: int = 65_536) -> Column:
    """What is kept of a source record: its redacted text cut at `limit` bytes between characters, its size before, and whether it was cut or redacted."""
    bare = F.regexp_replace(record, r"\r?\n?$", "")
    out = redacted(bare)
    # A cut inside a character leaves bytes that are no text, which go.
    raw = F.substring(F.encode(out, "UTF-8"), 1, limit).cast("string")
    cut = F.coalesce(F.try_validate_utf8(raw), F.regexp_replace(F.make_valid_utf8(raw), "\ufffd+$", ""))
    long = F.octet_length(out) > limit
    return F.struct(F.when(long, cut).otherwise(out).alias("text"), F.octet_length(bare).alias("source_bytes"), F.length(out).alias("redacted_chars"), long.alias("truncated"), (out != bare).alias("redaction_applied"))


def redacted_params(params: Column) -> Column:
    return F.transform(params, redacted)


def lexical_overlap(asked: Column, text: Column) -> Column:
    """How many distinct words of one text another has."""
    return F.size(F.array_intersect(F.array_distinct(tokens(asked)), tokens(text))).cast("long")


def feed_score(asked: Column, title: Column, snippet: Column) -> Column:
    """2 for each asked word in the title, else 1 for each in the snippet; with four words or more, one hit is none."""
    words, head, body = F.array_distinct(tokens(asked)), tokens(title), tokens(snippet)
    hits = F.filter(words, lambda w: F.array_contains(head, w) | F.array_contains(body, w))
    score = F.aggregate(hits, F.lit(0).cast("long"), lambda s, w: s + F.when(F.array_contains(head, w), 2).otherwise(1))
    return F.when((F.size(words) >= 4) & (F.size(hits) < 2), F.lit(0).cast("long")).otherwise(score)


def source_identity(path: Column) -> Column:
    """A relative path with forward slashes; null for absolute paths, drives and steps upwards."""
    slashed = F.translate(path, "\\", "/")
    parts = F.filter(F.split(slashed, "/"), lambda p: (p != "") & (p != "."))
    bad = slashed.rlike("^/|^[A-Za-z]:") | F.array_contains(parts, "..") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))


def citation_id(kind: Column, number: Column) -> Column:
    return F.concat_ws(":", kind, number.cast("string"))


def citation_parts(raw: Column, kinds: tuple[str, ...]) -> tuple[Column, Column]:
    """Kind and number of a canonical citation id; null for leading zeros, signs, unknown kinds and numbers past 64 bits."""
    pattern = f"^({'|'.join(kinds)}):(0|[1-9][0-9]{{0,19}})$"
    number = F.regexp_extract(raw, pattern, 2).try_cast("decimal(20,0)")
    good = raw.rlike(pattern) & (number <= F.lit(str(2**64 - 1)).cast("decimal(20,0)"))
    return F.when(good, F.regexp_extract(raw, pattern, 1)), F.when(good, number)


#: What may stand before an exception in its line: level, stream, thread in brackets.
LEAD = r"^\s*(?:(?:ERROR|WARN|INFO|DEBUG|FATAL|TRACE|error|warn|info|debug|fatal|trace) +)?(?:\[stderr\]\s*)?(?:\([^)]{0,96}\)\s*)?"


def exception_signature(text: Column) -> Column:
    """Type and normalised detail of the last exception line, without what stands before it; numbers and long hexadecimal become <*>."""
    named = lambda x: x.contains("Exception") | x.contains("Error") | x.contains("Panic")
    lines = lambda t: F.filter(F.split(t, "\n"), lambda x: named(x) & x.rlike(LEAD + r"(?:Caused by: )?(?:[\w$]+\.)*[A-Z][\w$]*(?:Exception|Error|Panic)\b"))
    last = lambda t: _once(lines(t), lambda found: F.get(found, F.size(found) - 1))
    bare = lambda x: F.regexp_replace(F.lower(F.trim(F.regexp_replace(x, LEAD + "(?:Caused by: )?", ""))), r"\b(?:0x)?[0-9a-f]{8,}\b|\d+", "<*>")
    return _once(text, lambda t: F.when(named(t), F.array_join(F.slice(F.split(bare(last(t)), r"\s+"), 1, 24), " ")))
