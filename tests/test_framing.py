"""Framing against a plain-Python version that keeps the open record's text."""

import random
import re

import pytest

from tidelog.sources import framing


def plain(lines):
    """Records as (first line, text, lines, truncated)."""
    out, open_, csv, cri, depth = [], None, False, False, 0

    def stamp(x):
        t = x.lstrip()
        return bool(re.match(r"\d{4}-..-", t, re.A) and len(t.encode()) >= 19 or re.match(r"\d{4}/../", t, re.A) or re.match(r"\S*T\S*\s(stdout|stderr)\s[FP](\s|$)", t))

    def after_pid(x):
        m = re.match(r"(?=.{4}-)[^\[]*\[[^\]]*\]\s*", x) if len(x.encode()) >= 30 else None
        return x[m.end() :].upper() if m else None

    tags = ("DETAIL:", "HINT:", "STATEMENT:", "CONTEXT:", "QUERY:", "LOCATION:")

    def stack(text):
        return any(
            any(w in t for w in ("Exception", "Error:", "panicked at", " ERROR ", " [ERR] ", " ERROR:")) or t.startswith(("Traceback", "panic:", "thread '", "stack backtrace")) for t in (x.lstrip() for x in text)
        )

    def braces(text):
        d, q, e = 0, False, False
        for ch in "\n".join(text):
            if e:
                e = False
            elif q:
                e, q = ch == "\\", ch != '"'
            else:
                q, d = ch == '"', max(0, d + (ch == "{") - (ch == "}"))
        return d

    def over(text):
        return len("\n".join(text).encode()) > framing.MAX_BYTES or len(text) > framing.MAX_LINES or depth > framing.MAX_DEPTH

    def emit(truncated):
        nonlocal open_
        if open_:
            out.append((open_[0], "\n".join(open_[1]), len(open_[1]), truncated))
        open_ = None

    def begin(i, x):
        nonlocal open_, csv, cri, depth
        open_ = (i, [x]) if x else None
        csv = x.lstrip().startswith('"') and x.count(",") >= 3
        m = re.match(r"\S*T\S*\s(?:stdout|stderr)\s([FP])(?:\s|$)", x.lstrip())
        cri, depth = bool(m and m[1] == "P"), int(re.fullmatch(r"\s*\{\s*", x) is not None)

    blown = False
    for i, x in enumerate(lines):
        if open_ is None:
            begin(i, x)
            continue
        text = open_[1]
        if blown:
            blown = False
            emit(True)
            begin(i, x)
            continue
        if csv and "\n".join(text).count('"') % 2:
            text.append(x)
            if "\n".join(text).count('"') % 2 == 0:
                emit(False)
                continue
        elif cri:
            text.append(x)
            if re.match(r"\S*T\S*\s(stdout|stderr)\sF(\s|$)", x.lstrip()):
                emit(False)
                continue
        elif depth:
            text.append(x)
            depth = braces(text)
            if not depth:
                emit(False)
                continue
        else:
            last, rest = after_pid(text[-1]), after_pid(x.lstrip())
            server = last is not None and last.startswith(("ERROR:", "FATAL:", "PANIC:", "WARNING:", "LOG:", "INFO:", "NOTICE:", "DEBUG", *tags))
            if (x.lstrip().upper() if rest is None else rest).startswith(tags) and server:
                joins = True
            elif stamp(x) or x.lstrip().startswith("panic:") and not stack(text):
                joins = False
            else:
                joins = stamp(text[0]) or stack(text) or not x.strip() and server
            if not joins:
                emit(False)
                begin(i, x)
                continue
            text.append(x)
        blown = over(text)
    emit(blown)
    return out


PG = "2024-01-02 03:04:05.006 UTC [12] "
POOL = [
    "", "  ", "note", "2024-01-02 03:04:05 start", "  2024-01-02T03:04:05Z x", "2024/01/02 go", "panic: boom", "goroutine 1 [running]:", "java.io.IOException: Exception", "\tat a.B(C.java:1)", PG + "ERROR:  bad",
    PG + "DETAIL:  Key", "HINT: do", PG + "LOG:  x", "{", ' "a": "}{",', ' "b": {"c": "\\""},', "}", '"a","b","c","d', 'e"', 'x","y', "2024-01-02T03:04:05Z stdout P part", "2024-01-02T03:04:05Z stdout F end", "2024-01-02T03:04:05Z stderr F", "SELECT 1", "é" * 9, " ERROR here",
    "2024-01-02 03:04:05 sending: SELECT", "FROM t", "thread 'main' panicked at x", "short 2024-01",
]


@pytest.mark.parametrize("block_lines", [1, 3, 4096])
def test_records_of_random_lines(spark, block_lines, monkeypatch):
    rng = random.Random(block_lines)
    sources = {f"s{k}": [rng.choice(POOL) for _ in range(60)] for k in range(40)}
    sources["braces"] = ["{"] * 70 + ["note"] + ["}"] * 80
    sources["long"] = ["2024-01-02 03:04:05 lead"] + ["x" * 400_000] * 7 + ["tail"]
    sources["many"] = ["2024-01-02 03:04:05 lead"] + ["y"] * 5_100
    rows = [(s, i, x + ("\r" if i % 7 == 0 else "")) for s, lines in sources.items() for i, x in enumerate(lines)]
    rng.shuffle(rows)
    got: dict = {}
    for r in framing.framed(spark.createDataFrame(rows, "source string, line_no long, line string"), block_lines).collect():
        got.setdefault(r.source, []).append((r.first_line, r.text, r.n_lines, r.truncated))
    for s, lines in sources.items():
        assert sorted(got.get(s, [])) == sorted(plain(lines)), s


def test_edges(spark):
    schema = "source string, line_no long, line string, part int"
    assert framing.framed(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, 1, None, 0), (None, 2, "a", 0), ("x", 1, "b", 0)]
    assert {(r.source, r.text) for r in framing.framed(spark.createDataFrame(rows, schema)).collect()} == {(None, "a"), ("x", "b")}
