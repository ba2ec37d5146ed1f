"""Templates, episodes, budgets and write logs against brute force and on edge cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidelog.operators import episodes, evidence, selection, templates

WILD = templates.WILD


def mined(messages):
    """One fold over skeletons in order of first appearance."""
    first = {}
    for m in messages:
        if m is None:
            continue
        tokens = tuple(
            WILD if (sum(c in "0123456789" for c in t) >= 2 and 2 * sum(c in "0123456789" for c in t) >= len(t)) or len(t) > 20 else t
            for t in re.split(r"[\s,;]+", m)
            if t
        )
        first[tokens] = first.get(tokens, 0) + 1
    found = []
    for tokens, n in first.items():
        rated = [(sum(a in (b, WILD) for a, b in zip(p, tokens)), -i) for i, (p, _) in enumerate(found) if len(p) == len(tokens)]
        same, at = max(rated, default=(0, 0))
        if tokens and rated and 2 * same >= len(tokens):
            p, held = found[-at]
            found[-at] = (tuple(a if a == b else WILD for a, b in zip(p, tokens)), held + n)
        else:
            found.append((tokens, n))
    return sorted((" ".join(p), n) for p, n in found)


def ours(spark, messages, salts=None):
    rows = spark.createDataFrame([(i, i, m) for i, m in enumerate(messages)], "seq long, ts long, message string")
    return sorted((r.pattern, r.n) for r in templates.templates(rows, F.lit(1)).collect())


def test_templates_fold(spark, monkeypatch):
    messages = ["GET /users/1 200 12ms", "GET /users/7 200 90ms", "disk full on node 17", "disk full on node 21", "", " ; ", None, "start", "stop", "start", "x" * 30, "naïve; reader, 2024"]
    assert ours(spark, messages) == mined(messages)
    assert ours(spark, []) == []
    # One share folds everything, so that the order of any mix of tokens is the same.
    monkeypatch.setattr(templates, "SALTS", 1)
    rng = random.Random(3)
    noise = [" ".join(rng.choice(["up", "down", "io", "net", "12", "4711", "a1"]) for _ in range(rng.randint(1, 5))) for _ in range(300)]
    assert ours(spark, noise) == mined(noise)


def test_templates_stop_at_their_limit(spark, monkeypatch):
    monkeypatch.setattr(templates, "MAX_TEMPLATES", 1)
    with pytest.raises(Exception, match="too many templates"):
        ours(spark, ["one", "two words", "three more words"])


def test_episodes_do_not_depend_on_blocks(spark):
    rng, seq, rows = random.Random(5), 0, []
    for _ in range(400):
        seq += rng.choice([1, 2, 3, 9, 30])
        rows.append((rng.choice(["a", "b", None]), seq, rng.choice([seq, seq + 4, None])))
    df = spark.createDataFrame([*rows, ("a", None, 1)], "source string, seq long, ts long")
    want, last, number = {}, {}, {}
    for source, s, ts in rows:
        before = last.get(source)
        if before is None or s - before[0] > 8 or (ts is not None and before[1] is not None and abs(ts - before[1]) > 5):
            number[source] = number.get(source, 0) + 1
        low, _, n = want.get((source, number[source]), (s, s, 0))
        want[source, number[source]] = (low, s, n + 1)
        last[source] = (s, ts)
    for block in (1, 7, 50, 100_000):
        got = {(r.source, r.episode): (r.first_seq, r.last_seq, r.n) for r in episodes.episodes(df, ["source"], block=block).collect()}
        assert got == want


def test_budget(spark):
    rows = [("k", i, s, n, e) for i, (s, n, e) in enumerate([(0.9, 900, False), (0.8, 5, True), (0.1, 5, False), (0.8, 5, False), (0.1, 5, False), (None, 5, False)])]
    df = spark.createDataFrame(rows, "key string, i int, score double, length long, echoed boolean")
    got = {r.i: r.decision for r in selection.within_budget(df, "key", ["i"], 600, 3, 0.2).collect()}
    assert got == {0: "selected", 1: "echo_suppressed", 2: "below_min_score", 3: "char_budget", 4: "char_budget", 5: "char_budget"}


def test_writes(spark):
    log = [(1, 1, "a", "write"), (1, 2, "b", "write"), (2, 1, "a", "write"), (2, 2, None, "retract"), (3, 1, "a", "purge"), (3, 2, "b", "write")]
    out = evidence.written(spark.createDataFrame(log, "id int, rev int, value string, deed string"), "id", "rev", "value", "deed")
    assert {r.id: (r.status, r.value, r.revisions) for r in out.collect()} == {1: ("active", "b", 2), 2: ("retracted", None, 2), 3: ("purged", None, 2)}


def test_bookmarks(spark):
    events = spark.createDataFrame([(1, 10), (2, 20)], "seq long, ts long")
    refs = spark.createDataFrame([("a", 1, 10), ("a", 1, 10), ("b", 1, 11), ("c", 9, 90)], "bookmark string, seq long, expected_ts long")
    assert {r.bookmark: (r.n_refs, r.missing, r.status) for r in evidence.resolved(refs, events).collect()} == {"a": (1, 0, "valid"), "b": (1, 0, "stale"), "c": (1, 1, "stale")}
