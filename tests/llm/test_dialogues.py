"""Conversation repair, hard negatives and toxicity against plain Python, and their edges."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import conversations, hard_negatives, queries, toxicity

SF = "/root/testdata/sf0.01"
TURNS = "conv_id long, turn long, role string, text string, audit string, part int"
STATE = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
AIM = {"": "u", "s": "u", "u": "a", "a": "u"}


def damage(rows):
    out = []
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        fate = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(c, t, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def repair(rows):
    """Digest and turns of one conversation, by whole edit strings instead of costs alone."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        ink = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "" if ink[-1] in ".!?" else "truncated")
        seen.add((role, text))
    first = [r[2][:1] for r in rows]
    best = {(len(rows), s): (0, "") for s in ("", "a")}

    def inserted(i):
        for _ in range(3):
            for s in STATE:
                if (i, AIM[s]) in best:
                    cost, edits = best[i, AIM[s]]
                    best[i, s] = min(best.get((i, s), (99**9, "")), (cost + 5, "I" + edits))

    inserted(len(rows))
    for i in reversed(range(len(rows))):
        for s in STATE:
            after = lambda t: best[i + 1, t]  # noqa: E731, B023
            ways = [(after(s)[0] + 2, "D" + after(s)[1])]
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                ways.append((after(AIM[s])[0] + 1 + more, "R" + after(AIM[s])[1]))
                if first[i] in STATE[s]:
                    to = STATE[s][first[i]]
                    ways.append((after(to)[0] + more, "K" + after(to)[1]))
            best[i, s] = min(ways)
        inserted(i)
    cost, edits = best[0, ""]
    turns, s, i = [], "", 0
    for op in edits:
        if op in "IR":
            s = AIM[s]
            turns.append(({"u": "user", "a": "assistant"}[s], rows[i][3] if op == "R" else ""))
        elif op == "K":
            s = first[i]
            turns.append(rows[i][2:])
        i += op != "I"
    times = [t for _, t, _, _ in rows if t is not None]
    told = {k: faults.count(k) for k in ("blank", "duplicate", "truncated")} | {"gaps": max(times) - min(times) + 1 - len(set(times)) if times else 0}
    told |= {"illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), "cost": cost, "audit": edits}
    return told | {"repaired_sha256": hashlib.sha256("\n".join(f"{r}:{x}" for r, x in turns).encode()).hexdigest()}, turns


def by_conversation(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append(r)
    return out


def same(df, want):
    got = {r.conv_id: r.asDict() for r in df.collect()}
    assert set(got) == set(want)
    for c, w in want.items():
        assert {k: got[c][k] for k in w} == w, c


rng = random.Random(11)
ROLES = ["user", "assistant", "system", "tool", "", None, "u2"]
RANDOM = [(c, rng.choice([None, *range(6)]), rng.choice(ROLES), rng.choice(["a.", "b!", "c", "", " ", None, "d?\n", "e. x", "é.", "a."])) for c in [*range(40), None] for _ in range(rng.randrange(14))]
RANDOM += [(99, rng.choice([None, *range(40)]), rng.choice(["user", "assistant", "system", None]), rng.choice(["a.", "b!", "c", " ", *(f"m{i}." for i in range(300))])) for _ in range(400)]
RANDOM += [(77, 5, "user", "same.")] * 50 + [(78, 1, "user", "x" * 200_000 + ".")]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame([(*r, "clash", 1) for r in RANDOM], TURNS)


def test_conversations_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    left = by_conversation(damage(rows))
    same(queries.op11_conversation_repair(spark, SF), {c: repair(left[c])[0] for c in {r[0] for r in rows}})


@pytest.mark.parametrize("piece_rows", [1, 7, conversations.PIECE_ROWS])
def test_conversations_in_pieces(spark, turns, piece_rows):
    keep = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        whole = by_conversation([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in RANDOM])
        want = {c: repair(rows) for c, rows in whole.items()}
        same(conversations.repaired_conversations(turns, piece_rows), {c: w[0] for c, w in want.items()})
        got = defaultdict(list)
        for r in conversations.repaired_turns(turns, piece_rows).orderBy("conv_id", "place").collect():
            assert r.place == len(got[r.conv_id])
            got[r.conv_id].append((r.role, r.text))
        assert got == {c: w[1] for c, w in want.items() if w[1]}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", keep)


def test_conversations_that_lose_all_turns(spark, turns):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "a.")]
    same(conversations.damaged_and_repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), {gone: repair([])[0]})
    assert conversations.damaged_and_repaired(turns.limit(0)).count() == 0
    assert conversations.repaired_turns(turns.limit(0)).count() == 0


def mined(rows, anchors, k=5):
    """rows of (vec_id, vector, label); anchors is a condition on vec_id."""
    rows = [(v, [math.floor(256 * x) for x in e], y) for v, e, y in rows if None not in (v, e, y) and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for a in rows:
        if not anchors(a[0]):
            continue
        scored = sorted((-sum(p * q for p, q in zip(a[1], b[1])), b[0], b[2] == a[2]) for b in rows if b is not a and len(b[1]) == len(a[1]))
        for p, pid, _ in [s for s in scored if s[2]][:k]:
            fits = [s for s in scored if not s[2] and 80 * -p <= 100 * -s[0] <= 100 * -p]
            out += [(a[0], pid, i + 1, n, -p, -s) for i, (s, n, _) in enumerate(fits[:k])]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_negatives_against_all_pairs(spark, small, monkeypatch):
    if small:
        monkeypatch.setattr(hard_negatives, "SHARD_ROWS", 16)
        monkeypatch.setattr(hard_negatives, "BLOCK", 8)
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(12, 6))
    rows = []
    for i in range(600):
        v = (centres[i % 12] + 0.2 * draw.normal(size=6)).tolist()
        rows.append((i, [0.5] * 6 if i % 3 == 0 else v, int(draw.integers(3))))  # a third are one vector: ties
    rows += [(None, [1.0] * 6, 1), (700, None, 1), (701, [1.0, None, 1.0], 1), (702, [math.nan] * 6, 1), (703, [math.inf] * 6, 1), (704, [0.0] * 6, 1), (705, [1.0, 2.0], 1), (710, [1.0, 2.0], 1), (720, [1.0, 1.9], 2), (730, [1.0] * 6, None), (710, [1.0, 2.0], 1), (740, [], 1), (750, [], 1), (751, [], 2)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, rid int, q string")
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect())
    assert got == mined(rows, lambda v: v % 10 == 0) and len(got) > 500
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_large_components_score_exactly(spark):
    rows = [(i, [float(2**17 + i), -float(2**17 - 3 * i), 1e300 if i == 9 else 0.5], i % 2) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 2 == 0).collect()) == mined([r for r in rows if r[0] != 9], lambda v: v % 2 == 0)


def test_toxic_documents_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    found = toxicity.toxicity(docs, labels)
    held = found.join(labels, "doc_id").where("held_out and toxic in (0, 1)").toPandas()
    recall, alarms = held[held.toxic == 1].predicted.mean(), held[held.toxic == 0].predicted.mean()
    assert recall >= 0.85 and alarms <= 0.02, (recall, alarms)
    r = found.where("offending <> ''").join(docs, "doc_id").select("text", "offending").first()
    for span in r.offending.split(","):
        a, b = map(int, span.split(":"))
        assert 0 <= a < b <= len(r.text) and (b == len(r.text) or r.text[b - 1] in ".!?\n")


def test_toxic_scores_by_hand(spark):
    schema = "doc_id long, text string, score double, found string, pairs int"
    bad, good = "You are an idiot, sir. A fine day!", "A fine day. You are well, dear sir."
    rows = [(i, (bad if i % 2 else good) + f" Number {i}.", 1.0, "x", 1) for i in range(400)] + [(500, None, None, None, None), (501, "", None, None, None), (None, bad, None, None, None), (503, "idiot " * 50_000, None, None, None), (504, "Ünïcode é.\nidiot é! ok", None, None, None), (504, "again", None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        by_id[r.doc_id].append(r)
    assert all(by_id[i][0].predicted == i % 2 for i in range(400))
    assert by_id[500][0].score == by_id[501][0].score < 0.1 and by_id[503][0].predicted == 1
    assert [by_id[1][0].offending] == ["0:22"] and sorted(r.offending for r in by_id[504]) == ["", "11:19"]
    found = toxicity.offending_sentences(docs.where("doc_id = 504"), labels)
    assert found.count() == 0  # nothing is learned from the labels of other documents
    assert toxicity.toxicity(docs, labels.limit(0)).select("score").distinct().count() == 1
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_noisy_or_slope():
    draw = np.random.default_rng(5)
    pairs = [np.sort(draw.integers(0, 3, 4) * (1 << 16) + draw.integers(0, 5, 4)) for _ in range(60)]
    pairs = [np.unique(p) for p in pairs]
    toxic = draw.integers(0, 2, 60)

    def loss(w, bias, clean):
        total = 0.0
        for y, p in zip(toxic, pairs):
            z = defaultdict(float)
            for x in p:
                z[x >> 16] += w[x % (1 << 16)]
            spared = clean - sum(np.logaddexp(0, bias + v) for v in z.values())
            total -= math.log(-math.expm1(spared)) if y else spared
        return total + 0.5 * (w @ w)

    w, bias, clean = toxicity.fit(toxic, pairs, 5, rounds=4000, rate=0.01, ridge=1.0)
    least = loss(w, bias, clean)
    for i in range(5):
        for step in (-0.05, 0.05):
            moved = w.copy()
            moved[i] += step
            assert loss(moved, bias, clean) >= least - 1e-3
