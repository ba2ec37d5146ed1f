"""Renderings, chains and matchings against plain Python and hand-made cases."""

import itertools
import random
import time

import pandas as pd
import pyarrow as pa
import pytest

from tidelog.operators import exceptions, graphs, long_chains, matchings, renderings

SCHEMA = "seq long, source string, ts long, wall boolean, message string, service string, host string, trace_id string"
FULL = "boom\njava.lang.IllegalStateException: q\n\tat a.b(C.java:5)"


def events(spark, rows):
    return spark.createDataFrame([(s, src, ts, True, m, None, None, None) for s, src, ts, m in rows], SCHEMA)


def found(spark, rows):
    return sorted(((r.kind, r.source, r.thread, r.first_seq, r.last_seq, r.records, r.signature) for r in renderings.renderings(events(spark, rows)).collect()), key=str)


LINES = {
    "header": "[stderr] (%s) app.JobException: job 7", "other": "[stderr] (%s) java.io.IOException: x", "frame": "[stderr] (%s) at a.B(C.java:1)", "cause": "[stderr] (%s) Caused by: java.net.TimeoutException: after 5 ms",
    "scaffold": "[stderr] (%s) Exception in thread wrapper", "text": "[stderr] (%s) hello", "full": FULL, "plain": "nothing of note", "malformed": "[stderr] (!!) at a.B(C.java:1)", "broken": "[stderr] (!!) app.JobException: job 7",
}
SIGNATURE = {"header": "app.jobexception: job <*>", "other": "java.io.ioexception: x", "cause": "java.net.timeoutexception: after <*> ms", "full": "java.lang.illegalstateexception: q", "broken": "app.jobexception: job <*>"}


def plain(rows):
    """rows of (seq, source, ts, kind, thread); a lane keeps its open rendering as a list."""
    lanes, out = {}, []

    def close(source, thread=...):
        for key in [k for k in lanes if k[0] == source and thread in (..., k[1])]:
            r = lanes.pop(key)
            out.append(("wrapped", *key, r["rows"][0], r["rows"][-1], len(r["rows"]), r["signature"]))

    for seq, source, ts, kind, thread in sorted(rows):
        lane = lanes.get((source, thread))
        near = lane and seq - lane["rows"][-1] <= 8 and abs(ts - lane["ts"]) <= 5
        if kind in ("full", "plain", "malformed", "broken"):
            close(source)
            if kind in ("full", "broken"):
                out.append(("full" if kind == "full" else "wrapped", source, None, seq, seq, 1, SIGNATURE[kind]))
        elif kind in ("header", "other") or kind == "cause" and not near:
            close(source, thread)
            lanes[source, thread] = {"rows": [seq], "ts": ts, "signature": SIGNATURE[kind]}
        elif near and kind != "text":
            if len(lane["rows"]) < 400:
                lane["rows"].append(seq)
                lane["ts"] = ts
            lane["signature"] = SIGNATURE.get(kind, lane["signature"])
    for source in {k[0] for k in lanes}:
        close(source)
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_lanes_of_random_records(spark, seed):
    rng = random.Random(seed)
    rows, ts = [], 0
    kinds = ["header", "other", "cause", "scaffold", "text"] + ["frame"] * 6 + ["full", "plain", "malformed", "broken"] * (seed == 1)
    for seq in range(3000):
        ts += rng.choice([0, 0, 0, 1, 7]) if rng.random() < 0.3 else 0
        if rng.random() < 0.9:
            rows.append((seq * rng.choice([1]) + (seq // 500) * 6000, rng.choice("ab"), ts + rng.choice([0, 0, -3]), rng.choice(kinds), rng.choice(["t1", "t2"])))
    made = [(s, src, t, LINES[k] % th if "%s" in LINES[k] else LINES[k]) for s, src, t, k, th in rows]
    assert found(spark, made) == plain(rows)


def test_records_beyond_the_bounds(spark):
    rows = [(i, "a", 0, LINES["frame"] % "t") for i in range(1, 450)]
    (r,) = renderings.renderings(events(spark, [(0, "a", 0, LINES["header"] % "t"), *rows])).collect()
    assert (r.records, r.complete, r.last_seq) == (400, False, 399)
    (r,) = renderings.renderings(events(spark, [(0, "a", 0, LINES["header"] % "t"), (1, "a", 0, "[stderr] (t) at " + "x" * 9000)])).collect()
    assert len(r.payload) == 8192 and r.records == 2
    assert renderings.renderings(events(spark, [(None, "a", 0, FULL), (1, None, 0, FULL), (2, "a", 0, None)])).count() == 0


def rendering(i, ts=0, site="s", types=("R",), signature="r: x", **more):
    return {"id": i, "signature": signature, "source": "a", "service": None, "host": None, "trace": None, "request": None, "thread": None, "first_seq": i, "first_ts": ts, "last_ts": ts, "wall": True, "conflict": False, "types": list(types), "site": site} | more


def chain_of(rows):
    got = renderings.grow(pd.DataFrame(rows))
    return {c: list(g.sort_values("place")["id"]) for c, g in got.groupby("chain")}


def test_chain_rules():
    r = rendering
    assert chain_of([r(1, trace="t", site="a"), r(2, trace="t", site="b", types=("O", "R"), signature="o: y"), r(3, trace="u", site="c")]) == {1: [1, 2], 3: [3]}
    # A shared trace with a site twice is withheld.
    assert chain_of([r(1, trace="t", site="a"), r(2, trace="t", site="b"), r(3, trace="t", site="a")]) == {1: [1], 2: [2], 3: [3]}
    # A thread joins two, but not where a third could claim the same.
    assert chain_of([r(1, thread="t", site="a"), r(2, 3, thread="t", site="b")]) == {1: [1, 2]}
    assert chain_of([r(1, thread="t", site="a"), r(2, 1, thread="t", site="b"), r(3, 2, thread="t", site="c")]) == {1: [1], 2: [2, 3]}
    # No member may be in conflict: the host of the third differs from the second's.
    assert chain_of([r(1, trace="t", site="a"), r(2, trace="t", site="b", host="x"), r(3, trace="t", site="c", host="y")]) == {1: [1, 2], 3: [3]}
    # The span of a timed chain is bounded; order alone needs a shared trace.
    assert chain_of([r(1, 0, trace="t", site="a"), r(2, 4, trace="t", site="b"), r(3, 8, trace="t", site="c")]) == {1: [1, 2], 3: [3]}
    assert chain_of([r(1, thread="t", site="a", wall=False), r(2, thread="t", site="b", wall=False)]) == {1: [1], 2: [2]}
    assert chain_of([r(1, trace="t", site="a", wall=False), r(2, 99, trace="t", site="b", wall=False)]) == {1: [1, 2]}
    # Types must end alike, or signatures agree.
    assert chain_of([r(1, trace="t", site="a"), r(2, trace="t", site="b", types=("Q",), signature="q: x")]) == {1: [1], 2: [2]}


def test_chains_of_components_as_of_all(spark):
    rng = random.Random(3)
    stack = lambda k, t: f"x\njava.io.{t}Exception: q\n\tat a.B{k}(C.java:5)"
    rows = [(i, "ab"[i % 2], i // 3 * 2, i % 5 != 0, stack(rng.randrange(9), rng.choice("PQ")), None, None, rng.choice([None, f"t{i // 6}"])) for i in range(300)]
    rows = [(s, src, ts, w, m if i % 3 else m.replace("x\n", f"x thread=w{i % 4}\n"), *rest) for i, (s, src, ts, w, m, *rest) in enumerate(rows)]
    full = renderings.renderings(spark.createDataFrame(rows, SCHEMA))
    got = sorted(tuple(r) for r in renderings.chains(full).collect())
    assert len(got) == 300 and {x[3] for x in got} >= {"seed", "anchor"}
    local = []
    for r in full.collect():
        kind = r.payload.split("\n")[1].split(":")[0]
        local.append(rendering(r.id, r.first_ts, r.payload.split("at ")[-1].split("(")[0], (kind,), r.signature, source=r.source, trace=r.trace, thread=r.thread, wall=r.wall))
    assert got == sorted(map(tuple, renderings.grow(pd.DataFrame(local)).itertuples(index=False)))
    assert {r.link for r in renderings.chains(full, 2).collect()} >= {"too_large"}


def test_chains_of_a_large_component(spark):
    """One thread of 2,600 renderings and one trace of 2,300 more, in two components, as bit sets on all of them."""
    rng = random.Random(6)
    rows = [(i, "a", i // 2, True, f"x thread=w\njava.io.PException: q\n\tat a.B{rng.randrange(60)}(C.java:5)", None, rng.choice([None, None, "h"]), rng.choice([None, f"t{i // 4}"])) for i in range(2600)]
    rows += [(i, "b", i, i % 2 == 0, f"x\njava.io.QException: q\n\tat a.B{i}(C.java:5)", None, rng.choice("gh"), "u") for i in range(3000, 5300)]
    full = renderings.renderings(spark.createDataFrame(rows, SCHEMA))
    got = sorted(tuple(r) for r in renderings.chains(full).collect())
    local = []
    for r in full.collect():
        kind = r.payload.split("\n")[1].split(":")[0]
        local.append(rendering(r.id, r.first_ts, r.payload.split("at ")[-1].split("(")[0], (kind,), r.signature, source=r.source, host=r.host, trace=r.trace, thread=r.thread, wall=r.wall))
    assert got == sorted(map(tuple, renderings.grow(pd.DataFrame(local)).itertuples(index=False)))
    assert {x[3] for x in got} == {"seed", "anchor", "thread"} and max(x[2] for x in got) > 500


def test_large_components_as_bit_sets():
    """Renderings with all kinds of keys, gaps, spans and conflicts, cut into batches anywhere."""
    texts = ("signature", "source", "service", "host", "trace", "request", "thread", "site")
    schema = pa.schema([(c, pa.string()) for c in texts] + [(c, pa.int64()) for c in ("id", "first_seq", "first_ts", "last_ts")] + [("wall", pa.bool_()), ("conflict", pa.bool_()), ("types", pa.list_(pa.string()))])
    joined = set()
    for seed in range(150):
        rng = random.Random(seed)
        some = lambda name, share, of: f"{name}{rng.randrange(of)}" if rng.random() < share else None
        n, seconds, clocks, own, threads, traces, hosts = rng.choice([8, 40, 150]), rng.choice([1, 30, 200]), rng.choice([0, 0.5, 0.95]), rng.choice([0, 0.5]), rng.choice([1, 3, 30]), rng.choice([1, 5, 30]), rng.choice([0, 0.1, 0.8])
        rows = []
        for i in range(n):
            ts = rng.randrange(seconds) - 20
            rows.append(
                rendering(
                    i, ts, f"render:{i}" if rng.random() < own else some("p", 0.98, 5), rng.choice([("A",), ("A",), ("B", "A"), ("C", "B", "A"), ("D",)]), some("s", 0.97, 4), source=some("f", 0.97, 3), service=some("v", hosts / 3, 2), host=some("h", hosts, 2), trace=some("t", rng.random(), traces),
                    request=some("r", rng.random() / 2, traces), thread=some("w", rng.random(), threads), first_ts=ts if rng.random() < 0.97 else None, last_ts=ts + rng.choice([0, 0, 0, -3, 2, 9]), wall=rng.random() < clocks or None, conflict=rng.random() < 0.03,
                )
            )
        cut = rng.randrange(n)
        parts = [pa.RecordBatch.from_pylist(some_rows, schema) for some_rows in (rows[:cut], rows[cut:])]
        want = list(renderings._grown_chains(rows))
        assert list(long_chains.grown(parts, renderings.CHAIN_SPAN)) == want, seed
        joined.update((x[3], x[4]) for x in want)
    assert len(joined) == 6


def test_a_large_component_takes_little_time():
    """A thread of 30,000 renderings with 10,000 in a second, each of its own site: bit sets would take 30,000 times 30,000 bits."""
    schema = pa.schema([(c, pa.string()) for c in ("signature", "source", "service", "host", "trace", "request", "thread", "site")] + [(c, pa.int64()) for c in ("id", "first_seq", "first_ts", "last_ts")] + [("wall", pa.bool_()), ("conflict", pa.bool_()), ("types", pa.list_(pa.string()))])
    began = time.time()
    got = list(long_chains.grown([pa.RecordBatch.from_pylist([rendering(i, i // 10_000, f"p{i}", thread="w") for i in range(30_000)], schema)], renderings.CHAIN_SPAN))
    # Each row but the last two has two others that could claim the next.
    assert [x[1] for x in got] == [*range(29_999), 29_998] and got[-1][2:] == (1, "thread", False)
    assert sum(x[4] for x in got) == 29_998 and time.time() - began < 20


def largest(pairs):
    best, found = 0, []
    for k in range(len(pairs), -1, -1):
        for some in itertools.combinations(pairs, k):
            if len({a for a, _ in some}) == k == len({b for _, b in some}):
                found.append(set(some))
                best = k
        if found:
            break
    return set.intersection(*found) if found and best else set()


def test_forced_pairs():
    rng = random.Random(4)
    for _ in range(200):
        pairs = sorted({(rng.randrange(4), rng.randrange(4)) for _ in range(rng.randrange(1, 8))})
        assert graphs.forced(pairs) == largest(pairs), pairs


def test_forced_pairs_of_a_long_path_take_little_time():
    """A path of 9,999 pairs has one largest matching; with one more left side, or closed to a ring, it has several."""
    path = [(i, i) for i in range(5000)] + [(i + 1, i) for i in range(4999)]
    began = time.time()
    assert graphs.forced(path + [(5000, 4999)]) == set()
    assert graphs.forced(path) == {(i, i) for i in range(5000)}
    assert graphs.forced(path + [(0, 4999)]) == set()
    assert time.time() - began < 20


def test_near_renderings_meet_once(spark):
    """Spans of a second to years against all pairs; one that is in time for its thread or has no key at all pairs with its like, another does not."""
    rng = random.Random(8)
    made = []
    for i in range(300):
        first = rng.randrange(-3000, 60_000)
        made.append((i, rng.choice(["full", "wrapped"]), rng.choice("xy"), f"s{i}", rng.choice([None, "r"]) if i % 4 == 0 else None, rng.choice([None, None, "t1", "t2"]), i, i, None if i % 50 == 7 else first, None if i % 50 == 9 else first + rng.choice([0, 3, 59, 61, 900, 7000, 10**8 if i % 60 == 0 else 5]), rng.random() < 0.9))
    rows = spark.createDataFrame(made, "id long, kind string, signature string, source string, request string, thread string, first_seq long, last_seq long, first_ts long, last_ts long, wall boolean")
    rows = rows.selectExpr("*", "cast(null as string) service", "cast(null as string) host", "cast(null as string) trace", "false conflict")
    want = set()
    for a in made:
        for b in made:
            if (a[1], b[1]) != ("full", "wrapped") or a[2] != b[2]:
                continue
            near = a[10] and b[10] and None not in (*a[8:10], *b[8:10]) and max(0, b[8] - a[9], a[8] - b[9]) <= 2
            anchor = a[4] is not None and a[4] == b[4]
            if a[5] and b[5] and a[5] != b[5] and not anchor:
                continue
            if anchor and (near or not (a[10] and b[10])) or near and (a[5] and a[5] == b[5]):
                want.add((a[0], b[0], "strong"))
            elif near and not (a[4] or b[4] or a[5] or b[5]):
                want.add((a[0], b[0], "moderate"))
    known = {i[0] for i in made if None not in i[8:10]}
    got = [tuple(r) for r in exceptions.candidates(rows).collect() if r[0] in known and r[1] in known]
    assert len(got) == len(set(got)) and set(got) == {w for w in want if w[0] in known and w[1] in known} and len(want) > 100


def test_matching_resolves_a_tie(spark):
    rows = [(1, 10), (1, 11), (2, 11), (5, 50), (5, 51), (None, 3), (1, 10)]
    got = {(r.left, r.right): r.status for r in graphs.matched(spark.createDataFrame(rows, "left long, right long")).collect()}
    assert got == {(1, 10): "paired", (1, 11): "ruled_out", (2, 11): "paired", (5, 50): "ambiguous", (5, 51): "ambiguous"}
    assert {r.status for r in graphs.matched(spark.createDataFrame(rows, "left long, right long"), 1).collect()} == {"too_large"}


def test_matching_of_a_large_component(spark):
    """22,653 pairs: 301 needs 600, so 300 needs 0, and 150 left sides are free to choose among 150 others. In one task and by rounds."""
    rows = [(a, b) for a in range(150) for b in range(151)] + [(300, 600), (300, 0), (301, 600)]
    want = {(a, b): "ambiguous" if b else "ruled_out" for a, b in rows} | {(300, 600): "ruled_out", (300, 0): "paired", (301, 600): "paired"}
    pairs = spark.createDataFrame(rows, "left long, right long")
    assert {(r.left, r.right): r.status for r in graphs.matched(pairs).collect()} == want
    assert {(r.left, r.right): r.status for r in graphs.matched(pairs, at_once=20_000).collect()} == want


def test_matching_by_rounds(spark):
    """Many small graphs as one, with free sides on the left, the right or neither."""
    rng = random.Random(7)
    pairs = set()
    for c in range(0, 6000, 100):
        n = rng.randrange(2, 12)
        m = max(1, n + rng.choice([-1, 0, 0, 0, 1]))
        pairs |= {(c + i, c + i) for i in range(min(n, m)) if rng.random() < 0.9}
        pairs |= {(c + rng.randrange(n), c + rng.randrange(m)) for _ in range(int(n * rng.choice([0.5, 1, 2])))}
    got = {(r.left, r.right): r.status for r in matchings.settled(spark.createDataFrame(sorted(pairs), "left long, right long")).collect()}
    sure = graphs.forced(sorted(pairs))
    lefts, rights = {a for a, _ in sure}, {b for _, b in sure}
    assert got == {(a, b): "paired" if (a, b) in sure else "ruled_out" if a in lefts or b in rights else "ambiguous" for a, b in pairs}
    assert len(set(got.values())) == 3


def test_rings(spark):
    """Two rings with a way between them, a chord, and ways in and out."""
    arcs = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 7), (7, 5), (6, 5), (0, 1), (7, 8), (8, 9)]
    assert {r.node for r in matchings.on_rings(spark.createDataFrame(arcs, "u long, v long")).collect()} == {1, 2, 3, 5, 6, 7}


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)] + [(None, 1), (7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    assert {r.node: r.component for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()} == {x: root(x) for x in parent}


def test_small_components_take_little_time():
    """20,000 components of three rows; a row without a time has no clock and joins by a shared trace only."""
    began = time.time()
    for i in range(20_000):
        rows = [rendering(i + k, k, trace="t", site=str(k)) for k in range(3)]
        assert [x[1] for x in renderings._grown_chains(rows)] == [i] * 3
    assert time.time() - began < 20
    r = rendering
    assert chain_of([r(1, trace="t", site="a"), r(2, None, trace="t", site="b"), r(3, None, thread="w", site="c"), r(4, None, thread="w", site="d")]) == {1: [1, 2], 3: [3], 4: [4]}


def test_records_are_told_once(spark):
    """What a record is, is not worked out again for a filter before the table."""
    plan = renderings._told(events(spark, [(1, "a", 0, FULL)]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Exception wrapper") == 1
