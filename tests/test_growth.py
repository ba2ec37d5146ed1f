"""Results and costs on tables larger or more lopsided than the given ones."""

import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelog import shared
from tidelog.functions import text
from tidelog.operators import evidence, incidents, retrieval, vector_graph
from tidelog.sources import framing, grammars


def test_secrets_in_long_runs_take_time_in_proportion(spark):
    run = "-" * 300_000
    texts = [f"my token {run} end", f"{run}api_key= abcdefgh12 {run}", "x-secret-token: 'abcdefghij'; a=b", "no word of it"]
    began = time.time()
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.secret_classes(F.col("t")).alias("c"), text.redacted(F.col("t")).alias("r")).orderBy("i").collect()
    assert time.time() - began < 60
    assert [r["c"] for r in rows] == [[], ["ASSIGNMENT"], ["ASSIGNMENT"], []]
    assert [r["r"] for r in rows] == [texts[0], f"{run}api_key= [REDACTED:ASSIGNMENT] {run}", "x-secret-token: '[REDACTED:ASSIGNMENT]'; a=b", texts[3]]


def test_hints_leave_no_secret_out(spark):
    samples = {
        "PRIVATE_KEY": "-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----", "JWT": "eyJabcdefgh.abcdefgh.abcd", "AWS_KEY": "ASIA0123456789ABCDEF", "AWS_SECRET": "Aws_Secret_Access_KEY = " + "a" * 30,
        "GITHUB_TOKEN": "ghr_" + "a" * 20, "API_KEY": "xai-" + "a" * 16, "BEARER": "bEARER abcdefghijkl", "URL_CREDENTIALS": "ftp://a:b@c", "ASSIGNMENT": "_My-PassPhrase\t:\tabcdefgh",
    }
    plain = F.col("t")
    for name, pattern in text.SECRETS:
        plain = F.regexp_replace(plain, pattern, f"$1[REDACTED:{name}]{text.AFTER.get(name, '')}")
    made = [(n, f"{before}{s}{behind}") for n, s in samples.items() for before in ("", "- ", "--", "é", "x=") for behind in ("", " and " + s, "\n")]
    for r in spark.createDataFrame(made, "n string, t string").select("n", "t", plain.alias("plain"), text._replaced(F.col("t"), text.AFTER).alias("r"), text.secret_classes(F.col("t")).alias("c")).collect():
        assert r["r"] == r["plain"] and (r["n"] in r["c"]) == (f"REDACTED:{r['n']}" in r["plain"] or r["n"] in r["c"]), r


def test_nearest_vectors_by_tiles(spark, monkeypatch):
    """Ties, own rows, other dimensions and more queries than a tile, against all pairs."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 4 if i % 11 else 3).astype(float).tolist()) for i in range(400)]
    monkeypatch.setattr(retrieval, "TILE", (7, 16))
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    ours = {}
    for r in retrieval.nearest_vectors(made, made.where("vec_id % 3 = 0"), 6).orderBy("query_id", "rank").collect():
        ours.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v in rows}
    for q, v in rows[::3]:
        all_ = sorted((-round(float(unit[q] @ unit[i]), 6), i) for i, w in rows if i != q and len(w) == len(v))
        assert ours.get(q, []) == [(i, -s) for s, i in all_ if s < 0][:6]


def test_nearest_vectors_hold_a_tile_at_a_time():
    """4,096 queries against one batch of 10,000 vectors stay below 200 MB; the whole product alone takes 328 MB."""
    rng = np.random.default_rng(4)
    asked = [{"vec_id": i, "embedding": v} for i, v in enumerate(rng.normal(size=(4096, 8)).tolist())]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.array(rng.normal(size=(10_000, 8)).tolist())], names=["vec_id", "embedding"])
    run = retrieval._nearest(asked, 10)
    tracemalloc.start()
    n = sum(b.num_rows for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 40_960 and peak < 200e6


def test_keyword_scores_by_blocks_of_queries(spark, monkeypatch):
    """More queries than a block and texts than a matrix, against plain sums; no task gathers more than the best of each query."""
    monkeypatch.setattr(retrieval, "QUERIES_SCORED", 3)
    monkeypatch.setattr(retrieval, "CELLS", 40)
    words = [f"w{i}" for i in range(12)]
    rng = np.random.default_rng(5)
    texts = [(i, " ".join(rng.choice(words, rng.integers(1, 9)))) for i in range(150)] + [(None, "w1 w2"), (200, None)]
    asked = [(i, " ".join(rng.choice(words, 3)) + " unseen") for i in range(10)] + [(11, "nothing")]
    docs, queries = spark.createDataFrame(texts, "doc_id int, text string").repartition(5), spark.createDataFrame(asked, "item_id long, text string")
    df = {w: sum(w in (t or "").split() for _, t in texts) for w in words}
    expected = set()
    for q, text_ in asked:
        terms = set(text_.split()) & set(words)
        sums = [(-round(sum(1 + np.log(len(texts) / (1 + df[w])) for w in terms & set((t or "").split())), 6), -1 if i is None else i) for i, t in texts if terms & set((t or "").split())]
        expected |= {(q, i, n + 1, -s) for n, (s, i) in enumerate(sorted(sums)[:7])}
    found = retrieval.tfidf(docs, "doc_id", queries, "item_id", 7)
    assert {(r["query_id"], -1 if r["doc_id"] is None else r["doc_id"], r["rank"], r["score"]) for r in found.collect()} == expected
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString().replace("Join Inner, (query#", "")


def test_correlation_makes_no_row_a_focus_second(spark):
    """Against all pairs; events meet at most one row of the buckets beside theirs."""
    rng = np.random.default_rng(6)
    rows = [(i, int(t), int(k)) for i, (t, k) in enumerate(zip(rng.integers(0, 400, 600), rng.integers(0, 9, 600)))] + [(600, None, 1), (601, 5, None), (602, 5000, 3)]
    focus = sorted({t for _, t, k in rows if k in (2, 5) and t is not None and t % 50 < 20})
    rows = [r for r in rows if r[2] not in (2, 5) or r[1] in focus]
    votes: dict = {}
    for _, t, k in rows:
        near = sorted((abs(t - f), f) for f in focus if abs(t - f) <= 10) if t is not None and k is not None and k not in (2, 5) else []
        if near:
            votes.setdefault(k, []).append(1 if t < near[0][1] else -1)
    found = incidents.correlate(spark.createDataFrame(rows + rows[:9], "seq long, ts long, template_id long"), [2, 5], 10, 50)
    assert {(r["template_id"], r["n"], r["precedes"]) for r in found.collect()} == {(k, len(v), sum(v) > 0) for k, v in votes.items()}
    assert "Generate explode" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_repeated_references_go_in_tasks_of_their_own(spark):
    """Not in those of a join by seq, which are few for many rows."""
    rows = spark.createDataFrame([(b, s, s + b % 2) for b in range(6) for s in (1, 2, 2, 9)], "bookmark long, seq long, expected_ts long")
    known = spark.createDataFrame([(1, 1), (2, 2)], "seq long, ts long")
    found = evidence.resolved(rows.join(known.select("seq"), "seq", "left"), known)
    assert {tuple(r) for r in found.collect()} == {(b, 3, 1, 0 if b % 2 else 2, "stale") for b in range(6)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [bookmark" in plan and plan.index("RepartitionByExpression [bookmark") > plan.index("Aggregate [bookmark")


def test_an_assignment_is_looked_for_where_one_ends(spark):
    """A name without a long value behind it is no reason to try the pattern."""
    t = F.col("t")
    rows = spark.createDataFrame([("x-api-key: Basic q",), ("X-Api-Key: 'Basic123",), ("token",)], "t string")
    assert [r[0] for r in rows.select(text._may_hold("ASSIGNMENT", t, F.lower(t))).collect()] == [False, True, False]


def test_lines_are_dealt_before_they_are_told(spark, monkeypatch):
    """Framing and grammars work on lines behind the exchange, so that a file read by one task is no bound, and ranges are found from bare lines."""
    rows = spark.createDataFrame([("a", i, "x") for i in range(9)], "source string, line_no long, line string")
    made = []
    monkeypatch.setattr(framing, "kept", lambda df, path: made.append(df) or shared.kept(df, path))
    assert framing.framed(rows, 4).count() == 9
    g = grammars.LineGrammar("g", 1, ("year", "=-", "month", "=-", "day", "= ", "hour", "=:", "minute"), ("space", "message"))
    for plan, mark in ((made[0], "stack backtrace"), (grammars._marked(rows, g), "(?<year>")):
        told = plan._jdf.queryExecution().optimizedPlan().toString()
        assert "Repartition" in told and mark in told and mark not in told[told.rindex("Repartition") :]
    assert grammars.selected(rows, [g]).first()["outcome"] == "no_match"


def test_graphs_hold_a_block_at_a_time():
    """A shard of 8,192 vectors is built in less than 80 MB beside its batch; three blocks of 1,024 rows against all take 200 MB."""
    x = np.random.default_rng(5).normal(size=(8192, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(8192, np.int32)), pa.array(np.arange(8192)), pa.array(x.tolist())], names=["shard", "vec_id", "embedding"])
    tracemalloc.start()
    (built,) = vector_graph._built(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert built.num_rows == 8192 and peak < 80_000_000, peak


def test_graphs_refuse_two_dimensions():
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(2, np.int32)), pa.array([1, 2]), pa.array([[1.0, 0.0], [1.0, 0.0, 0.0, 0.0]])], names=["shard", "vec_id", "embedding"])
    with pytest.raises(ValueError):
        list(vector_graph._built(iter([batch])))
