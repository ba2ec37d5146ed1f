"""Clusters, chunks, groups of rolled files and reranking on small cases and against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import exceptions, ranking, rules
from tidelog.sources import archives, documents


def bags(a, b):
    from collections import Counter

    x, y = Counter(a.lower().split()), Counter(b.lower().split())
    return sum((x & y).values()) / sum((x | y).values()) if x or y else 1.0


def test_clusters(spark):
    import math

    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("disk net io cpu mem up down slow".split()) for _ in range(rng.randint(0, 4))), rng.randint(0, 5), rng.randint(1, 90)) for i in range(60)]
    score = lambda s, n: s * math.log1p(n) * (1.5 if n <= 2 else 1.0)
    ordered = sorted(rows, key=lambda r: (-score(r[2], r[3]), -r[2], -r[3], r[0]))
    want = []
    for r in ordered:
        home = next((c for c in want if bags(r[1], c[0][1]) >= 0.4), None)
        want.append([r]) if home is None else home.append(r)
    expected = {",".join(map(str, sorted(r[0] for r in c))): (c[0][1], sum(r[3] for r in c), max(r[2] for r in c)) for c in want}
    df = spark.createDataFrame(rows, "template_id long, pattern string, severity int, n long")
    got = ranking.clusters(df, 512).collect()
    assert {r.template_ids: (r.label, r.n, r.severity) for r in got} == expected
    assert {(r.considered, r.available) for r in got} == {(60, 60)}
    assert ranking.clusters(df.where("false"), 5).count() == 0


def test_clusters_keep_severe_ones_beyond_their_number(spark):
    rows = [(i, f"word{i}", 1, 1000 - i % 7) for i in range(600)] + [(900, "rare", 5, 1)]
    df = spark.createDataFrame(rows, "template_id long, pattern string, severity int, n long")
    got = ranking.clusters(df, 600).collect()
    assert len(got) == 512 and any(r.template_ids == "900" for r in got) and got[0].available == 601


def test_chunks(spark):
    text = "\n".join(["# head", "x" * 1500, "", "y" * 1500, "z" * 3000, "end"])
    files = [("a", text), ("b", None), ("c", ""), ("d", " \n \n"), ("e", "one"), ("f", "one\r\ntwo\n")]
    got = {}
    for r in documents.chunks(spark.createDataFrame(files, "path string, text string")).collect():
        got.setdefault(r.path, []).append((r.start_line, r.end_line, r.text))
    lines = text.split("\n")
    assert set(got) == {"a", "e", "f"} and got["e"] == [(1, 1, "one")] and got["f"] == [(1, 2, "one\ntwo")]
    assert got["a"][0][:2] == (1, 3) and got["a"][-1][1] == 6
    assert all(b == "\n".join(lines[s - 1 : e]) for s, e, b in got["a"])
    assert set(range(1, 7)) == {n for s, e, _ in got["a"] for n in range(s, e + 1)}


def test_long_texts_are_covered_by_chunks():
    rng = random.Random(2)
    lines = [rng.choice(["", "# t", "w" * rng.randint(1, 900)]) for _ in range(400)]
    found = list(documents._chunked("\n".join(lines)))
    for (s, e, body), after in zip(found, [*found[1:], (None, None, None)], strict=True):
        assert body == "\n".join(lines[s - 1 : e]) and (len(body) <= 2400 or s == e)
        assert after[0] is None or s < after[0] <= e + 1
    assert found[-1][1] == len(lines) or not "".join(lines[found[-1][1] :]).strip()


def test_path_patterns():
    import re

    hit = lambda p, i: bool(re.search(documents.path_pattern(p), "/" + i))
    assert hit("a/**", "a") and hit("a/**", "a/b/c") and hit("**/x.log", "x.log") and hit("**/x.log", "q/r/x.log") and hit("a/?.log", "a/b.log")
    assert not hit("a/*", "a/b/c") and not hit("a/*.log", "a/bXlog") and not hit("x.log", "a/x.log")
    for bad in ("", "/a", "a//b", "a/../b", "a\\b", "./a"):
        with pytest.raises(ValueError):
            documents.path_pattern(bad)


def test_rolled_names(spark):
    names = {"app.log": None, "app.log.1": "app.log", "d/app.log.2026-01-01": "d/app.log", "app.log-20260101-120000": "app.log", "app-2026-01-01.log": "app.log", "app.log.1.gz": "app.log", "20260101.txt": None, "w.12-2026-01-01_03-04-05.log": "w.log", "a.log.2026-01_01": None}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", documents.rolled_stem(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in rows} == names


def test_invalid_scores_leave_the_order(spark):
    rows = [("ok", i, i, float(i), "a" if i == 1 else None) for i in range(1, 6)] + [("gap", i, i, None if i == 2 else 1.0, "a" if i == 5 else None) for i in range(1, 6)] + [("nan", i, i, float("nan") if i == 1 else float(i), None) for i in range(1, 4)] + [("none", 1, 1, None, "a")]
    got = {}
    for r in ranking.reranked(spark.createDataFrame(rows, "q string, seq long, pre_rank int, score double, anchor string"), "q", 2).orderBy("final_rank").collect():
        got.setdefault(r.q, []).append((r.seq, r.promoted))
    assert got == {"ok": [(5, False), (1, True)], "gap": [(1, False), (2, False)], "nan": [(1, False), (2, False)], "none": [(1, False)]}


def test_empty_and_null_messages(spark):
    df = spark.createDataFrame([(None,), ("",)], "m string")
    assert [tuple(r.e) for r in df.select(exceptions.envelope(F.col("m")).alias("e")).collect()][1][:4] == (None, None, None, "")
    assert [r[0] for r in df.select(exceptions.pattern_role(F.col("m"))).collect()] == [None, None]
    lines = spark.createDataFrame([("{}",), ('{"content": " "}',), ("x",), (None,), ('{"content": "a"}',), ('{"content": "a ", "kind": "k"}',)], "line string")
    assert [(r.kind, r.content) for r in rules.imported(lines, spark.createDataFrame([], "id string")).collect()] == [("k", "a")]


def test_export_is_written_by_source(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10, "a", "x", "info"), (2, None, "b", "y", "warn")], "seq long, ts long, source string, message string, level string")
    documents.write_export(rows, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out"))
    checked = documents.checked_events(back.select("source", F.lit(1).alias("line_no"), F.col("value").alias("line"))).collect()
    assert {(r.source, r.seq, r.codes) for r in checked} == {("a", 1, ""), ("b", 2, "")}


def test_archives_in_archives(spark):
    import io
    import zipfile

    def packed(files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in files.items():
                z.writestr(name, data)
        return out.getvalue()

    third = packed({"deep.log": b"3", "fourth.zip": packed({"x": b"4"})})
    outer = packed({"a.log": b"1", "in.zip": packed({"b.log": b"2", "third.zip": third}), "../up.log": b"no", "bomb": b"0" * 9_000_000, "bad.zip": b"nope", "d/": b""})
    rows = spark.createDataFrame([("o.zip", bytearray(outer)), ("n.zip", None)], "identity string, content binary")
    monstrous = {r.identity: (bytes(r.content) if r.content is not None else None, r.error) for r in archives.members(rows).collect()}
    bomb = monstrous.pop("o.zip!/bomb")
    assert bomb[1] in (None, "ratio_exceeded")
    assert monstrous == {
        "o.zip!/a.log": (b"1", None), "o.zip!/in.zip!/b.log": (b"2", None), "o.zip!/in.zip!/third.zip!/deep.log": (b"3", None), "o.zip!/in.zip!/third.zip!/fourth.zip": (None, "depth_exceeded"),
        "o.zip!/../up.log": (None, "unsafe_path"), "o.zip!/bad.zip": (None, "not_an_archive"), "n.zip": (None, "not_an_archive"),
    }


def test_an_empty_corpus_has_one_finding(spark):
    from tidelog.operators import quality

    events = spark.createDataFrame([], "seq long, source string, trace_id string, level string, template_id long")
    sources = spark.createDataFrame([], "source string, state string")
    assert [r.id for r in quality.findings(events, F.lit("wall"), F.lit(True), sources).collect()] == ["lq.corpus.empty"]


def test_redacted_params_keep_their_places(spark):
    from tidelog.functions import text

    df = spark.createDataFrame([(["a", "token=abcdefgh12", None],), ([],), (None,)], "p array<string>")
    assert [r[0] for r in df.select(text.redacted_params(F.col("p"))).collect()] == [["a", "token=[REDACTED:ASSIGNMENT]", None], [], None]
    cut = df.limit(1).select(text.original(F.lit("aäö\n"), 4).alias("o")).first().o
    assert (cut.text, cut.source_bytes, cut.redacted_chars, cut.truncated, cut.redaction_applied) == ("aä", 5, 3, True, False)
