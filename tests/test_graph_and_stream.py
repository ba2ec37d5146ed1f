"""Recall of graphs against the exact search, and records of a stream with late lines."""

import time

import numpy as np
from pyspark.sql import functions as F

from tidelog.operators import retrieval, vector_graph
from tidelog.sources import framing
from tidelog.streaming.framer import framed_stream


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")


def test_recall_of_graphs(spark):
    draw = np.random.default_rng(7)
    for x in (draw.normal(size=(3000, 24)), draw.normal(size=(40, 24)).repeat(60, 0) + 0.2 * draw.normal(size=(2400, 24))):
        df = vectors(spark, x)
        asked = df.where("vec_id % 30 = 0")
        index = vector_graph.indexed(df, 1000)
        assert index.count() == len(x) and index.select("shard").distinct().count() == -(-len(x) // 1000)
        want = {(r.query_id, r.vec_id) for r in retrieval.nearest_vectors(df, asked, 10).collect()}
        got = {(r.query_id, r.vec_id) for r in vector_graph.search(index, asked, 10).collect()}
        assert len(want & got) >= 0.9 * len(want), len(want & got) / len(want)


def test_edges_of_graphs(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, [None, 1.0]), (5, [0.0, 0.0]), (6, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in vector_graph.nearest(df, df.where("vec_id = 1"), 2, 0).orderBy("rank").collect()] == [(1, 6), (1, 2)]
    assert vector_graph.nearest(df.limit(0), df, 2, 0).count() == 0
    assert vector_graph.nearest(df, df, 2).count() == retrieval.nearest_vectors(df, df, 2).count()


def test_stream_of_lines(spark, tmp_path):
    lines = ["2024-01-02 03:04:05 start", "java.io.IOException: x", "\tat a.B(C.java:1)", "{", "2024-01-02 03:04:06 next", '{"a": 1', "2024-01-02 03:04:07 P", "note", "2024-01-02T03:04:05Z stdout P a", "b", "2024-01-02T03:04:05Z stdout F c", "tail", "Traceback", "x", ""]
    rows = [(s, i, x) for s in "ab" for i, x in enumerate(lines)]
    schema = "source string, line_no long, line string"
    for k in range(3):
        spark.createDataFrame(rows[0:15][k * 5 : k * 5 + 5] + rows[15:][k * 5 : k * 5 + 5] + ([("a", 2, "too late")] if k == 2 else []), schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = framed_stream(stream, 1000).writeStream.outputMode("append").format("memory").queryName("framed").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        end = time.time() + 90
        want = {(r.source, r.first_line, r.text, r.n_lines, r.truncated) for r in framing.framed(spark.createDataFrame(rows, schema)).collect()}
        while time.time() < end:
            got = spark.sql("select * from framed").collect()
            if len({(r.source, r.first_line, r.text) for r in got if r.status == "record"}) >= len(want):
                break
            time.sleep(1)
        assert {(r.source, r.first_line, r.text, r.n_lines, r.truncated) for r in got if r.status == "record"} == want
        assert [(r.source, r.first_line, r.text) for r in got if r.status == "late"] == [("a", 2, "too late")]
    finally:
        query.stop()


def test_time_quality(spark):
    from tidelog.functions.times import quality

    rows = spark.createDataFrame([(0, 0), (5, 0), (5, 5), (5, 2)], "total long, wall long")
    assert [r[0] for r in rows.select(quality(F.col("total"), F.col("wall"))).collect()] == ["order_only", "order_only", "wall", "mixed"]
