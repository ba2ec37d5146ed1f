"""Queries over documents, pages, vectors and star-schema tables, and their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import maths, text, times
from ..operators import records, retrieval
from ..sources.events import table


def dedup_exact(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content"))
    return docs.groupBy("content").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


def bm25_search(spark, sf_dir):
    found = retrieval.bm25(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "benchmark"), "item_id", 10)
    return found.select("query_id", "doc_id", "score", "rank")


def tfidf_search(spark, sf_dir):
    found = retrieval.tfidf(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "benchmark"), "item_id", 10)
    return found.select("query_id", "doc_id", "score", "rank")


def rrf_fusion(spark, sf_dir):
    docs, asked = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    both = retrieval.Postings(docs, "doc_id", asked, "item_id")
    a, b = retrieval.bm25(docs, "doc_id", asked, "item_id", 50, postings=both), retrieval.tfidf(docs, "doc_id", asked, "item_id", 50, postings=both)
    return retrieval.fused(a, b, "doc_id", 10).select("query_id", "doc_id", "score", "rank")


def vector_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.nearest_vectors(vectors, vectors.where("vec_id % 50 = 0"), 10).select("query_id", "vec_id", "score", "rank")


def retrieval_metrics(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.label_metrics(retrieval.nearest_vectors(vectors, vectors.where("vec_id % 50 = 0"), 10), vectors, 10)


def redact_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.size(text.secret_classes(F.col("text"))) > 0)
    return docs.select("doc_id", F.array_join(text.secret_classes(F.col("text")), ",").alias("classes"), F.sha2(text.redacted(F.col("text")), 256).alias("redacted_sha256"))


def timestamp_epoch_bands(spark, sf_dir):
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    scale = F.element_at(F.array(*(F.lit(x).cast("long") for x in (1, 10**3, 10**6, 10**9))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", times.epoch_seconds(seconds * scale).alias("ts"))


def latest_revision_per_customer(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return records.latest(orders, "o_custkey", "o_orderdate", "o_orderkey")


def case_participants(spark, sf_dir):
    return records.participants(table(spark, sf_dir, "customer"), "c_custkey", table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), "o_orderkey")


def _runs(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_quantity") < 20, "pass").when(F.col("l_quantity") < 35, "fail").otherwise("inconclusive")
    return items.select("l_returnflag", "l_linestatus", F.col("l_suppkey").alias("model"), F.col("l_orderkey").alias("run"), F.col("l_partkey").alias("evidence"), F.floor("l_quantity").alias("amount"), status.alias("status"))


def ledger_aggregate(spark, sf_dir):
    return records.ledger(_runs(spark, sf_dir), ["model"], "amount", "status")


def agreement_anchors(spark, sf_dir):
    return records.anchors(_runs(spark, sf_dir).withColumnRenamed("l_returnflag", "role"))


def role_conflicts(spark, sf_dir):
    return records.role_conflicts(_runs(spark, sf_dir).withColumnRenamed("l_returnflag", "role"))


_WORDS = """d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: len(w) > 1) AS w FROM documents),
q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: len(w) > 1)) AS term FROM benchmark),
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
f AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
c AS (SELECT count(*) AS total, avg(len(w)) AS mean FROM d),
bm AS (SELECT query_id, doc_id, round(sum(ln(1 + (total - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len(w) / mean))), 6) AS score
  FROM t JOIN f USING (term) JOIN d USING (doc_id) JOIN q USING (term), c GROUP BY 1, 2),
ti AS (SELECT query_id, doc_id, round(sum(1 + ln(total / (1 + df))), 6) AS score FROM t JOIN f USING (term) JOIN q USING (term), c GROUP BY 1, 2)"""
_RANKED = "SELECT query_id, {key}, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS rank FROM {of} QUALIFY rank <= {top}"
_NEAR = """n AS (SELECT q.vec_id AS query_id, v.vec_id, round(greatest(0, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS score
  FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id)"""
_RUNS = """r AS (SELECT l_returnflag AS role, l_suppkey AS model, l_orderkey AS run, l_partkey AS evidence, CAST(floor(l_quantity) AS BIGINT) AS amount,
  CASE WHEN l_quantity < 20 THEN 'pass' WHEN l_quantity < 35 THEN 'fail' ELSE 'inconclusive' END AS status FROM lineitem)"""
_RANK10 = {"key": "vec_id", "of": "n WHERE score > 0", "top": 10}



def _redact_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    gone = "text"
    for name, pattern in text.SECRETS:
        gone = f"regexp_replace({gone}, {quoted(pattern)}, '\\1[REDACTED:{name}]{text.AFTER.get(name, '')}', 'g')"
    classes = ", ".join(f"CASE WHEN regexp_matches(text, {quoted(p)}) THEN {quoted(n)} END" for n, p in text.SECRETS)
    return f"SELECT doc_id, array_to_string(list_filter([{classes}], lambda c: c IS NOT NULL), ',') AS classes, sha256({gone}) AS redacted_sha256 FROM documents WHERE classes <> ''"


ORACLES = {
    "redact_secrets": _redact_sql(),
    "dedup_exact": "SELECT sha256(coalesce(text, '')) AS content, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1 HAVING n > 1",
    "bm25_search": f"WITH {_WORDS} {_RANKED.format(key='doc_id', of='bm', top=10)}",
    "tfidf_search": f"WITH {_WORDS} {_RANKED.format(key='doc_id', of='ti', top=10)}",
    "rrf_fusion": f"WITH {_WORDS}, x AS ({_RANKED.format(key='doc_id', of='bm', top=50)}), y AS ({_RANKED.format(key='doc_id', of='ti', top=50)}), z AS (SELECT query_id, doc_id, round(coalesce(1.0::DOUBLE / (60 + x.rank), 0) + coalesce(1.0::DOUBLE / (60 + y.rank), 0), 6) AS score FROM x FULL JOIN y USING (query_id, doc_id)) {_RANKED.format(key='doc_id', of='z', top=10)}",
    "vector_topk": f"WITH {_NEAR} {_RANKED.format(**_RANK10)}",
    "retrieval_metrics": f"""WITH {_NEAR}, k AS ({_RANKED.format(**_RANK10)}), g AS (
  SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY v.vec_id) AS ideal FROM embeddings q JOIN embeddings v ON v.label = q.label AND v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, round(count(rank) / count(*), 6) AS recall, round(coalesce(1 / min(rank), 0), 6) AS mrr, round(coalesce(sum(1 / log2(rank + 1)), 0) / sum(1 / log2(ideal + 1)) FILTER (ideal <= 10), 6) AS ndcg FROM g LEFT JOIN k USING (query_id, vec_id) GROUP BY 1""",
    "timestamp_epoch_bands": "SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS ts FROM orders",
    "latest_revision_per_customer": "SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "case_participants": "SELECT c_custkey, count(o_orderkey) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "ledger_aggregate": f"""WITH {_RUNS} SELECT model, count(*) AS runs, CAST(sum(amount) AS BIGINT) AS total, CAST(floor((v[(len(v) + 1) // 2] + v[len(v) // 2 + 1]) / 2) AS BIGINT) AS median, round(p / nullif(j, 0), 6) AS pass_rate FROM (
  SELECT *, list(amount) OVER w AS v FROM (SELECT * FROM r) WINDOW w AS (PARTITION BY model ORDER BY amount ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) JOIN (SELECT model, count(*) FILTER (status = 'pass') AS p, count(*) FILTER (status <> 'inconclusive') AS j FROM r GROUP BY 1) USING (model) GROUP BY model, v, p, j""",
    "agreement_anchors": f"WITH {_RUNS} SELECT evidence, role, count(DISTINCT run) AS runs, count(DISTINCT model) AS models, models >= 2 AS independent FROM r GROUP BY 1, 2",
    "role_conflicts": f"WITH {_RUNS} SELECT evidence, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles FROM r GROUP BY 1 HAVING count(DISTINCT role) > 1",
}

QUERIES = {name: globals()[name] for name in ORACLES}
