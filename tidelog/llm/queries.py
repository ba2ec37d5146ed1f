"""Registered queries of the training-data operators, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, licenses
from .class_lm import language_scores
from .conversations import damaged_and_repaired
from .decontamination import benchmark_matches
from .embedding_join import near_duplicate_vectors
from .hard_negatives import hard_negatives
from .licenses import license_matches
from .minhash import near_duplicates
from .packing import pack
from .pii import personal_data_digest
from .quality import quality
from .repeats import without_repeats
from .sharding import contents, sharded
from .tables import table
from .toxicity import toxicity


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return contents(sharded(docs), docs)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "start_word", "n_words")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


def op6_class_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_digest(table(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damaged_and_repaired(table(spark, sf_dir, "conversations"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_class_ngram_lm": op6_class_ngram_lm,
    "op7_license_scan": op7_license_scan,
    "op8_pii": op8_pii,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_toxicity": op13_toxicity,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op2_minhash_near_dedup": f"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS MATERIALIZED (
  SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op4_benchmark_decontamination": f"""
WITH w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), v AS MATERIALIZED (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark
), d AS MATERIALIZED (
  SELECT doc_id, n, words, s.i - 1 AS pos, s.t AS s FROM (
    SELECT doc_id, len(w) AS words, greatest(len(w) - 4, 1) AS n,
      unnest([{{'i': i, 't': array_to_string(w[i:i+4], ' ')}} FOR i IN range(1, greatest(len(w) - 4, 1) + 1)]) AS s FROM w WHERE len(w) > 0)
), b AS MATERIALIZED (
  SELECT item_id, width, size, s, count(*) AS c FROM (
    SELECT item_id, len(w) AS width, greatest(len(w) - 4, 1) AS size,
      unnest([array_to_string(w[i:i+4], ' ') FOR i IN range(1, greatest(len(w) - 4, 1) + 1)]) AS s FROM v WHERE len(w) > 0) GROUP BY ALL
), hit AS MATERIALIZED (
  SELECT doc_id, n, words, pos, item_id, width, size, d.s, c, least(size, n) AS span FROM d JOIN b USING (s)
), place AS (
  SELECT DISTINCT doc_id, item_id, words, width, size, span,
    unnest(range(greatest(pos - span + 1, 0), least(pos, n - span) + 1)) AS p FROM hit
), met AS (
  SELECT p.doc_id, p.item_id, p.words, p.width, p.size, p.span, p.p, h.s, least(count(*), any_value(h.c)) AS m
  FROM place p JOIN hit h ON h.doc_id = p.doc_id AND h.item_id = p.item_id AND h.pos >= p.p AND h.pos < p.p + p.span GROUP BY ALL
), scored AS (
  SELECT doc_id, item_id, p, least(width, words) AS n_words, sum(m)::DOUBLE / (span + size - sum(m))::DOUBLE AS similarity
  FROM met GROUP BY doc_id, item_id, p, width, words, size, span
)
SELECT doc_id, item_id, max(similarity) AS similarity, arg_min(p, struct_pack(a := -similarity, b := p)) AS start_word, any_value(n_words) AS n_words
FROM scored WHERE similarity >= 0.75 GROUP BY doc_id, item_id""",
    "op1_sharding": """
SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, sha256(coalesce(text, '')) AS text_sha256, true AS settled FROM documents""",
    "op7_license_scan": licenses.oracle(),
    "op9_embedding_near_dedup": """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), link AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1
), n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY 1)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)""",
    "op11_conversation_repair": conversations.ORACLE,
    "op12_hard_negatives": """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.rid, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.rid <> b.rid AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS nth FROM s WHERE same QUALIFY nth <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.rid, p.nth ORDER BY s.score DESC, s.vec_id) AS place,
    s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.rid = p.rid AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
)
SELECT anchor_id, positive_id, place::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 5""",
}
