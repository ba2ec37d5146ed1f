"""Templates, pools and neighbours: scores that rank what a question asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def with_patterns(events: DataFrame, templates: DataFrame) -> DataFrame:
    """Events with the pattern of their template, empty where it is not known. Both sides stay as Spark joins them; a small table is broadcast by its measured size."""
    return events.join(templates.select("template_id", "pattern"), "template_id", "left").withColumn("pattern", F.coalesce("pattern", F.lit("")))


def problem_score(severity: Column, count: Column) -> Column:
    """Severity times ln(1 + count), half as much again for what was seen once or twice."""
    return severity * F.log1p(count) * F.when(count <= 2, 1.5).otherwise(1.0)


def ordered_hits(events: DataFrame, asked: str, top: int = 500) -> DataFrame:
    """Events that hold a word asked for: most of them first, then by seq. At most `top`, which Spark takes before the shuffle."""
    score = text.lexical_overlap(F.lit(asked), F.col("message"))
    return events.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "seq").limit(top)


def template_hits(events: DataFrame, asked: str, similarity: Column, severity: Column, top: int = 100, exemplars: int = 3) -> DataFrame:
    """The `top` templates by 0.45 keyword + 0.45 similarity + 0.10 severity / 5, each with the seqs of up to `exemplars` events.

    Scores of a template are the best of its events. Exemplars hold the whole phrase
    first, then the most words, then the lowest seq.
    """
    words = F.size(F.array_distinct(text.tokens(F.lit(asked))))
    keyword = text.lexical_overlap(F.lit(asked), F.col("message")) / words
    rows = events.select("template_id", "seq", keyword.alias("keyword"), similarity.alias("similar"), severity.alias("severity"), F.lower("message").contains(asked.lower()).alias("phrase"))
    best = rows.groupBy("template_id").agg(F.max("keyword").alias("keyword"), F.max("similar").alias("similar"), F.max("severity").alias("severity"))
    score = F.round(0.45 * F.col("keyword") + 0.45 * F.col("similar") + 0.10 * F.col("severity") / 5, 6)
    best = best.select("template_id", score.alias("score")).orderBy(F.desc("score"), "template_id").limit(top)
    place = F.row_number().over(Window.partitionBy("template_id").orderBy(F.desc("phrase"), F.desc("keyword"), "seq"))
    shown = rows.join(best.select("template_id"), "template_id").withColumn("place", place).where(F.col("place") <= exemplars)
    shown = shown.groupBy("template_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "seq"))), lambda x: x["seq"].cast("string")), ",").alias("exemplars"))
    return best.join(shown, "template_id")


def pooled(hits: DataFrame, now: int, keyword_weight: float = 0.6) -> DataFrame:
    """Hits of several pools on one scale: keyword scores over their pool's best, and similarity.

    A hit found by similarity alone (keyword 0) must be valid now. Needs pool, id,
    keyword, similar, valid_from and valid_to.
    """
    best = hits.groupBy("pool").agg(F.max("keyword").alias("best"))
    valid = (F.coalesce(F.col("valid_from") <= now, F.lit(True))) & F.coalesce(F.col("valid_to") > now, F.lit(True))
    rows = hits.where((F.col("keyword") > 0) | valid).join(best, "pool")
    share = F.when(F.col("best") > 0, F.col("keyword") / F.col("best")).otherwise(0.0)
    return rows.select("pool", "id", F.round(keyword_weight * share + (1 - keyword_weight) * F.col("similar"), 6).alias("score"))


def with_neighbours(hits: DataFrame, edges: DataFrame, most: int = 4, share: float = 0.85) -> DataFrame:
    """Hits (id, score) and up to `most` neighbours of each by edge weight, at `share` of its score; of several ways to one id the best counts.

    Two equality joins, one for each direction of an edge, stand for an OR.
    """
    near = hits.join(edges.select(F.col("source").alias("id"), F.col("target").alias("other"), "weight"), "id").unionByName(hits.join(edges.select(F.col("target").alias("id"), F.col("source").alias("other"), "weight"), "id"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("weight"), "other"))
    found = near.withColumn("place", place).where(F.col("place") <= most).select(F.col("other").alias("id"), (F.col("score") * share).alias("score"), F.lit(True).alias("reached"))
    both = hits.select("id", "score", F.lit(False).alias("reached")).unionByName(found)
    return both.groupBy("id").agg(F.round(F.max("score"), 6).alias("score"), F.bool_and("reached").alias("reached"))


def diagnostics(ranking: DataFrame, relevant: DataFrame, corpus: DataFrame, shortlist: int, k: int) -> DataFrame:
    """Of each query with a ranking (query_id, vec_id, rank): recall at k, relevant ids lost between shortlist and k, ids foreign to the corpus.

    A repeated id makes the whole ranking invalid, with recall null; a query without relevant ids has recall 0.
    """
    known = corpus.select("vec_id", F.lit(True).alias("known"))
    marked = ranking.join(relevant.select("query_id", "vec_id", F.lit(True).alias("good")), ["query_id", "vec_id"], "left").join(known, "vec_id", "left")
    found = marked.groupBy("query_id").agg(
        F.count("*").alias("n"), F.countDistinct("vec_id").alias("ids"), F.count_if(F.col("good") & (F.col("rank") <= k)).alias("hits"), F.count_if(F.col("good") & (F.col("rank") > k) & (F.col("rank") <= shortlist)).alias("lost"), F.count_if(F.col("known").isNull()).alias("foreign_ids")
    )
    wanted = relevant.groupBy("query_id").agg(F.count("*").alias("wanted"))
    recall = F.when(F.col("n") != F.col("ids"), None).when(F.coalesce("wanted", F.lit(0)) == 0, 0.0).otherwise(F.round(F.col("hits") / F.col("wanted"), 6))
    return found.join(wanted, "query_id", "left").select("query_id", recall.alias("recall"), "lost", "foreign_ids")
