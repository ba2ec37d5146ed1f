"""Orders of hits: reranked with pinned anchors, blended scores, one hit a page, clusters, neighbourhoods of a focus."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .search import problem_score

# What clusters are made of, and when two patterns are one problem.
CANDIDATES, RARE_RESERVE, SIMILAR = 512, 64, 0.4


def anchored(pool: DataFrame, key: str, terms: list[str], structured: bool = False) -> DataFrame:
    """Adds `anchor` to each candidate: a phrase asked for, the structured filter, or the first or last of its pool in time."""
    phrases = [F.lower("message").contains(t.strip().lower()) for t in terms if t.strip()]
    phrase = F.lit(False)
    for p in phrases:
        phrase = phrase | F.coalesce(p, F.lit(False))
    edges = pool.groupBy(key).agg(F.min(F.struct("ts", "seq")).alias("head"), F.max(F.struct("ts", "seq")).alias("tail"))
    edge = F.col("seq").isin(F.col("head.seq"), F.col("tail.seq"))
    kind = F.when(phrase, "exact_phrase").when(F.lit(structured), "structured").when(edge, "chronology")
    return pool.join(edges, key).withColumn("anchor", kind).drop("head", "tail")


def reranked(pool: DataFrame, key: str, k: int) -> DataFrame:
    """The k best of each pool (key, seq, pre_rank, score, anchor) by score, and the anchors among them: adds final_rank and promoted.

    Scores belong to a prefix of the ranks; behind it the rank decides. Anchors beyond
    k take the places of the worst that are none, as long as there are such. A pool
    whose scores are no prefix, or not finite, keeps its order, its anchors unpinned.
    """
    whole = Window.partitionBy(key)
    scored = F.col("score").isNotNull()
    finite = F.col("score").between(-1.7976931348623157e308, 1.7976931348623157e308)
    valid = (F.count("score").over(whole) > 0) & F.coalesce(F.max(F.when(scored, F.col("pre_rank"))).over(whole) == F.count("score").over(whole), F.lit(False)) & F.coalesce(F.min(F.when(scored, finite)).over(whole), F.lit(False))
    rows = pool.withColumn("valid", valid)
    rows = rows.withColumn("used", F.when(F.col("valid"), F.col("score")))
    rows = rows.withColumn("place", F.row_number().over(whole.orderBy(F.desc_nulls_last("used"), "pre_rank")))
    inside, pinned = F.col("place") <= k, F.col("anchor").isNotNull() & F.col("valid")
    late, weak = (~inside & pinned).cast("int"), (inside & ~pinned).cast("int")
    rows = rows.withColumn("late", F.sum(late).over(whole.orderBy("place"))).withColumn("weak", F.sum(weak).over(whole.orderBy(F.desc("place"))))
    moved = F.least(F.max("late").over(whole), F.max("weak").over(whole))
    rows = rows.withColumn("moved", F.when(F.col("valid"), moved).otherwise(0))
    promoted = ~inside & pinned & (F.col("late") <= F.col("moved"))
    kept = rows.withColumn("promoted", promoted).where(promoted | (inside & (pinned | (F.col("weak") > F.col("moved")))))
    return kept.withColumn("final_rank", F.row_number().over(whole.orderBy("place"))).drop("valid", "used", "place", "late", "weak", "moved")


def blended(keyword: Column, best: Column, similar: Column | None, recency: Column | None, weights: tuple[float, float, float] = (0.55, 0.35, 0.10)) -> Column:
    """Keyword score over the best one, similarity and recency, each within 0 and 1; the weights of those that are not given fall to the others."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    parts = [(weights[0], F.when(best > 0, unit(keyword / F.nullif(best, F.lit(0.0)))).otherwise(0.0))]
    parts += [(w, unit(c)) for w, c in zip(weights[1:], (similar, recency), strict=True) if c is not None]
    return sum(c * w for w, c in parts) / sum(w for w, _ in parts)


def one_a_page(hits: DataFrame, page: str, order: list[Column], top: int) -> DataFrame:
    """The best hit of each page, and of these the first `top`."""
    place = F.row_number().over(Window.partitionBy(page).orderBy(*order))
    return hits.withColumn("_place", place).where("_place = 1").drop("_place").orderBy(*order).limit(top)


def _bag(pattern: str) -> dict[str, int]:
    bag: dict[str, int] = {}
    word = ""
    for c in (pattern or "") + " ":
        if c.isalnum() or c == "*":
            word += c
        elif word:
            bag[word.lower()] = bag.get(word.lower(), 0) + 1
            word = ""
    return bag


def _similar(a: dict[str, int], b: dict[str, int]) -> float:
    high = sum(max(a.get(w, 0), b.get(w, 0)) for w in a.keys() | b.keys())
    return sum(min(n, b.get(w, 0)) for w, n in a.items()) / high if high else 1.0


def _greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each template, in order of impact, joins the first cluster whose first template is like it. At most CANDIDATES rows come."""
    rows = pd.concat([pd.DataFrame({"template_id": [], "pattern": []}), *batches])
    first: list[tuple[int, dict[str, int]]] = []
    out = []
    for t, pattern in zip(rows["template_id"], rows["pattern"], strict=True):
        bag = _bag(pattern)
        home = next((c for c, proto in first if _similar(bag, proto) >= SIMILAR), None)
        if home is None:
            home = len(first)
            first.append((home, bag))
        out.append((int(t), home))
    yield pd.DataFrame(out, columns=["template_id", "home"]).astype("int64")


def clusters(templates: DataFrame, top: int) -> DataFrame:
    """Problems: templates (template_id, pattern, severity, n) whose words are alike, by score: cluster_id, label, template_ids, n, severity, score, considered, available.

    Considered are the CANDIDATES of most impact; beyond that number RARE_RESERVE places
    go to the most severe. Both are top-k by the executors, so the one task that puts
    them in clusters, which is a sequence by nature, holds a bounded number.
    """
    score = problem_score(F.col("severity"), F.col("n"))
    rows = templates.select("template_id", "pattern", "severity", "n", score.alias("score"))
    impact = [F.desc("score"), F.desc("severity"), F.desc("n"), F.asc("template_id")]
    available = rows.agg(F.count("*").alias("available"))
    most, severe = rows.orderBy(*impact).limit(CANDIDATES), rows.orderBy(F.desc("severity"), *impact).limit(CANDIDATES)
    whole = Window.orderBy(*impact)  # over at most CANDIDATES rows
    most = most.withColumn("place", F.row_number().over(whole))
    rare = severe.join(most.where(F.col("place") <= CANDIDATES - RARE_RESERVE).select("template_id"), "template_id", "left_anti").orderBy(F.desc("severity"), *impact).limit(RARE_RESERVE)
    chosen = most.where(F.col("place") <= CANDIDATES - RARE_RESERVE).drop("place").unionByName(rare)
    placed = chosen.coalesce(1).sortWithinPartitions(*impact).select("template_id", "pattern").mapInPandas(_greedy, "template_id long, home long")
    best = F.min(F.struct(-F.col("score"), -F.col("severity"), -F.col("n"), "template_id", "pattern"))
    found = chosen.join(placed, "template_id").groupBy("home").agg(
        F.min("template_id").alias("cluster_id"), best["pattern"].alias("label"), F.array_join(F.transform(F.array_sort(F.collect_list("template_id")), lambda t: t.cast("string")), ",").alias("template_ids"),
        F.sum("n").alias("n"), F.max("severity").alias("severity"), F.count("*").alias("members"),
    )
    total = Window.partitionBy()  # one row a cluster, at most CANDIDATES
    found = found.withColumn("considered", F.sum("members").over(total)).crossJoin(F.broadcast(available))  # one row
    found = found.withColumn("score", problem_score(F.col("severity"), F.col("n")))
    return found.drop("home", "members").orderBy(F.desc("score"), F.desc("severity"), F.desc("n"), "cluster_id").limit(max(1, top))


def neighbourhood(rows: DataFrame, radius: int, most: int, comparable: bool) -> DataFrame:
    """id and category of rows (id, scope, candidate, source, ordinal, traced) around what is in focus.

    Rows of scope candidate are the focus; in a traced candidate those of another
    source than its first row are linked, or propagated if later. Others are before or
    after the nearest focus of their source, or of any source where theirs has none
    and clocks are comparable, within `radius`; beyond it, without an ordinal, and
    behind the `most` nearest they are independent. Focus ordinals are distinct and
    met by buckets of the radius, so no source is sorted.
    """
    focus, other = rows.where("scope = 'candidate'"), rows.where("scope <> 'candidate'")
    first = focus.where("ordinal is not null").groupBy("candidate").agg(F.min(F.struct("ordinal", "source")).alias("first"))
    linked = F.col("traced") & (F.col("source") != F.col("first.source"))
    kind = F.when(linked & (F.col("ordinal") > F.col("first.ordinal")), "propagation").when(linked, "trace_linked").otherwise("focus")
    seen = focus.join(first, "candidate", "left").select("id", kind.alias("category"))
    points = focus.where("ordinal is not null").select("source", F.col("ordinal").alias("at")).distinct()
    wide = max(1, radius)
    spread = lambda df: df.withColumn("bucket", F.explode(F.array(*(F.floor(F.col("at") / wide) + d for d in (-1, 0, 1)))))
    asked = other.select("id", "source", "ordinal", F.floor(F.col("ordinal") / wide).alias("bucket")).join(points.select("source").distinct().withColumn("own", F.lit(True)), "source", "left")
    gap = F.abs(F.col("ordinal") - F.col("at"))
    own = asked.where("own").join(spread(points), ["source", "bucket"]).select("id", "ordinal", F.struct(gap.alias("gap"), "at").alias("near"), F.lit(True).alias("own"))
    any_source = asked.where(F.col("own").isNull() & F.lit(comparable)).join(spread(points.select("at").distinct()), "bucket").select("id", "ordinal", F.struct(gap.alias("gap"), "at").alias("near"), F.lit(False).alias("own"))
    nearest = own.unionByName(any_source).where(F.col("near.gap") <= radius).groupBy("id", "ordinal", "own").agg(F.min("near").alias("near"))
    kept = nearest.orderBy("near.gap", "ordinal", "id").limit(most)
    category = F.when(~F.col("own"), "cross_source_temporal").when(F.col("ordinal") < F.col("near.at"), "preceding_same_source").otherwise("following_same_source")
    context = other.select("id").join(kept.select("id", category.alias("category")), "id", "left").select("id", F.coalesce("category", F.lit("independent_noise")).alias("category"))
    return seen.unionByName(context)


def substring_hits(texts: DataFrame, asked: str, order: list[str], top: int) -> DataFrame:
    """The first `top` texts, by `order`, that hold what was asked for in any case, each with an excerpt around it."""
    found = texts.where(F.lower("text").contains(asked.lower()))
    return found.select(*order, text.excerpt(F.col("text"), asked).alias("excerpt")).orderBy(*order).limit(top)
