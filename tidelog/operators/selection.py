"""Sessions found by terms, and ranked hits chosen under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(turns: DataFrame, key: str, terms: list[str], title: Column, pinned: Column, age_hours: Column, limit: int) -> DataFrame:
    """key and score of the sessions that hold a term, best first, then by key.

    A term counts 4 in the title and 1 in the turns; pinned adds 0.25, and recency at
    most 0.5. A term holds no line break, so the turns are looked through one by one
    and only one flag a term is shuffled. `title` is null but on the turn that has it.
    """
    low, head = F.lower(F.coalesce("text", F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    said = [F.max(low.contains(t.lower()).cast("int")) for t in terms]
    named = [F.max(head.contains(t.lower()).cast("int")) for t in terms]
    hits = sum(said, F.lit(0)) + sum((n * 4 for n in named), F.lit(0))
    found = turns.groupBy(key).agg(hits.alias("hits"), F.max(pinned.cast("int")).alias("pinned"), F.min(age_hours).alias("age")).where("hits > 0")
    score = F.col("hits") + F.coalesce("pinned", F.lit(0)) * 0.25 + F.coalesce(0.5 / (1 + F.greatest("age", F.lit(0)) / 720), F.lit(0.0))
    return found.select(key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def within_budget(hits: DataFrame, key: str, order: list, max_chars: int, max_items: int, min_score: float) -> DataFrame:
    """`hits` (score, length, echoed) with `decision` for each: selected, below_min_score, echo_suppressed, char_budget or max_items.

    Hits of a key are taken in `order` until one would exceed the budget (the first
    always fits); all after that one share its reason. What was chosen is thus a
    prefix of the eligible hits, which running sums tell.
    """
    ranked = Window.partitionBy(key).orderBy(*order)
    fit = (F.col("score") >= min_score) & ~F.col("echoed")
    taken = hits.withColumn("_fit", F.coalesce(fit, F.lit(False)))
    taken = taken.withColumn("_at", F.sum(F.col("_fit").cast("int")).over(ranked)).withColumn("_chars", F.sum(F.when(F.col("_fit"), F.col("length")).otherwise(0)).over(ranked))
    stops = F.when(F.col("_fit") & (F.col("_chars") > max_chars) & (F.col("_at") > 1), "char_budget").when(F.col("_fit") & (F.col("_at") > max_items), "max_items")
    stopped = F.first(stops, ignorenulls=True).over(ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own = F.when(F.col("_fit"), "selected").when(F.coalesce(F.col("score") < min_score, F.lit(True)), "below_min_score").otherwise("echo_suppressed")
    return taken.withColumn("decision", F.coalesce(stopped, own)).drop("_fit", "_at", "_chars")


def packed(blocks: DataFrame, key: str, order: list[Column | str], budget: int, most: int = 256) -> DataFrame:
    """The blocks of each key that a budget of characters takes: in order, and one that does not fit is passed over for smaller ones behind it.

    `blocks` has length. At most `most` blocks of a key are tried, the first by order, so
    the fold over them is bounded; the others are not included.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    tried = blocks.withColumn("place", place).where(F.col("place") <= most)
    lengths = tried.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col("length").cast("long").alias("length")))), lambda x: x).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("taken"))

    def step(s: Column, x: Column) -> Column:
        fits = s["used"] + x["length"] <= budget
        return F.struct((s["used"] + F.when(fits, x["length"]).otherwise(0)).alias("used"), F.when(fits, F.array_append(s["taken"], x["place"])).otherwise(s["taken"]).alias("taken"))

    return lengths.select(key, F.aggregate("all", start, step).alias("s")).select(key, F.col("s.used").alias("used"), F.array_join(F.col("s.taken").cast("array<string>"), ",").alias("places"))
