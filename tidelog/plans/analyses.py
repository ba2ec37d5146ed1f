"""Queries over templates, pools, revisions, series and texts of times, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import levels, maths, text, times
from ..operators import changes, facts, records, reports, retrieval, search
from ..operators.filters import WALL, EventFilter
from ..sources.events import events, table
from .events import DAY, START, _with

ASKED = "error user purchase k view"
NOW = START + 20 * DAY
_SEVERITY = "CASE level WHEN 'debug' THEN 1 WHEN 'info' THEN 2 WHEN 'warn' THEN 3 WHEN 'error' THEN 4 END"
_WORDS = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^a-z0-9]+'), lambda w: len(w) > 1)"


def _basis():
    return F.element_at(F.array(*map(F.lit, (*WALL, "unresolved_local", "order_only"))), (F.col("seq") % 4 + 1).cast("int"))


def wall_time_scope(spark, sf_dir):
    rows = EventFilter(wall_only=True).apply(events(spark, sf_dir).withColumn("basis", _basis()))
    return rows.groupBy("source", "basis").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))


def _templates(spark, sf_dir):
    return events(spark, sf_dir).where("template_id % 2 = 0").select("template_id", F.concat(F.lit("k="), F.col("template_id").cast("string")).alias("pattern")).distinct()


def template_lookup(spark, sf_dir):
    return search.with_patterns(events(spark, sf_dir), _templates(spark, sf_dir)).groupBy("pattern").agg(F.count("*").alias("n"))


def template_facts(spark, sf_dir):
    rows = events(spark, sf_dir)
    active, suppressed = rows.where("ts < %d" % (START + DAY)).select("template_id"), rows.where("template_id % 10 = 3").select("template_id")
    return facts.template_facts(rows, active.union(suppressed).distinct())


def reduction_ratio(spark, sf_dir):
    return reports.reduction(events(spark, sf_dir), "source")


def problem_scores(spark, sf_dir):
    counts = events(spark, sf_dir).groupBy("template_id").agg(F.max(levels.severity(F.col("level"))).alias("severity"), F.count("*").alias("n"))
    return counts.select("template_id", F.round(search.problem_score(F.col("severity"), F.col("n")), 6).alias("score"))


def ingest_confidence(spark, sf_dir):
    outcome = F.when(F.col("template_id") % 5 == 0, "plain").when(F.col("template_id") % 5 == 1, "json").otherwise("logfmt")
    return reports.confidence(events(spark, sf_dir), "source", outcome, _basis())


def suppression_preview(spark, sf_dir):
    return facts.suppression_preview(events(spark, sf_dir), [3, 7, 11, 42])


def report_counts(spark, sf_dir):
    return reports.counted_runs(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_orderkey", "l_suppkey", "l_partkey")


def revised_event_stats(spark, sf_dir):
    rows = events(spark, sf_dir)
    return changes.revised_stats(rows, _updates(rows))


def _updates(rows):
    return rows.where("seq % 50 = 0").select("seq", F.col("ts").alias("expected_ts"), (F.col("ts") + 40 * DAY).alias("new_ts"))


def revision_undo(spark, sf_dir):
    rows = events(spark, sf_dir).select("seq", "ts")
    return changes.undone(records.revised(rows, _updates(rows)).select("seq", "ts"), _updates(rows).where("seq % 100 = 0"))


def revision_audit(spark, sf_dir):
    rows = events(spark, sf_dir).select("seq", "ts", "level", "template_id")
    stated = _updates(rows).select("seq", (F.col("expected_ts") + F.when(F.col("seq") % 150 == 0, 1).otherwise(0)).alias("before_ts"), "new_ts")
    active = records.revised(rows, _updates(rows)).select("seq", "ts").join(rows.drop("ts"), "seq")
    return changes.audited(stated, active.withColumn("level", F.when(F.col("seq") % 350 == 0, F.lit(None)).otherwise(F.col("level"))), rows.withColumnRenamed("ts", "ts"), ["level", "template_id"])


def multiset_difference(spark, sf_dir):
    rows = events(spark, sf_dir)
    day = lambda d: rows.where(F.col("ts").between(START + d * DAY, START + (d + 1) * DAY - 1)).select("level", "template_id")
    return changes.multiset_difference(day(1), day(2)).groupBy("side", "level", "template_id").agg(F.count("*").alias("n"))


def timezone_apply(spark, sf_dir):
    at, reason = times.local_to_utc(F.timestamp_seconds("ts"), "America/Chicago")
    local = F.col("source") == "src1"
    return events(spark, sf_dir).select("seq", F.when(local & (reason == "resolved"), F.unix_seconds(at)).otherwise(F.col("ts")).alias("ts"), F.when(local, reason).alias("reason"))


def inventory_diff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("n_chars"), F.lit(0)).alias("size"), (F.col("doc_id") % 90).alias("mtime"))
    later = docs.where("doc_id % 13 <> 0").withColumn("mtime", F.col("mtime") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0))
    return changes.inventory(docs.where("doc_id % 11 <> 0"), later, "doc_id", "size", "mtime")


def embedding_plan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content"))
    stored = docs.where("doc_id % 3 <> 0").withColumn("content", F.when(F.col("doc_id") % 5 == 0, F.lit("old")).otherwise(F.col("content")))
    return changes.to_embed(docs, stored, "doc_id", "content", 2048)


def inbox_batch(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length(F.coalesce("text", F.lit(""))) % 100).alias("confidence"), (F.col("turn") * 17 % 100).alias("salience"))
    return reports.worth_review(turns)


def pool_recall(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    hits = turns.select(
        (F.col("conv_id") % 2).alias("pool"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), (F.length(F.coalesce("text", F.lit(""))) % 7).cast("double").alias("keyword"), ((F.col("conv_id") * 7 + F.col("turn") * 13) % 100 / 100).alias("similar"),
        F.when(F.col("turn") % 3 == 0, F.col("conv_id") % 50).alias("valid_from"), F.when(F.col("turn") % 4 == 0, F.col("conv_id") % 60).alias("valid_to"),
    )
    return search.pooled(hits, 25)


def neighbour_expansion(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    edges = items.groupBy(F.col("l_partkey").alias("source"), (F.col("l_suppkey") + 10_000_000).alias("target")).agg(F.sum(F.col("l_quantity")).cast("long").alias("weight"))
    hits = table(spark, sf_dir, "part").where("p_partkey % 97 = 0").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50).alias("score"))
    hits = hits.unionByName(table(spark, sf_dir, "supplier").where("s_suppkey % 9 = 0").select((F.col("s_suppkey") + 10_000_000).alias("id"), F.lit(0.5).alias("score")))
    return search.with_neighbours(hits, edges)


def lane_sources(spark, sf_dir):
    own = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat(F.lit("src"), ((F.col("s_suppkey") + i * i) % 8).cast("string")))
    both = reports.shared_sources(own, [f"src{i}" for i in (0, 2, 3, 5)])
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(both, ",").alias("sources"))


def uncited_evidence(spark, sf_dir):
    visible = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("evidence"), "p_brand")
    cited = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("evidence"))
    return reports.uncovered(visible, cited, "evidence")


def watchers_due(spark, sf_dir):
    watchers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_mktsegment") != "BUILDING").alias("enabled"), (F.col("c_custkey") % 30 * 86_400 * 20).alias("every"))
    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max(F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("last_ts"))
    return facts.due(watchers, runs, 1_000_000_000)


def stale_leases(spark, sf_dir):
    return reports.stale(table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "O", "o_orderdate", F.lit("1996-06-30 00:00:00").cast("timestamp"), "o_orderkey")


def source_ranking(spark, sf_dir):
    return reports.ranked_sources(events(spark, sf_dir), F.col("message").contains("error"), ["src0", "src4"], 5)


def page_with_total(spark, sf_dir):
    rows = events(spark, sf_dir).where("level = 'error'").select("ts", "seq", "message")
    return reports.with_total(rows, ["ts", "seq"], 50)


def ordered_search(spark, sf_dir):
    return search.ordered_hits(events(spark, sf_dir), ASKED).select("seq", "score")


def template_search(spark, sf_dir):
    return search.template_hits(events(spark, sf_dir), ASKED, F.col("template_id") * 37 % 100 / 100, levels.severity(F.col("level")))


def feed_scores(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 60).alias("title"), F.substring("text", 61, 300).alias("snippet"))
    score = text.feed_score(F.lit("the that thing license token"), F.col("title"), F.col("snippet"))
    return pages.select("doc_id", score.alias("score"), text.lexical_overlap(F.lit("the that thing"), F.col("snippet")).alias("overlap"))


def otel_levels(spark, sf_dir):
    return events(spark, sf_dir).groupBy(levels.otel_severity(F.col("level")).alias("otel")).agg(F.count("*").alias("n"))


def template_params(spark, sf_dir):
    words = F.split("message", " ")
    pattern = F.array_join(F.transform(words, lambda w: F.when(w.rlike("[0-9]"), "<*>").otherwise(w)), " ")
    rows = events(spark, sf_dir).withColumn("pattern", pattern)
    return rows.withColumn("params", reports.parameters(F.col("message"), F.col("pattern"))).groupBy("pattern").agg(F.count("*").alias("n"), F.countDistinct(F.array_join("params", "|")).alias("kinds"), F.max(F.array_join("params", "|")).alias("last"))


def _paths():
    key = F.col("o_orderkey")
    name = key.cast("string")
    kinds = [F.concat(F.lit("logs\\day\\"), name, F.lit(".log")), F.concat(F.lit("/var/"), name), F.concat(F.lit("C:\\x\\"), name), F.concat(F.lit("a/../"), name), F.concat(F.lit("./ok//"), name), F.lit("")]
    return F.element_at(F.array(*kinds), (key % 6 + 1).cast("int"))


def source_identities(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.source_identity(_paths()).alias("identity"))


def citation_ids(spark, sf_dir):
    key = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("event", "template", "other"))), (key % 3 + 1).cast("int"))
    raw = F.when(key % 7 == 0, F.concat(kind, F.lit(":0"), key.cast("string"))).when(key % 7 == 1, F.concat(kind, F.lit(":99999999999999999999"))).otherwise(text.citation_id(kind, key))
    found, number = text.citation_parts(raw, ("event", "template"))
    return table(spark, sf_dir, "orders").select("o_orderkey", found.alias("kind"), number.cast("string").alias("number"))


_SUFFIXES = ("Z", " UTC", "+02:00", "-0530", " EST", "", " XYZ", ".250Z")
_SHIFTS = (0, 0, -7200, 19_800, None, None, None, 0)


def explicit_times(spark, sf_dir):
    key = F.col("o_orderkey")
    raw = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.element_at(F.array(*map(F.lit, _SUFFIXES)), (key % 8 + 1).cast("int")))
    at, reason = times.explicit_time(F.when(key % 101 == 0, F.lit("1999-02-30 10:00:00Z")).otherwise(raw))
    return table(spark, sf_dir, "orders").select("o_orderkey", at.alias("ts"), reason.alias("reason"))


def rfc3339_times(spark, sf_dir):
    return events(spark, sf_dir).select("seq", times.rfc3339(F.col("ts")).alias("at"))


def recency_scores(spark, sf_dir):
    day = lambda c: F.datediff(F.lit("2001-08-01").cast("date"), F.col(c).cast("date"))
    half = F.when(F.col("o_orderstatus") == "O", 14.0).when(F.col("o_orderstatus") == "F", 90.0).otherwise(365.0)
    valid = times.valid_at(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_custkey") + 500), F.lit(900))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(times.recency(day("o_orderdate"), half), 6).alias("boost"), valid.alias("valid"))


def interval_gaps(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("a"), (F.unix_seconds(F.col("l_shipdate").cast("timestamp")) + F.col("l_quantity").cast("long") * 86_400).alias("b"))
    one = items.where("l_linenumber = 1").groupBy("l_orderkey").agg(F.min(F.struct("a", "b")).alias("x"))
    two = items.where("l_linenumber = 2").groupBy("l_orderkey").agg(F.min(F.struct("a", "b")).alias("y"))
    return one.join(two, "l_orderkey").select("l_orderkey", maths.interval_gap(F.col("x.a"), F.col("x.b"), F.col("y.a"), F.col("y.b")).alias("gap"))


def unit_vectors(spark, sf_dir):
    unit = maths.unit(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(unit[0], 6).alias("first"), F.round(maths.dot(unit, unit), 6).alias("norm"))


def bag_similarity(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.first("text").alias("text")).select("conv_id", "turn", F.explode(text.tokens(F.col("text"))).alias("w"))
    bags = words.groupBy("conv_id", "turn", "w").agg(F.count("*").alias("n")).groupBy("conv_id", "turn").agg(F.map_from_entries(F.collect_list(F.struct("w", "n"))).alias("bag"))
    after = bags.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("bag").alias("later"))
    return bags.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(maths.multiset_jaccard(F.col("bag"), F.col("later")), 6).alias("similarity"))


def cause_chains(spark, sf_dir):
    longer = F.split(F.col("o_orderkey").cast("string"), "")
    shorter = F.split((F.col("o_orderkey") % 10 * 1 + F.col("o_custkey") % 3 * 10).cast("string"), "")
    clean = lambda a: F.filter(a, lambda x: x != "")
    return table(spark, sf_dir, "orders").select("o_orderkey", maths.is_suffix(clean(longer), clean(shorter)).alias("ends"))


def series_steps_back(spark, sf_dir):
    return facts.steps_back(events(spark, sf_dir), "source")


def metric_window(spark, sf_dir):
    return facts.in_range(events(spark, sf_dir), "host", START + 5 * DAY, START + 5 * DAY + 3600)


_GAPS = [(START + d * DAY, START + d * DAY + 3 * 3600) for d in (2, 9, 10, 25)]


def gap_membership(spark, sf_dir):
    inside, clamped = reports.in_gaps(F.col("ts"), _GAPS), reports.clamped(F.col("ts"), START + DAY, START + 27 * DAY)
    return events(spark, sf_dir).where(inside | (clamped != F.col("ts"))).select("seq", inside.alias("in_gap"), clamped.alias("clamped"))


def lane_quality(spark, sf_dir):
    lanes = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("view"), F.col("s_suppkey").alias("lane"))
    loaded = lanes.where("lane % 6 <> 0").select("lane", F.when(F.col("lane") % 5 == 0, "mixed").otherwise("wall").alias("quality"))
    return facts.lane_quality(lanes, loaded)


def conformance_summary(spark, sf_dir):
    code = F.when(F.col("value").isNull(), "no_value").when(F.col("value") < 10, "low_value").when(~F.col("props").rlike(r'"k": ?[0-9]+'), "bad_props").otherwise("ok")
    return table(spark, sf_dir, "events").groupBy(code.alias("code")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def retrieval_diagnostics(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 50 = 0")
    ranking = retrieval.nearest_vectors(vectors, asked, 25).select("query_id", "vec_id", "rank")
    relevant = asked.select(F.col("vec_id").alias("query_id"), "label").join(vectors.where("vec_id % 3 = 0").select("vec_id", "label"), "label").where("query_id <> vec_id").select("query_id", "vec_id")
    return search.diagnostics(ranking, relevant, vectors.where("vec_id % 40 <> 1"), 25, 10)


def group_ablation(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 50 = 0")
    ranking = retrieval.nearest_vectors(vectors, asked, 50).join(vectors.select("vec_id", "label"), "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("label").alias("asked")), "query_id")
    good, decoy = F.col("label") == F.col("asked"), F.col("label") == F.col("asked") + 1
    found = ranking.groupBy("asked").agg(F.countDistinct("query_id").alias("queries"), F.count_if(good & (F.col("rank") <= 10)).alias("p"), F.count_if(decoy & (F.col("rank") <= 25)).alias("d"))
    return found.select("asked", F.round(F.col("p") / (10 * F.col("queries")), 6).alias("precision"), F.round(F.col("d") / (25 * F.col("queries")), 6).alias("decoy_share"))


_UPD = "u AS (SELECT seq, ts AS expected_ts, ts + 3456000 AS new_ts FROM e WHERE seq % 50 = 0)"
_BASIS = "['explicit_wall', 'resolved_local', 'unresolved_local', 'order_only'][CAST(seq % 4 + 1 AS BIGINT)]"
_ASKED_WORDS = "['error', 'user', 'purchase', 'view']"
_OVERLAP = f"len(list_intersect({_ASKED_WORDS}, list_distinct({_WORDS.format('message')})))"
_NEAREST = """n AS (SELECT * FROM (SELECT q.vec_id AS query_id, q.label AS asked, v.vec_id, v.label, round(greatest(0, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id)
  WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {top}), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM n)"""
_DOCS = f"d AS (SELECT doc_id, {_WORDS.format('substr(text, 1, 60)')} AS t, {_WORDS.format('substr(text, 61, 300)')} AS s FROM documents)"

ORACLES = {
    "wall_time_scope": _with(f"SELECT source, {_BASIS} AS basis, count(*) AS n, min(ts) AS first_ts FROM e WHERE seq % 4 < 2 GROUP BY 1, 2"),
    "template_lookup": _with("SELECT CASE WHEN template_id % 2 = 0 THEN 'k=' || template_id ELSE '' END AS pattern, count(*) AS n FROM e GROUP BY 1"),
    "template_facts": _with(f"""SELECT template_id, count(*) AS n, count(*) FILTER (level IN ('error', 'fatal')) AS errors, count(*) FILTER (level = 'warn') AS warnings, count(trace_id) AS traced, min(ts) AS first_ts, max(ts) AS last_ts,
  min(ts) FILTER (level IN ('error', 'fatal')) AS first_error_ts, max(ts) FILTER (level IN ('error', 'fatal')) AS last_error_ts, count(DISTINCT source) AS sources FROM e WHERE template_id IN (SELECT template_id FROM e WHERE ts < {START + DAY}) OR template_id % 10 = 3 GROUP BY 1"""),
    "reduction_ratio": _with("SELECT source, round(count(*) / count(DISTINCT template_id), 6) AS lines_per_template FROM e GROUP BY 1"),
    "problem_scores": _with(f"SELECT template_id, round(max({_SEVERITY}) * ln(1 + count(*)) * CASE WHEN count(*) <= 2 THEN 1.5::DOUBLE ELSE 1 END, 6) AS score FROM e GROUP BY 1"),
    "ingest_confidence": _with(f"SELECT source, CASE template_id % 5 WHEN 0 THEN 'plain' WHEN 1 THEN 'json' ELSE 'logfmt' END AS outcome, {_BASIS} AS reason, count(*) AS n FROM e GROUP BY 1, 2, 3"),
    "suppression_preview": _with("""SELECT template_id, count(*) AS n, count(DISTINCT source) AS sources, min(ts) AS first_ts, max(ts) AS last_ts,
  (SELECT string_agg(level || ':' || c, ',' ORDER BY level) FROM (SELECT level, count(*) AS c FROM e y WHERE y.template_id = x.template_id GROUP BY 1)) AS levels, array_to_string(list(seq ORDER BY ts, seq)[1:3], ',') AS shown FROM e x WHERE template_id IN (3, 7, 11, 42) GROUP BY 1"""),
    "report_counts": "SELECT l_returnflag, count(DISTINCT l_orderkey) AS cases, count(DISTINCT l_suppkey) AS models, count(DISTINCT (l_suppkey, l_partkey)) AS pairs, count(*) AS runs FROM lineitem GROUP BY 1",
    "revised_event_stats": _with("SELECT CAST(count(t) AS BIGINT) AS n, min(t) AS first_ts, max(t) AS last_ts FROM (SELECT ts + CASE WHEN seq % 50 = 0 THEN 3456000 ELSE 0 END AS t FROM e)"),
    "revision_undo": _with("SELECT seq, ts + CASE WHEN seq % 50 = 0 AND seq % 100 <> 0 THEN 3456000 ELSE 0 END AS ts FROM e"),
    "revision_audit": _with("SELECT seq, seq % 150 <> 0 AND seq % 350 <> 0 AS holds FROM e WHERE seq % 50 = 0"),
    "multiset_difference": _with(f"""SELECT side, level, template_id, count(*) AS n FROM (
  SELECT 'a' AS side, * FROM (SELECT level, template_id FROM e WHERE ts BETWEEN {START + DAY} AND {START + 2 * DAY - 1} EXCEPT ALL SELECT level, template_id FROM e WHERE ts BETWEEN {START + 2 * DAY} AND {START + 3 * DAY - 1})
  UNION ALL SELECT 'b' AS side, * FROM (SELECT level, template_id FROM e WHERE ts BETWEEN {START + 2 * DAY} AND {START + 3 * DAY - 1} EXCEPT ALL SELECT level, template_id FROM e WHERE ts BETWEEN {START + DAY} AND {START + 2 * DAY - 1})) GROUP BY 1, 2, 3"""),
    # Winter throughout, so the zone is six hours behind.
    "timezone_apply": _with("SELECT seq, ts + CASE WHEN source = 'src1' THEN 21600 ELSE 0 END AS ts, CASE WHEN source = 'src1' THEN 'resolved' END AS reason FROM e"),
    "inventory_diff": "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'added' WHEN doc_id % 13 = 0 THEN 'removed' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS fate FROM documents WHERE NOT (doc_id % 11 = 0 AND doc_id % 13 = 0)",
    "embedding_plan": "SELECT doc_id, sha256(coalesce(text, '')) AS content FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0 ORDER BY doc_id LIMIT 2048",
    "inbox_batch": "SELECT conv_id, turn, length(coalesce(text, '')) % 100 AS confidence, turn * 17 % 100 AS salience FROM conversations WHERE confidence >= 70 AND salience >= 30",
    "pool_recall": """WITH h AS (SELECT conv_id % 2 AS pool, conv_id * 1000 + turn AS id, CAST(length(coalesce(text, '')) % 7 AS DOUBLE) AS keyword, ((conv_id * 7 + turn * 13) % 100)::DOUBLE / 100 AS near, CASE WHEN turn % 3 = 0 THEN conv_id % 50 END AS f, CASE WHEN turn % 4 = 0 THEN conv_id % 60 END AS t FROM conversations)
SELECT pool, id, round(0.6::DOUBLE * keyword / (SELECT max(keyword) FROM h x WHERE x.pool = h.pool) + 0.4::DOUBLE * near, 6) AS score FROM h WHERE keyword > 0 OR (coalesce(f <= 25, true) AND coalesce(t > 25, true))""",
    "neighbour_expansion": """WITH g AS (SELECT l_partkey AS source, l_suppkey + 10000000 AS target, CAST(sum(l_quantity) AS BIGINT) AS weight FROM lineitem GROUP BY 1, 2),
h AS (SELECT p_partkey AS id, p_size::DOUBLE / 50 AS score FROM part WHERE p_partkey % 97 = 0 UNION ALL SELECT s_suppkey + 10000000, 0.5 FROM supplier WHERE s_suppkey % 9 = 0),
n AS (SELECT h.id, h.score, CASE WHEN g.source = h.id THEN g.target ELSE g.source END AS other, weight FROM h JOIN g ON g.source = h.id OR g.target = h.id),
r AS (SELECT other AS id, score * 0.85::DOUBLE AS score, true AS reached FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY weight DESC, other) <= 4)
SELECT id, round(max(score), 6) AS score, bool_and(reached) AS reached FROM (SELECT id, score, false AS reached FROM h UNION ALL SELECT id, score, reached FROM r) GROUP BY 1""",
    "lane_sources": "SELECT s_suppkey, array_to_string(list_sort(list_intersect(['src' || (s_suppkey % 8), 'src' || ((s_suppkey + 1) % 8), 'src' || ((s_suppkey + 4) % 8), 'src' || ((s_suppkey + 9) % 8)], ['src0', 'src2', 'src3', 'src5'])), ',') AS sources FROM supplier",
    "uncited_evidence": "SELECT p_partkey AS evidence, p_brand FROM part WHERE p_size > 10 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)",
    "watchers_due": """WITH w AS (SELECT c_custkey AS id, greatest(c_custkey % 30 * 86400 * 20, 60) AS every, CAST(list_reduce(list_transform(range(7, -1, -1), lambda i: CAST('0x' || substr(sha256(c_custkey::VARCHAR), 2 * i + 1, 2) AS BIGINT)::HUGEINT), lambda a, b: a * 256 + b) % (least(greatest(greatest(c_custkey % 30 * 86400 * 20, 60) // 10, 1), 60) + 1) AS BIGINT) AS jitter FROM customer WHERE c_mktsegment <> 'BUILDING'),
r AS (SELECT o_custkey AS id, max(CAST(floor(epoch(o_orderdate)) AS BIGINT)) AS last_ts FROM orders GROUP BY 1)
SELECT id, last_ts, jitter FROM w LEFT JOIN r USING (id) WHERE last_ts IS NULL OR 1000000000 - last_ts >= every + jitter""",
    "stale_leases": "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1996-06-30 00:00:00'",
    "source_ranking": _with("SELECT source, CAST(CASE WHEN source IN ('src0', 'src4') THEN 20 ELSE 10 END + CASE WHEN count(*) FILTER (contains(message, 'error')) * 5 > count(*) THEN 5 ELSE 0 END AS BIGINT) AS score FROM e GROUP BY 1 ORDER BY score DESC, source LIMIT 5"),
    "page_with_total": _with("SELECT ts, seq, message, count(*) OVER () AS total FROM e WHERE level = 'error' ORDER BY ts, seq LIMIT 50"),
    "ordered_search": _with(f"SELECT seq, {_OVERLAP} AS score FROM e WHERE score > 0 ORDER BY score DESC, seq LIMIT 500"),
    "template_search": _with(f""", r AS (SELECT template_id, seq, {_OVERLAP} / 4 AS keyword, (template_id * 37 % 100)::DOUBLE / 100 AS near, {_SEVERITY} AS severity, contains(lower(message), '{ASKED}') AS phrase FROM e),
b AS (SELECT template_id, round(0.45::DOUBLE * max(keyword) + 0.45::DOUBLE * max(near) + 0.1::DOUBLE * max(severity) / 5, 6) AS score FROM r GROUP BY 1 ORDER BY score DESC, template_id LIMIT 100)
SELECT template_id, any_value(score) AS score, array_to_string(list(seq ORDER BY phrase DESC, keyword DESC, seq)[1:3], ',') AS exemplars FROM b JOIN r USING (template_id) GROUP BY 1""").replace("FROM events)\n,", "FROM events),"),
    "feed_scores": f"""WITH {_DOCS}, q AS (SELECT unnest(['the', 'that', 'thing', 'license', 'token']) AS w),
m AS (SELECT doc_id, w, list_contains(t, w) AS a, list_contains(s, w) AS b FROM d, q)
SELECT doc_id, CAST(CASE WHEN count(*) FILTER (a OR b) < 2 THEN 0 ELSE sum(CASE WHEN a THEN 2 WHEN b THEN 1 ELSE 0 END) END AS BIGINT) AS score, count(*) FILTER (b AND w IN ('the', 'that', 'thing')) AS overlap FROM m GROUP BY 1""",
    "otel_levels": _with("SELECT CASE level WHEN 'debug' THEN 5 WHEN 'info' THEN 9 WHEN 'warn' THEN 13 WHEN 'error' THEN 17 END AS otel, count(*) AS n FROM e GROUP BY 1"),
    "template_params": _with("""SELECT array_to_string(list_transform(string_split(message, ' '), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END), ' ') AS pattern, count(*) AS n, count(DISTINCT array_to_string(list_filter(string_split(message, ' '), lambda w: regexp_matches(w, '[0-9]')), '|')) AS kinds,
  max(array_to_string(list_filter(string_split(message, ' '), lambda w: regexp_matches(w, '[0-9]')), '|')) AS last FROM e GROUP BY 1"""),
    "source_identities": "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'logs/day/' || o_orderkey || '.log' WHEN 4 THEN 'ok/' || o_orderkey END AS identity FROM orders",
    "citation_ids": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 1 THEN ['event', 'template'][CAST(o_orderkey % 3 + 1 AS BIGINT)] END AS kind, CASE WHEN o_orderkey % 7 > 1 AND o_orderkey % 3 < 2 THEN CAST(o_orderkey AS VARCHAR) END AS number FROM orders",
    "explicit_times": """SELECT o_orderkey, CASE WHEN o_orderkey % 101 <> 0 THEN CAST(epoch(o_orderdate) AS BIGINT) + [0, 0, -7200, 19800, NULL, NULL, NULL, 0][CAST(o_orderkey % 8 + 1 AS BIGINT)] END AS ts,
  CASE WHEN o_orderkey % 101 = 0 OR o_orderkey % 8 = 6 THEN 'none' WHEN o_orderkey % 8 IN (4, 5) THEN 'unresolved_local' ELSE 'explicit' END AS reason FROM orders""",
    "rfc3339_times": _with("SELECT seq, strftime(make_timestamp(ts * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS at FROM e"),
    "recency_scores": """SELECT o_orderkey, round(1 / (1 + date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') / CASE o_orderstatus WHEN 'O' THEN 14.0::DOUBLE WHEN 'F' THEN 90.0 ELSE 365.0 END), 6) AS boost,
  coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END <= 900, true) AND coalesce(900 < CASE WHEN o_orderkey % 4 = 0 THEN o_custkey + 500 END, true) AS valid FROM orders""",
    "interval_gaps": """WITH i AS (SELECT l_orderkey, l_linenumber AS l, min((CAST(floor(epoch(l_shipdate)) AS BIGINT), CAST(floor(epoch(l_shipdate)) AS BIGINT) + CAST(l_quantity AS BIGINT) * 86400)) AS s FROM lineitem WHERE l_linenumber < 3 GROUP BY 1, 2)
SELECT x.l_orderkey, greatest(0, y.s[1] - x.s[2], x.s[1] - y.s[2]) AS gap FROM i x JOIN i y ON x.l_orderkey = y.l_orderkey AND x.l = 1 AND y.l = 2""",
    "unit_vectors": "SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first, 1.0::DOUBLE AS norm FROM embeddings",
    "bag_similarity": f"""WITH t AS (SELECT conv_id, turn, any_value(text) AS text FROM conversations GROUP BY 1, 2), w AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest({_WORDS.format('text')}) AS w FROM t) GROUP BY 1, 2, 3),
c AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.turn, b.turn - 1) AS turn, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM w a FULL JOIN w b ON a.conv_id = b.conv_id AND a.turn = b.turn - 1 AND a.w = b.w)
SELECT conv_id, turn, round(sum(least(x, y)) / sum(greatest(x, y)), 6) AS similarity FROM c GROUP BY 1, 2 HAVING sum(x) > 0 AND sum(y) > 0""",
    "cause_chains": "SELECT o_orderkey, suffix(CAST(o_orderkey AS VARCHAR), CAST(o_orderkey % 10 + o_custkey % 3 * 10 AS VARCHAR)) AS ends FROM orders",
    "series_steps_back": _with("SELECT source, CAST(sum(CASE WHEN p >= ts THEN 1 ELSE 0 END) AS BIGINT) AS back FROM (SELECT source, ts, lag(ts) OVER (PARTITION BY source ORDER BY seq) AS p FROM e) GROUP BY 1"),
    "metric_window": _with(f""", p AS (SELECT host, ts, seq, ts BETWEEN {START + 5 * DAY} AND {START + 5 * DAY + 3600} AS i FROM e)
SELECT host, ts, seq, NOT i AS neighbour FROM p WHERE i UNION ALL (SELECT host, ts, seq, true FROM p WHERE ts < {START + 5 * DAY} QUALIFY row_number() OVER (PARTITION BY host ORDER BY ts DESC, seq DESC) = 1)
UNION ALL (SELECT host, ts, seq, true FROM p WHERE ts > {START + 5 * DAY + 3600} QUALIFY row_number() OVER (PARTITION BY host ORDER BY ts, seq) = 1)""").replace("FROM events)\n,", "FROM events),"),
    "gap_membership": _with(f"""SELECT seq, {' OR '.join(f'ts BETWEEN {a} AND {b}' for a, b in _GAPS)} AS in_gap, greatest({START + DAY}, least({START + 27 * DAY}, ts)) AS clamped FROM e WHERE in_gap OR clamped <> ts"""),
    "lane_quality": "SELECT s_nationkey AS view, ['wall', 'mixed', 'order_only'][max(CASE WHEN s_suppkey % 6 = 0 THEN 3 WHEN s_suppkey % 5 = 0 THEN 2 ELSE 1 END)] AS quality FROM supplier GROUP BY 1",
    "conformance_summary": """SELECT CASE WHEN value IS NULL THEN 'no_value' WHEN value < 10 THEN 'low_value' WHEN NOT regexp_matches(props, '"k": ?[0-9]+') THEN 'bad_props' ELSE 'ok' END AS code, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1""",
    "retrieval_diagnostics": f"""WITH {_NEAREST.format(top=25)}, g AS (SELECT q.vec_id AS query_id, v.vec_id FROM embeddings q JOIN embeddings v ON v.label = q.label AND v.vec_id <> q.vec_id AND v.vec_id % 3 = 0 WHERE q.vec_id % 50 = 0)
SELECT query_id, CASE WHEN w IS NULL THEN 0 ELSE round(h::DOUBLE / w, 6) END AS recall, lost, foreign_ids FROM (SELECT query_id, count(*) FILTER (g.vec_id IS NOT NULL AND rank <= 10) AS h, count(*) FILTER (g.vec_id IS NOT NULL AND rank > 10) AS lost, count(*) FILTER (vec_id % 40 = 1) AS foreign_ids FROM k LEFT JOIN g USING (query_id, vec_id) GROUP BY 1)
LEFT JOIN (SELECT query_id, count(*) AS w FROM g GROUP BY 1) USING (query_id)""",
    "group_ablation": f"WITH {_NEAREST.format(top=50)} SELECT asked, round(count(*) FILTER (label = asked AND rank <= 10)::DOUBLE / (10 * count(DISTINCT query_id)), 6) AS precision, round(count(*) FILTER (label = asked + 1 AND rank <= 25)::DOUBLE / (25 * count(DISTINCT query_id)), 6) AS decoy_share FROM k GROUP BY 1",
}

QUERIES = {name: globals()[name] for name in ORACLES}
