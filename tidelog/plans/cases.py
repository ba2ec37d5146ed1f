"""Queries over evidence, sessions, episodes and templates, and their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import levels
from ..operators import episodes, evidence, selection, templates
from ..sources.events import events, table
from .events import DAY, EVENTS, START

TERMS = ("river", "data", "the")


def template_mining(spark, sf_dir):
    return templates.templates(events(spark, sf_dir), levels.severity(F.col("level")))


def error_episodes(spark, sf_dir):
    return episodes.episodes(events(spark, sf_dir).where("level = 'error'"), ["source", "host"], 40, 3600, 5000)


def session_search(spark, sf_dir):
    title, pinned, age = F.when(F.col("turn") == 0, F.col("text")), F.col("conv_id") % 7 == 0, F.col("conv_id") % 1000
    return selection.sessions(table(spark, sf_dir, "conversations"), "conv_id", list(TERMS), title, pinned, age, 100)


def ambient_selection(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("length"), (F.col("role") == "system").alias("echoed"))
    hits = turns.withColumn("score", (F.col("length") % 10) / 10.0)
    return selection.within_budget(hits, "conv_id", [F.desc("score"), "turn", "length"], 600, 3, 0.2).select("conv_id", "turn", "length", "decision")


def exact_fetch(spark, sf_dir):
    return evidence.fetched(events(spark, sf_dir), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seq"))).select("seq", "ts", "message")


def delta_feed(spark, sf_dir):
    return evidence.delta(events(spark, sf_dir), "ts", "seq", START + 3 * DAY).select("seq", "ts")


def resident_window(spark, sf_dir):
    rows = events(spark, sf_dir).select("seq", "ts", "message")
    return evidence.resident(rows.where(F.col("ts") < START + 6 * DAY), rows.where(F.col("ts") >= START + 4 * DAY), 500)


def contribution_reconcile(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.collect_set("l_suppkey").alias("evidence"))
    key = F.col("l_orderkey")
    claims = lines.select(F.col("l_returnflag").alias("candidate"), F.lit("cause").alias("kind"), "evidence", (key % 2).alias("role"), (key % 16).alias("model"), (key % 3).alias("gateway"))
    found = evidence.reconciled(claims)
    return found.withColumn("evidence", F.array_join(F.col("evidence").cast("array<string>"), ","))


def trace_comparison(spark, sf_dir):
    cited = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("candidate"), F.col("l_partkey").alias("evidence"))
    return evidence.compared_traces(cited, table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("evidence")))


def turn_telemetry(spark, sf_dir):
    quantity = F.col("l_quantity").cast("long")
    rounds = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("turn"), F.col("l_linenumber").alias("at"), F.when(quantity <= 45, quantity).alias("prompt_tokens"), F.when(quantity > 10, quantity).alias("reasoning_chars"),
        F.when(F.col("l_returnflag") == "R", "failed").otherwise("completed").alias("outcome"), F.col("l_linestatus").alias("finish_reason"), F.col("l_suppkey").alias("route"),
    )
    return evidence.telemetry(rounds, "turn", "at", ["prompt_tokens"], ["reasoning_chars"], "outcome", ["finish_reason", "route"])


def bookmark_resolution(spark, sf_dir):
    rows = events(spark, sf_dir)
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bookmark"), (F.col("l_suppkey") * 3).alias("seq"))
    known = rows.select("seq", (F.col("ts") + F.when(F.col("seq") % 30 == 0, 1).otherwise(0)).alias("expected_ts"))
    return evidence.resolved(refs.join(known, "seq", "left"), rows)


def memory_log(spark, sf_dir):
    deed = F.when(F.col("o_orderkey") % 50 == 0, "purge").when(F.col("o_orderkey") % 9 == 0, "retract").otherwise("write")
    return evidence.written(table(spark, sf_dir, "orders").withColumn("deed", deed), "o_custkey", "o_orderkey", "o_orderpriority", "deed")


def lane_assignment(spark, sf_dir):
    return evidence.lanes(events(spark, sf_dir), F.coalesce("service", "source"), "seq")


def host_evidence_filter(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"))
    return evidence.accepted(ids, table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("id")), "id")


_SAID = ", ".join(f"max(contains(lower(coalesce(text, '')), '{t}')::INT) AS s{i}, max(contains(lower(coalesce(CASE WHEN turn = 0 THEN text END, '')), '{t}')::INT) AS t{i}" for i, t in enumerate(TERMS))
_HITS = " + ".join(f"s{i} + 4 * t{i}" for i in range(len(TERMS)))

ORACLES = {
    "error_episodes": f"""WITH {EVENTS}, b AS (SELECT *, coalesce(seq - lag(seq) OVER w > 40 OR abs(ts - lag(ts) OVER w) > 3600, true)::INT AS b FROM e WHERE level = 'error' WINDOW w AS (PARTITION BY source, host ORDER BY seq)),
  n AS (SELECT *, CAST(sum(b) OVER (PARTITION BY source, host ORDER BY seq) AS BIGINT) AS episode FROM b) SELECT source, host, episode, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM n GROUP BY 1, 2, 3""",
    "session_search": f"""WITH s AS (SELECT conv_id, {_SAID} FROM conversations GROUP BY 1), h AS (SELECT conv_id, {_HITS} AS hits FROM s)
SELECT conv_id, round(hits + CASE WHEN conv_id % 7 = 0 THEN 0.25::DOUBLE ELSE 0 END + 0.5::DOUBLE / (1 + (conv_id % 1000) / 720.0::DOUBLE), 6) AS score FROM h WHERE hits > 0 ORDER BY score DESC, conv_id LIMIT 100""",
    "ambient_selection": """WITH h AS (SELECT conv_id, turn, length(coalesce(text, '')) AS length, length(coalesce(text, '')) % 10 AS s, coalesce(role = 'system', false) AS echoed FROM conversations),
  f AS (SELECT *, s >= 2 AND NOT echoed AS fit, row_number() OVER (PARTITION BY conv_id ORDER BY s DESC, turn, length) AS r FROM h),
  c AS (SELECT *, sum(fit::INT) OVER w AS pos, sum(CASE WHEN fit THEN length ELSE 0 END) OVER w AS chars FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY r)),
  z AS (SELECT *, CASE WHEN fit AND chars > 600 AND pos > 1 THEN 'char_budget' WHEN fit AND pos > 3 THEN 'max_items' END AS stop FROM c),
  y AS (SELECT conv_id, min(r) AS r, arg_min(stop, r) AS why FROM z WHERE stop IS NOT NULL GROUP BY 1)
SELECT z.conv_id, turn, length, CASE WHEN z.r >= y.r THEN why WHEN fit THEN 'selected' WHEN s < 2 THEN 'below_min_score' ELSE 'echo_suppressed' END AS decision FROM z LEFT JOIN y ON z.conv_id = y.conv_id""",
    "exact_fetch": f"WITH {EVENTS} SELECT seq, ts, message FROM e WHERE seq IN (SELECT s_suppkey FROM supplier)",
    "delta_feed": f"WITH {EVENTS} SELECT seq, ts FROM e WHERE ts > {START + 3 * DAY} ORDER BY ts, seq LIMIT 1000",
    "resident_window": f"WITH {EVENTS} SELECT DISTINCT seq, ts, message FROM e ORDER BY ts DESC, seq DESC LIMIT 500",
    "contribution_reconcile": """WITH l AS (SELECT l_orderkey, l_returnflag AS candidate, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS evidence FROM lineitem GROUP BY 1, 2)
SELECT candidate, 'cause' AS kind, evidence, count(*) AS claims, count(DISTINCT l_orderkey % 2) AS roles, count(DISTINCT l_orderkey % 16) AS models, count(DISTINCT l_orderkey % 3) AS gateways, models >= 2 AS agreed FROM l GROUP BY 1, 2, 3""",
    "trace_comparison": """WITH p AS (SELECT DISTINCT l_suppkey AS candidate, l_partkey AS evidence FROM lineitem), s AS (SELECT evidence, count(*) AS n FROM p GROUP BY 1)
SELECT candidate, count(*) AS cited, count(*) FILTER (n > 1) AS shared, count(*) FILTER (n = 1) AS alone, count(*) FILTER (evidence IN (SELECT p_partkey FROM part WHERE p_size > 25)) AS in_gold FROM p JOIN s USING (evidence) GROUP BY 1""",
    "turn_telemetry": """WITH r AS (SELECT l_orderkey AS turn, l_linenumber AS line, CAST(floor(l_quantity) AS BIGINT) AS q, l_returnflag <> 'R' AS done, l_linestatus AS finish_reason, l_suppkey AS route FROM lineitem),
  f AS (SELECT turn, finish_reason, route FROM r WHERE done QUALIFY row_number() OVER (PARTITION BY turn ORDER BY line DESC, finish_reason DESC, route DESC) = 1)
SELECT turn, count(*) AS rounds, CAST(CASE WHEN bool_and(q <= 45) THEN sum(q) END AS BIGINT) AS prompt_tokens, CAST(sum(CASE WHEN q > 10 THEN q END) AS BIGINT) AS reasoning_chars, any_value(f.finish_reason) AS finish_reason, any_value(f.route) AS route FROM r LEFT JOIN f USING (turn) GROUP BY 1""",
    "bookmark_resolution": f"""WITH {EVENTS}, r AS (SELECT DISTINCT l_orderkey AS bookmark, l_suppkey * 3 AS seq FROM lineitem)
SELECT bookmark, count(*) AS n_refs, count(*) FILTER (e.seq IS NULL) AS missing, count(*) FILTER (e.seq % 30 <> 0) AS valid, CASE WHEN valid = n_refs THEN 'valid' ELSE 'stale' END AS status FROM r LEFT JOIN e ON e.seq = r.seq GROUP BY 1""",
    "memory_log": """WITH o AS (SELECT *, CASE WHEN o_orderkey % 50 = 0 THEN 'purge' WHEN o_orderkey % 9 = 0 THEN 'retract' ELSE 'write' END AS deed FROM orders)
SELECT o_custkey, count(*) AS revisions, CASE WHEN bool_or(deed = 'purge') THEN 'purged' WHEN arg_max(deed, o_orderkey) = 'retract' THEN 'retracted' ELSE 'active' END AS status, CASE WHEN status = 'active' THEN arg_max(o_orderpriority, o_orderkey) END AS value FROM o GROUP BY 1""",
    "lane_assignment": f"""WITH {EVENTS}, g AS (SELECT coalesce(service, source) AS "group", count(*) AS n, min(seq) AS f FROM e GROUP BY 1), r AS (SELECT *, CAST(row_number() OVER (ORDER BY f, "group") AS INT) AS r FROM g)
SELECT "group", n, CASE WHEN r <= 4 THEN r END AS lane FROM r""",
    "host_evidence_filter": "SELECT DISTINCT l_partkey AS id, l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 25) AS accepted FROM lineitem",
}

#: Rows only: the fold over skeletons is held against brute force in tests.
ROWS_ONLY = {"template_mining": template_mining}

QUERIES = {name: globals()[name] for name in ORACLES} | ROWS_ONLY
