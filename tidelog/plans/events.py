"""Queries over the event table, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import levels
from ..operators import incidents, noise, pages, quality, records, timelines
from ..operators.filters import EventFilter
from ..sources.events import events

#: The event table in SQL, as sources.events makes it.
EVENTS = """e AS (SELECT event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS ts,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' WHEN 'view' THEN 'debug' ELSE 'info' END AS level,
  event_type AS service, 'h' || (user_id % 4) AS host, CAST(props->>'k' AS BIGINT) AS template_id,
  'u' || user_id || '-' || CAST(floor(floor(epoch(ts)) / 86400) AS BIGINT) AS trace_id,
  event_type || ' k=' || (props->>'k') || ' user=' || user_id AS message, 'src' || (user_id % 8) AS source, value FROM events)"""

DAY = 86_400
SHOWN = EventFilter(levels=["error", "warn"], excluded_templates=[3, 7], sources=["src1", "src2", "src5"])
_SHOWN = "level IN ('error', 'warn') AND template_id NOT IN (3, 7) AND source IN ('src1', 'src2', 'src5')"
START = 1_704_067_200  # a fixed day; windows below are relative to it
LANES = {"one": ["src0", "src1"], "two": ["src2"], "three": ["src3", "src4", "src5"]}
COLUMNS = ("seq", "ts", "level", "source", "template_id", "message")


def _with(body: str) -> str:
    return f"WITH {EVENTS}\n{body}"


def event_filter_page(spark, sf_dir):
    return pages.page(events(spark, sf_dir), SHOWN, 200).select(*COLUMNS)


def event_page_reverse(spark, sf_dir):
    return pages.page(events(spark, sf_dir), SHOWN, 100, before=(START + 20 * DAY, 0)).select(*COLUMNS)


def event_page_after(spark, sf_dir):
    return pages.page(events(spark, sf_dir), SHOWN, 100, after=(START + 5 * DAY, 0)).select(*COLUMNS)


def event_keyword(spark, sf_dir):
    return EventFilter(keyword="USER=1").apply(events(spark, sf_dir)).select("seq", "message")


def event_keyword_wildcard(spark, sf_dir):
    return EventFilter(keyword="k=_ user", wildcards=True).apply(events(spark, sf_dir)).select("seq", "message")


def event_case_sensitive(spark, sf_dir):
    return EventFilter(literal="error k=1").apply(events(spark, sf_dir)).select("seq", "message")


def event_regex(spark, sf_dir):
    return EventFilter(pattern="^(click|error) k=[0-4]+ ").apply(events(spark, sf_dir)).select("seq", "message")


def event_service_null(spark, sf_dir):
    return EventFilter(services=["", "signup"], hosts=["h1"], seq_from=10, ts_from=START).apply(events(spark, sf_dir)).select("seq", "service")


def event_neighborhood(spark, sf_dir):
    rows = events(spark, sf_dir)
    at = rows.where("seq = 500").select("ts").first()
    return pages.neighbourhood(rows, EventFilter(), (at["ts"] if at else 0, 500), 20).select("seq", "ts", "side")


def source_catalog_page(spark, sf_dir):
    return pages.source_catalogue(events(spark, sf_dir), "SRC", "src1", 5)


def facets_all_dims(spark, sf_dir):
    return pages.facets(events(spark, sf_dir), SHOWN)


def timeline_fixed(spark, sf_dir):
    return timelines.fixed(events(spark, sf_dir), 3600)


def timeline_bounded(spark, sf_dir):
    return timelines.bounded(events(spark, sf_dir))


def timeline_coarsened(spark, sf_dir):
    return timelines.coarsened(events(spark, sf_dir))


def timeline_shared_lanes(spark, sf_dir):
    out = timelines.dense_lanes(events(spark, sf_dir), LANES, 24)
    return out.select("lane", "series", F.posexplode("counts").alias("bucket", "n"))


def template_frequency(spark, sf_dir):
    return incidents.template_frequency(events(spark, sf_dir))


def error_by_service(spark, sf_dir):
    return incidents.errors_by_service(events(spark, sf_dir))


def cooccurrence_top(spark, sf_dir):
    return incidents.co_occurrence(events(spark, sf_dir), 3600, 20)


def cross_source_traces(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("trace_id", F.concat("host", F.lit("-"), F.floor(F.col("ts") / 3600).cast("string")))
    return incidents.cross_source_traces(rows)


def trace_follow(spark, sf_dir):
    rows = events(spark, sf_dir)
    return incidents.follow(rows.withColumn("trace_id", F.concat(F.lit("h"), F.pmod("seq", F.lit(97)).cast("string"))), "h5")


def correlate_focus(spark, sf_dir):
    return incidents.correlate(events(spark, sf_dir), [4, 11], 600, 20)


def anomalies_windows(spark, sf_dir):
    return incidents.anomalies(events(spark, sf_dir), (START, START + 5 * DAY), (START + 5 * DAY, START + 25 * DAY))


def templates_in_range(spark, sf_dir):
    return incidents.templates_in_range(events(spark, sf_dir), START + DAY, START + 2 * DAY)


def lane_scrub_asof(spark, sf_dir):
    return incidents.scrub(events(spark, sf_dir), START + 10 * DAY)


def lane_alignment(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("ts", F.floor(F.col("ts") / 3600) * 3600)
    return incidents.aligned(rows, "src1", "src2")


def lane_gaps(spark, sf_dir):
    return incidents.lane_gaps(events(spark, sf_dir), ["src1", "src2", "src3"], 3600)


def noise_facts(spark, sf_dir):
    return noise.facts(events(spark, sf_dir))


def noise_scores(spark, sf_dir):
    return noise.scores(noise.facts(events(spark, sf_dir)))


def noise_levels(spark, sf_dir):
    return noise.level_counts(events(spark, sf_dir), 2)


def noise_representatives(spark, sf_dir):
    return noise.representatives(events(spark, sf_dir))


def quality_sources(spark, sf_dir):
    return quality.by_source(events(spark, sf_dir))


def quality_concentration(spark, sf_dir):
    return quality.concentration(events(spark, sf_dir))


def quality_grade(spark, sf_dir):
    rows = events(spark, sf_dir)
    sources = rows.select("source").distinct().withColumn("selected", F.col("source") != "src7")
    return quality.grade(rows, F.col("template_id") % 5 != 0, sources)


def metric_downsample(spark, sf_dir):
    return records.downsampled(events(spark, sf_dir), "service", 6 * 3600)


def revision_apply(spark, sf_dir):
    rows = events(spark, sf_dir)
    changes = rows.where("seq % 10 = 0").select("seq", F.when(F.col("seq") % 20 == 0, F.col("ts")).otherwise(F.col("ts") + 1).alias("expected_ts"), (F.col("ts") - 3600).alias("new_ts"))
    return records.revised(rows, changes)


def level_normalize(spark, sf_dir):
    rows = events(spark, sf_dir)
    raw = F.element_at(F.array(*map(F.lit, ("WARNING", " err ", "Severe", "dbg", "NOTICE", "panic", "", "custom"))), (F.pmod("seq", F.lit(8)) + 1).cast("int"))
    return rows.select("seq", levels.normalize(raw).alias("level"), levels.severity(raw).cast("long").alias("severity"))


_FACTS = """m AS (SELECT template_id, floor(ts / 60) AS minute, count(*) AS n FROM e GROUP BY 1, 2),
p AS (SELECT template_id, count(*) AS minutes, max(n) AS peak FROM m GROUP BY 1),
f AS (SELECT e.template_id, count(*) AS n, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warn') AS warns, count(*) FILTER (level = 'info') AS infos,
  min(ts) AS first_ts, max(ts) AS last_ts, any_value(minutes) AS minutes, any_value(peak) AS peak, count(DISTINCT source) AS sources FROM e JOIN p USING (template_id) GROUP BY 1)"""

ORACLES = {
    "event_filter_page": _with(f"SELECT seq, ts, level, source, template_id, message FROM e WHERE {_SHOWN} ORDER BY ts, seq LIMIT 200"),
    "event_page_reverse": _with(f"SELECT seq, ts, level, source, template_id, message FROM e WHERE {_SHOWN} AND ts < {START + 20 * DAY} ORDER BY ts DESC, seq DESC LIMIT 100"),
    "event_page_after": _with(f"SELECT seq, ts, level, source, template_id, message FROM e WHERE {_SHOWN} AND (ts > {START + 5 * DAY} OR ts = {START + 5 * DAY} AND seq > 0) ORDER BY ts, seq LIMIT 100"),
    "event_keyword": _with("SELECT seq, message FROM e WHERE contains(lower(message), 'user=1')"),
    "event_keyword_wildcard": _with("SELECT seq, message FROM e WHERE lower(message) LIKE '%k=_ user%'"),
    "event_case_sensitive": _with("SELECT seq, message FROM e WHERE contains(message, 'error k=1')"),
    "event_regex": _with("SELECT seq, message FROM e WHERE regexp_matches(message, '^(click|error) k=[0-4]+ ')"),
    "event_service_null": _with(f"SELECT seq, service FROM e WHERE coalesce(service, '') IN ('', 'signup') AND host = 'h1' AND seq >= 10 AND ts >= {START}"),
    "event_neighborhood": _with("""SELECT seq, ts, side FROM (
  (SELECT seq, ts, -1 AS side FROM e WHERE (ts, seq) < (SELECT (ts, seq) FROM e WHERE seq = 500) ORDER BY ts DESC, seq DESC LIMIT 20)
  UNION ALL (SELECT seq, ts, 0 FROM e WHERE seq = 500)
  UNION ALL (SELECT seq, ts, 1 FROM e WHERE (ts, seq) > (SELECT (ts, seq) FROM e WHERE seq = 500) ORDER BY ts, seq LIMIT 20))"""),
    "source_catalog_page": _with("SELECT source, count(*) AS n FROM e WHERE contains(source, 'src') AND source > 'src1' GROUP BY 1 ORDER BY 1 LIMIT 5"),
    "facets_all_dims": _with(f"""SELECT dimension, value, n, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value) AS rank FROM (
  SELECT 'source' AS dimension, source AS value, count(*) AS n FROM e WHERE {_SHOWN} GROUP BY 2 UNION ALL SELECT 'level', level, count(*) FROM e WHERE {_SHOWN} GROUP BY 2
  UNION ALL SELECT 'service', service, count(*) FROM e WHERE {_SHOWN} GROUP BY 2 UNION ALL SELECT 'host', host, count(*) FROM e WHERE {_SHOWN} GROUP BY 2) QUALIFY rank <= 200"""),
    "timeline_fixed": _with("SELECT CAST(floor(ts / 3600) * 3600 AS BIGINT) AS bucket, level, count(*) AS n FROM e GROUP BY 1, 2"),
    "timeline_bounded": _with("""SELECT bucket, low + bucket * width AS start, least(low + (bucket + 1) * width, high + 1) AS end, level, count(*) AS n, width FROM (
  SELECT CAST(floor((ts - low) / width) AS BIGINT) AS bucket, * FROM e, (SELECT min(ts) AS low, max(ts) AS high, (max(ts) - min(ts) + 1 + 95) // 96 AS width FROM e)) GROUP BY ALL""").replace("AS end,", 'AS "end",'),
    "timeline_coarsened": _with("""SELECT ts - ts % width AS start, level, count(*) AS n, width FROM e, (
  SELECT coalesce(min(w) FILTER (floor(high / w) - floor(low / w) + 1 <= 512), 2592000)::BIGINT AS width FROM (SELECT min(ts) AS low, max(ts) AS high FROM e), (SELECT unnest([1, 5, 15, 60, 300, 900, 3600, 21600, 86400, 604800, 2592000]) AS w)) GROUP BY ALL"""),
    "timeline_shared_lanes": _with("""SELECT a.lane, ['error', 'warn', 'info', 'debug', 'other'][a.s + 1] AS series, a.bucket, count(x.seq) AS n FROM (
  SELECT unnest(['one', 'two', 'three']) AS lane) l, LATERAL (SELECT l.lane, s, bucket, low, width FROM (SELECT min(ts) AS low, max(ts) AS high, (max(ts) - min(ts) + 24) // 24 AS width FROM e WHERE source NOT IN ('src6', 'src7')), range(5) t(s), range(24) u(bucket) WHERE bucket <= (high - low) // width) a
LEFT JOIN (SELECT *, CASE level WHEN 'error' THEN 0 WHEN 'warn' THEN 1 WHEN 'info' THEN 2 WHEN 'debug' THEN 3 ELSE 4 END AS s,
  CASE WHEN source IN ('src0', 'src1') THEN 'one' WHEN source = 'src2' THEN 'two' WHEN source IN ('src3', 'src4', 'src5') THEN 'three' END AS lane FROM e) x
  ON x.lane = a.lane AND x.s = a.s AND (x.ts - a.low) // a.width = a.bucket GROUP BY a.lane, a.s, a.bucket"""),
    "template_frequency": _with("SELECT template_id, count(*) AS n FROM e GROUP BY 1"),
    "error_by_service": _with("SELECT service, count(*) AS n FROM e WHERE level IN ('error', 'fatal') GROUP BY 1"),
    "cooccurrence_top": _with("""SELECT a.template_id AS template_a, b.template_id AS template_b, CAST(sum(a.n * b.n) AS BIGINT) AS n FROM
  (SELECT floor(ts / 3600) AS k, template_id, count(*) AS n FROM e GROUP BY 1, 2) a JOIN (SELECT floor(ts / 3600) AS k, template_id, count(*) AS n FROM e GROUP BY 1, 2) b
  ON a.k = b.k AND a.template_id < b.template_id GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20"""),
    "cross_source_traces": _with("""SELECT host || '-' || CAST(floor(ts / 3600) AS BIGINT) AS trace_id, count(*) AS n, count(DISTINCT source) AS sources, count(*) FILTER (level = 'error') AS errors, min(ts) AS first_ts, max(ts) AS last_ts
FROM e GROUP BY 1 HAVING sources > 1 AND errors > 0 ORDER BY errors DESC, sources DESC, n DESC, trace_id LIMIT 32"""),
    "trace_follow": _with("SELECT ts, seq, source, level, left(message, 160) AS message FROM e WHERE seq % 97 = 5"),
    "correlate_focus": _with("""SELECT template_id, n, votes > 0 AS precedes, round(n * CASE WHEN votes > 0 THEN 1.2::DOUBLE ELSE 1.0 END, 6) AS score FROM (
  SELECT template_id, count(*) AS n, sum(CASE WHEN ts < near THEN 1 ELSE -1 END) AS votes FROM (
    SELECT e.seq, e.ts, e.template_id, arg_min(f.ts, (abs(e.ts - f.ts), f.ts)) AS near FROM e JOIN (SELECT DISTINCT ts FROM e WHERE template_id IN (4, 11)) f ON abs(e.ts - f.ts) <= 600 WHERE e.template_id NOT IN (4, 11) GROUP BY 1, 2, 3) GROUP BY 1)
ORDER BY score DESC, template_id LIMIT 20"""),
    "anomalies_windows": _with(f"""SELECT template_id, base_n, incident_n, round(incident_n / (base_n + 1), 6) AS score FROM (SELECT template_id, count(*) FILTER (ts >= {START} AND ts < {START + 5 * DAY}) AS base_n, count(*) FILTER (ts >= {START + 5 * DAY} AND ts < {START + 25 * DAY}) AS incident_n FROM e GROUP BY 1)
WHERE incident_n > 0 AND (base_n = 0 OR score >= 3)"""),
    "templates_in_range": _with(f"SELECT DISTINCT template_id FROM e WHERE ts >= {START + DAY} AND ts < {START + 2 * DAY}"),
    "lane_scrub_asof": _with(f"""SELECT source, (coalesce(a, b)).ts AS ts, (coalesce(a, b)).seq AS seq, a IS NOT NULL AS at_or_after FROM (
  SELECT source, min({{'ts': ts, 'seq': seq}}) FILTER (ts >= {START + 10 * DAY}) AS a, max({{'ts': ts, 'seq': seq}}) FILTER (ts < {START + 10 * DAY}) AS b FROM e GROUP BY 1)"""),
    "lane_alignment": _with("""SELECT ts, occurrence, max(seq) FILTER (source = 'src1') AS left_seq, max(seq) FILTER (source = 'src2') AS right_seq FROM (
  SELECT CAST(floor(ts / 3600) * 3600 AS BIGINT) AS ts, source, seq, row_number() OVER (PARTITION BY source, floor(ts / 3600) ORDER BY seq) AS occurrence FROM e WHERE source IN ('src1', 'src2')) GROUP BY 1, 2"""),
    "lane_gaps": _with("""SELECT CAST(min(k) * 3600 AS BIGINT) AS ts_from, CAST((max(k) + 1) * 3600 AS BIGINT) AS ts_to, silent FROM (
  SELECT k, silent, k - row_number() OVER (PARTITION BY silent ORDER BY k) AS island FROM (
    SELECT k, array_to_string([s FOR s IN ['src1', 'src2', 'src3'] IF NOT list_contains(have, s)], ',') AS silent FROM (SELECT floor(ts / 3600) AS k, list(DISTINCT source) AS have FROM e WHERE source IN ('src1', 'src2', 'src3') GROUP BY 1)) WHERE silent <> '')
GROUP BY silent, island"""),
    "noise_facts": _with(f"SELECT * FROM f").replace("FROM events)", f"FROM events), {_FACTS}"),
    "noise_scores": _with("""SELECT template_id, n, share AS share_bps, CAST(CASE WHEN bad >= 5000 THEN raw * 50 // 100 WHEN bad >= 1000 THEN greatest(0, raw - 15) ELSE raw END AS BIGINT) AS score,
  all_n >= 20 AND (n >= 10 OR n >= 5 AND sources >= 3) AND (share >= 50 OR n >= 500) AND NOT (errors > 0 AND n < 10) AS eligible,
  CASE WHEN span <= 0 OR minutes < 4 THEN 'insufficient_time' WHEN top <= 2500 THEN 'steady' ELSE 'bursty' END AS shape FROM (
  SELECT *, least(40, least(share, 1000) // 25) + least(sources, 10) * 2
    + CASE WHEN span = 0 OR all_span = 0 THEN 0 WHEN covered >= 70 AND kept >= 20 THEN 15 WHEN covered >= 70 THEN 12 WHEN covered >= 40 AND kept >= 10 THEN 9 WHEN covered >= 40 THEN 7 WHEN covered >= 20 THEN 4 ELSE 1 END
    + CASE WHEN minutes < 4 THEN 0 WHEN top <= 2500 THEN 10 WHEN top <= 5000 THEN 6 ELSE 0 END
    + CASE WHEN infos * 100 // n >= 70 THEN 15 WHEN warns * 100 // n >= 70 THEN 12 WHEN infos * 100 // n + warns * 100 // n >= 70 THEN 10 ELSE 4 END AS raw FROM (
    SELECT *, n * 10000 // all_n AS share, last_ts - first_ts AS span, all_last - all_first AS all_span, (last_ts - first_ts) * 100 // (all_last - all_first) AS covered, minutes * 100 // ((all_last - all_first) // 60 + 1) AS kept,
      peak * 10000 // n AS top, errors * 10000 // n AS bad FROM f, (SELECT sum(n)::BIGINT AS all_n, min(first_ts) AS all_first, max(last_ts) AS all_last FROM f)))""").replace("FROM events)", f"FROM events), {_FACTS}"),
    "noise_levels": _with("""SELECT template_id, CASE WHEN r <= 2 THEN level ELSE 'other' END AS level, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT template_id, level, count(*) AS n, row_number() OVER (PARTITION BY template_id ORDER BY count(*) DESC, level) AS r FROM e GROUP BY 1, 2) GROUP BY ALL"""),
    "noise_representatives": _with("""SELECT template_id, row_number() OVER (PARTITION BY template_id ORDER BY r, source, seq) AS rank, source, seq FROM (
  SELECT template_id, source, seq, row_number() OVER (PARTITION BY template_id, source ORDER BY seq) AS r FROM e) WHERE r <= 3 QUALIFY rank <= 3"""),
    "quality_sources": _with("SELECT source, count(*) AS n, count(ts) AS wall, count(trace_id) AS traced, count(*) FILTER (coalesce(level, 'unknown') = 'unknown') AS unknown_level, count(DISTINCT template_id) AS templates FROM e GROUP BY 1"),
    "quality_concentration": _with("SELECT max(n * 10000 // total) AS top_share_bps, least(CAST(sum((n * 10000 // total) * (n * 10000 // total)) AS BIGINT) // 100, 10000) AS hhi_bps, max(total) AS n FROM (SELECT count(*) AS n, (SELECT count(*) FROM e) AS total FROM e GROUP BY template_id)"),
    "quality_grade": _with("""SELECT *, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 50 THEN 'C' WHEN score >= 25 THEN 'D' ELSE 'F' END AS grade FROM (
  SELECT *, (timestamp_certainty * 2500 + (selection_coverage + parse_structure + stored_level_usefulness + noise_concentration_review + trace_id_coverage) * 1500) // 10000 AS score FROM (
  SELECT wall * 10000 // n // 100 AS timestamp_certainty, chosen * 10000 // sources // 100 AS selection_coverage, structured * 10000 // n // 100 AS parse_structure, known * 10000 // n // 100 AS stored_level_usefulness,
    CAST(80 - CASE WHEN top >= 5000 THEN 35 WHEN top >= 2500 THEN 15 ELSE 0 END - CASE WHEN hhi >= 4000 THEN 20 ELSE 0 END AS BIGINT) AS noise_concentration_review, traced * 10000 // n // 100 AS trace_id_coverage
  FROM (SELECT count(*) AS n, count(ts) AS wall, count(trace_id) AS traced, count(*) FILTER (level <> 'unknown') AS known, count(*) FILTER (template_id % 5 <> 0) AS structured, count(DISTINCT source) AS sources, count(DISTINCT source) FILTER (source <> 'src7') AS chosen FROM e),
    (SELECT max(n * 10000 // total) AS top, least(CAST(sum((n * 10000 // total) * (n * 10000 // total)) AS BIGINT) // 100, 10000) AS hhi FROM (SELECT count(*) AS n, (SELECT count(*) FROM e) AS total FROM e GROUP BY template_id))))"""),
    "metric_downsample": _with("""SELECT service, CAST(floor(ts / 21600) AS BIGINT) AS bucket, arg_min(seq, (value, ts, seq)) AS low_seq, min(value) AS low, arg_min(seq, (-value, ts, seq)) AS high_seq, max(value) AS high FROM e GROUP BY 1, 2"""),
    "revision_apply": _with("SELECT seq, CASE WHEN seq % 20 = 0 THEN ts - 3600 ELSE ts END AS ts, seq % 20 = 0 AS changed FROM e"),
    "level_normalize": _with("""SELECT seq, ['warn', 'error', 'error', 'debug', 'notice', 'fatal', 'unknown', 'custom'][seq % 8 + 1] AS level, [3, 4, 4, 1, 2, 5, 0, 0][seq % 8 + 1]::BIGINT AS severity FROM e"""),
}

QUERIES = {name: globals()[name] for name in ORACLES}
