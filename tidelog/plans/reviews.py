"""Queries over reviewed grammars, fields of lines, zones, revisions, secrets and hashed vectors, made from the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import packages, state
from ..functions import embeddings, text
from ..operators import retrieval, vector_graph
from ..shared import fresh_folder
from ..sources import documents, formats, grammars, readonly, zones
from ..sources.events import events, table
from .events import _with
from .streams import _pick

JOBS = grammars.LineGrammar("jobs", 1, ("year", "=-", "month", "=-", "day", "= ", "hour", "=:", "minute", "=:", "second", "=,", "millis"), ("space", "level", "space", ("thread", "[", "]"), "space", ("logger", None, None), ("literal", " - "), "message"), priority=5)
GATES = grammars.LineGrammar("gates", 3, ("day", "=/", "month", "=/", "year", "=T", "hour", "=:", "minute", "=:", "second", "offset"), (("literal", " |"), ("logger", "<", ">"), "space", "message"), continued=False)


def _reviewed_lines(spark, sf_dir):
    """Even blocks of 500 events as JOBS, odd ones as GATES; every fourth event has two more lines, every block begins with one that fits none."""
    at = lambda pattern: F.date_format(F.timestamp_seconds(F.coalesce("ts", F.lit(0))), pattern)
    m, block = F.coalesce("message", F.lit("")), F.floor(F.col("seq") / 500)
    head = F.when(block % 2 == 0, F.concat(at("yyyy-MM-dd HH:mm:ss"), F.lit(",250 "), F.upper("level"), F.lit(" [w "), (F.col("seq") % 5).cast("string"), F.lit("] org.app - "), m)).otherwise(
        F.concat(at("dd/MM/yyyy'T'HH:mm:ss"), F.lit("+02:30 |<"), "source", F.lit(">  "), m)
    )
    lines = F.concat(F.when(F.col("seq") % 500 == 0, F.array(F.lit("preamble"))).otherwise(F.array().cast("array<string>")), F.array(head), F.when(F.col("seq") % 4 == 1, F.array(F.lit("  more"), F.lit("2024-13-01 00:00:00,000 no month"))).otherwise(F.array().cast("array<string>")))
    rows = events(spark, sf_dir).select(F.concat(F.lit("f"), block.cast("string")).alias("source"), "seq", F.posexplode(lines).alias("i", "line"))
    return rows.select("source", (F.col("seq") * 10 + F.col("i")).alias("line_no"), "line", (block % 2 == 0).alias("even"))


def reviewed_grammars(spark, sf_dir):
    rows = _reviewed_lines(spark, sf_dir)
    return grammars.assembled(rows.where("even"), JOBS).unionByName(grammars.assembled(rows.where("not even"), GATES))


def grammar_selection(spark, sf_dir):
    return grammars.selected(_reviewed_lines(spark, sf_dir), [JOBS, GATES])


def log_fields(spark, sf_dir):
    """Lines with epochs of several units, hosts, traces and syslog without a priority."""
    ts, n, m = F.coalesce("ts", F.lit(0)).cast("string"), F.col("seq").cast("string"), F.coalesce("message", F.lit(""))
    made = _pick(
        F.col("seq"), F.concat(F.lit('{"ts":'), ts, F.lit(',"lvl":40,"host":"'), "host", F.lit('","traceId":"'), n, F.lit('","msg":"x"}')), F.concat(F.lit("ts="), ts, F.lit("123 level=info msg=x node="), "host", F.lit(" trace="), n),
        F.concat(F.date_format(F.timestamp_seconds(F.coalesce("ts", F.lit(0))), "MMM dd HH:mm:ss"), F.lit(" "), "host", F.lit(" sshd[12]: "), m), F.concat(F.lit('{"ts":"bad","timestamp":"'), ts, F.lit('000000","level":"warn","message":"y"}')),
    )
    found = formats.parsed(events(spark, sf_dir).select("seq", made.alias("line")), "line")
    return found.select("seq", "format", "ts", "level", "service", "host", "trace_id")


def zone_times(spark, sf_dir):
    """Every quarter of an hour of an order's day as a local time of one of four zones, some with an abbreviation."""
    local = F.unix_date(F.col("o_orderdate").cast("date")).cast("long") * 86_400 + F.col("o_orderkey") * 7 % 96 * 900
    zone = _pick(F.col("o_custkey"), *map(F.lit, ("America/Chicago", "Europe/Berlin", "Asia/Kolkata", "Nowhere/Land")))
    short = F.when((F.col("o_custkey") % 4 == 0) & (F.col("o_orderkey") % 3 == 0), "cdt")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", local.alias("local"), zone.alias("zone"), short.alias("abbreviation"))
    return zones.resolved(rows, zones.offsets(spark, ["America/Chicago", "Europe/Berlin", "Asia/Kolkata"], 1990, 2005), "o_orderkey")


def versioned_times(spark, sf_dir):
    """Events under revisions: appended in two batches, new times for some, one more change that is undone."""
    kept = state.Versioned(spark, fresh_folder(spark, "versioned"))
    rows = events(spark, sf_dir).select("seq", "source", "ts", "message")
    state.append(kept, rows.where("seq % 3 <> 0"), 0)
    state.append(kept, rows.where("seq % 3 = 0"), 1)
    change = rows.where("seq % 7 = 0").select("seq", "source", F.col("ts").alias("expected_ts"), (F.coalesce("ts", F.lit(0)) + 60).alias("new_ts"))
    state.apply_times(kept, change, 2)
    state.apply_times(kept, change.select("seq", "source", F.col("new_ts").alias("expected_ts"), F.lit(0).alias("new_ts")), 3)
    kept.undo(4)
    return kept.read().select("seq", "source", "ts", F.lit(kept.revision()).cast("long").alias("revision"))


def secret_tokens(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    digest = F.sha2(key, 256)
    made = _pick(F.col("o_orderkey"), F.concat(F.lit("see "), F.substring(digest, 1, 40), F.lit(" now")), F.concat(F.lit("aws_secret_access_key = "), F.substring(digest, 1, 36)), F.concat(F.lit("github_pat_"), F.substring(digest, 1, 24), F.lit("!")), F.concat(F.lit("id "), F.repeat(F.lit("ab1"), 12)), F.concat(F.lit("short "), F.substring(digest, 1, 31)))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.redacted(made).alias("redacted"), F.array_join(text.secret_classes(made), ",").alias("classes"))


def canonical_numbers(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    made = _pick(F.col("o_orderkey"), F.concat(F.lit('{"b": 1e400, "a": [12345678901234567890'), key, F.lit(", true]}")), F.concat(F.lit('{ "z" : '), key, F.lit(', "a" : null }')), F.concat(F.lit('{"x": 1e40, "x": '), key, F.lit("}")))
    return table(spark, sf_dir, "orders").select("o_orderkey", documents.canonical_json(made).alias("json"))


def readonly_query(spark, sf_dir):
    return readonly.query({"e": events(spark, sf_dir)}, "WITH t AS (SELECT source, template_id, count(*) AS n FROM e WHERE level IN ('error', 'warn') GROUP BY source, template_id) SELECT source, max(n) AS most, count(*) AS templates FROM t GROUP BY source")


def hashed_vectors(spark, sf_dir):
    """Each text's nearest axis and its share, to six places."""
    v = embeddings.hashed(F.col("text"), 32)
    found = table(spark, sf_dir, "documents").select("doc_id", v.alias("v"))
    top = F.array_max("v")
    return found.select("doc_id", F.when(top > 0, F.array_position("v", top)).otherwise(0).alias("axis"), F.round(top, 6).alias("share"), F.lit(embeddings.space(32)).alias("space"))


_DAY = "CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 86400 + o_orderkey * 7 % 96 * 900"

ORACLES = {
    "reviewed_grammars": _with("""SELECT 'f' || (seq // 500) AS source, seq * 10 + CASE WHEN seq % 500 = 0 THEN 1 ELSE 0 END AS start_line,
  CASE WHEN seq // 500 % 2 = 0 THEN strftime(make_timestamp(coalesce(ts, 0) * 1000000), '%Y-%m-%d %H:%M:%S') || ',250' ELSE strftime(make_timestamp(coalesce(ts, 0) * 1000000), '%d/%m/%YT%H:%M:%S') || '+02:30' END AS stamp,
  CASE WHEN seq // 500 % 2 = 1 THEN coalesce(ts, 0) - 9000 END AS ts, CASE WHEN seq // 500 % 2 = 0 THEN upper(level) END AS level, CASE WHEN seq // 500 % 2 = 0 THEN 'org.app' ELSE source END AS logger, CASE WHEN seq // 500 % 2 = 0 THEN 'w ' || seq % 5 END AS thread,
  coalesce(message, '') AS message, CASE WHEN seq // 500 % 2 = 0 AND seq % 4 = 1 THEN '  more' || chr(10) || '2024-13-01 00:00:00,000 no month' ELSE '' END AS continuation, CAST(CASE WHEN seq // 500 % 2 = 0 AND seq % 4 = 1 THEN 2 ELSE 0 END AS BIGINT) AS n_continued, CAST(0 AS BIGINT) AS lines_dropped FROM e"""),
    "grammar_selection": _with("SELECT DISTINCT 'f' || (seq // 500) AS source, 'selected' AS outcome, CASE WHEN seq // 500 % 2 = 0 THEN 'jobs' ELSE 'gates' END AS format_id, CASE WHEN seq // 500 % 2 = 0 THEN 1 ELSE 3 END::INT AS version FROM e"),
    "log_fields": _with("""SELECT seq, ['json', 'logfmt', 'bsd_syslog', 'json'][seq % 4 + 1] AS format, CASE WHEN seq % 4 <> 2 THEN coalesce(ts, 0) END AS ts, CASE seq % 4 WHEN 0 THEN 'warn' WHEN 1 THEN 'info' WHEN 2 THEN CASE WHEN service = 'error' THEN 'error' ELSE 'unknown' END ELSE 'warn' END AS level,
  CASE WHEN seq % 4 = 2 THEN 'sshd' END AS service, CASE WHEN seq % 4 < 3 THEN host END AS host, CASE WHEN seq % 4 < 2 THEN seq::VARCHAR END AS trace_id FROM e"""),
    "zone_times": f"""WITH l AS (SELECT o_orderkey, {_DAY} AS local, ['America/Chicago', 'Europe/Berlin', 'Asia/Kolkata', 'Nowhere/Land'][o_custkey % 4 + 1] AS zone, o_custkey % 4 = 0 AND o_orderkey % 3 = 0 AS short FROM orders),
u AS (SELECT *, CASE WHEN zone <> 'Nowhere/Land' THEN [epoch(timezone(zone, make_timestamp((local + d) * 1000000)))::BIGINT - d FOR d IN [-10800, 0, 10800]] END AS guesses, make_timestamp(local * 1000000) AS t FROM l),
g AS (SELECT *, list_sort(list_distinct(list_filter(guesses, lambda s: timezone(zone, to_timestamp(s)) = t))) AS real FROM u)
SELECT o_orderkey, CASE WHEN zone <> 'Nowhere/Land' AND len(real) = 1 AND (NOT short OR local - real[1] = -18000) THEN real[1] WHEN len(real) = 2 AND short THEN real[1] END AS ts,
  CASE WHEN zone <> 'Nowhere/Land' AND len(real) = 1 AND (NOT short OR local - real[1] = -18000) THEN local - real[1] WHEN len(real) = 2 AND short THEN local - real[1] END AS "offset",
  CASE WHEN zone = 'Nowhere/Land' THEN 'unknown_zone' WHEN len(real) = 0 THEN 'gap' WHEN short AND len(real) = 1 AND local - real[1] <> -18000 THEN 'mismatch' WHEN len(real) = 1 OR short THEN 'resolved' ELSE 'fold' END AS reason FROM g""",
    "versioned_times": _with("SELECT seq, source, CASE WHEN seq % 7 = 0 THEN coalesce(ts, 0) + 60 ELSE ts END AS ts, CAST(5 AS BIGINT) AS revision FROM e"),
    "secret_tokens": """WITH d AS (SELECT o_orderkey, sha256(o_orderkey::VARCHAR) AS h, o_orderkey % 5 AS k FROM orders), t AS (SELECT *, substr(h, 1, 40) AS t FROM d),
r AS (SELECT *, len(list_distinct(string_split(t, ''))) >= 16 AND regexp_matches(t, '[a-z]') AND regexp_matches(t, '[0-9]') AS random FROM t)
SELECT o_orderkey, CASE k WHEN 0 THEN 'see ' || CASE WHEN random THEN '[REDACTED:HIGH_ENTROPY]' ELSE t END || ' now' WHEN 1 THEN 'aws_secret_access_key = [REDACTED:AWS_SECRET]' WHEN 2 THEN '[REDACTED:GITHUB_TOKEN]!' WHEN 3 THEN 'id ' || repeat('ab1', 12) ELSE 'short ' || substr(h, 1, 31) END AS redacted,
  CASE k WHEN 0 THEN CASE WHEN random THEN 'HIGH_ENTROPY' ELSE '' END WHEN 1 THEN 'AWS_SECRET,ASSIGNMENT' WHEN 2 THEN 'GITHUB_TOKEN' ELSE '' END AS classes FROM r""",
    "canonical_numbers": """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '{"a":[12345678901234567890' || o_orderkey || ',true],"b":1e400}' WHEN 1 THEN '{"a":null,"z":' || o_orderkey || '}' END AS json FROM orders""",
    "readonly_query": _with("SELECT source, max(n) AS most, count(*) AS templates FROM (SELECT source, template_id, count(*) AS n FROM e WHERE level IN ('error', 'warn') GROUP BY 1, 2) GROUP BY 1"),
    "hashed_vectors": """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) AS w FROM documents), f AS (SELECT doc_id, w AS f, 2 AS x FROM w UNION ALL SELECT doc_id, unnest(string_split(w, '')), 1 FROM w),
b AS (SELECT doc_id, CAST('0x' || substr(md5(f), 1, 8) AS BIGINT) % 32 AS axis, sum(x)::DOUBLE AS n FROM f GROUP BY 1, 2), t AS (SELECT doc_id, min(axis) FILTER (n = most) + 1 AS axis, max(most) / sqrt(sum(n * n)) AS share FROM (SELECT *, max(n) OVER (PARTITION BY doc_id) AS most FROM b) GROUP BY 1)
SELECT d.doc_id, coalesce(axis, 0) AS axis, round(coalesce(share, 0), 6) AS share, 'hashed-words:md5:1:2:32' AS space FROM documents d LEFT JOIN t USING (doc_id)""",
}

QUERIES = {name: globals()[name] for name in ORACLES}


def graph_recall(spark, sf_dir):
    """Every fiftieth vector against all, over graphs: how many of the ten nearest are found, by query."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 50 = 0")
    exact = retrieval.nearest_vectors(rows, asked, 10).select("query_id", "vec_id")
    found = vector_graph.search(vector_graph.indexed(rows), asked, 10).select("query_id", "vec_id")
    return exact.join(found.withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.count("*").alias("n"), F.count("hit").alias("found"))


QUERIES["graph_recall"] = graph_recall


def package_there_and_back(spark, sf_dir):
    """Events and templates as a package, checked and read again."""
    root = fresh_folder(spark, "package")
    rows = events(spark, sf_dir)
    packages.export({"events": rows.select("seq", "source", "message"), "templates": rows.select("template_id").distinct()}, root)
    back = packages.load(spark, root)
    return back["events"].groupBy("source").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"), F.max(F.sha2("message", 256)).alias("greatest")).withColumn("templates", back["templates"].agg(F.count("*")).scalar())


def declared_zones(spark, sf_dir):
    """Two sources with a declared zone, one of them taken back."""
    kept = state.Versioned(spark, fresh_folder(spark, "zoned"))
    wall = F.col("seq") % 3 == 0
    rows = events(spark, sf_dir).select("seq", "source", F.when(wall, F.col("ts")).alias("ts"), F.col("ts").alias("local"), F.lit(None).cast("string").alias("abbreviation"), F.when(wall, "explicit_wall").otherwise("unresolved_local").alias("basis"))
    state.append(kept, rows, 0)
    state.apply_zones(kept, {"src0": "Asia/Kolkata", "src1": "Asia/Tokyo"}, 1)
    state.clear_zone(kept, "src1", 2)
    return kept.read().select("seq", "ts", "basis")


ORACLES |= {
    "package_there_and_back": _with("SELECT source, count(*) AS n, max(seq) AS last_seq, max(sha256(message)) AS greatest, (SELECT count(DISTINCT coalesce(template_id, -1)) FROM e) AS templates FROM e GROUP BY 1"),
    "declared_zones": _with("""SELECT seq, CASE WHEN seq % 3 = 0 THEN ts WHEN source = 'src0' THEN ts - 19800 END AS ts, CASE WHEN seq % 3 = 0 THEN 'explicit_wall' WHEN source = 'src0' AND ts IS NOT NULL THEN 'resolved_local' ELSE 'unresolved_local' END AS basis FROM e"""),
}
QUERIES |= {"package_there_and_back": package_there_and_back, "declared_zones": declared_zones}
