"""Queries over exceptions, rankings, rules, files and documents of JSON, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, times
from ..operators import episodes, exceptions, pages, quality, ranking, rules, selection
from ..sources import archives, documents
from ..sources.events import dealt, events, table
from .events import _with


def _pick(number, *values):
    """The value at `number` (from 0, any integer) modulo their count."""
    return F.element_at(F.array(*values), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def _sql_pick(number, *values):
    return f"[{', '.join(values)}][CAST(({number}) % {len(values)} + 1 AS BIGINT)]"


def exception_envelopes(spark, sf_dir):
    key, seq, m = F.col("template_id").cast("string"), F.col("seq").cast("string"), F.col("message")
    made = _pick(
        F.col("seq"), F.concat(F.lit("ERROR [stderr] (pool-"), key, F.lit(") java.io.IOException: x request_id="), seq), F.lit("[stderr] (bad(one) y"),
        F.concat(m, F.lit(" thread=t"), key, F.lit(" traceId="), seq), F.lit("[stderr] (a-1) tid=a-2 hi"), m,
    )
    return events(spark, sf_dir).select("seq", exceptions.envelope(made).alias("e")).select("seq", "e.*")


_PATTERNS = ("\tat a.B.c(C.java:7)", "ERROR [stderr] (t-1) Caused by: java.io.IOException: <*>", "java.lang.IllegalStateException: job <*>", "Exception in thread main", "a throwable came", "user <*> came")
_ROLES = ("stack_frame", "cause_suppressed", "header_or_full_stack", "wrapper_scaffold", "unknown_suspicious", None)


def pattern_roles(spark, sf_dir):
    role = exceptions.pattern_role(_pick(F.col("template_id"), *map(F.lit, _PATTERNS)))
    return events(spark, sf_dir).groupBy("template_id", role.alias("role")).agg(F.count("*").alias("n"))


def exception_families(spark, sf_dir):
    signature = F.concat(F.lit("E"), (F.col("template_id") % 37).cast("string"))
    rows = events(spark, sf_dir).where("level = 'error'")
    rows = rows.select(signature.alias("signature"), F.when(F.col("seq") % 3 == 0, "wrapped").otherwise("full").alias("kind"), F.col("trace_id").alias("occurrence"), (F.col("template_id") % 4 + 1).alias("records"))
    return exceptions.families(rows, 24)


def two_renderings(spark, sf_dir):
    """Errors as full and wrapped renderings by turns."""
    seq, no = F.col("seq"), F.lit(None).cast("string")
    return events(spark, sf_dir).where("level = 'error' and ts is not null").select(
        seq.alias("id"), F.when(seq % 2 == 0, "full").otherwise("wrapped").alias("kind"), F.concat(F.lit("E"), (F.col("template_id") % 3).cast("string")).alias("signature"), "source",
        F.when(seq % 9 == 0, "a").when(seq % 9 == 1, "b").alias("service"), F.when(seq % 4 == 0, F.col("host")).alias("host"), F.when(seq % 3 == 0, F.concat(F.lit("r"), F.floor(seq / 40).cast("string"))).alias("request"),
        no.alias("trace"), F.when(seq % 5 == 0, "t1").when(seq % 5 == 1, "t2").alias("thread"), seq.alias("first_seq"), seq.alias("last_seq"), F.col("ts").alias("first_ts"), (F.col("ts") + 400).alias("last_ts"),
        (seq % 11 != 0).alias("wall"), (seq % 13 == 0).alias("conflict"),
    )


def exception_pairs(spark, sf_dir):
    return exceptions.paired(two_renderings(spark, sf_dir))


def template_episodes(spark, sf_dir):
    rows = events(spark, sf_dir)
    found = episodes.episodes(rows.where("level = 'error'"), ["source", "host"], 40, 3600, 5000)
    return exceptions.template_episodes(rows, found, ["source", "host"])


def rerank_anchors(spark, sf_dir):
    rows = events(spark, sf_dir).select("source", "seq", "ts", "message", "value")
    rank = "row_number() over (partition by source order by value desc nulls last, seq)"
    pool = rows.withColumn("pre_rank", F.expr(rank)).where("pre_rank <= 40")
    pool = ranking.anchored(pool, "source", [" K=7", "k=8 "]).withColumn("score", F.when(F.col("pre_rank") <= 30, (F.col("seq") * 7919 % 101).cast("double")))
    return ranking.reranked(pool, "source", 12).select("source", "seq", "pre_rank", "anchor", "promoted", "final_rank")


def _chunk_scores(spark, sf_dir, weights, semantic):
    body = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(body).alias("length"), text.lexical_overlap(F.lit("the that and tion whthan"), body).cast("double").alias("keyword"))
    best = rows.agg(F.max("keyword").alias("best"))
    rows = rows.where("keyword > 0").crossJoin(F.broadcast(best))  # one row
    score = ranking.blended(F.col("keyword"), F.col("best"), (F.col("length") % 100) / 100.0 if semantic else None, 1.0 / (1.0 + F.col("turn")) if weights[2] else None, weights)
    return rows.withColumn("score", F.round(score, 6))


def hybrid_chunks(spark, sf_dir):
    order = [F.desc("score"), F.asc("conv_id"), F.asc("turn"), F.asc("length")]
    return _chunk_scores(spark, sf_dir, (0.55, 0.35, 0.10), True).select("conv_id", "turn", "length", "score").orderBy(*order).limit(200)


def keyword_chunks(spark, sf_dir):
    order = [F.desc("score"), F.asc("conv_id"), F.asc("turn"), F.asc("length")]
    return _chunk_scores(spark, sf_dir, (0.55, 0.35, 0.10), False).select("conv_id", "turn", "length", "score").orderBy(*order).limit(200)


def help_pages(spark, sf_dir):
    order = [F.desc("score"), F.asc("conv_id"), F.asc("turn"), F.asc("length")]
    hits = _chunk_scores(spark, sf_dir, (0.65, 0.35, 0.0), True)
    return ranking.one_a_page(hits.select("conv_id", "turn", "length", "score"), "conv_id", order, 50)


def problem_clusters(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("template_id"), F.concat_ws(" ", "p_type", "p_brand").alias("pattern"), (F.col("p_size") % 6).alias("severity"), F.col("p_size").cast("long").alias("n"))
    return ranking.clusters(parts, 50)


def focus_neighbourhood(spark, sf_dir):
    seq = F.col("seq")
    rows = events(spark, sf_dir).select(
        seq.alias("id"), F.when((seq % 97 == 0) & (F.col("source") < "src4"), "candidate").otherwise("independent").alias("scope"), F.concat(F.lit("c"), (seq % 5).cast("string")).alias("candidate"),
        "source", F.when(seq % 89 != 1, seq).alias("ordinal"), (seq % 5).isin(0, 2).alias("traced"),
    )
    return ranking.neighbourhood(rows, 8, 500, True)


def _rule_log(spark, sf_dir):
    rule, key = F.col("o_custkey") % 240, F.col("o_orderkey")
    state = F.when(key % 5 == 0, "disabled").when(key % 5 == 1, "removed").otherwise("enabled")
    mark = F.concat(F.lit("f"), (rule % 130).cast("string"), F.when(rule % 9 == 0, "x").otherwise(""))
    return table(spark, sf_dir, "orders").select(rule.alias("rule_id"), key.alias("revision"), state.alias("state"), (rule % 130).alias("template_id"), F.when(rule % 31 != 0, mark).alias("fingerprint"))


def _fingerprints(spark, sf_dir):
    return events(spark, sf_dir).select("template_id", F.concat(F.lit("f"), F.col("template_id").cast("string")).alias("fingerprint")).distinct()


def suppression_rules(spark, sf_dir):
    return rules.rule_states(_rule_log(spark, sf_dir), _fingerprints(spark, sf_dir))


def suppression_lens(spark, sf_dir):
    asked = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 150).alias("template_id"))
    allowed = rules.trusted_lens(asked, rules.rule_states(_rule_log(spark, sf_dir), _fingerprints(spark, sf_dir)))
    return events(spark, sf_dir).join(allowed, "template_id", "left_anti").groupBy("source").agg(F.count("*").alias("n"))


def space_binding(spark, sf_dir):
    key = F.col("s_suppkey")
    stored = F.when(key % 6 != 0, F.struct(F.concat(F.lit("m"), (key % 2).cast("string")).alias("model"), F.when(key % 5 != 0, "d").alias("dialect"), F.when(key % 4 != 0, 64 + key % 3).alias("dimensions")))
    asked = F.struct(F.lit("m1").alias("model"), F.lit("d").alias("dialect"), F.lit(64).alias("dimensions"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", rules.binding(stored, asked, ["model", "dialect"]).alias("b")).select("s_suppkey", "b.*")


def version_pairs(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    runs = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("name"), (F.col("o_custkey") % 50).alias("task"), F.year(day).alias("snapshot"), F.when(F.col("o_orderkey") % 10 != 0, F.month(day)).alias("version"), F.col("o_orderkey").alias("run"), F.floor(F.col("o_totalprice") / 10000).alias("score"),
    )
    return rules.version_pairs(runs, ["name", "task", "snapshot"], "score")


def memory_import(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    lines = turns.select(F.to_json(F.struct(F.col("role").alias("kind"), F.col("text").alias("content"))).alias("line"))
    stored = turns.where("conv_id % 3 = 0").select(F.sha2(F.trim("text"), 256).alias("id")).distinct()
    return rules.imported(lines, stored).select("id", "kind")


def original_page(spark, sf_dir):
    return pages.originals(events(spark, sf_dir).withColumn("original", F.concat_ws(" ", "level", "message")), 300, 512).select("seq", "original")


def text_chunks(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text", "source")
    parts = documents.chunks(files.select("path", "text")).select("path", "start_line", "end_line", F.length("text").alias("length"))
    return documents.with_files(parts, files.select("path", "source"))


def feed_items(spark, sf_dir):
    key = F.col("s_suppkey").cast("string")
    item = lambda title, link, body: F.concat(F.lit("<item><title>"), title, F.lit("</title><link>"), link, F.lit("</link><description>"), body, F.lit("</description></item>"))
    xml = F.concat(F.lit('<rss version="2.0"><channel><title>x</title>'), item(F.concat(F.lit(" A &amp; "), key), F.concat(F.lit("http://a/"), key), F.lit("&lt;b&gt;bold&lt;/b&gt; text")), item(F.lit(""), F.lit("http://b"), F.lit("none")), item(F.lit("C"), F.concat(F.lit("http://c/?q=1&amp;k="), key), F.lit("")), F.lit("</channel></rss>"))
    return documents.feed_items(table(spark, sf_dir, "supplier").select("s_suppkey", xml.alias("xml")))


def profile_groups(spark, sf_dir):
    key = F.col("o_orderkey")
    name = key.cast("string")
    identity = _pick(key, F.concat(F.lit("logs/app-"), name, F.lit(".log")), F.concat(F.lit("logs/a/b.c/"), name, F.lit(".log")), F.concat(F.lit("etc/"), name, F.lit(".conf")), F.concat(F.lit("etc/x/"), name, F.lit(".conf")), F.concat(F.lit("box.zip!/m-"), name))
    return documents.profiled(table(spark, sf_dir, "orders").select(identity.alias("identity")), {"app": "logs/app-*.log", "all": "logs/**/*.log", "conf": "etc/?*.conf", "member": "box.zip!/**"})


_ROLLED = ("", ".1", "-2024-01-02", ".gz", ".2.gz", ".20240103-120000")


def rolled_groups(spark, sf_dir):
    key = F.col("o_orderkey")
    folder = key % 700
    identity = F.concat(F.lit("d"), folder.cast("string"), F.lit("/app.log"), _pick(F.floor(key / 700), *map(F.lit, _ROLLED)))
    kind = F.when((folder % 7 == 0) & (F.floor(key / 700) % 6 == 1), "json").when(folder % 11 != 0, "plain")
    return documents.rolled_groups(table(spark, sf_dir, "orders").select(identity.alias("identity"), kind.alias("format")).distinct())


def json_guards(spark, sf_dir):
    name = F.col("o_orderkey").cast("string")
    raw = _pick(F.col("o_orderkey"), F.concat(F.lit('{"b": '), name, F.lit(', "a": [{"c": "}{"}, 1.5]}')), F.concat(F.lit('{"a": 1, "\\u0061": '), name, F.lit("}")), name, F.concat(F.lit("nope "), name), F.lit("[[[[]]]]"))
    return table(spark, sf_dir, "orders").select("o_orderkey", documents.json_depth(raw).alias("depth"), documents.duplicate_keys(raw).alias("repeats"), documents.canonical_json(raw).alias("canonical"))


def normalized_export(spark, sf_dir):
    return documents.export_lines(events(spark, sf_dir)).select("source", "seq", F.sha2(F.coalesce(documents.canonical_json(F.col("line")), F.lit("")), 256).alias("line_sha256"))


_LINES = (
    '{"sourceSeq":{n},"time":{"resolution":"source_explicit","basis":"wall","instant":"2024-01-01T00:00:00Z"},"severity":{"confidence":"high","provenance":"source_declared"}}',
    '{"sourceSeq":{n},"time":{"resolution":"source_explicit","basis":"wall","instant":"2024-01-01"}}',
    '{"sourceSeq":{n},"time":{"resolution":"order_only","basis":"wall"}}',
    '{"sourceSeq":{n},"time":{"resolution":"unresolved","basis":"order"}}',
    '{"sourceSeq":{n},"time":{"resolution":"producer_resolved","basis":"wall","localText":"10:00","resolvedTimezone":"Europe/Oslo"}}',
    '{"sourceSeq":{n},"time":{"resolution":"order_only","basis":"order"},"severity":{"canonical":30,"confidence":"high","provenance":"text_inferred"},"traceId":"xyz"}',
    "nope {n}",
)
_CODES = ("", "instant_malformed", "time_basis_inconsistent", "local_text_required", "instant_required", "severity_number_out_of_range,severity_provenance_inconsistent,trace_identifier_malformed", "malformed_line")


def checked_events(spark, sf_dir):
    number = (F.col("seq") + F.when(F.col("seq") % 101 == 0, 1).otherwise(0)).cast("string")
    line = _pick(F.col("seq"), *(F.replace(F.lit(x), F.lit("{n}"), number) for x in _LINES))
    found = documents.checked_events(events(spark, sf_dir).select(F.concat(F.lit("s"), F.floor(F.col("seq") / 500).cast("string")).alias("source"), F.col("seq").alias("line_no"), line.alias("line")))
    return found.select("source", "line_no", "codes")


def share_safe_texts(spark, sf_dir):
    name = F.col("o_orderkey").cast("string")
    raw = F.concat(F.lit("see https://h/"), name, F.lit("?q=1 in /var/log/app/"), name, F.lit(".log, C:\\tmp\\b"), name, F.lit(" by Bob; x-api-key: Basic q"), name, F.lit(" or a/b/c"))
    return dealt(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", text.share_safe(raw, ("bob",)).alias("shown"))


def condensed_queries(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(text.condensed(F.coalesce("text", F.lit(""))), 256).alias("words_sha256"))


def memory_cues(spark, sf_dir):
    name = F.col("o_orderkey").cast("string")
    said = _pick(F.col("o_orderkey"), F.concat(F.lit("Well.\nPlease Remember the API runs on port "), name, F.lit("! bye")), F.concat(F.lit("we decided maybe `"), name, F.lit("`")), F.lit("todo: x"), F.concat(F.lit("I prefer tea over number "), name, F.lit(". And\nso on")))
    found = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(text.cues(said)).alias("c")).select("o_orderkey", "c.*")
    s, c = text.salience(F.col("kind"), F.col("content"), F.col("cue"))
    return found.select("o_orderkey", "cue", "kind", "content", s.alias("salience"), c.alias("confidence"))


def calendar_times(spark, sf_dir):
    made = F.date_format("o_orderdate", "EEE MMM d HH:mm:ss yyyy")
    return table(spark, sf_dir, "orders").select("o_orderkey", times.calendar_text(F.when(F.col("o_orderkey") % 3 == 0, F.regexp_replace(made, "^...", "Day")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit(" "), made)).otherwise(F.regexp_replace(made, "[0-9]+ ", "32 "))).alias("local_text"))


def substring_search(spark, sf_dir):
    return ranking.substring_hits(table(spark, sf_dir, "conversations").where("text is not null").distinct(), "thANd", ["conv_id", "turn"], 200)


def quality_findings(spark, sf_dir):
    basis = F.when(F.col("seq") % 10 < 6, "wall").when(F.col("seq") % 10 < 7, "unresolved").otherwise("order")
    rows = events(spark, sf_dir)
    state = _pick(F.substring("source", 4, 1).cast("int"), *map(F.lit, ("imported", "failed", "ignored")))
    return quality.findings(rows, basis, F.col("template_id") % 3 == 0, rows.select("source").distinct().withColumn("state", state))


def original_records(spark, sf_dir):
    made = F.concat("message", F.when(F.col("seq") % 3 == 0, F.lit(" password=hunter2hunter2")).otherwise(F.lit(" äöü")), F.when(F.col("seq") % 2 == 0, F.lit("\r\n")).otherwise(F.lit("\n")))
    return events(spark, sf_dir).select("seq", text.original(made, 60).alias("o")).select("seq", "o.*")


def exception_graphs(spark, sf_dir):
    name = F.col("template_id").cast("string")
    trace = _pick(
        F.col("seq"), F.concat(F.lit("boom\napp.JobError: job "), name, F.lit("\n\tat a.B.run(B.java:5)\n\tat a.C.go(C.java:1)\nCaused by: java.io.IOException: disk "), name, F.lit("\n\tat d.E.f(E.java:9)")), F.concat(F.lit("java.lang.IllegalStateException: k"), name), F.col("message"),
    )
    return events(spark, sf_dir).select("seq", exceptions.graph(trace).alias("g")).select("seq", "g.*")


def bundle_check(spark, sf_dir):
    key = F.col("s_suppkey")
    files = table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), key.cast("string")).alias("path"), F.encode("s_name", "UTF-8").alias("content"), key.alias("key"))
    declared = files.where("key % 7 <> 0").select("path", F.when(F.col("key") % 5 == 0, F.lit("00")).otherwise(F.upper(F.sha2("content", 256))).alias("sha256"), (F.octet_length("content") + F.when(F.col("key") % 3 == 0, 1).otherwise(0)).cast("long").alias("n_bytes"))
    declared = declared.unionByName(declared.where("path like '%1'")).unionByName(files.where("key % 11 = 1").select(F.concat(F.lit("g"), "path").alias("path"), F.lit("00").alias("sha256"), F.lit(1).cast("long").alias("n_bytes")))
    return archives.verified(declared, files.select("path", "content"))


def reviewed_selection(spark, sf_dir):
    key = F.col("s_suppkey")
    found = table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), key.cast("string")).alias("identity"), F.sha2("s_name", 256).alias("sha256"), key.alias("key"))
    allowed = found.where("key % 2 = 0").select("identity", F.when(F.col("key") % 3 == 0, F.lit("old")).otherwise(F.col("sha256")).alias("sha256"))
    return archives.selected(found.where("key % 5 <> 0"), allowed)


def bounded_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", archives.bounded(F.coalesce("text", F.lit("")), 500).alias("b")).select("doc_id", F.sha2("b.text", 256).alias("text_sha256"), "b.truncated")


def evidence_packing(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey"), "l_linenumber", F.col("l_quantity").cast("long").alias("length"), F.col("l_suppkey") % 4)
    return selection.packed(lines, "l_orderkey", [F.asc("l_linenumber"), F.asc("length")], 80, 6)


def nested_update(spark, sf_dir):
    job = F.struct(F.col("o_orderkey").alias("id"), F.struct(F.col("o_orderstatus").alias("status"), F.lit(0).alias("tries")).alias("state"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(job.withField("state.status", F.when(F.col("o_orderkey") % 2 == 0, "done").otherwise(F.col("o_orderstatus")))).alias("job"))


_REP = """SELECT seq AS id, seq % 2 = 0 AS is_full, 'E' || (template_id % 3) AS signature, source, CASE seq % 9 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS service, CASE WHEN seq % 4 = 0 THEN host END AS host,
  CASE WHEN seq % 3 = 0 THEN 'r' || (seq // 40) END AS request, CASE seq % 5 WHEN 0 THEN 't1' WHEN 1 THEN 't2' END AS thread, seq, ts, ts + 400 AS te, seq % 11 <> 0 AS wall FROM e WHERE level = 'error' AND ts IS NOT NULL AND seq % 13 <> 0"""
_KEYWORD = "len(list_intersect(list_distinct(['the', 'that', 'and', 'tion', 'whthan']), list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: len(w) > 1)))"
_SCORED = f"""s AS (SELECT conv_id, turn, length(coalesce(text, '')) AS length, CAST({_KEYWORD} AS DOUBLE) AS kw FROM conversations), b AS (SELECT max(kw) AS best FROM s), h AS (SELECT *, least(1, kw / best) AS k, (length % 100) / 100.0::DOUBLE AS sim, 1.0::DOUBLE / (1 + turn) AS rec FROM s, b WHERE kw > 0)"""
_STATES = """l AS (SELECT o_custkey % 240 AS rule_id, max(o_orderkey) AS revision FROM orders GROUP BY 1),
  r AS (SELECT *, CASE revision % 5 WHEN 0 THEN 'disabled' WHEN 1 THEN 'removed' ELSE 'enabled' END AS state, rule_id % 130 AS template_id, CASE WHEN rule_id % 31 <> 0 THEN 'f' || (rule_id % 130) || CASE WHEN rule_id % 9 = 0 THEN 'x' ELSE '' END END AS fingerprint FROM l),
  t AS (SELECT DISTINCT template_id FROM e), c AS (SELECT template_id, count(*) AS n FROM r WHERE state = 'enabled' GROUP BY 1),
  st AS (SELECT rule_id, revision, state, r.template_id, CASE WHEN state <> 'enabled' THEN 'inactive' WHEN fingerprint IS NULL THEN 'invalid_predicate' WHEN c.n > 1 THEN 'conflicting_predicate' WHEN t.template_id IS NULL THEN 'stale_target_missing'
    WHEN fingerprint <> 'f' || r.template_id THEN 'stale_fingerprint_changed' ELSE 'matches_current' END AS resolution FROM r LEFT JOIN t ON t.template_id = r.template_id LEFT JOIN c ON c.template_id = r.template_id)"""
_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_STEM = "'d' || folder || '/app.log'"

ORACLES = {
    "exception_envelopes": _with(f"""SELECT seq, CASE WHEN seq % 5 IN (0, 1, 3) THEN 'stderr' END AS stream, {_sql_pick('seq', "'pool-' || template_id", "NULL", "'t' || template_id", "'a-2'", "NULL")} AS thread,
  CASE WHEN seq % 5 IN (0, 2) THEN CAST(seq AS VARCHAR) END AS request, {_sql_pick('seq', "'java.io.IOException: x request_id=' || seq", "'(bad(one) y'", "message || ' thread=t' || template_id || ' traceId=' || seq", "'tid=a-2 hi'", "message")} AS payload, seq % 5 = 3 AS conflict, seq % 5 = 1 AS malformed FROM e"""),
    "pattern_roles": _with(f"""SELECT template_id, {_sql_pick('template_id', *(f"'{r}'" if r else 'NULL' for r in _ROLES))} AS role, count(*) AS n FROM e GROUP BY 1, 2"""),
    "exception_families": _with("""SELECT 'E' || (template_id % 37) AS signature, CAST(sum(template_id % 4 + 1) AS BIGINT) AS records, CAST(sum(CASE WHEN seq % 3 = 0 THEN template_id % 4 + 1 ELSE 0 END) AS BIGINT) AS wrapped_records, count(*) AS renderings, count(DISTINCT trace_id) AS occurrences,
  CASE WHEN occurrences = 0 THEN 0 ELSE records % occurrences END AS remainder, CASE WHEN occurrences = 0 THEN 0 ELSE records // occurrences END AS each FROM e WHERE level = 'error' GROUP BY 1 ORDER BY records DESC, signature LIMIT 24"""),
    "exception_pairs": _with(f""", r AS ({_REP}), j AS (SELECT a.id AS "left", b.id AS "right", coalesce(a.request = b.request, false) AS anchor, a.wall AND b.wall AS timed, greatest(0, b.ts - a.te, a.ts - b.te) <= 2 AS close, coalesce(a.thread = b.thread, false) AS same_thread, coalesce(a.thread <> b.thread, false) AS other_thread, a.source = b.source AS same_source,
    coalesce(a.request, a.thread, b.request, b.thread) IS NULL AS keyless FROM r a JOIN r b ON a.signature = b.signature AND a.is_full AND NOT b.is_full AND NOT coalesce(a.service <> b.service, false) AND NOT coalesce(a.host <> b.host, false) AND NOT coalesce(a.request <> b.request, false) AND NOT (a.source = b.source AND abs(a.seq - b.seq) > 512)),
  p AS (SELECT "left", "right", CASE WHEN other_thread AND (same_source OR NOT anchor) THEN NULL WHEN anchor AND (NOT timed OR close) THEN 'strong' WHEN timed AND close AND same_thread THEN 'strong' WHEN timed AND close AND keyless THEN 'moderate' END AS confidence FROM j)
SELECT *, CASE WHEN count(*) OVER (PARTITION BY "left") = 1 AND count(*) OVER (PARTITION BY "right") = 1 THEN 'paired' ELSE 'ambiguous' END AS status FROM p WHERE confidence IS NOT NULL"""),
    "template_episodes": _with(""", b AS (SELECT *, coalesce(seq - lag(seq) OVER w > 40 OR abs(ts - lag(ts) OVER w) > 3600, true)::INT AS b FROM e WHERE level = 'error' WINDOW w AS (PARTITION BY source, host ORDER BY seq)), n AS (SELECT *, sum(b) OVER (PARTITION BY source, host ORDER BY seq) AS episode FROM b),
  s AS (SELECT source, host, episode, min(seq) AS f, max(seq) AS l FROM n GROUP BY 1, 2, 3) SELECT template_id, count(DISTINCT CASE WHEN episode IS NOT NULL THEN s.source || '/' || s.host || '/' || episode END) AS episodes, count(*) FILTER (episode IS NULL) AS outside FROM e LEFT JOIN s ON e.source = s.source AND e.host = s.host AND e.seq BETWEEN f AND l GROUP BY 1"""),
    "rerank_anchors": _with(""", p AS (SELECT source, seq, ts, message, row_number() OVER (PARTITION BY source ORDER BY value DESC NULLS LAST, seq) AS pre_rank FROM e QUALIFY pre_rank <= 40),
  a AS (SELECT *, CASE WHEN contains(message, 'k=7') OR contains(message, 'k=8') THEN 'exact_phrase' WHEN row_number() OVER (PARTITION BY source ORDER BY ts, seq) = 1 OR row_number() OVER (PARTITION BY source ORDER BY ts DESC, seq DESC) = 1 THEN 'chronology' END AS anchor, CASE WHEN pre_rank <= 30 THEN seq * 7919 % 101 END AS score FROM p),
  o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC NULLS LAST, pre_rank) AS place FROM a), m AS (SELECT *, sum((place > 12 AND anchor IS NOT NULL)::INT) OVER (PARTITION BY source ORDER BY place) AS late, sum((place <= 12 AND anchor IS NULL)::INT) OVER (PARTITION BY source ORDER BY place DESC) AS weak FROM o),
  k AS (SELECT *, least(max(late) OVER (PARTITION BY source), max(weak) OVER (PARTITION BY source)) AS moved FROM m), f AS (SELECT *, place > 12 AS promoted FROM k WHERE (place > 12 AND anchor IS NOT NULL AND late <= moved) OR (place <= 12 AND (anchor IS NOT NULL OR weak > moved)))
SELECT source, seq, CAST(pre_rank AS INT) AS pre_rank, anchor, promoted, CAST(row_number() OVER (PARTITION BY source ORDER BY place) AS INT) AS final_rank FROM f"""),
    "hybrid_chunks": f"WITH {_SCORED} SELECT conv_id, turn, CAST(length AS INT) AS length, round(0.55::DOUBLE * k + 0.35::DOUBLE * sim + 0.10::DOUBLE * rec, 6) AS score FROM h ORDER BY score DESC, conv_id, turn, length LIMIT 200",
    "keyword_chunks": f"WITH {_SCORED} SELECT conv_id, turn, CAST(length AS INT) AS length, round((0.55::DOUBLE * k + 0.10::DOUBLE * rec) / 0.65::DOUBLE, 6) AS score FROM h ORDER BY score DESC, conv_id, turn, length LIMIT 200",
    "help_pages": f"WITH {_SCORED}, z AS (SELECT conv_id, turn, CAST(length AS INT) AS length, round(0.65::DOUBLE * k + 0.35::DOUBLE * sim, 6) AS score FROM h) SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn, length) = 1 ORDER BY score DESC, conv_id, turn, length LIMIT 50",
    "focus_neighbourhood": _with(""", r AS (SELECT seq, source, seq % 97 = 0 AND source < 'src4' AS focus, 'c' || (seq % 5) AS candidate, CASE WHEN seq % 89 <> 1 THEN seq END AS ordinal, seq % 5 IN (0, 2) AS traced FROM e),
  f AS (SELECT candidate, arg_min(source, ordinal) AS fs, min(ordinal) AS fo FROM r WHERE focus AND ordinal IS NOT NULL GROUP BY 1), c AS (SELECT seq AS id, CASE WHEN traced AND source <> fs AND ordinal > fo THEN 'propagation' WHEN traced AND source <> fs THEN 'trace_linked' ELSE 'focus' END AS category FROM r LEFT JOIN f USING (candidate) WHERE focus),
  p AS (SELECT source, ordinal AS pt FROM r WHERE focus AND ordinal IS NOT NULL), o AS (SELECT r.*, source IN (SELECT source FROM p) AS own FROM r WHERE NOT focus AND ordinal IS NOT NULL),
  n AS (SELECT o.seq, o.ordinal, own, min(abs(ordinal - pt) * 1000000000 + pt) AS near FROM o JOIN p ON pt BETWEEN ordinal - 8 AND ordinal + 8 AND (NOT own OR o.source = p.source) GROUP BY ALL), k AS (SELECT * FROM n ORDER BY near // 1000000000, ordinal, seq LIMIT 500)
SELECT * FROM c UNION ALL SELECT r.seq, CASE WHEN k.seq IS NULL THEN 'independent_noise' WHEN NOT k.own THEN 'cross_source_temporal' WHEN k.ordinal < near % 1000000000 THEN 'preceding_same_source' ELSE 'following_same_source' END FROM r LEFT JOIN k ON k.seq = r.seq WHERE NOT focus"""),
    "suppression_rules": _with(f", {_STATES} SELECT * FROM st"),
    "suppression_lens": _with(f", {_STATES} SELECT source, count(*) AS n FROM e WHERE NOT (template_id IN (SELECT template_id FROM st WHERE resolution = 'matches_current') AND template_id IN (SELECT s_suppkey % 150 FROM supplier)) GROUP BY 1"),
    "space_binding": """SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 0 OR s_suppkey % 4 = 0 THEN 'legacy_unbound' WHEN s_suppkey % 2 = 1 AND s_suppkey % 5 <> 0 AND s_suppkey % 3 = 0 THEN 'bound' ELSE 'drift' END AS verdict,
  CASE WHEN verdict <> 'legacy_unbound' THEN concat_ws(',', CASE WHEN s_suppkey % 2 = 0 THEN 'model' END, CASE WHEN s_suppkey % 5 = 0 THEN 'dialect' END, CASE WHEN s_suppkey % 3 <> 0 THEN 'dimensions' END) END AS drift FROM supplier""",
    "version_pairs": """WITH r AS (SELECT o_orderpriority AS name, o_custkey % 50 AS task, CAST(year(o_orderdate) AS INT) AS snapshot, CAST(month(o_orderdate) AS INT) AS version, o_orderkey AS run, floor(o_totalprice / 10000) AS score FROM orders WHERE o_orderkey % 10 <> 0),
  p AS (SELECT name, task, snapshot, lag(version) OVER w AS older_version, version AS newer_version, lag(run) OVER w AS older_run, run AS newer_run, score - lag(score) OVER w AS d FROM r WINDOW w AS (PARTITION BY name, task, snapshot ORDER BY version, run))
SELECT * EXCLUDE (d), CASE WHEN d > 0 THEN 'improved' WHEN d < 0 THEN 'regressed' WHEN d = 0 THEN 'unchanged' ELSE 'incomparable' END AS change FROM p WHERE older_version <> newer_version""",
    "memory_import": "SELECT sha256(trim(text)) AS id, min(role) AS kind FROM conversations WHERE trim(text) <> '' AND trim(text) NOT IN (SELECT trim(text) FROM conversations WHERE conv_id % 3 = 0 AND text IS NOT NULL) GROUP BY 1",
    "original_page": _with("SELECT seq, level || ' ' || message AS original FROM e WHERE seq > 300 ORDER BY seq LIMIT 512"),
    "feed_items": """SELECT s_suppkey, 0 AS place, 'A & ' || s_suppkey AS title, 'http://a/' || s_suppkey AS link, 'bold text' AS snippet FROM supplier UNION ALL SELECT s_suppkey, 2, 'C', 'http://c/?q=1&k=' || s_suppkey, '' FROM supplier""",
    "profile_groups": f"""SELECT {_sql_pick('o_orderkey', "'logs/app-' || o_orderkey || '.log'", "'logs/a/b.c/' || o_orderkey || '.log'", "'etc/' || o_orderkey || '.conf'", "'etc/x/' || o_orderkey || '.conf'", "'box.zip!/m-' || o_orderkey")} AS identity, {_sql_pick('o_orderkey', "'ambiguous'", "'all'", "'conf'", 'NULL', "'member'")} AS "group" FROM orders""",
    "rolled_groups": f"""WITH f AS (SELECT DISTINCT o_orderkey % 700 AS folder, (o_orderkey // 700) % 6 AS i FROM orders), g AS (SELECT folder, i, CASE WHEN folder % 7 = 0 AND i = 1 THEN 'json' WHEN folder % 11 <> 0 THEN 'plain' END AS format, {_STEM} || {_sql_pick('i', *(f"'{x}'" for x in _ROLLED))} AS identity FROM f)
SELECT {_STEM} AS stem, min(format) AS format, string_agg(identity, ',' ORDER BY identity) AS members, count(*) AS n FROM g WHERE format IS NOT NULL GROUP BY folder HAVING count(*) > 1 AND min(format) = max(format) AND max(i) > 0""",
    "json_guards": f"""SELECT o_orderkey, CAST({_sql_pick('o_orderkey', '3', '1', '0', '0', '4')} AS INT) AS depth, CASE WHEN o_orderkey % 5 <> 3 THEN o_orderkey % 5 = 1 END AS repeats, {_sql_pick('o_orderkey', """'{"a":[{"c":"}{"},1.5],"b":' || o_orderkey || '}'""", 'NULL', 'CAST(o_orderkey AS VARCHAR)', 'NULL', "'[[[[]]]]'")} AS canonical FROM orders""",
    "normalized_export": _with("""SELECT source, seq, sha256('{"body":"' || message || '","severity":{"raw":"' || level || '"},"sourceSeq":' || seq || ',"time":{"basis":"wall","instant":"' || strftime(make_timestamp(ts * 1000000), '%Y-%m-%dT%H:%M:%SZ') || '","resolution":"source_explicit"}}') AS line_sha256 FROM e"""),
    "checked_events": _with(f""", v AS (SELECT 's' || (seq // 500) AS source, seq AS line_no, CASE WHEN seq % 7 <> 6 THEN seq + (seq % 101 = 0)::INT END AS n FROM e), c AS (SELECT *, lag(n) OVER (PARTITION BY source ORDER BY line_no) + 1 <> n AS broken FROM v)
SELECT source, line_no, array_to_string(list_sort(list_filter(string_split({_sql_pick('line_no', *(f"'{c}'" for c in _CODES))} || CASE WHEN broken THEN ',sequence_not_contiguous' ELSE '' END, ','), lambda x: x <> '')), ',') AS codes FROM c"""),
    "share_safe_texts": "SELECT o_orderkey, 'see [endpoint-redacted] in [local-path]/' || o_orderkey || '.log, [local-path]/b' || o_orderkey || ' by [identity-redacted]; [credential-redacted] or a/b/c' AS shown FROM orders",
    "condensed_queries": rf"""WITH w AS (SELECT conv_id, turn, array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s/\\|]+'), lambda w: regexp_replace(w, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') <> '' AND lower(regexp_replace(w, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')) NOT IN ({_STOP})), ' ') AS t FROM conversations) SELECT conv_id, turn, sha256(t) AS words_sha256 FROM w""",
    "memory_cues": """SELECT o_orderkey, 'explicit_please_remember' AS cue, 'fact' AS kind, 'the API runs on port ' || o_orderkey || '!' AS content, 80 AS salience, 93 AS confidence FROM orders WHERE o_orderkey % 4 = 0
UNION ALL SELECT o_orderkey, 'decision_we_decided', 'decision', 'maybe `' || o_orderkey, CASE WHEN length('maybe `' || o_orderkey) < 12 THEN 50 ELSE 60 END, CASE WHEN length('maybe `' || o_orderkey) < 12 THEN 43 ELSE 58 END FROM orders WHERE o_orderkey % 4 = 1 AND length('maybe `' || o_orderkey) >= 8
UNION ALL SELECT o_orderkey, 'pref_i_prefer', 'preference', 'tea over number ' || o_orderkey || '.', CASE WHEN length('tea over number ' || o_orderkey || '.') >= 20 THEN 63 ELSE 58 END, CASE WHEN length('tea over number ' || o_orderkey || '.') >= 20 THEN 67 ELSE 57 END FROM orders WHERE o_orderkey % 4 = 3""",
    "calendar_times": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%a %b %-d %H:%M:%S %Y') END AS local_text FROM orders",
    "quality_findings": _with(""", t AS (SELECT count(*) AS n, count(*) FILTER (seq % 10 < 6) AS wall, count(*) FILTER (seq % 10 = 6) AS un, count(*) FILTER (template_id % 3 <> 0) AS plain, count(trace_id) AS traced, count(*) FILTER (level <> 'unknown') AS known FROM e),
  s AS (SELECT count(DISTINCT source) FILTER (CAST(source[4:] AS INT) % 3 = 1) AS failed, count(DISTINCT source) FILTER (CAST(source[4:] AS INT) % 3 = 2) AS ignored FROM e), p AS (SELECT max(c) AS c FROM (SELECT count(*) AS c FROM e GROUP BY template_id)),
  w AS (SELECT count(*) AS weak FROM (SELECT source FROM e GROUP BY 1 HAVING count(*) >= 2 AND count(*) FILTER (seq % 10 < 6) * 10000 // count(*) < 5000)), m AS (SELECT *, (n - wall - un) * 10000 // n AS ord, un * 10000 // n AS uns, c * 10000 // n AS top FROM t, s, p, w)
SELECT 'lq.timestamp.order_only_dominant' AS id, 'critical' AS severity, 95 AS priority, ord AS measured FROM m WHERE ord >= 8000 UNION ALL SELECT 'lq.timestamp.mixed_certainty', 'high', 85, ord FROM m WHERE ord < 8000 AND wall > 0 AND wall < n
UNION ALL SELECT 'lq.timestamp.unresolved_local_share', CASE WHEN uns >= 2500 THEN 'high' ELSE 'medium' END, 80, uns FROM m WHERE uns >= 500 UNION ALL SELECT 'lq.selection.failed_sources', 'high', 78, failed FROM m WHERE failed > 0
UNION ALL SELECT 'lq.severity.stored_level_not_provenance', CASE WHEN known * 10000 // n < 7000 THEN 'high' ELSE 'info' END, CASE WHEN known * 10000 // n < 7000 THEN 72 ELSE 35 END, known * 10000 // n FROM m UNION ALL SELECT 'lq.noise.review_only_concentration', CASE WHEN top >= 5000 THEN 'high' ELSE 'medium' END, 70, top FROM m WHERE top >= 2500 AND n >= 20
UNION ALL SELECT 'lq.timestamp.source_weak_certainty', 'medium', 65, weak FROM m WHERE weak > 0 UNION ALL SELECT 'lq.trace.low_parser_trace_id_coverage', 'medium', 60, traced * 10000 // n FROM m WHERE traced * 10000 // n < 2000 UNION ALL SELECT 'lq.parse.mostly_plain', 'medium', 55, plain * 10000 // n FROM m WHERE plain * 10000 // n >= 6000
UNION ALL SELECT 'lq.selection.coverage_buckets', 'info', 40, ignored FROM m WHERE ignored > 0"""),
    "original_records": _with("""SELECT seq, message || CASE WHEN seq % 3 = 0 THEN ' password=[REDACTED:ASSIGNMENT]' ELSE ' äöü' END AS whole, CASE WHEN strlen(whole) > 60 THEN whole[:60] ELSE whole END AS text, CAST(strlen(message) + CASE WHEN seq % 3 = 0 THEN 24 ELSE 7 END AS INT) AS source_bytes,
  CAST(length(whole) AS INT) AS redacted_chars, strlen(whole) > 60 AS truncated, seq % 3 = 0 AS redaction_applied FROM e""").replace("SELECT seq, message ||", "SELECT * EXCLUDE (whole) FROM (SELECT seq, message ||") + ")",
    "exception_graphs": _with(f"""SELECT seq, {_sql_pick('seq', "'app.JobError>java.io.IOException'", "'java.lang.IllegalStateException'", "''")} AS types, {_sql_pick('seq', "'a.B.run>d.E.f'", "''", "''")} AS frames, {_sql_pick('seq', "'disk ' || template_id", "'k' || template_id", "''")} AS root_detail,
  {_sql_pick('seq', "'a.B.run'", "'sig:java.lang.IllegalStateException'", "'unknown_site'")} AS site, seq % 3 = 0 AS complete FROM e"""),
    "bundle_check": """SELECT 'f' || s_suppkey AS path, CASE WHEN s_suppkey % 7 = 0 THEN 'undeclared' WHEN s_suppkey % 10 = 1 THEN 'declared_twice' WHEN s_suppkey % 3 = 0 THEN 'size_mismatch' WHEN s_suppkey % 5 = 0 THEN 'digest_mismatch' ELSE 'ok' END AS status FROM supplier
UNION ALL SELECT 'gf' || s_suppkey, 'missing' FROM supplier WHERE s_suppkey % 11 = 1""",
    "reviewed_selection": "SELECT 'f' || s_suppkey AS identity, CASE WHEN s_suppkey % 5 = 0 THEN 'missing' WHEN s_suppkey % 3 = 0 THEN 'changed' ELSE 'selected' END AS status FROM supplier WHERE s_suppkey % 2 = 0",
    "bounded_lines": r"SELECT doc_id, sha256(substring(regexp_replace(coalesce(text, ''), '\r?\n?\z', ''), 1, 500)) AS text_sha256, length(regexp_replace(coalesce(text, ''), '\r?\n?\z', '')) > 500 AS truncated FROM documents",
    "evidence_packing": """WITH RECURSIVE l AS (SELECT l_orderkey, CAST(floor(l_quantity) AS BIGINT) AS length, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(floor(l_quantity) AS BIGINT)) AS place FROM lineitem QUALIFY place <= 6),
  f AS (SELECT l_orderkey, 0 AS place, CAST(0 AS BIGINT) AS used, '' AS places FROM (SELECT DISTINCT l_orderkey FROM l) UNION ALL SELECT l.l_orderkey, CAST(l.place AS INT), CASE WHEN used + length <= 80 THEN used + length ELSE used END, CASE WHEN used + length <= 80 THEN places || ',' || l.place ELSE places END FROM f JOIN l ON l.l_orderkey = f.l_orderkey AND l.place = f.place + 1)
SELECT l_orderkey, used, places[2:] AS places FROM f QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY place DESC) = 1""",
    "nested_update": """SELECT o_orderkey, '{"id":' || o_orderkey || ',"state":{"status":"' || CASE WHEN o_orderkey % 2 = 0 THEN 'done' ELSE o_orderstatus END || '","tries":0}}' AS job FROM orders""",
    "substring_search": """WITH h AS (SELECT DISTINCT conv_id, turn, role, text, instr(lower(text), 'thand') AS place FROM conversations WHERE contains(lower(text), 'thand')), x AS (SELECT *, greatest(1, place - 40) AS s FROM h)
SELECT conv_id, turn, CASE WHEN s > 1 THEN '…' ELSE '' END || substring(text, s, 85) || CASE WHEN s + 85 <= length(text) THEN '…' ELSE '' END AS excerpt FROM x ORDER BY conv_id, turn LIMIT 200""",
}

#: Rows only: clusters and chunks are held against brute force in tests.
ROWS_ONLY = {"problem_clusters": problem_clusters, "text_chunks": text_chunks}

QUERIES = {name: globals()[name] for name in ORACLES} | ROWS_ONLY
