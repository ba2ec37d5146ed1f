"""Queries over log lines of many formats, made from the event table, and their SQL, which knows what each line was made from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, times
from ..sources import formats, logs
from ..sources.events import events, table
from .events import _with

_FORMATS = ("json", "logfmt", "rfc5424", "syslog", "postgres", "wildfly", "elasticsearch", "docker", "cef", "cri", "datetime", "postgres_csv", "plain")


def _lines(spark, sf_dir):
    """seq, source and a line for each event, in the format that seq % 13 picks."""
    m, level = F.col("message"), F.col("level")
    at = lambda pattern: F.date_format(F.timestamp_seconds("ts"), pattern)
    iso, plain, upper = at("yyyy-MM-dd'T'HH:mm:ss'Z'"), at("yyyy-MM-dd HH:mm:ss"), F.upper(level)
    pri = F.when(level == "error", "11").when(level == "warn", "12").when(level == "info", "14").otherwise("15")
    pg = F.when(level == "error", "ERROR").when(level == "warn", "WARNING").when(level == "info", "LOG").otherwise("DEBUG2")
    made = (
        F.to_json(F.struct(iso.alias("time"), level.alias("level"), m.alias("msg"), F.col("service"))),
        F.concat(F.lit("ts="), iso, F.lit(" level="), level, F.lit(' msg="'), m, F.lit('"')),
        F.concat(F.lit("<"), pri, F.lit(">1 "), iso, F.lit(" h1 app 12 - - "), m),
        F.concat(F.lit("<"), pri, F.lit(">"), at("MMM dd HH:mm:ss"), F.lit(" h1 app[7]: "), m),
        F.concat(plain, F.lit(" UTC [12] "), pg, F.lit(":  "), m),
        F.concat(at("HH:mm:ss"), F.lit(",250 "), upper, F.lit("  [org.app] (main) "), m),
        F.concat(F.lit("["), iso, F.lit("]["), F.rpad(upper, 5, " "), F.lit("][o.e.Node  ] [n1] "), m),
        F.to_json(F.struct(F.concat(level, F.lit(": "), m).alias("log"), F.lit("stderr").alias("stream"), iso.alias("time"))),
        F.concat(F.lit("CEF:0|v|app|1|7|"), m, F.lit("|"), F.when(level == "error", "8").when(level == "warn", "5").otherwise("2"), F.lit("|src=1")),
        F.concat(iso, F.lit(" stdout F "), level, F.lit(": "), m),
        F.concat(plain, F.lit("+02:00 "), upper, F.lit(" "), m),
        F.concat(plain, F.lit(' UTC,"u","d",12,"h","s",3,"t","2024",1,2,'), pg, F.lit(',00000,"'), m, F.lit('",,,,,,,,')),
        F.concat(F.lit("~ "), m),
    )
    return events(spark, sf_dir).select("seq", "source", F.element_at(F.array(*made), (F.col("seq") % 13 + 1).cast("int")).alias("line"))


def log_parsing(spark, sf_dir):
    found = formats.parsed(_lines(spark, sf_dir).select("seq", "line"), "line")
    return found.select("seq", "format", "ts", "level", "message")


def log_format_counts(spark, sf_dir):
    rows = formats.parsed(_lines(spark, sf_dir), "line")
    return rows.groupBy("source", "format").agg(F.count("*").alias("n"), F.count("ts").alias("timed"), F.count_if(F.col("level") != "unknown").alias("levelled"))


def line_formats(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy(logs.line_format(F.col("line")).alias("format")).agg(F.count("*").alias("n"))


def cri_joining(spark, sf_dir):
    mark = F.when(F.col("turn") % 3 == 2, "F").otherwise("P")
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    found = formats.joined_fragments(turns.select(F.col("conv_id").alias("source"), F.col("turn").alias("line_no"), F.concat(F.lit("2024-01-01T00:00:00Z stdout "), mark, F.lit(" "), "text").alias("line")))
    return found.select("source", "record", "fragments", F.sha2("text", 256).alias("text_sha256"))


def record_framing(spark, sf_dir):
    stamp = F.concat(F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd HH:mm:ss"), F.lit(" "), "message")
    lines = F.when(F.col("seq") % 3 == 0, F.array(stamp)).when(F.col("seq") % 3 == 1, F.array(stamp, F.lit("java.io.IOException: x"), F.lit("\tat a.B(C.java:7)"))).otherwise(F.array(stamp, F.lit("  detail")))
    rows = events(spark, sf_dir).select(F.concat("source", F.lit("/"), F.floor(F.col("seq") / 500).cast("string")).alias("source"), "seq", F.posexplode(lines).alias("i", "line"))
    found = logs.records(rows.select("source", (F.col("seq") * 10 + F.col("i")).alias("line_no"), "line"))
    return found.select("source", "record", "n_lines", F.sha2("text", 256).alias("text_sha256"))


def exception_signatures(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("java.lang.IllegalStateException", "ValueError", "app.io.DiskError"))), (F.col("seq") % 3 + 1).cast("int"))
    cause = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("\nCaused by: java.net.TimeoutException: after "), F.col("seq").cast("string"), F.lit(" ms"))).otherwise("")
    trace = F.concat("message", F.lit("\n"), kind, F.lit(": job "), F.col("template_id").cast("string"), F.lit(" at 0xdeadbeef0123\n\tat a.B(C.java:5)"), cause)
    rows = events(spark, sf_dir).where("level = 'error'").select(text.exception_signature(trace).alias("signature"))
    return rows.groupBy("signature").agg(F.count("*").alias("n"))


def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.title(F.col("html")).alias("title"), text.without_markup(F.col("html")).alias("text"))


def dst_resolve(spark, sf_dir):
    local = F.col("o_orderdate").cast("timestamp") + F.make_interval(mins=F.col("o_orderkey").cast("int") % 1440)
    at, reason = times.local_to_utc(local, "America/Chicago")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.unix_seconds(at).alias("ts"), reason.alias("reason"))


_STAMPED = "strftime(make_timestamp(ts * 1000000), '%Y-%m-%d %H:%M:%S') || ' ' || message"
_BARE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _entity, _plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _BARE = f"replace({_BARE}, '{_entity}', '{_plain}')"
_NAMES = ", ".join(f"'{n}'" for n in _FORMATS)

ORACLES = {
    "log_parsing": _with(f"""SELECT seq, [{_NAMES}][CAST(seq % 13 + 1 AS BIGINT)] AS format, CASE WHEN seq % 13 IN (3, 5, 8, 12) THEN NULL WHEN seq % 13 = 10 THEN ts - 7200 ELSE ts END AS ts,
  CASE WHEN seq % 13 = 8 AND level = 'debug' THEN 'info' WHEN seq % 13 = 12 THEN CASE WHEN service = 'error' THEN 'error' ELSE 'unknown' END ELSE level END AS level,
  CASE WHEN seq % 13 IN (7, 9) THEN level || ': ' || message WHEN seq % 13 = 12 THEN '~ ' || message ELSE message END AS message FROM e"""),
    "log_format_counts": _with(f"""SELECT source, [{_NAMES}][CAST(seq % 13 + 1 AS BIGINT)] AS format, count(*) AS n, count(*) FILTER (seq % 13 NOT IN (3, 5, 8, 12)) AS timed, count(*) FILTER (seq % 13 <> 12 OR service = 'error') AS levelled FROM e GROUP BY 1, 2"""),
    "line_formats": _with("SELECT CASE WHEN seq % 13 IN (0, 7) THEN 'json' WHEN seq % 13 IN (2, 3) THEN 'syslog' WHEN seq % 13 IN (4, 9, 10, 11) THEN 'logfmt' ELSE 'logfmt' END AS format, count(*) AS n FROM e GROUP BY 1"),
    "cri_joining": """WITH t AS (SELECT conv_id AS source, turn, min(coalesce(text, '')) AS text FROM conversations GROUP BY 1, 2), r AS (SELECT *, sum(CASE WHEN turn % 3 = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY turn) - CASE WHEN turn % 3 = 2 THEN 1 ELSE 0 END AS record FROM t)
SELECT source, CAST(record AS BIGINT) AS record, count(*) AS fragments, sha256(string_agg(text, '' ORDER BY turn)) AS text_sha256 FROM r GROUP BY 1, 2""",
    "record_framing": _with(f"""SELECT source || '/' || (seq // 500) AS source, row_number() OVER (PARTITION BY source, seq // 500 ORDER BY seq) AS record, [1, 3, 2][CAST(seq % 3 + 1 AS BIGINT)] AS n_lines,
  sha256({_STAMPED} || [ '', chr(10) || 'java.io.IOException: x' || chr(10) || chr(9) || 'at a.B(C.java:7)', chr(10) || '  detail'][CAST(seq % 3 + 1 AS BIGINT)]) AS text_sha256 FROM e"""),
    "exception_signatures": _with("""SELECT CASE WHEN seq % 2 = 0 THEN 'java.net.timeoutexception: after <*> ms' ELSE ['java.lang.illegalstateexception', 'valueerror', 'app.io.diskerror'][CAST(seq % 3 + 1 AS BIGINT)] || ': job <*> at <*>' END AS signature, count(*) AS n FROM e WHERE level = 'error' GROUP BY 1"""),
    "html_text": rf"SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\s*>', 1), '\s+', ' ', 'g')), '') AS title, trim(regexp_replace({_BARE}, '\s+', ' ', 'g')) AS text FROM pages",
    "dst_resolve": """WITH l AS (SELECT o_orderkey, o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS BIGINT)) AS t FROM orders), u AS (SELECT *, timezone('America/Chicago', t) AS u FROM l),
r AS (SELECT o_orderkey, u, CASE WHEN timezone('America/Chicago', u) <> t THEN 'gap' WHEN timezone('America/Chicago', u + INTERVAL 1 HOUR) = t OR timezone('America/Chicago', u - INTERVAL 1 HOUR) = t THEN 'fold' ELSE 'resolved' END AS reason FROM u)
SELECT o_orderkey, CASE WHEN reason = 'resolved' THEN CAST(epoch(u) AS BIGINT) END AS ts, reason FROM r""",
}

QUERIES = {name: globals()[name] for name in ORACLES}
