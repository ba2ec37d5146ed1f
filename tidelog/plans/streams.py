"""Queries over files, framed lines, renderings and chains of exceptions, all made from the event table, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import exceptions, graphs, renderings
from ..shared import fresh_folder
from ..sources import files, framing
from ..sources.events import events
from .events import _with
from .triage import two_renderings


def _pick(number, *values):
    return F.element_at(F.array(*values), (number % len(values) + 1).cast("int"))


def file_reading(spark, sf_dir):
    """Writes the messages as one text file for each source and 20,000 events, and reads the folder again."""
    root = fresh_folder(spark, "files")
    name = F.concat("source", F.lit("-"), F.floor(F.col("seq") / 20_000).cast("string"))
    rows = events(spark, sf_dir).select(name.alias("file"), "seq", F.coalesce("message", F.lit("")).alias("value"))
    rows.repartition("file").sortWithinPartitions("file", "seq").select("file", "value").write.partitionBy("file").text(root)
    paths = [r.path for r in files.inventory(spark, root).where("status = 'file'").collect()]
    last = files.lines(spark, paths).groupBy("source").agg(F.max("line_no").alias("last_line_no"), F.max_by("line", "line_no").alias("last_line"), F.count_if("truncated").alias("cut"))
    return files.digests(spark, paths).join(last, "source").select(F.regexp_extract("source", "file=([^/]+)", 1).alias("file"), "n_lines", "n_bytes", "sha256", "last_line_no", "last_line", "cut")


def exact_framing(spark, sf_dir):
    at = lambda pattern: F.date_format(F.timestamp_seconds(F.coalesce("ts", F.lit(0))), pattern)
    n, stamp, iso = F.col("seq").cast("string"), at("yyyy-MM-dd HH:mm:ss"), at("yyyy-MM-dd'T'HH:mm:ss'Z'")
    made = _pick(
        F.col("seq"), F.array(F.lit("{"), F.concat(F.lit('  "id": '), n, F.lit(", \"text\": \"}\"")), F.lit("}")), F.array(F.concat(F.lit('"a","b",'), n, F.lit(',"open')), F.lit('closed"')), F.array(F.concat(F.lit("note "), n)),
        F.array(F.concat(F.lit("panic: boom "), n), F.lit(""), F.lit("goroutine 1 [running]:")), F.array(F.concat(stamp, F.lit(" failed "), n), F.lit("java.io.IOException: x"), F.lit("\tat a.B(C.java:7)")),
        F.array(F.concat(stamp, F.lit(".000 UTC [12] ERROR:  bad")), F.concat(stamp, F.lit(".000 UTC [12] DETAIL:  Key "), n)), F.array(F.concat(iso, F.lit(" stdout P part")), F.concat(iso, F.lit(" stdout F end "), n)),
    )
    rows = events(spark, sf_dir).select(F.concat(F.lit("f"), F.floor(F.col("seq") / 500).cast("string")).alias("source"), "seq", F.posexplode(made).alias("i", "line"))
    found = framing.framed(rows.select("source", (F.col("seq") * 10 + F.col("i")).alias("line_no"), "line"), 128)
    return found.select("source", "first_line", "n_lines", "truncated", F.sha2("text", 256).alias("text_sha256"))


def exception_renderings(spark, sf_dir):
    n = F.col("seq").cast("string")
    made = _pick(
        F.col("seq"), F.concat(F.lit("[stderr] (t1) app.JobException: job "), n), F.lit("[stderr] (t1) at a.B(C.java:1)"), F.lit("[stderr] (t2) java.io.IOException: x"), F.lit("[stderr] (t1) Caused by: java.net.TimeoutException: after 5 ms"),
        F.lit("[stderr] (t2) at x.Y(Z.java:3)"), F.concat(F.lit("ERROR boom\njava.lang.IllegalStateException: q "), n, F.lit("\n\tat a.b(C.java:5)")), F.lit("[stderr] (!!) at lost.Frame(A.java:1)"), F.lit("[stderr] (t1) at stray.Frame(A.java:1)"),
    )
    rows = events(spark, sf_dir).select("seq", F.concat(F.lit("f"), F.floor(F.col("seq") / 50_000).cast("string")).alias("source"), F.col("seq").alias("ts"), F.lit(True).alias("wall"), made.alias("message"), "service", "host", "trace_id")
    return renderings.renderings(rows).select("id", "kind", "source", "thread", "signature", "records", "last_seq", F.octet_length("payload").alias("n_bytes"))


def exception_chains(spark, sf_dir):
    """Every event as a whole stack, some of a trace, some of a thread."""
    seq = F.col("seq")
    stack = F.concat(F.lit("x"), F.when(seq % 4 == 1, F.concat(F.lit(" thread=w"), F.floor(seq / 12).cast("string"))).otherwise(""), F.lit("\njava.io."), _pick(seq + F.floor(seq / 7), F.lit("Closed"), F.lit("Timed")), F.lit("Exception: q\n\tat a.B"), (seq % 5).cast("string"), F.lit("(C.java:5)"))
    rows = events(spark, sf_dir).select("seq", "source", F.floor(seq / 2).alias("ts"), (seq % 9 != 0).alias("wall"), stack.alias("message"), F.lit(None).cast("string").alias("service"), F.lit(None).cast("string").alias("host"), F.when(seq % 3 == 0, F.concat(F.lit("t"), F.floor(seq / 9).cast("string"))).alias("trace_id"))
    return renderings.chains(renderings.renderings(rows))


def exception_matching(spark, sf_dir):
    return graphs.matched(exceptions.candidates(two_renderings(spark, sf_dir)).select("left", "right"))


_STAMP = "strftime(make_timestamp(coalesce(ts, 0) * 1000000), '%Y-%m-%d %H:%M:%S')"
_ISO = "strftime(make_timestamp(coalesce(ts, 0) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"

ORACLES = {
    "file_reading": _with("""SELECT source || '-' || (seq // 20000) AS file, count(*) AS n_lines, CAST(sum(octet_length(encode(coalesce(message, ''))) + 1) AS BIGINT) AS n_bytes, sha256(string_agg(coalesce(message, ''), chr(10) ORDER BY seq) || chr(10)) AS sha256,
  count(*) - 1 AS last_line_no, arg_max(coalesce(message, ''), seq) AS last_line, CAST(0 AS BIGINT) AS cut FROM e GROUP BY 1"""),
    "exact_framing": _with(f"""SELECT 'f' || (seq // 500) AS source, seq * 10 AS first_line, CAST([3, 2, 1, 3, 3, 2, 2][seq % 7 + 1] AS BIGINT) AS n_lines, false AS truncated, sha256(replace(CASE seq % 7
  WHEN 0 THEN '{{|  "id": ' || seq || ', "text": "}}"|}}' WHEN 1 THEN '"a","b",' || seq || ',"open|closed"' WHEN 2 THEN 'note ' || seq WHEN 3 THEN 'panic: boom ' || seq || '||goroutine 1 [running]:'
  WHEN 4 THEN {_STAMP} || ' failed ' || seq || '|java.io.IOException: x|' || chr(9) || 'at a.B(C.java:7)' WHEN 5 THEN {_STAMP} || '.000 UTC [12] ERROR:  bad|' || {_STAMP} || '.000 UTC [12] DETAIL:  Key ' || seq
  ELSE {_ISO} || ' stdout P part|' || {_ISO} || ' stdout F end ' || seq END, '|', chr(10))) AS text_sha256 FROM e"""),
    "exception_renderings": _with("""SELECT min(seq) AS id, CASE WHEN lane = 'full' THEN 'full' ELSE 'wrapped' END AS kind, 'f' || (seq // 50000) AS source, CASE WHEN lane <> 'full' THEN lane END AS thread,
  CASE WHEN lane = 'full' THEN 'java.lang.illegalstateexception: q <*>' WHEN lane = 't2' THEN 'java.io.ioexception: x' WHEN bool_or(seq % 8 = 3) THEN 'java.net.timeoutexception: after <*> ms' ELSE 'app.jobexception: job <*>' END AS signature, CAST(count(*) AS INT) AS records, max(seq) AS last_seq,
  CAST(sum(CASE seq % 8 WHEN 0 THEN 22 + length(seq::VARCHAR) WHEN 1 THEN 16 WHEN 2 THEN 22 WHEN 3 THEN 48 WHEN 4 THEN 16 ELSE 64 + length(seq::VARCHAR) END) + count(*) - 1 AS INT) AS n_bytes
FROM (SELECT seq, CASE WHEN seq % 8 IN (0, 1, 3) THEN 't1' WHEN seq % 8 IN (2, 4) THEN 't2' ELSE 'full' END AS lane FROM e WHERE seq % 8 < 6) GROUP BY seq // 50000, seq // 8, lane"""),
}

QUERIES = {name: globals()[name] for name in (*ORACLES, "exception_chains", "exception_matching")}
