"""Line grammars, times and identities on small hand-made cases."""

from pyspark.sql import functions as F

from tidelog.functions import text, times
from tidelog.sources import formats


def rows(spark, values, name="line"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")


def test_malformed_tails_stay_whole(spark):
    lines = [None, "", "<999>1 2024-01-01T00:00:00Z h a 1 - - x", "12:00:00,1 INFO [a] (b) c", "{not json", '{"msg": "a", "level": 50}', "CEF:0|v|p|1|7|name|10|", "<8>Jan  1 00:00:00 h app: m", "[2024-01-01T00:00:00,1][WARN ][x.y] [n] m"]
    found = formats.parsed(rows(spark, lines), "line").orderBy("i").collect()
    assert [(r["format"], r["level"]) for r in found] == [("plain", "unknown"), ("plain", "unknown"), ("plain", "unknown"), ("plain", "info"), ("plain", "unknown"), ("json", "error"), ("cef", "fatal"), ("syslog", "fatal"), ("elasticsearch", "warn")]
    assert found[4]["message"] == "{not json" and found[5]["message"] == "a" and found[6]["message"] == "name" and found[8]["ts"] is None


def test_fragments_with_an_open_end(spark):
    lines = [("s", 1, "t stdout P a"), ("s", 2, "t stdout F b"), ("s", 3, "t stderr P c"), ("z", 1, "t stdout F d")]
    found = formats.joined_fragments(spark.createDataFrame(lines, "source string, line_no int, line string")).orderBy("source", "record").collect()
    assert [(r["source"], r["text"], r["fragments"]) for r in found] == [("s", "ab", 2), ("s", "c", 1), ("z", "d", 1)]


def test_explicit_times(spark):
    given = ["2024-02-29 23:59:59Z", "2023-02-29 00:00:00Z", "2024-01-01T00:00:00.5+0530", "2024-01-01 00:00:00", "2024-01-01 00:00:00 CST", "2024-01-01 00:00:00 Mars", None]
    at, why = times.explicit_time(F.col("line"))
    assert [tuple(r) for r in rows(spark, given).orderBy("i").select(at, why).collect()] == [(1709251199, "explicit"), (None, "none"), (1704047400, "explicit"), (None, "unresolved_local"), (None, "unresolved_local"), (None, "none"), (None, "none")]


def test_secrets_identities_and_citations(spark):
    given = ['token = "0123456789abcdef"', "my_api_key: abcdefgh1", "Bearer abcdefghijklmnop", "http://u:p@host/", "the token is lost", None]
    found = [r[0] for r in rows(spark, given).orderBy("i").select(text.redacted(F.col("line"))).collect()]
    assert found == ['token = "[REDACTED:ASSIGNMENT]"', "my_api_key: [REDACTED:ASSIGNMENT]", "[REDACTED:BEARER]", "http://[REDACTED:URL_CREDENTIALS]@host/", "the token is lost", None]
    assert [r[0] for r in rows(spark, ["a\\b", "../a", "a//b/.", "C:\\x", None]).orderBy("i").select(text.source_identity(F.col("line"))).collect()] == ["a/b", None, "a/b", None, None]
    kind, number = text.citation_parts(F.col("line"), ("event",))
    assert [tuple(map(str, r)) for r in rows(spark, ["event:0", "event:01", "event:18446744073709551615", "event:18446744073709551616", "x:1"]).orderBy("i").select(kind, number).collect()] == [("event", "0"), ("None", "None"), ("event", "18446744073709551615"), ("None", "None"), ("None", "None")]
