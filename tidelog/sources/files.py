"""Files of any size as lines: a deterministic inventory, splits by byte ranges, bounded lines, a digest of each source.

Spark's text reader cuts a file into byte ranges and gives each line to the range it begins
in, on every file system that Spark reads. A line's number is the number of lines in the
ranges before it, a small table, plus its place in its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .archives import members

# Entries and bytes that one walk may meet, and bytes of a line.
MAX_ENTRIES, MAX_TOTAL_BYTES, MAX_LINE_BYTES = 50_000, 4 << 30, 16 << 20
_INVENTORY = "path string, name string, n_bytes long, status string"


class LimitExceeded(ValueError):
    """A walk met more entries or bytes than it may."""


def inventory(spark: SparkSession, path: str, max_entries: int = MAX_ENTRIES, max_bytes: int = MAX_TOTAL_BYTES) -> DataFrame:
    """path, name (below the root), n_bytes, status of everything under a file or folder, in the order of paths.

    Status is file, hidden (a name that begins with a dot, not entered), reserved (one that
    begins with an underscore, which Spark's readers pass over), symlink, or other for what is
    no regular file. The driver lists folders, as Spark does for its own readers; entries and
    bytes are bounded, and LimitExceeded says which bound was met.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    rows: list[tuple[str, str, int, str]] = []
    total = 0

    def is_link(at) -> bool:
        if fs.getScheme() != "file":
            return False
        plain = jvm.java.io.File(at.toUri().getPath()).toPath()
        return jvm.java.nio.file.Files.isSymbolicLink(plain)

    def add(status, name: str) -> None:
        nonlocal total
        at, base = status.getPath(), status.getPath().getName()
        kind = "symlink" if is_link(at) else "hidden" if base.startswith(".") else "reserved" if base.startswith("_") else "file" if status.isFile() else "folder" if status.isDirectory() else "other"
        if len(rows) >= max_entries:
            raise LimitExceeded(f"more than {max_entries} entries")
        if kind == "file":
            total += status.getLen()
            if total > max_bytes:
                raise LimitExceeded(f"more than {max_bytes} bytes")
        rows.append((at.toString(), name, status.getLen() if kind == "file" else 0, kind))
        if kind == "folder":
            below = sorted(fs.listStatus(at), key=lambda s: s.getPath().getName())
            for s in below:
                add(s, f"{name}/{s.getPath().getName()}".lstrip("/"))

    top = fs.getFileStatus(root)
    if is_link(root):
        raise ValueError("a symlink is no source")
    if top.isFile():
        add(top, root.getName())
    else:
        for s in sorted(fs.listStatus(root), key=lambda s: s.getPath().getName()):
            add(s, s.getPath().getName())
    found = [r for r in rows if r[3] != "folder"]
    return spark.createDataFrame(sorted(found), _INVENTORY)


def lines(spark: SparkSession, paths: list[str], max_line_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """source, line_no (from 0), line, n_bytes (with no line feed), truncated of text files, in as many tasks as they have splits.

    A line longer than `max_line_bytes` is cut there and truncated, so no row grows beyond
    that; bytes that are no UTF-8 become U+FFFD; one carriage return at the end goes. The end
    of a file without a line feed is a line like any other, an empty end is none.
    """
    if not paths:
        return spark.createDataFrame([], "source string, line_no long, line string, n_bytes long, truncated boolean")
    place = F.monotonically_increasing_id()  # the task's number above 33 bits of the row's
    raw = spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("begin"), place.alias("place"), "value")
    within = Window.partitionBy("source").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    splits = raw.groupBy("source", "begin").agg(F.count("*").alias("n"), F.min("place").alias("lead")).withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0)))
    data = F.col("value").cast("binary")
    size = F.octet_length(data).cast("long")
    cut = F.make_valid_utf8(F.when(size > max_line_bytes, F.substring(data, 1, max_line_bytes)).otherwise(data).cast("string"))
    numbered = raw.join(splits.select("source", "begin", "lead", "before"), ["source", "begin"])
    return numbered.select("source", (F.col("before") + F.col("place") - F.col("lead")).alias("line_no"), F.regexp_replace(cut, r"\r$", "").alias("line"), size.alias("n_bytes"), (size > max_line_bytes).alias("truncated"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each source's lines in order, and of the line feeds between them and, if the size says so, behind them."""
    now, sha, seen, size, count = None, None, 0, 0, 0

    def out() -> pa.RecordBatch:
        if seen < size:
            sha.update(b"\n")
        return pa.RecordBatch.from_pylist([{"source": now, "n_lines": count, "n_bytes": size, "sha256": sha.hexdigest()}])

    for batch in batches:
        for source, total, value in zip(batch.column("source").to_pylist(), batch.column("size").to_pylist(), batch.column("value")):
            if source != now:
                if now is not None:
                    yield out()
                now, sha, seen, size, count = source, hashlib.sha256(), 0, total, 0
            elif count:
                sha.update(b"\n")
                seen += 1
            data = value.as_buffer()
            sha.update(data)
            seen, count = seen + data.size, count + 1
    if now is not None:
        yield out()


def digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """source, n_lines, n_bytes, sha256 of the bytes of text files. Files without a byte have no row.

    A digest is a chain over its file, so one task streams through each file; memory is that of
    a batch of lines, however long the file.
    """
    if not paths:
        return spark.createDataFrame([], "source string, n_lines long, n_bytes long, sha256 string")
    raw = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("place"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value")
    )
    return raw.repartition("source").sortWithinPartitions("source", "begin", "place").select("source", "size", "value").mapInArrow(_hashed, "source string, n_lines long, n_bytes long, sha256 string")


def ingested(spark: SparkSession, path: str, max_line_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """source, line_no, line, truncated of a text file, of a folder's files in the order of paths, or of a zip archive's members.

    Archives that lie in a folder are unpacked as well, with the bounds of `archives.members`;
    what cannot be unpacked has no lines.
    """
    found = [r.path for r in inventory(spark, path).where("status = 'file'").collect()]
    packed = [p for p in found if p.lower().endswith(".zip")]
    plain = lines(spark, [p for p in found if p not in set(packed)], max_line_bytes).select("source", "line_no", "line", "truncated")
    if not packed:
        return plain
    content = members(spark.read.format("binaryFile").load(packed).select(F.col("path").alias("identity"), "content")).where("content is not null")
    text = F.make_valid_utf8(F.col("content").cast("string"))
    each = content.select(F.col("identity").alias("source"), F.posexplode(F.split(F.regexp_replace(text, r"\n$", ""), "\n")).alias("line_no", "whole")).where("whole <> '' or line_no > 0")
    size, data = F.octet_length("whole"), F.col("whole").cast("binary")
    cut = F.make_valid_utf8(F.when(size > max_line_bytes, F.substring(data, 1, max_line_bytes)).otherwise(data).cast("string"))
    return plain.unionByName(each.select("source", F.col("line_no").cast("long").alias("line_no"), F.regexp_replace(cut, r"\r$", "").alias("line"), (size > max_line_bytes).alias("truncated")))
