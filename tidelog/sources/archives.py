"""What an import starts from: members of archives, reviewed selections, bundles with a manifest, lines of a bounded length."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How deep archives may lie in archives, and how much a member may grow when unpacked.
DEPTH, RATIO = 3, 2048


def _members(identity: str, data: bytes, depth: int) -> Iterator[tuple[str, bytes | None, str | None]]:
    """Identity, content and error of each file of an archive, archives inside it included. A member is unpacked when its turn comes."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, ValueError):
        yield identity, None, "not_an_archive"
        return
    for info in archive.infolist():
        name = f"{identity}!/{info.filename}"
        parts = info.filename.replace("\\", "/").split("/")
        if info.is_dir():
            continue
        if ".." in parts or parts[0] in ("", ".") or ":" in parts[0]:
            yield name, None, "unsafe_path"
        elif info.file_size > RATIO * max(1, info.compress_size):
            yield name, None, "ratio_exceeded"
        elif info.filename.lower().endswith(".zip") and depth >= DEPTH:
            yield name, None, "depth_exceeded"
        else:
            try:
                content = archive.read(info)
            except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError):
                yield name, None, "unreadable"
                continue
            if info.filename.lower().endswith(".zip"):
                yield from _members(name, content, depth + 1)
            else:
                yield name, content, None


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for identity, data in zip(batch["identity"], batch["content"], strict=True):
            for row in _members(identity, data or b"", 1):
                yield pd.DataFrame([row], columns=["identity", "content", "error"])


def members(archives: DataFrame) -> DataFrame:
    """identity, content, error of the files in zip archives (identity, content), as `outer.zip!/inner.zip!/app.log`.

    Archives may lie in archives up to DEPTH; what is deeper, grows more than RATIO
    times, leaves its folder or cannot be read has an error and no content. One archive
    is one row, as Spark's binaryFile source gives it, and is unpacked member by member.
    """
    return archives.select("identity", "content").mapInPandas(_unpacked, "identity string, content binary, error string")


def selected(inventory: DataFrame, allowed: DataFrame) -> DataFrame:
    """The files (identity, sha256) that were reviewed, by the status of each allowed one: selected, changed since, or missing; others are not let in."""
    both = allowed.select("identity", F.col("sha256").alias("reviewed")).join(inventory.select("identity", F.col("sha256").alias("found")), "identity", "left")
    status = F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("reviewed"), "selected").otherwise("changed")
    return both.select("identity", status.alias("status"))


def verified(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Each path of a bundle by what is wrong with it: the manifest (path, sha256, n_bytes) against its files (path, content)."""
    found = files.select("path", F.sha2("content", 256).alias("_sha256"), F.octet_length("content").cast("long").alias("_bytes"))
    twice = manifest.groupBy("path").agg(F.count("*").alias("_times"), F.min("sha256").alias("sha256"), F.min("n_bytes").alias("n_bytes"))
    both = twice.join(found, "path", "full")
    status = (
        F.when(F.col("_times").isNull(), "undeclared").when(F.col("_times") > 1, "declared_twice").when(F.col("_sha256").isNull(), "missing")
        .when(F.col("n_bytes") != F.col("_bytes"), "size_mismatch").when(F.lower("sha256") != F.col("_sha256"), "digest_mismatch").otherwise("ok")
    )
    return both.select("path", status.alias("status"))


def bounded(line: Column, limit: int) -> Column:
    """Struct of text and truncated: a line without its ending, cut at `limit` characters, so that no record grows without bound."""
    bare = F.regexp_replace(line, r"\r?\n?$", "")
    return F.struct(F.substring(bare, 1, limit).alias("text"), (F.length(bare) > limit).alias("truncated"))
