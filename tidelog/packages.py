"""Packages of tables that may leave a cluster and come back: data, a manifest with digests, versions; and a catalog of corpora."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.archives import verified
from .state import Conflict

# The version of the layout, the oldest reader that understands it, and the tables one package may have.
FORMAT, READER, MAX_TABLES = 1, 1, 32


class Damaged(ValueError):
    """A package that is not what its manifest says, or that this reader does not understand."""


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _write_once(spark: SparkSession, path: str, text: str) -> None:
    at, fs = _path(spark, path)
    out = fs.create(at, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _text(spark: SparkSession, path: str) -> str:
    at, fs = _path(spark, path)
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _files(spark: SparkSession, root: str) -> DataFrame:
    """path (below the package) and content of the data files; digests are taken where the files are read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{root}/data")
    return raw.select(F.regexp_extract("path", r"/(data/[^/]+/[^/]+)$", 1).alias("path"), "content")


def export(tables: dict[str, DataFrame], root: str, features: tuple[str, ...] = ()) -> None:
    """Writes tables, a manifest of their files (path, sha256, n_bytes) and a header to a folder that must not exist; the header comes last, so a folder without one is no package."""
    if not tables or len(tables) > MAX_TABLES or any(not n.isidentifier() for n in tables):
        raise Damaged("1 to 32 tables with plain names")
    spark = next(iter(tables.values())).sparkSession
    at, fs = _path(spark, root)
    if fs.exists(at):
        raise Damaged(f"{root} exists")
    for name, table in tables.items():
        table.write.parquet(f"{root}/data/{name}")
    manifest = _files(spark, root).select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("n_bytes"))
    manifest.write.parquet(f"{root}/manifest")
    rows = {n: spark.read.parquet(f"{root}/data/{n}").count() for n in tables}
    _write_once(spark, f"{root}/package.json", json.dumps({"format": FORMAT, "min_reader": READER, "features": sorted(features), "tables": rows}, sort_keys=True))


def header(spark: SparkSession, root: str) -> dict:
    """The header of a package this reader understands. Features it does not know are advice and pass."""
    at, fs = _path(spark, f"{root}/package.json")
    if not fs.exists(at):
        raise Damaged("no header")
    try:
        found = json.loads(_text(spark, f"{root}/package.json"))
        needs, names = int(found["min_reader"]), dict(found["tables"])
    except (ValueError, KeyError, TypeError) as e:
        raise Damaged("header") from e
    if needs > READER or int(found["format"]) < 1 or not names or len(names) > MAX_TABLES or any(not n.isidentifier() for n in names):
        raise Damaged("version or tables")
    return found


def problems(spark: SparkSession, root: str) -> DataFrame:
    """path and status of every file that is missing, changed, undeclared or declared twice."""
    return verified(spark.read.parquet(f"{root}/manifest"), _files(spark, root)).where("status <> 'ok'")


def load(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of a package, once every file is as declared and every table has its number of rows; Damaged otherwise."""
    found = header(spark, root)
    wrong = problems(spark, root).orderBy("path").limit(1).collect()
    if wrong:
        raise Damaged(f"{wrong[0].path}: {wrong[0].status}")
    tables = {n: spark.read.parquet(f"{root}/data/{n}") for n in found["tables"]}
    for name, n in found["tables"].items():
        if tables[name].count() != n:
            raise Damaged(f"{name}: rows")
    return tables


@dataclass(frozen=True)
class Corpus:
    corpus_id: str
    name: str
    path: str


class Catalog:
    """Corpora of a folder: one small file for each, so that making and renaming one touches no other; discarded ones are no longer listed, their data goes with them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def create(self, name: str) -> Corpus:
        if not name.strip():
            raise ValueError("a corpus has a name")
        made = Corpus(uuid.uuid4().hex, name.strip(), "")
        made = Corpus(made.corpus_id, made.name, f"{self.root}/{made.corpus_id}")
        _write_once(self.spark, f"{made.path}/names/00000000.json", json.dumps({"name": made.name}))
        return made

    def open(self, corpus_id: str) -> Corpus:
        at, fs = _path(self.spark, f"{self.root}/{corpus_id}/names")
        if not corpus_id.isalnum() or not fs.exists(at):
            raise LookupError(corpus_id)
        last = max(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().endswith(".json"))
        return Corpus(corpus_id, json.loads(_text(self.spark, f"{self.root}/{corpus_id}/names/{last}"))["name"], f"{self.root}/{corpus_id}")

    def rename(self, corpus_id: str, name: str) -> Corpus:
        """Names are a log as well: of two renamings at once, one is refused."""
        self.open(corpus_id)
        if not name.strip():
            raise ValueError("a corpus has a name")
        at, fs = _path(self.spark, f"{self.root}/{corpus_id}/names")
        n = len([s for s in fs.listStatus(at) if s.getPath().getName().endswith(".json")])
        try:
            _write_once(self.spark, f"{self.root}/{corpus_id}/names/{n:08d}.json", json.dumps({"name": name.strip()}))
        except Exception as e:
            raise Conflict(f"{corpus_id} was renamed by another writer") from e
        return self.open(corpus_id)

    def corpora(self) -> list[Corpus]:
        """All corpora, by name and then id."""
        at, fs = _path(self.spark, self.root)
        ids = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()] if fs.exists(at) else []
        return sorted((self.open(i) for i in ids if i.isalnum()), key=lambda c: (c.name, c.corpus_id))

    def discard(self, corpus_id: str) -> None:
        found = self.open(corpus_id)
        at, fs = _path(self.spark, found.path)
        fs.delete(at, True)
