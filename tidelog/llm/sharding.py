"""A store of immutable Parquet shards with size-tiered compaction and versioned manifests.

An append writes its rows as small shards. A shard belongs to a tier by its size:
tier 0 holds those of at least half the target, each further tier those FANOUT times
smaller. Once a tier holds MERGE runs, they are read and written again as files of
about the target size. Runs of one tier are alike in size, so merging is a coalesce
of their partitions: no row is shuffled, and no task holds more than a batch.

Every change writes new files first and then commits a manifest that names all live
shards. The commit claims its version by creating a file that must not exist, then
renames the finished manifest into place, so a reader sees the old version or the new
one, and of two writers one fails and can retry. A writer that dies after its claim
blocks nobody for longer than CLAIM_SECONDS: then the version may be claimed anew, and
a late writer whose claim has been overtaken gives up. Creating a file that must not
exist has to be atomic, as on HDFS and local disks; on object stores it is where the
connector offers conditional puts. Vacuuming spares unnamed files younger than
GRACE_SECONDS, which a writer may be about to commit. Files outside the manifest, as a
failed or lost task leaves them, are never read. As with Spark's own file index, the
list of files is held by the driver; rows are not.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import shared_root

TARGET_BYTES = 128 << 20
FANOUT = 4
MERGE = 4
ARRIVAL_ROWS = 2000
#: Age from which a claim without a manifest counts as dead, and from which a file without a manifest may go.
CLAIM_SECONDS = 900
GRACE_SECONDS = 24 * 3600
#: Files of one merge job.
AT_ONCE = 10_000


class ConcurrentCommit(RuntimeError):
    """Another writer has committed or claimed the version."""


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, merge: int = MERGE, claim_seconds: float = CLAIM_SECONDS):
        self.spark, self.root, self.target, self.fanout, self.merge, self.claim_seconds = spark, root.rstrip("/"), target_bytes, fanout, merge, claim_seconds
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._hadoop.Path(f"{self.root}/manifest"))

    # Manifests

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._hadoop.Path(f"{self.root}/manifest"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if not version:
            return []
        lines = self.spark.read.text(f"{self.root}/manifest/{version:012d}.json").collect()
        return [Shard(**json.loads(r["value"])) for r in lines]

    def _claims(self, version: int) -> list:
        """Claims of a version, oldest first."""
        found = self._fs.globStatus(self._hadoop.Path(f"{self.root}/manifest/{version:012d}.claim-*")) or []
        return sorted(found, key=lambda s: int(s.getPath().getName().rpartition("-")[2]))

    def _commit(self, shards: list[Shard], after: int) -> int:
        at = f"{self.root}/manifest/{after + 1:012d}"
        path = self._hadoop.Path
        before = self._claims(after + 1)
        alive = before and time.time() - before[-1].getModificationTime() / 1000 < self.claim_seconds
        if alive or self._fs.exists(path(f"{at}.json")) or not self._fs.createNewFile(path(f"{at}.claim-{len(before)}")):
            raise ConcurrentCommit(f"version {after + 1} is taken")
        draft = path(f"{at}.{uuid.uuid4().hex}.draft")
        out = self._fs.create(draft, False)
        out.write(bytearray("".join(json.dumps(asdict(s)) + "\n" for s in sorted(shards, key=lambda s: s.path)).encode()))
        out.close()
        if len(self._claims(after + 1)) > len(before) + 1 or self._fs.exists(path(f"{at}.json")) or not self._fs.rename(draft, path(f"{at}.json")):
            raise ConcurrentCommit(f"version {after + 1} could not be put in place")
        return after + 1

    # Shards

    def tier(self, size: int) -> int:
        return 0 if 2 * size >= self.target else 1 + int(math.log(self.target / (2 * max(size, 1)), self.fanout))

    def _written(self, df: DataFrame, rows_each: int = 0) -> list[Shard]:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", rows_each).parquet(folder)
        found = self._fs.listStatus(self._hadoop.Path(folder))
        return [Shard(s.getPath().toString(), s.getLen()) for s in found if s.getPath().getName().startswith("part-")]

    def append(self, arrivals: DataFrame, rows_each: int = ARRIVAL_ROWS) -> int:
        """Adds rows as small shards; returns the version that has them. No rows add no shards."""
        before = self.version()
        shards = self._written(arrivals, rows_each)
        return self._commit(self.manifest(before) + shards, before)

    def compact(self) -> int:
        """Merges tiers until none but tier 0 holds `merge` runs; returns the newest version."""
        while True:
            version = self.version()
            live = self.manifest(version)
            tiers: dict[int, list[Shard]] = {}
            for s in live:
                tiers.setdefault(self.tier(s.bytes), []).append(s)
            ripe = [t for t, runs in tiers.items() if t and len(runs) >= self.merge]
            if not ripe:
                return version
            runs = sorted(tiers[max(ripe)], key=lambda s: s.path)[:AT_ONCE]
            merged = self._written(self.spark.read.parquet(*(s.path for s in runs)).coalesce(max(1, round(sum(s.bytes for s in runs) / self.target))))
            self._commit([s for s in live if s not in set(runs)] + merged, version)

    def vacuum(self, keep: int = 1, grace_seconds: float = GRACE_SECONDS) -> None:
        """Deletes data files that none of the newest `keep` manifests name, and older manifests.

        Files younger than `grace_seconds` stay; with 0, no other writer may be at work.
        """
        old = (time.time() - grace_seconds) * 1000
        newest = self.version()
        live = {s.path for v in range(max(1, newest - keep + 1), newest + 1) for s in self.manifest(v)}
        data = self._hadoop.Path(f"{self.root}/data")
        for folder in self._fs.listStatus(data) if self._fs.exists(data) else []:
            files = list(self._fs.listStatus(folder.getPath()))
            young = any(s.getModificationTime() > old for s in [folder, *files])
            if not young and not any(s.getPath().toString() in live for s in files):
                self._fs.delete(folder.getPath(), True)
                continue
            for s in files:
                if s.getPath().getName().startswith("part-") and s.getPath().toString() not in live and s.getModificationTime() <= old:
                    self._fs.delete(s.getPath(), False)
        for v in range(1, newest - keep + 1):
            self._fs.delete(self._hadoop.Path(f"{self.root}/manifest/{v:012d}.json"), False)
            for s in self._claims(v):
                self._fs.delete(s.getPath(), False)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version; None if it has no shards."""
        shards = self.manifest(version)
        return self.spark.read.parquet(*(s.path for s in shards)) if shards else None


def sharded(docs: DataFrame, arrivals: int = 4, target_bytes: int = TARGET_BYTES) -> ShardStore:
    """A store that got `docs` in `arrivals` parts (by a hash of doc_id), compacted after each.

    All columns and rows are stored as they are, null and repeated ones too.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, f"{shared_root(spark)}/shards-{uuid.uuid4().hex[:12]}", target_bytes)
    for a in range(arrivals):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)) == a))
        store.compact()
        store.vacuum(grace_seconds=0)  # the store is this call's own
    return store


def contents(store: ShardStore, like: DataFrame) -> DataFrame:
    """What the newest version holds, row by row: doc_id, n_bytes, text_sha256, and whether the row's shard is in the manifest's tiers.

    settled is true if the shard has its final size or waits in a tier that is not yet full.
    """
    shards = store.manifest()
    rows = store.read()
    if rows is None:
        rows = like.limit(0)
    tiers = [store.tier(s.bytes) for s in shards]
    settled = all(t == 0 or tiers.count(t) < store.merge for t in tiers)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"), F.lit(settled).alias("settled"))
