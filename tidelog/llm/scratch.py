"""Tables that cut lineage, written to the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .tables import short_batches


def shared_root(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. A local session without one gets a folder of its own; on a cluster that would be each machine's own, so it is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidelog-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Writes intermediate tables as Parquet and reads them back.

    A lost executor costs only a re-run of the stage that was writing, since
    every later stage reads committed files. Tables a result still needs stay
    until the folder is emptied by whoever owns it; `drop` removes those that a
    later table has replaced.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        short_batches(spark)
        self.base = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
