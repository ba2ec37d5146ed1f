"""Reading the input tables and fixing their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Rows of whole texts that go to a Python worker at once.
BATCH_ROWS = "1024"


def short_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches, whose default of 10,000 rows is much memory for texts; a session that has set it keeps its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_ROWS)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """`names`, each with as many underscores behind it as keep it apart from the columns of `df`."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
