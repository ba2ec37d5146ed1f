"""A training corpus from the documents table, in stages that are written and read again.

1. quality: documents that the boosted-tree classifier rejects go.
2. near_duplicates: one document of each MinHash near-duplicate group stays.
3. decontamination: documents that hold a benchmark item go.
4. personal_data: spans of personal data give way to their kind.
5. packing: pieces of the remaining documents get places in fixed-length sequences.

All stages but the last return the columns of their input. Rows with nulls, repeated
rows and empty tables pass as the operators of each stage define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.decontamination import without_benchmark
from tidelog.llm.minhash import without_near_duplicates
from tidelog.llm.packing import pack
from tidelog.llm.pii import without_personal_data
from tidelog.llm.quality import accepted
from tidelog.llm.scratch import Scratch
from tidelog.llm.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_personal_data(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", packing)]

#: A fitted classifier is no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
