"""The corpus pipeline: language, near copies, benchmark leaks, mixture, token files.

Every stage takes (spark, docs, sf_dir) and its result is written as Parquet and read again as the next one's docs. All
stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexwave.llm.common import new_path, table
from lexwave.llm.decontaminate import decontaminate
from lexwave.llm.language_id import with_language
from lexwave.llm.mixing import mixed
from lexwave.llm.near_dedup import near_dedup
from lexwave.llm.token_store import token_store

STAGES = [
    ("language_id", lambda spark, docs, sf_dir: with_language(spark, docs)),
    ("near_dedup", lambda spark, docs, sf_dir: near_dedup(spark, docs)),
    ("decontaminate", lambda spark, docs, sf_dir: decontaminate(spark, docs, table(spark, sf_dir, "benchmark"))),
    ("mixing", lambda spark, docs, sf_dir: mixed(spark, docs)),
    ("token_store", lambda spark, docs, sf_dir: token_store(spark, docs)),
]

#: Kernel regression, sampling and learned token merges can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(path := new_path(spark, f"pipeline-{name}"))
        docs = spark.read.parquet(path)
    return docs
