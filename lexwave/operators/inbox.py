"""The inbox of high-priority signals: an append-only table, filtered by priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexwave.sources import store

ORDER = ["low", "medium", "high", "critical"]
STAGES = {"EMERGENT": 1, "ACTUALIZING": 2, "SETTLED": 3}


def rank(priority: Column) -> Column:
    """A priority's place; unknown and missing ones count as the lowest."""
    return F.greatest(F.coalesce(F.array_position(F.array(*map(F.lit, ORDER)), F.lower(priority)), F.lit(0)) - 1, F.lit(0)).cast("int")


def candidates(analysis: DataFrame, min_stage: str = "ACTUALIZING") -> DataFrame:
    """Signals of a stage or a later one, with the priority they are pushed with."""
    stages = F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv])
    rows = analysis.filter(F.coalesce(stages[F.col("stage")], F.lit(0)) >= STAGES[min_stage])
    return rows.withColumn("priority", F.when(F.col("stage") == "ACTUALIZING", "high").otherwise("medium"))


def push(rows: DataFrame, path: str) -> DataFrame:
    return store.append(rows, path)


def listed(rows: DataFrame, min_priority: str = "low", limit: int = 50, order: str = "signal_id") -> DataFrame:
    """The last rows of a priority or a higher one; an unknown priority asks for all; 0: no limit."""
    least = ORDER.index(min_priority.lower()) if min_priority.lower() in ORDER else 0
    out = rows.filter(rank(F.col("priority")) >= least)
    return out.orderBy(F.desc(order)).limit(limit) if limit > 0 else out


def clear(spark: SparkSession, path: str, dry_run: bool = False) -> int:
    """Empties the inbox (unless dry_run); the number of rows that it had."""
    if not store.exists(spark, path):
        return 0
    n = spark.read.parquet(path).count()
    if not dry_run:
        store.delete(spark, path)
    return n
