"""The analysis of signals. What follows from the query alone is computed once for each distinct query and joined back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexwave.functions import text as T
from lexwave.operators import lineage as L
from lexwave.sources import signals as S


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals with the cleaned first 280 characters of what was read."""
    rows = S.signals(spark, sf_dir)
    return rows.withColumn("observed", T.clean(F.substring("raw", 1, 280)))


def distinct_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query, raw, observed: a row for each distinct query."""
    rows = S.signals(spark, sf_dir).select("query").distinct().withColumn("raw", S.mock_text(F.col("query")))
    return rows.withColumn("observed", T.clean(F.substring("raw", 1, 280)))


def by_query(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """The signals' ids with columns that follow from their queries."""
    return S.signals(spark, sf_dir).drop("raw").join(rows, "query")


def analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_query(spark, sf_dir, analysed_queries(distinct_observed(spark, sf_dir), L.registry(spark)))


def analysed_queries(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Every score of rows (query, raw, observed; one a query)."""
    found = L.best(L.candidates(rows, "query", F.col("observed"), terms), "query").select("query", F.col("family_id").alias("family"), F.col("hybrid").alias("lineage_confidence"), "matched", "branch_operator")
    rows = rows.join(found, "query", "left")
    text = F.col("observed")
    rows = rows.withColumns(T.virality(text)).withColumn("stage", T.stage(text)).withColumn("neologisms", T.neologisms(text)).withColumn("n_neologisms", F.size("neologisms"))
    rows = rows.withColumns({"counts": T.typology_counts(text), "place": T.sense_place(text)})
    rows = rows.withColumn("type_scores", T.typology_scores(F.col("counts"), F.col("family"))).withColumns(T.typology_of(F.col("type_scores")))
    rows = rows.withColumns(T.sense(F.col("place"), F.col("family"), F.col("typology")))
    rows = rows.withColumns(T.predict(F.col("hybrid"), F.col("velocity"), F.col("acceleration"), F.col("lineage_confidence"), F.col("memetic_score"), F.col("stage"), F.col("n_neologisms")))
    rows = rows.withColumn("risk", T.risk(F.col("stage"), F.col("hybrid"), F.col("predicted"), F.col("lineage_confidence"), F.col("memetic_score"))).withColumn("tier", T.risk_tier(F.col("risk")))
    content = F.sha2(F.col("raw"), 256)
    key = F.concat_ws("|", F.lit("mock"), F.lower(F.trim("query")), content, F.lit(""), F.lit("ingest-v1.7"))
    return rows.withColumn("fingerprint_id", F.substring(F.sha2(key, 256), 1, 24))
