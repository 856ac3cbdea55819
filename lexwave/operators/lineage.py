"""Lineage: texts against the lexicon, by family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexwave.functions.text import AFTER, BEFORE, half_up
from lexwave.sources import lexicon as X

FAMILY_TERMS = "family_pos int, family_id string, branch_operator string, term_pos int, term string, weight double, n_terms int"


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(X.family_rows(), FAMILY_TERMS)


def hits(rows: DataFrame, key: str, text: Column, terms: DataFrame) -> DataFrame:
    """(key, chars, term columns) of each term in a text, in one pass over the texts. Single words of ASCII letters and digits
    are looked up among the text's distinct words; phrases by containment; other words by containment and a word test. The
    registry travels as one row of lists and is broadcast (a constant; an override must be as small)."""
    single, phrase = F.col("term").rlike("^[a-z0-9]+$"), F.col("term").contains(" ")
    lists = terms.agg(F.collect_set(F.when(single, F.col("term"))).alias("singles"), F.collect_set(F.when(phrase, F.col("term"))).alias("phrases"), F.collect_set(F.when(~single & ~phrase, F.col("term"))).alias("others"))
    low = rows.select(key, F.lower(text).alias("corpus")).crossJoin(F.broadcast(lists))
    words = F.array_intersect(F.split("corpus", r"[^\p{L}\p{N}_]+"), F.col("singles"))
    inside = F.filter("phrases", lambda t: F.col("corpus").contains(t))
    whole = F.filter("others", lambda t: F.col("corpus").contains(t) & F.regexp_like(F.col("corpus"), F.concat(F.lit(BEFORE), t, F.lit(AFTER))))
    found = low.select(key, F.length("corpus").alias("chars"), F.explode(F.concat(words, inside, whole)).alias("term"))
    return found.join(F.broadcast(terms), "term").select(key, "chars", "family_pos", "family_id", "branch_operator", "term_pos", "term", "weight", "n_terms")


def confidence(n: Column, specificity: Column, n_terms: Column, chars: Column) -> dict[str, Column]:
    coverage = n / n_terms
    bonus = F.when(n == 1, 0.12).when(n == 2, 0.22).when(n == 3, 0.30).when(n == 4, 0.36).otherwise(0.38)
    density = F.when(n >= 2, F.least(F.lit(0.18), 0.06 * (n - 1) * (0.5 + 0.5 * F.greatest(F.lit(0.0), 1.0 - chars / 600.0)))).otherwise(0.0)
    raw = 0.18 + 0.38 * specificity + 0.22 * coverage + bonus + density
    return {"coverage": coverage, "hit_bonus": bonus, "density": density, "raw_score": raw, "confidence": half_up(F.greatest(F.lit(0.0), F.least(F.lit(0.98), raw)), 3)}


def candidates(rows: DataFrame, key: str, text: Column, terms: DataFrame, boosts: DataFrame | None = None, min_confidence: float = X.THRESHOLD) -> DataFrame:
    """One row per (text, family) that is eligible; boosts: (family_id, boost), with the key where they differ
    by text, are added before the ranking."""
    by = hits(rows, key, text, terms).groupBy(key, "chars", "family_pos", "family_id", "branch_operator", "n_terms").agg(
        F.count(F.lit(1)).alias("n_hits"), F.avg("weight").alias("specificity"), F.sort_array(F.collect_list(F.struct("term_pos", "term"))).alias("found"))
    c = confidence(F.col("n_hits"), F.col("specificity"), F.col("n_terms"), F.col("chars"))
    out = by.withColumns(c).withColumn("matched", F.array_join(F.col("found.term"), ","))
    out = out.filter(F.col("confidence") >= min_confidence - 0.06)
    if boosts is not None:
        on = [key, "family_id"] if key in boosts.columns else ["family_id"]
        out = out.join(boosts, on, "left").withColumn("boost", F.coalesce("boost", F.lit(0.0)))
    else:
        out = out.withColumn("boost", F.lit(0.0))
    out = out.withColumn("hybrid", half_up(F.least(F.lit(0.98), F.col("confidence") + F.col("boost")), 3))
    return out.filter(F.col("hybrid") >= min_confidence)


def best(candidates_: DataFrame, key: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("hybrid"), F.desc("confidence"), "family_pos")
    return candidates_.withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank")


def hybrid_best(candidates_: DataFrame, key: str, margin: float = 0.08) -> DataFrame:
    """The best candidate by hybrid score, the lexical winner beside it, and whether the boosts changed the winner."""
    lexical = Window.partitionBy(key).orderBy(F.desc("confidence"), "family_pos")
    first = lambda c: F.first(c).over(lexical)
    rows = candidates_.withColumn("lexical_family", first("family_id")).withColumn("lexical_confidence", first("confidence"))
    changed = (F.col("family_id") != F.col("lexical_family")) & (F.col("hybrid") - F.col("lexical_confidence") >= -margin)
    return best(rows, key).withColumn("flipped", changed)
