"""Mixing sources to target weights by the cube method.

Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share SHARE of all words; a target stops at CAP
times its source's words, and the excess goes to the others by weight. A document's expected copies are its source's
target over its source's words: the whole part is taken at once, the fraction is an inclusion probability. The cube
method moves these probabilities through the null space of two constraints (words and documents of the source), until
each is 0 or 1 but for two a block; blocks' remainders meet again in blocks, until one block a source is left, and only
its one or two remainders are landed. So a hot source is split over blocks and no total moves before the landing.

A null text has size 0. Rows with equal doc_id, source and size are one unit, taken alike. Random numbers follow from
the rows alone: reruns agree. An empty table gives no rows; a source without words has target 0. Other columns stay.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, fresh, saved, table

WEIGHTS, SHARE, CAP, BLOCK = (5.0, 2.0, 1.0), 1.5, 2.0, 4096
_EPS = 1e-9


def word_count(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(units: DataFrame) -> DataFrame:
    """source, source_size, n, target: one row a source. target = min(CAP x size, level x weight), the level from sorted ratios."""
    by = units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(place - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    rows = by.withColumn("weight", weight).withColumn("cap", CAP * F.col("source_size"))
    ratio = F.col("cap") / F.col("weight")
    upto = Window.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    # with the sources before this one at their caps, the level that shares out the rest
    level = (SHARE * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    rows = rows.withColumn("level", level).withColumn("free", F.col("level") <= ratio)
    common = F.min(F.when(F.col("free"), F.struct(ratio.alias("r"), F.col("level").alias("level")))).over(every)["level"]
    return rows.withColumn("target", F.coalesce(F.least("cap", common * F.col("weight")), F.col("cap"))).select("source", "source_size", "n", "target")


def flight(size: np.ndarray, p: np.ndarray, rng: np.random.Generator, land: bool = False) -> np.ndarray:
    """Moves p through the null space of (size, 1); at most two stay fractional, none if land."""
    p = np.where(p < _EPS, 0.0, np.where(p > 1 - _EPS, 1.0, p))
    todo = np.flatnonzero((p > 0) & (p < 1)).tolist()[::-1]
    draws = iter(rng.random(len(todo) + 4).tolist())
    pl, sl, active = p.tolist(), size.astype(float).tolist(), []
    while True:
        while len(active) < 3 and todo:
            active.append(todo.pop())
        s = [sl[i] for i in active]
        if len(active) == 3:
            u = (s[1] - s[2], s[2] - s[0], s[0] - s[1])
            if not any(u):
                u = (1.0, -1.0, 0.0)
        elif len(active) == 2 and (s[0] == s[1] or land):
            u = (1.0, -1.0)
        elif len(active) == 1 and land:
            u = (1.0,)
        else:
            break
        up = min((1 - pl[i]) / c if c > 0 else -pl[i] / c for i, c in zip(active, u, strict=True) if c)
        down = min(pl[i] / c if c > 0 else (pl[i] - 1) / c for i, c in zip(active, u, strict=True) if c)
        step = up if next(draws) * (up + down) < down else -down
        for i, c in zip(active, u, strict=True):
            x = pl[i] + step * c
            pl[i] = 0.0 if x < _EPS else 1.0 if x > 1 - _EPS else x
        active = [i for i in active if 0 < pl[i] < 1]
    return np.array(pl)


def _fly(level: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(w=-pdf["size"] * pdf["copies"]).sort_values(["w", "o", "doc_id"], kind="stable").drop(columns="w")  # long texts first: what is left to land is short
        seed = zlib.crc32(f"{pdf['source'].iloc[0]}|{pdf['block'].iloc[0]}|{level}".encode())
        pdf["p"] = flight((pdf["size"] * pdf["copies"]).to_numpy(), pdf["p"].to_numpy(), np.random.default_rng(seed), land=bool(pdf["last"].iloc[0]))
        return pdf

    return run


def mix(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row a unit: doc_id, source, size, copies (rows of the unit), source_size, target, times (that each is taken)."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"))
    units = saved(spark, sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies")), "units")
    goal = saved(spark, targets(units), "targets")
    expected = F.least(F.lit(CAP), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rows = units.join(broadcast_if_small(goal), units.source.eqNullSafe(goal.source)).select(units["*"], "source_size", "target", "n", expected.alias("e"))
    rows = rows.withColumn("whole", F.floor(F.col("e") + _EPS).cast("int")).withColumn("p", F.greatest(F.lit(0.0), F.col("e") - F.col("whole"))).withColumn("o", F.xxhash64("doc_id", "source", "size"))
    cols, schema = rows.columns, None
    done, level = [], 0
    while True:
        # as many blocks as the source's open units fill; the last level has one a source and lands it
        left = saved(spark, rows.groupBy("source").agg(F.count(F.lit(1)).alias("open")).select(F.col("source").alias("s"), F.ceil(F.col("open") / BLOCK).cast("int").alias("blocks")), "left")
        block = F.pmod(F.xxhash64("o", "doc_id", F.lit(level)), F.col("blocks")).cast("int")
        dealt = rows.join(broadcast_if_small(left), rows.source.eqNullSafe(left.s)).withColumn("block", block).withColumn("last", F.col("blocks") == 1).select(*cols, "block", "last")
        schema = schema or dealt.schema
        flown = saved(spark, dealt.groupBy("source", "block").applyInPandas(_fly(level), schema), "flown")
        still = F.col("p").between(_EPS, 1 - _EPS)
        done.append(flown.filter(~still).select(*cols))
        rows, level = flown.filter(still).select(*cols), level + 1
        if not rows.limit(1).count():
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "source", "size", "copies", "source_size", "target", (F.col("whole") + F.round("p").cast("int")).alias("times"))


def mixed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with each row as often as it is taken; all of docs' columns, whatever their names."""
    names = [fresh(docs, c) for c in ("mix_id", "mix_source", "mix_size", "mix_times", "mix_words")]
    m_id, m_source, m_size, times, words = names
    plan = saved(spark, mix(spark, docs).filter("times > 0").select(F.col("doc_id").alias(m_id), F.col("source").alias(m_source), F.col("size").alias(m_size), F.col("times").alias(times)), "mix")
    at = F.col("doc_id").cast("long").eqNullSafe(F.col(m_id)) & F.col("source").cast("string").eqNullSafe(F.col(m_source)) & (F.col(words) == F.col(m_size))
    met = docs.withColumn(words, word_count()).join(broadcast_if_small(plan), at)
    return met.withColumn(times, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(spark, table(spark, sf_dir, "documents"))
    each = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "source", "times")
