"""Append-only, hash-chained ledgers."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64


def body_hash(*cols: Column) -> Column:
    """A record's own hash: its fields, joined with |."""
    return F.sha2(F.concat_ws("|", *cols), 256)


def linked(log: DataFrame, chain: str, seq: str, body: Column) -> DataFrame:
    """Each record with its body's hash and the one before in its chain (a link table; no recursion)."""
    rows = log.withColumn("body_hash", body)
    return rows.withColumn("prev_hash", F.lag("body_hash", 1, GENESIS).over(Window.partitionBy(chain).orderBy(seq)))


def append_chain(log: DataFrame, chain: str, seq: str, body: str, tips: DataFrame | None = None) -> DataFrame:
    """record_hash = sha256(prev_hash | body), in order of seq within each chain: sequential in a chain, parallel over chains.
    tips: (chain, tip) of chains that go on from an earlier record."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(seq)
        prev, out = pdf["_tip"].iloc[0] or GENESIS, []
        for x in pdf[body]:
            out.append((prev, hashlib.sha256(f"{prev}|{x}".encode()).hexdigest()))
            prev = out[-1][1]
        return pdf.assign(prev_hash=[a for a, _ in out], record_hash=[b for _, b in out]).drop(columns="_tip")

    schema = log.schema.simpleString()[7:-1] + ",prev_hash:string,record_hash:string"
    known = log.withColumn("_tip", F.lit(None).cast("string")) if tips is None else log.join(tips.withColumnRenamed("tip", "_tip"), chain, "left")
    return known.groupBy(chain).applyInPandas(run, schema)


def tips(log: DataFrame, chain: str, seq: str) -> DataFrame:
    """(chain, tip, last): each chain's last record hash and its seq."""
    return log.groupBy(chain).agg(F.max_by("record_hash", seq).alias("tip"), F.max(seq).alias("last"))


def verify_chain(log: DataFrame, chain: str, seq: str, body: str) -> DataFrame:
    """One row a chain: ok, n, the first broken record and why (the link is looked at before the record)."""
    order = Window.partitionBy(chain).orderBy(seq)
    rows = log.withColumn("want", F.lag("record_hash", 1, GENESIS).over(order)).withColumn("at", F.row_number().over(order) - 1)
    why = F.when(~F.col("prev_hash").eqNullSafe(F.col("want")), "prev_hash mismatch").when(~F.col("record_hash").eqNullSafe(F.sha2(F.concat_ws("|", "prev_hash", body), 256)), "record_hash mismatch")
    broken = F.min(F.when(F.col("why").isNotNull(), F.struct("at", "why")))
    out = rows.withColumn("why", why).groupBy(chain).agg(F.count(F.lit(1)).alias("n"), broken.alias("b"))
    return out.select(chain, "n", F.col("b").isNull().alias("ok"), F.col("b.at").alias("broken_at"), F.col("b.why").alias("reason"))


def verify_links(rows: DataFrame, chain: str, seq: str) -> DataFrame:
    """One row a chain of a link table: ok, n, the first seq whose link is broken."""
    want = F.lag("body_hash", 1, GENESIS).over(Window.partitionBy(chain).orderBy(seq))
    return rows.withColumn("bad", F.when(want != F.col("prev_hash"), F.col(seq))).groupBy(chain).agg(F.count(F.lit(1)).alias("n"), F.min("bad").alias("broken_at")).withColumn("ok", F.col("broken_at").isNull())


def stats(receipts: DataFrame) -> DataFrame:
    """Counts and mean confidence by family, by stage, by event type and overall, in one pass."""
    sets = receipts.groupingSets([("family",), ("stage",), ("event_type",), ()], "family", "stage", "event_type")
    kind = F.when(F.grouping("family") == 0, "family").when(F.grouping("stage") == 0, "stage").when(F.grouping("event_type") == 0, "event_type").otherwise("all")
    out = sets.agg(kind.alias("kind"), F.count(F.lit(1)).alias("n"), F.round(F.avg("lineage_confidence"), 6).alias("mean_confidence"))
    return out.select("kind", F.coalesce("family", "stage", "event_type", F.lit("all")).alias("value"), "n", "mean_confidence")
