"""Receipts of analyses: a JSON record each with its integrity hash, and an index ledger that chains them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexwave.operators import ledger as G
from lexwave.sources import store

#: A receipt's fields that its integrity covers, in order.
COVERED = ["signal_id", "query", "observed", "family", "lineage_confidence", "typology", "stage", "hybrid", "predicted", "n_neologisms", "fingerprint_id", "canonical_hash"]
#: What two receipts are compared by.
COMPARED = ["integrity", "canonical_hash", "source", "brier", "family", "lineage_confidence", "typology", "hybrid", "predicted", "stage", "n_neologisms"]


def text_of(c: str) -> Column:
    """A field as it stands in a hash's preimage: numbers with six places, nothing for null."""
    return F.when(F.col(c).isNull(), "").otherwise(F.format_string("%.6f", F.col(c)) if c in ("lineage_confidence", "hybrid", "predicted") else F.col(c).cast("string"))


def canonical_hash() -> Column:
    return F.substring(F.sha2(F.concat_ws("|", "fingerprint_id", F.substring("observed", 1, 100), F.col("n_neologisms").cast("string"), "query"), 256), 1, 16)


def integrity() -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[text_of(c) for c in COVERED]), 256), 1, 12)


def receipts(analysis: DataFrame, chain: str = "user_id") -> DataFrame:
    """One receipt an analysed signal. brier is NULL until a series scores it."""
    rows = analysis.withColumn("canonical_hash", canonical_hash()).withColumn("source", F.lit("mock")).withColumn("brier", F.lit(None).cast("double"))
    rows = rows.withColumn("integrity", integrity())
    return rows.select(F.col(chain).alias("chain"), *COVERED, "source", "brier", "integrity", F.concat(F.lit("receipt_"), F.col("signal_id").cast("string"), F.lit("_"), F.col("integrity")).alias("name"))


def verify(rows: DataFrame) -> DataFrame:
    """rows with ok and message: the integrity hash made again."""
    want = integrity()
    message = F.when(F.coalesce("integrity", F.lit("")) == "", "missing integrity").when(F.col("integrity") != want, "integrity mismatch").otherwise("valid")
    return rows.withColumn("message", message).withColumn("ok", F.col("message") == "valid")


def index_body() -> Column:
    return F.concat_ws("|", "name", "integrity", "canonical_hash", "source", F.coalesce("family", F.lit("")), text_of("lineage_confidence"), "stage", F.substring("observed", 1, 160))


def append_index(spark: SparkSession, new: DataFrame, path: str) -> DataFrame:
    """Adds receipts to the ledger at path (each chain goes on from its tip) and returns the ledger. One writer a chain."""
    rows = new.filter(F.coalesce("integrity", F.lit("")) != "").select("chain", "signal_id", "name", "integrity", "canonical_hash", "source", "family", "lineage_confidence", "stage", F.substring("observed", 1, 160).alias("preview"), index_body().alias("body"))
    tips = G.tips(spark.read.parquet(path), "chain", "seq") if store.exists(spark, path) else None
    order = F.row_number().over(Window.partitionBy("chain").orderBy("signal_id")).cast("long")
    if tips is None:
        rows = rows.withColumn("seq", order)
    else:
        rows = rows.join(tips.select("chain", "last"), "chain", "left").withColumn("seq", order + F.coalesce("last", F.lit(0))).drop("last")
    return store.append(G.append_chain(rows, "chain", "seq", "body", None if tips is None else tips.select("chain", "tip")), path)


def emit(spark: SparkSession, rows: DataFrame, folder: str, ledger: str) -> tuple[DataFrame, DataFrame]:
    """Writes receipts as JSON lines and indexes what was written; returns both as read back."""
    rows.write.mode("append").json(folder)
    back = spark.read.schema(rows.schema).json(folder)
    return back, append_index(spark, back.join(spark.read.parquet(ledger).select("name"), "name", "left_anti") if store.exists(spark, ledger) else back, ledger)


def listed(ledger: DataFrame, limit: int = 50, family: str | None = None) -> DataFrame:
    """The last entries, of one family if named; 0: all."""
    rows = ledger if family is None else ledger.filter(F.col("family") == family)
    return rows.orderBy(F.desc("signal_id")).limit(limit) if limit > 0 else rows


def diff(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """(key, field, a, b) of each compared field that differs between two receipts of one key."""
    fields = lambda df: F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("v")) for c in COMPARED])
    one = a.select(*key, F.inline(fields(a))).withColumnRenamed("v", "a")
    two = b.select(*key, F.inline(fields(b))).withColumnRenamed("v", "b")
    return one.join(two, [*key, "field"]).filter(~F.col("a").eqNullSafe(F.col("b")))


def summaries(rows: DataFrame, most: int = 240) -> DataFrame:
    """Publishable receipts: hashes and scores, and the observed text's beginning only."""
    return rows.select("integrity", "canonical_hash", "source", "query", "family", "lineage_confidence", "typology", "hybrid", "predicted", "stage", "n_neologisms", "brier", F.substring("observed", 1, most).alias("preview"), F.when(F.col("family").isNotNull(), "INFERRED").otherwise("NOT_COMPUTABLE").alias("lineage_label"))


def canonical_json(text: Column, escaped: bool = True, without: tuple[str, ...] = ()) -> Column:
    """A foreign JSON object as its writer hashes it: sorted keys, no blanks, characters beyond ASCII escaped or not; null if
    it isn't an object. Python, for its number and escape forms are Python's."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(t):
            try:
                x = json.loads(t)
            except (TypeError, ValueError):
                return None
            return json.dumps({k: v for k, v in x.items() if k not in without}, sort_keys=True, separators=(",", ":"), ensure_ascii=escaped) if isinstance(x, dict) else None

        for batch in batches:
            yield batch.map(one)

    return run(text)


def verify_foreign(rows: DataFrame, text: str) -> DataFrame:
    """rows with ok: whether a foreign receipt's integrity is the hash of all but its receipt block."""
    stated = F.get_json_object(text, "$.receipt.integrity")
    return rows.withColumn("ok", F.coalesce(F.substring(F.sha2(canonical_json(F.col(text), True, ("receipt",)), 256), 1, 12) == stated, F.lit(False)))


def foreign_hash(record: dict) -> str:
    """The hash of one foreign log record, over all but record_hash."""
    return hashlib.sha256(json.dumps({k: v for k, v in record.items() if k != "record_hash"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def verify_foreign_log(rows: DataFrame, chain: str, seq: str, text: str) -> DataFrame:
    """ledger.verify_chain for foreign JSON records: their own hash and the link to the record before."""
    want = F.sha2(canonical_json(F.col(text), False, ("record_hash",)), 256)
    at = rows.select(chain, seq, F.get_json_object(text, "$.prev_hash").alias("prev_hash"), F.get_json_object(text, "$.record_hash").alias("record_hash"), want.alias("want"))
    order = Window.partitionBy(chain).orderBy(seq)
    why = F.when(~F.col("prev_hash").eqNullSafe(F.lag("record_hash", 1, G.GENESIS).over(order)), "prev_hash mismatch").when(~F.col("record_hash").eqNullSafe(F.col("want")), "record_hash mismatch")
    bad = at.withColumn("at", F.row_number().over(order) - 1).withColumn("why", why)
    out = bad.groupBy(chain).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("why").isNotNull(), F.struct("at", "why"))).alias("b"))
    return out.select(chain, "n", F.col("b").isNull().alias("ok"), F.col("b.at").alias("broken_at"), F.col("b.why").alias("reason"))


def violations(rows: DataFrame, key: str, required: list[str], values: dict[str, list[str]]) -> DataFrame:
    """(key, field, problem): required fields that are missing, and fields with a value outside their list."""
    tests = [F.when(F.col(c).isNull(), F.struct(F.lit(c).alias("field"), F.lit("missing").alias("problem"))) for c in required]
    tests += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(v), F.struct(F.lit(c).alias("field"), F.lit("not allowed").alias("problem"))) for c, v in values.items()]
    return rows.select(key, F.inline(F.filter(F.array(*tests), lambda x: x.isNotNull())))


def write_archive(rows: DataFrame, snapshot: str, path: str) -> DataFrame:
    """Publishes summaries, one folder a snapshot."""
    rows.withColumn("snapshot_id", F.col(snapshot)).write.mode("append").partitionBy("snapshot_id").parquet(path)
    return rows.sparkSession.read.parquet(path)


def archive_catalog(archive: DataFrame) -> DataFrame:
    """One row a snapshot, newest first by rank: entries, those with a lineage, mean confidence."""
    by = archive.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n_receipts"), F.count("family").alias("n_with_lineage"), F.countDistinct("family").alias("n_families"), F.avg("lineage_confidence").alias("mean_confidence"))
    return by.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("snapshot_id"))))
