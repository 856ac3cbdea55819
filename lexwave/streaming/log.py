"""Streams: an append-only log's latest records, windowed counts with late data, and forecasts meeting their settlements.

Results go to Parquet tables in the shared folder, with the stream's checkpoint beside them; nothing is gathered in the
driver's memory. Aggregates write what each batch changed, under its number, and the last write of a key counts; so a
batch that runs twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexwave.sources import store


def log_stream(spark: SparkSession, path: str, files: int = 64) -> DataFrame:
    """path: a Parquet table, one file or a folder of them; new files are new rows, at most so many files a batch."""
    schema, reader = spark.read.parquet(path).schema, spark.readStream.option("maxFilesPerTrigger", files)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.schema(schema).parquet(path)
    folder, name = path.rstrip("/").rsplit("/", 1)
    return reader.schema(schema).option("pathGlobFilter", name).parquet(folder)


def _changes(stream: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Runs what is there to its end; the rows of the last batch that wrote each key."""
    out, schema = f"{folder}/rows", stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    if not store.exists(spark, out):
        return spark.createDataFrame([], schema)
    rest = [c for c in schema.names if c not in keys]
    rows = spark.read.option("basePath", out).parquet(out)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def latest(stream: DataFrame, key: list[str], seq: str, columns: list[str], folder: str) -> DataFrame:
    """Last write wins for each key: a streaming max over a struct that begins with seq. State: one row a key."""
    rows = stream.groupBy(*key).agg(F.max(F.struct(seq, *columns)).alias("last"))
    return _changes(rows, key, folder).select(*key, "last.*")


def windows(stream: DataFrame, at: str, size: str, late: str, by: str, value: str, folder: str) -> DataFrame:
    """Tumbling windows. Rows later than the watermark are dropped, and windows before it leave the state."""
    rows = stream.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    rows = rows.select(F.col("w.start").alias("window_start"), by, "n", "total")
    return _changes(rows, ["window_start", by], folder)


def settled(forecasts: DataFrame, settlements: DataFrame, late: str, longest: str, folder: str) -> DataFrame:
    """Forecasts (forecast_id, made_at, ..) as their settlements (settled_id, settled_at, ..) arrive, within longest; both are
    kept in state until the watermark passes."""
    a, b = forecasts.withWatermark("made_at", late), settlements.withWatermark("settled_at", late)
    on = (F.col("forecast_id") == F.col("settled_id")) & (F.col("settled_at") >= F.col("made_at")) & (F.col("settled_at") <= F.col("made_at") + F.expr(f"INTERVAL {longest}"))
    met = a.join(b, on, "inner")
    query = met.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return forecasts.sparkSession.read.schema(met.schema).parquet(f"{folder}/rows")


def cadence(tier: Column) -> Column:
    """Seconds between two scans by risk tier."""
    return F.when(tier == "CRITICAL", 3600).when(tier == "ELEVATED", 7200).when(tier == "MODERATE", 21600).otherwise(43200)
