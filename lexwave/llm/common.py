"""What the operators share: tables, folders that all executors see, sizes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Rows go to Python in batches of a few MB, so that long texts don't fill a worker or the memory beside the JVM's heap.
    A smaller limit that the session already has stays."""
    if int(str(spark.conf.get(_BATCH, str(most + 1))).rstrip("b")) > most:
        spark.conf.set(_BATCH, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lexwave-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def saved(spark: SparkSession, df: DataFrame, what: str) -> DataFrame:
    """Cuts the lineage: written to the shared folder and read again."""
    df.write.parquet(path := new_path(spark, what))
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def drop(spark: SparkSession, *tables: DataFrame | None) -> None:
    """Deletes tables made by saved that nothing reads any more."""
    for x in tables:
        if x is not None:
            p = spark._jvm.org.apache.hadoop.fs.Path(x.saved_at)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id) -> F.Column:
    """Rows that no model here learns labels from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows, and bytes on disk, of written tables that may be broadcast: some tens of MB in memory at most.
SMALL, SMALL_BYTES = 1_000_000, 12 << 20


def written_bytes(spark: SparkSession, df: DataFrame) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(df.saved_at)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def broadcast_if_small(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """df must be a table of saved, or be cheap to count. Beyond the limits of rows and bytes the join shuffles instead."""
    small = (not hasattr(df, "saved_at") or written_bytes(df.sparkSession, df) <= SMALL_BYTES) and df.limit(limit + 1).count() <= limit
    return F.broadcast(df) if small else df


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b), and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (differ := root[x] != root[y]).any():
        x, y = x[differ], y[differ]
        u, v = root[x], root[y]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return nodes, nodes[root]


def components(spark: SparkSession, edges: DataFrame, limit: int = SMALL) -> DataFrame:
    """(node, label): the smallest node of each connected component of edges (a, b), which must be cheap to count. Up to the
    limit the driver joins them (16 bytes an edge). More are joined in Spark, one written table a round; there a node of many
    edges is many rows of one key in a join without order, which adaptive execution splits."""
    if edges.limit(limit + 1).count() <= limit:
        got = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).toArrow()
        node, label = joined(got["a"].to_numpy(), got["b"].to_numpy())
        return saved(spark, spark.createDataFrame(pa.table({"node": node, "label": label})), "labels")
    pairs = F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in (("a", "b"), ("b", "a"), ("a", "a"), ("b", "b"))])).alias("e")
    both = saved(spark, edges.select(pairs).select("e.*").distinct(), "edges")
    labels = saved(spark, both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"), F.max(F.when(F.col("a") == F.col("b"), F.col("label"))).alias("old"))
        # pointer jumping: the label's own label
        via = labels.select(F.col("node").alias("via"), F.col("label").alias("next"))
        new = saved(spark, near.join(via, F.col("near") == F.col("via")).select(F.col("a").alias("node"), F.least("near", "next").alias("label"), "old"), "labels")
        drop(spark, labels)
        labels = new.select("node", "label")
        labels.saved_at = new.saved_at
        if not new.filter("label <> old").limit(1).count():
            drop(spark, both)
            return labels
