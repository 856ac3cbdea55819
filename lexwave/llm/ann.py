"""Approximate nearest neighbours by learned partitions.

On a bounded sample (SAMPLE vectors by a hash of vec_id) the neighbour graph is cut into equal parts by recursive
bisection, and a small network learns to tell a vector's part. Every row is indexed under its likeliest part; a query
searches its likeliest parts, as many as it takes on the sample to hold TARGET of the true neighbours, and reranks their
rows by the exact distance. Equal vectors share one entry with their K + 1 smallest ids (more can't be among the K
nearest, as ties go to smaller ids). Parts are searched in blocks of rows and of queries, so a hot part is many tasks.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part. Repeated
rows count once; rows of the query's own vec_id are never its neighbours. Rows with a null vec_id take no part. Fewer
rows than K give all candidates; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

K, EVERY, SAMPLE, PART_ROWS, MAX_PARTS, TARGET, SEED = 10, 100, 6000, 800, 256, 0.95, 5
GRAPH_K, HIDDEN, EPOCHS, ROWS_BLOCK, QUERY_BLOCK = 10, 64, 40, 4096, 1024


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(x), k), np.int64)
    norm = (x * x).sum(1)
    for a in range(0, len(x), 1000):
        d = norm[None] - 2 * x[a : a + 1000] @ x.T
        d[np.arange(len(d)), a + np.arange(len(d))] = np.inf
        out[a : a + 1000] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def bisect(near: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """A part for each node, sizes equal but for one: halves at the median of the graph's slowest smooth vector, again and again."""
    part = np.zeros(len(near), np.int64)
    src, dst = np.repeat(np.arange(len(near)), near.shape[1]), near.reshape(-1)
    src, dst = np.concatenate([src, dst]), np.concatenate([dst, src])
    while parts > 1:
        inside = part[src] == part[dst]
        s, d = src[inside], dst[inside]
        degree = np.bincount(s, minlength=len(near)) + 1.0
        count = np.bincount(part)
        v = rng.normal(size=len(near))
        for _ in range(60):
            v = (np.bincount(s, v[d] / degree[d], len(near)) + v / degree + v) / 2
            flat = np.bincount(part, v, len(count)) / np.bincount(part, degree, len(count))
            v -= degree * flat[part]
            v /= np.sqrt(np.bincount(part, v * v, len(count)))[part] + 1e-12
        order = np.lexsort((v / degree, part))
        at = np.arange(len(near)) - np.concatenate([[0], np.cumsum(count)])[part[order]]
        new = np.empty_like(part)
        new[order] = 2 * part[order] + (at >= count[part[order]] / 2)
        part, parts = new, parts // 2
    return part


class Router:
    """One hidden layer, softmax over parts."""

    def __init__(self, x: np.ndarray, soft: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = x.mean(0), x.std() + 1e-12
        x = (x - self.mean) / self.scale
        w = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, soft.shape[1])), np.zeros(soft.shape[1])]
        m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for _ in range(EPOCHS):
            for ids in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
                h = np.maximum(x[ids] @ w[0] + w[1], 0)
                g = (_softmax(h @ w[2] + w[3]) - soft[ids]) / len(ids)
                gh = (g @ w[2].T) * (h > 0)
                t += 1
                for i, d in enumerate((x[ids].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                    m[i] = 0.9 * m[i] + 0.1 * d
                    v[i] = 0.999 * v[i] + 0.001 * d * d
                    w[i] -= 0.005 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.w = w

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return _softmax(np.maximum((x - self.mean) / self.scale @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3])


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def fit(x: np.ndarray, rows: int) -> tuple[Router | None, int, int]:
    """(router, parts, parts that a query searches)."""
    parts = 1
    while parts * 2 * PART_ROWS <= rows and parts < MAX_PARTS and len(x) >= 16 * parts * 2:
        parts *= 2
    if parts == 1:
        return None, 1, 1
    near = neighbours(x, GRAPH_K)
    part = bisect(near, parts, np.random.default_rng(SEED))
    soft = np.zeros((len(x), parts))
    np.add.at(soft, (np.arange(len(x)), part), 2.0)
    np.add.at(soft, (np.repeat(np.arange(len(x)), near.shape[1]), part[near.reshape(-1)]), 1.0)
    router = Router(x, soft / soft.sum(1, keepdims=True))
    p = router(x)
    home, order = p.argmax(1), np.argsort(-p, axis=1)
    rank = np.empty_like(order)
    rank[np.arange(len(x))[:, None], order] = np.arange(parts)
    need = np.sort(rank[np.arange(len(x))[:, None], home[near]].reshape(-1))
    return router, parts, int(need[int(np.ceil(TARGET * len(need))) - 1]) + 1


def valid(rows: DataFrame) -> DataFrame:
    """(vec_id, v): one row for each distinct row that takes part."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    x = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    x = x.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.coalesce(F.exists("v", lambda y: y != 0), F.lit(False)))
    return x


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.empty((0, 0))


def _route(router: Router | None, parts: int, probes: int, counts: np.ndarray | None, salts: np.ndarray | None):
    """counts None: the likeliest part of each row; else a query's parts, more of them while they hold too few candidates."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            p = router(_matrix(pdf["v"])) if router is not None and len(pdf) else np.ones((len(pdf), 1))
            if counts is None:
                pdf["part"] = p.argmax(1).astype(np.int32)
                yield pdf
                continue
            order = np.argsort(-p, axis=1, kind="stable")
            enough = np.cumsum(counts[order], axis=1) >= 4 * K
            n = np.maximum(probes, np.where(enough.any(1), enough.argmax(1) + 1, parts))
            pdf["part"] = [order[i, : n[i]].astype(np.int32) for i in range(len(pdf))]
            yield pdf.explode("part").astype({"part": "int32"})

    return run


def _search(_, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    if not len(rows) or not len(queries):
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    x, q = _matrix(rows["v"]), _matrix(queries["v"])
    out = []
    xx, take = (x * x).sum(1), min(len(x), K + 1)
    for a in range(0, len(q), 256):
        d = xx[None] - 2 * q[a : a + 256] @ x.T + (q[a : a + 256] ** 2).sum(1)[:, None]
        top = np.partition(d, take - 1, axis=1)[:, take - 1]
        for i in range(len(d)):
            near = np.flatnonzero(d[i] <= top[i] + 1e-9 * (1 + abs(top[i])))
            exact = np.sqrt(np.cumsum((x[near] - q[a + i]) ** 2, axis=1)[:, -1])
            qid = queries["vec_id"].iloc[a + i]
            found = sorted((s, int(v)) for s, j in zip(exact.tolist(), near.tolist(), strict=True) for v in rows["ids"].iloc[j] if v != qid)[:K]
            out += [(qid, v, s) for s, v in found]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def nearest(spark: SparkSession, rows: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score: the K nearest of rows (vec_id, embedding) of each of queries (vec_id, embedding)."""
    all_rows = valid(rows)
    size = all_rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = size["dim"] if size else 0
    all_rows = all_rows.filter(F.size("v") == dim)
    # equal vectors: one entry with the smallest ids, first within salts, then over them
    salted = all_rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    first = salted.distinct().withColumn("r", F.row_number().over(Window.partitionBy("v", "salt").orderBy("vec_id"))).filter(F.col("r") <= K + 1)
    top = first.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("r") <= K + 1)
    entries = saved(spark, top.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    n = entries.count()
    sample = entries.select("v", F.xxhash64(F.col("ids")[0]).alias("o"), F.col("ids")[0].alias("id")).orderBy("o", "id").limit(SAMPLE).select("v").toPandas()  # at most SAMPLE rows
    router, parts, probes = fit(_matrix(sample["v"]), n)
    index = saved(spark, entries.mapInPandas(_route(router, parts, probes, None, None), "v array<double>, ids array<long>, part int"), "index")
    counts = np.zeros(parts, np.int64)
    for r in index.groupBy("part").count().collect():  # at most MAX_PARTS rows
        counts[r["part"]] = r["count"]
    asked = valid(queries).filter(F.size("v") == dim).distinct()
    asked = saved(spark, asked.mapInPandas(_route(router, parts, probes, counts, None), "vec_id long, v array<double>, part int"), "asked")
    per = {r["part"]: r["count"] for r in asked.groupBy("part").count().collect()}  # at most MAX_PARTS rows
    blocks = spark.createDataFrame([(p, max(1, -(-int(counts[p]) // ROWS_BLOCK)), max(1, -(-per.get(p, 0) // QUERY_BLOCK))) for p in range(parts)], "part int, rows int, asks int")
    left = index.join(F.broadcast(blocks), "part").withColumn("r", F.pmod(F.xxhash64(F.col("ids")[0]), F.col("rows")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("asks") - 1))).select("part", "r", "q", "v", "ids")
    right = asked.join(F.broadcast(blocks), "part").withColumn("q", F.pmod(F.xxhash64("vec_id"), F.col("asks")).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).select("part", "r", "q", "v", "vec_id")
    key = ["part", "r", "q"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= K).select("query_id", "rank", "vec_id", "score")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(spark, rows, rows.filter(F.col("vec_id") % EVERY == 0))
