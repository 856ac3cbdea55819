"""Vector tables: exact cosine search, neighbours, upserts, and the hashed text embedding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, FloatType, StructField, StructType


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top_k(vectors: DataFrame, query: DataFrame, k: int = 10, min_score: float = 0.15, where: Column | None = None) -> DataFrame:
    """query: one row (qv). Filters reach the scan; ties go to the smaller id."""
    rows = vectors if where is None else vectors.filter(where)
    scored = rows.crossJoin(F.broadcast(query)).withColumn("score", dot(F.col("embedding"), F.col("qv"))).filter(F.col("score") >= min_score)
    return scored.orderBy(F.desc("score"), "vec_id").limit(max(1, k))


#: Queries of a group, the least and the most rows it meets (between these a 64th of all), and queries and rows of one matrix product.
QUERY_BLOCK, LEAST_ROWS, MOST_ROWS, TILE = 32768, 4096, 65536, (512, 4096)


def by_length(lists: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length, the places of the vectors that have it, and these in double precision. Those that are null or hold nulls are left out."""
    a = lists.combine_chunks()
    ends, values, ok = a.offsets.to_numpy().astype(np.int64), a.values, a.is_valid().to_numpy(zero_copy_only=False)
    if values.null_count:
        gaps = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
        ok, values = ok & (gaps[ends[1:]] == gaps[ends[:-1]]), values.fill_null(0)
    flat, size = values.to_numpy(zero_copy_only=False), np.diff(ends)
    places = {int(d): np.flatnonzero(ok & (size == d)) for d in np.unique(size[ok])}
    return {d: (at, flat[ends[at][:, None] + np.arange(d)].astype(np.float64)) for d, at in places.items()}


def first_copies(y: np.ndarray, k: int) -> np.ndarray:
    """Places of y without the rows that have k equal ones before them."""
    bits = np.ascontiguousarray(y).view(np.uint64)
    key = (bits * (np.random.default_rng(1).integers(0, 1 << 63, y.shape[1], np.uint64) * np.uint64(2) + np.uint64(1))).sum(1, dtype=np.uint64)
    _, first, group, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    many = np.flatnonzero(count[group] > k)
    many = many[(bits[many] == bits[first[group[many]]]).all(1)]
    many = many[np.argsort(group[many], kind="stable")]
    return np.setdiff1d(np.arange(len(y)), many[_place_in_run(group[many]) >= k], assume_unique=True)


def _place_in_run(x: np.ndarray) -> np.ndarray:
    """The place of each element in its run of equal ones."""
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
    return np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x))))


def summed(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """dot() of the rows i of x and j of y, to the last bit: the products summed in their order."""
    out = np.zeros(len(i))
    if x.shape[1]:
        with np.errstate(all="ignore"):
            for a in range(0, len(i), 1 << 14):
                at = slice(a, a + (1 << 14))
                out[at] += np.cumsum(x[i[at]] * y[j[at]], axis=1)[:, -1]
    return out


def best_rows(x: np.ndarray, y: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score): for each row of x the k rows of y of the highest dot() from least on, NaN above all; of equal ones the first.
    Matrix products only tell the rows that can be among these, by a bound on their rounding; those are scored by dot()'s own sums."""
    at = first_copies(y, k)
    y = y[at]
    tame_x, tame_y = (np.abs(v).max(axis=1, initial=0) < 1e100 for v in (x, y))  # for the others nothing is told
    u, v = np.where(tame_x[:, None], x, 0), np.where(tame_y[:, None], y, 0)
    off = 4 * (x.shape[1] + 1) * 2.0**-53 * np.sqrt((u * u).sum(1)) * np.sqrt((v * v).sum(1)).max(initial=0) + 1e-290
    found = []
    for a in range(0, len(x), TILE[0]):
        q = slice(a, a + TILE[0])
        bound = least - off[q]
        i, j, s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for b in range(0, len(y), TILE[1]):
            r = slice(b, b + TILE[1])
            near = u[q] @ v[r].T
            near[:, ~tame_y[r]] = -np.inf
            if b == 0 and near.shape[1] >= k:  # as many columns as k hold a value from the k-th largest of the groups' maxima on
                groups = min(near.shape[1], 6 * k)
                whole = near.shape[1] // groups * groups
                bound = np.maximum(bound, np.partition(near[:, :whole].reshape(len(near), groups, -1).max(2), groups - k, axis=1)[:, groups - k] - off[q])
            can = near >= bound[:, None]
            can[:, ~tame_y[r]] = True
            can[~tame_x[q]] = True
            new_i, new_j = np.divmod(np.flatnonzero(can), near.shape[1])
            score = summed(x, y, a + new_i, b + new_j)
            kept = ~(score < least)
            i, j, s = np.concatenate([i, new_i[kept]]), np.concatenate([j, b + new_j[kept]]), np.concatenate([s, score[kept]])
            order = np.lexsort((j, -s, ~np.isnan(s), i))
            rank = _place_in_run(i[order])
            order, rank = order[rank < k], rank[rank < k]
            i, j, s = i[order], j[order], s[order]
            last = rank == k - 1
            bound[i[last]] = np.maximum(bound[i[last]], np.where(np.isnan(s[last]), np.inf, s[last]) - off[q][i[last]])
        found.append((a + i, at[j], s))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int = 10, min_score: float = 0.15, where: Column | None = None) -> DataFrame:
    """queries: rows (query_id, qv); the k best of each, against all vectors, exactly. Ties go to the smaller id. Both sides are dealt
    into blocks; each pair of blocks is one task's matrix products that hand on k rows a query, so that no pair is written out."""
    k = max(1, k)
    rows = vectors if where is None else vectors.filter(where)
    asked, given = ([f for f in df.schema.fields if f.name != v] for df, v in ((queries, "qv"), (rows, "embedding")))
    schema = StructType([*given, *asked, StructField("score", DoubleType())])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right, [("vec_id", "ascending")], null_placement="at_start"))
        x, y = by_length(left["_v"]), by_length(right["_v"])
        found = [(x[d][0][i], y[d][0][j], s) for d in sorted(x.keys() & y.keys()) for i, j, s in [best_rows(x[d][1], y[d][1], k, min_score)]]
        i, j, s = (np.concatenate(c) for c in zip((np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), *found, strict=True))
        left, right = left.select([f.name for f in asked]).take(pa.array(i)), right.select([f.name for f in given]).take(pa.array(j))
        return pa.table([*right.columns, *left.columns, pa.array(s)], names=schema.names).cast(to_arrow_schema(schema))  # zones come by other names

    def dealt(df, embedding, key, fields, own, other, into):
        kind = df.schema[embedding].dataType
        held = F.col(embedding) if isinstance(kind.elementType, FloatType) else F.col(embedding).cast("array<double>")
        df = df.filter(F.col(embedding).isNotNull()).select(*fields, held.alias("_v"), F.col(key).alias("_key")).crossJoin(F.broadcast(blocks))
        number = [F.pmod(F.xxhash64("_key", "_v"), F.col(own)).cast("int").alias(into[0]), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(into[1])]
        return df.select(*number, "_v", *fields).groupBy("_i", "_j")

    of = F.ceil(F.col("m") / QUERY_BLOCK), F.ceil(F.col("n") / F.least(F.greatest(F.col("n") / 64, F.lit(LEAST_ROWS)), F.lit(MOST_ROWS)))
    counts = queries.agg(F.count(F.lit(1)).alias("m")).crossJoin(rows.agg(F.count(F.lit(1)).alias("n")))
    blocks = counts.select(*(F.greatest(c, F.lit(1)).cast("int").alias(name) for c, name in zip(of, ("_queries", "_rows"), strict=True)))
    left = dealt(queries, "qv", "query_id", [f.name for f in asked], "_queries", "_rows", ("_i", "_j"))
    right = dealt(rows, "embedding", "vec_id", [f.name for f in given], "_rows", "_queries", ("_j", "_i"))
    scored = left.cogroup(right).applyInArrow(best, schema)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)


def family_boosts(found: DataFrame, cap: float = 0.12, by: list[str] | None = None) -> DataFrame:
    """Summed scores of the neighbours by family, scaled so that the largest (of each by) is cap."""
    by = by or []
    return found.groupBy(*by, "label").agg(F.sum("score").alias("s")).withColumn("boost", cap * F.col("s") / F.max("s").over(Window.partitionBy(*by))).drop("s")


#: Rows of one label that are compared at once with as many others.
BLOCK_ROWS = 2048


def label_neighbours(vectors: DataFrame, k: int = 3, least: float = 0.08) -> DataFrame:
    """The k nearest of each vector within its label, exactly. A label's rows are dealt into blocks; each pair of blocks is one
    matrix product that hands on k rows a vector, so that no pair is written out and a large label is many tasks."""

    def best(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            x, y = (np.stack([np.asarray(v, np.float64) for v in df["v"]]) for df in (left, right))
            a, b = left["id"].to_numpy(), right["id"].to_numpy()
            order = np.argsort(b, kind="stable")
            y, b = y[order], b[order]
            score = x @ y.T
            score[a[:, None] == b[None]] = -np.inf
            for i, row in enumerate(score):
                top = np.flatnonzero(row >= max(least, np.partition(row, -min(k, len(row)))[-min(k, len(row))]))
                top = top[np.argsort(-row[top], kind="stable")][:k]
                out += [(key[0], a[i], b[j], row[j]) for j in top]
        return pd.DataFrame(out, columns=["label", "a", "b", "score"])

    rows = vectors.select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    counts = rows.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    dealt = rows.join(counts, "label").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = dealt.select("label", F.col("own").alias("i"), others.alias("j"), "id", "v")
    right = dealt.select(F.col("label").alias("label"), others.alias("i"), F.col("own").alias("j"), F.col("id").alias("id"), F.col("v").alias("v"))
    key = ["label", "i", "j"]
    pairs = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(best, f"label {dict(vectors.dtypes)['label']}, a long, b long, score double")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))).filter(F.col("rank") <= k)


def neighbour_edges(found: DataFrame) -> DataFrame:
    """Neighbours without direction, each edge once, with its larger score."""
    return found.groupBy("label", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("score").alias("score"))


def upsert(table: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The latest version of each key of both."""
    rows = table.unionByName(new)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))).filter("_r = 1").drop("_r")


def vector_id(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.substring(F.sha2(F.concat(F.lit(f"{kind}:"), key), 256), 1, 24))


def without_kind(table: DataFrame, kind: str) -> DataFrame:
    """The table without the rows of a kind; rows without one stay."""
    return table.filter(~F.col("kind").eqNullSafe(F.lit(kind)))


ROW = "id string, kind string, text string, family_id string, model string, embedding array<float>"


def export(table: DataFrame, path: str, kind: str | None = None) -> None:
    """JSON lines, embeddings as they are."""
    rows = table if kind is None else table.filter(F.col("kind") == kind)
    rows.write.mode("overwrite").json(path)


def sync(table: DataFrame, into: DataFrame) -> DataFrame:
    """Rows of two stores; where both have an id, the first one's."""
    return table.unionByName(into.join(table.select("id"), "id", "left_anti"))


def seeds(registry: DataFrame, packs: DataFrame, receipts: DataFrame) -> DataFrame:
    """(id, kind, text, family_id, source) of what a store is filled with: the registry's terms, the packs' and receipts. Rows of
    one id are one row."""
    own = registry.select(vector_id("term", F.concat("family_id", F.lit(":"), F.lower("term"))).alias("id"), F.lit("term").alias("kind"), F.col("term").alias("text"), "family_id", F.lit("registry").alias("source"))
    more = packs.select(vector_id("term", F.concat(F.lit("backfill:"), "family_id", F.lit(":"), F.lower("term"))).alias("id"), F.lit("term").alias("kind"), F.col("term").alias("text"), "family_id", F.lit("backfill").alias("source"))
    text = F.substring(F.trim(F.concat_ws(" ", "query", F.substring("observed", 1, 400), F.replace("matched", F.lit(","), F.lit(" ")))), 1, 2000)
    kept = receipts.select(vector_id("receipt", F.col("integrity")).alias("id"), F.lit("receipt").alias("kind"), text.alias("text"), F.col("family").alias("family_id"), F.lit("receipt").alias("source"))
    return own.unionByName(more).unionByName(kept).filter(F.col("text") != "").groupBy("id").agg(F.min(F.struct("kind", "text", "family_id", "source")).alias("r")).select("id", "r.*")


def index_rows(analysis: DataFrame) -> DataFrame:
    """(id, kind, text, family_id): the terms that an analysis adds to a store: those matched, and the query if it is short."""
    terms = F.slice(F.split(F.coalesce("matched", F.lit("")), ","), 1, 12)
    short = F.when(F.size(F.split("query", " ")) <= 4, F.array("query")).otherwise(F.array().cast("array<string>"))
    rows = analysis.select(F.col("family").alias("family_id"), F.explode(F.array_distinct(F.concat(F.filter(terms, lambda t: t != ""), short))).alias("text")).distinct()
    return rows.select(vector_id("term", F.concat(F.lit("ingest:"), F.coalesce("family_id", F.lit("")), F.lit(":"), F.lower("text"))).alias("id"), F.lit("term").alias("kind"), "text", "family_id")


# Weights of a text's words, of their first and last two letters, and of the letter trigrams of all its words.
_WORD, _EDGE, _TRIGRAM = 1.0, 0.5, 0.35


def features(text: str | None) -> list[tuple[str, float]]:
    """Tokens of a text with their weights."""
    words = (text or "").lower().split()
    edges = [e for w in words if len(w) >= 2 for e in (f"{w[:2]}#", f"#{w[-2:]}")]
    inner = "^" + " ".join(re.findall(r"[^\W_]+", " ".join(words))) + "$" if words else ""
    trigrams = map("".join, zip(inner, inner[1:], inner[2:], strict=False))
    return [(w, _WORD) for w in words] + [(e, _EDGE) for e in edges] + [(f"c3:{g}", _TRIGRAM) for g in trigrams]


def embeddings(texts: list[str | None], dim: int = 256) -> np.ndarray:
    """Hashed features of a batch of texts, a row of unit length each (all zero for a text without any). Each distinct token is hashed once."""
    found = [features(t) for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(f) for f in found])
    flat = [x for f in found for x in f]
    place = {t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little") % dim for t in {t for t, _ in flat}}
    at = row * dim + np.fromiter((place[t] for t, _ in flat), np.int64, len(flat))
    out = np.bincount(at, np.array([w for _, w in flat], np.float64), len(texts) * dim).reshape(len(texts), dim).astype(np.float64)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


def embed(rows: DataFrame, text: str, dim: int = 256) -> DataFrame:
    """rows with an embedding column, by Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(embeddings(batch.tolist(), dim).astype(np.float32)), index=batch.index)

    return rows.withColumn("embedding", run(F.col(text)))


def text_boosts(rows: DataFrame, key: str, text: str, terms: list[tuple[str, str]], k: int = 8, least: float = 0.12, cap: float = 0.12) -> DataFrame:
    """(key, family_id, boost) of each text: the k nearest of terms (family, term; a constant list) by hashed embedding, their
    scores summed by family and scaled so that the largest is cap. Batches of texts are one matrix product with the terms."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y = embeddings([t for _, t in terms]).astype(np.float32).astype(np.float64)
        families = sorted({f for f, _ in terms})
        member = np.array([[f == g for g in families] for f, _ in terms], np.float64)
        for pdf in frames:
            score = embeddings(pdf["t"].tolist()).astype(np.float32).astype(np.float64) @ y.T
            order = np.argsort(-score, axis=1, kind="stable")[:, :k]
            kept = np.zeros_like(score)
            np.put_along_axis(kept, order, np.take_along_axis(score, order, 1), 1)
            kept[kept < least] = 0
            mass = kept @ member
            i, j = np.nonzero(mass)
            yield pd.DataFrame({key: pdf["k"].to_numpy()[i], "family_id": np.array(families, object)[j], "boost": cap * mass[i, j] / mass.max(1)[i]})

    return rows.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, family_id string, boost double")
