"""Benchmark decontamination by greedy string tiling.

Every text's and item's words are hashed as running Karp-Rabin K-grams; equal ones are joined in Spark as seeds, and
per (document, item) runs of seeds on a diagonal are the maximal matches of K words or more. The longest match of
unmarked words is marked, again and again, until none of K words is left; so reordered passages add up. A document is
contaminated by an item if the marked words are COVERAGE of the item's or more.

An item of 1 to K-1 words is one seed of all its words. Items without words, null texts and texts without words match
nothing. Rows of equal doc_id count as one document; rows with a null doc_id match nothing in matches, but decontaminate checks each. Other columns are
ignored (kept by decontaminate). Empty tables give no matches.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SMALL, bound_batches, broadcast_if_small, fresh, saved, table
from .words import each

K, COVERAGE = 5, 0.8
_BITS = 22
_PLACES = "id long, n_words long, places array<struct<k:int,pos:long,h:long>>"


def _grams(ks: tuple[int, ...], maps: dict[int, np.ndarray] | None, item: bool):
    """Emits a row a text: its words' number and its k-grams (for items: k = min(K, words)); maps: which may be seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in each(batch):
                count = np.diff(w.at)
                found = []
                for k in ks:
                    h, ok = w.grams(k)
                    if item:
                        doc = np.searchsorted(w.at, np.arange(len(h)), "right") - 1
                        ok = ok & (np.minimum(count[doc], K) == k)
                    if maps is not None:
                        ok = ok & maps[k][h >> np.uint64(64 - _BITS)]
                    at = np.flatnonzero(ok)
                    found.append((np.full(len(at), k), at, h[at].view(np.int64)))
                size, at, h = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(at, kind="stable")
                size, at, h = size[order], at[order], h[order]
                cut = np.searchsorted(at, w.at)
                doc = np.repeat(np.arange(b - a), np.diff(cut))
                places = pa.StructArray.from_arrays([pa.array(size.astype(np.int32)), pa.array(at - w.at[doc]), pa.array(h)], names=["k", "pos", "h"])
                out = pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(count), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), places)], names=["id", "n_words", "places"])
                yield out if item else out.filter(pa.array(np.diff(cut) > 0))

    return run


def tiles(seeds: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(item position, text position, words) of the greedy tiles; seeds: (item position, text position, k)."""
    runs: dict[int, list[list[int]]] = {}
    for i, d, k in sorted(seeds, key=lambda s: (s[1] - s[0], s[0])):
        line = runs.setdefault(d - i, [])
        if line and i <= line[-1][1] - k + 1:
            line[-1][1] = max(line[-1][1], i + k)
        else:
            line.append([i, i + k, k])
    heap = [(a - b, a, a + diag, k) for diag, line in runs.items() for a, b, k in line]
    heapq.heapify(heap)
    in_item, in_text, out = set(), set(), []
    while heap:
        less, i, d, k = heapq.heappop(heap)
        n = -less
        free = [x for x in range(n) if i + x not in in_item and d + x not in in_text]
        if len(free) == n:
            out.append((i, d, n))
            in_item.update(range(i, i + n))
            in_text.update(range(d, d + n))
            continue
        a = 0
        while a < len(free):  # what marked words leave of it comes again at its own length
            b = a
            while b + 1 < len(free) and free[b + 1] == free[b] + 1:
                b += 1
            if b - a + 1 >= k:
                heapq.heappush(heap, (-(b - a + 1), i + free[a], d + free[a], k))
            a = b + 1
    return out


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, words = [], []
        for seeds in batch.column("seeds").to_pylist():
            got = tiles([(s["i"], s["d"], s["k"]) for s in seeds])
            n.append(len(got))
            words.append(sum(t[2] for t in got))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("item_id"), batch.column("n_words"), pa.array(n, pa.int32()), pa.array(words, pa.int64())], names=["doc_id", "item_id", "n_words", "n_tiles", "covered"])


def matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_words, n_tiles, covered, coverage of all pairs that share a seed."""
    bound_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    ks = tuple(range(1, K + 1))
    seeds = items.mapInArrow(_grams(ks, None, True), _PLACES).select(F.col("id").alias("item_id"), "n_words", F.explode("places").alias("p")).select("item_id", "n_words", "p.k", "p.h", F.col("p.pos").alias("i"))
    seeds = saved(spark, seeds, "seeds")
    used = tuple(sorted(r.k for r in seeds.select("k").distinct().collect())) or (K,)
    maps = None
    if seeds.limit(SMALL + 1).count() <= SMALL:  # else all k-grams are joined, by a shuffle
        maps = {k: np.zeros(1 << _BITS, bool) for k in used}
        for r in seeds.select("k", "h").distinct().collect():
            maps[r.k][np.int64(r.h).view(np.uint64) >> np.uint64(64 - _BITS)] = True
    texts = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    places = texts.mapInArrow(_grams(used, maps, False), _PLACES).select(F.col("id").alias("doc_id"), F.explode("places").alias("p")).select("doc_id", "p.k", "p.h", F.col("p.pos").alias("d"))
    pairs = places.join(broadcast_if_small(seeds), ["k", "h"]).groupBy("doc_id", "item_id", "n_words").agg(F.collect_set(F.struct("i", "d", "k")).alias("seeds"))
    out = pairs.mapInArrow(_tile, "doc_id long, item_id long, n_words long, n_tiles int, covered long")
    return out.withColumn("coverage", F.col("covered") / F.col("n_words"))


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    return matches(spark, docs, benchmark).filter(F.col("coverage") >= coverage)


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """docs without the contaminated ones, with all their columns; a row with a null doc_id is a document of its own, under a number made for this stage."""
    named = _clean(spark, docs, "doc_id", benchmark, coverage)
    if not docs.filter(F.col("doc_id").isNull()).limit(1).count():
        return named
    number = fresh(docs, "row_number")
    rows = saved(spark, docs.filter(F.col("doc_id").isNull()).withColumn(number, F.monotonically_increasing_id()), "unnamed")
    return named.filter(F.col("doc_id").isNotNull()).unionByName(_clean(spark, rows, number, benchmark, coverage).select(*docs.columns))


def _clean(spark: SparkSession, rows: DataFrame, key: str, benchmark: DataFrame, coverage: float) -> DataFrame:
    texts = rows.select(F.col(key).cast("long").alias("doc_id"), "text")
    name = fresh(rows, "bad_id")
    bad = saved(spark, contaminated(spark, texts, benchmark, coverage).select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    return rows.join(broadcast_if_small(bad), F.col(key).cast("long") == F.col(name), "left_anti")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contaminated (document, item) pair."""
    return contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
