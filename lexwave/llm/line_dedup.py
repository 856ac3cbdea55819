"""Line dedup by a deletion-neighbourhood join (edit distance 1).

Lines are compared without the blanks at their ends. Equal lines count as one (a 128-bit hash and the length); a line is
removed where an equal or a similar one stands earlier (by doc_id, then line). Similar: an edit distance of 1 (one
character inserted, dropped or changed), for lines of at_least characters or more (0: all).

Of two such lines, the halves on one side are equal: lines whose halves no other line has are set aside first, without
loss. The others emit a hash of themselves and of each variant with one character deleted (rolling sums, so a long line
costs its length, not the square). Keys of one line only are dropped, and what is left is joined without making pairs:
lines of one length that share a variant at one position differ there only, so each is linked to the earliest of them;
a variant that is a line itself links that line and its longer ones, a star. Links are verified by their texts.

Null texts and blank lines have nothing to remove; rows with a null doc_id come last. Rows of one doc_id, or without one,
are numbered once in a written table, which all later steps read; elsewhere doc_id itself is a row's key. So the result
doesn't depend on how any step splits its input. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, drop, saved, table
from .words import _pow, blocks, mix, release, utf8

MIN, EDITS = 8, 1
#: Bytes of lines whose variants are held at once; one longer line is handled alone.
_HELD = 1 << 19
_SEEDS = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


_LINE = ["h", "g", "n"]


def _lines(docs: DataFrame) -> DataFrame:
    """One row a non-blank line: uid, doc_id, line (from 0), text, its key (h, g, n)."""
    line = F.trim(F.col("raw"))
    rows = docs.select("uid", "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    return rows.select("uid", "doc_id", "line", line.alias("s")).filter("s <> ''").withColumn("h", F.xxhash64("s")).withColumn("g", F.xxhash64(F.lit(29), "s")).withColumn("n", F.length("s"))


def _halves(s: str = "s", n: str = "n") -> F.Column:
    """Keys of a line: the first and last parts that a line at one edit must share with it."""
    keys = []
    for m in (F.col(n), F.col(n) - 1):  # the shorter line's length
        p = F.floor(m / 2).cast("int")
        keys += [F.xxhash64(F.lit(0), p, F.substring(s, F.lit(1), p)), F.xxhash64(F.lit(1), m - p, F.substring(s, F.col(n) - (m - p) + 1, m - p))]
    return F.array_distinct(F.array(*keys))


def variant_keys(points: np.ndarray, start: np.ndarray, size: np.ndarray, seed: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Keys of lines (code points, first place and length of each), and of them without each of their characters."""
    up, down = _pow(len(points) + 2)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix((points.astype(np.uint64) + np.uint64(1)) * seed) * up[: len(points)], out=total[1:])
    whole = (total[start + size] - total[start]) * down[start] + size.astype(np.uint64)
    s, n = np.repeat(start, size), np.repeat(size, size)
    cut = (total[:-1] - total[s]) * down[s] + (total[s + n] - total[1:]) * down[s + 1] + (n - 1).astype(np.uint64)
    return mix(whole), mix(cut)


def _variants(places: bool):
    """Of lines (h, g, n, s): each one's distinct keys, or its keys with the place of the character left out (-1: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("s")
            for a, b in blocks(utf8(text)[1], _HELD):
                lines = text.slice(a, b - a).to_pylist()
                points = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
                size = np.fromiter(map(len, lines), np.int64, b - a)
                start = np.cumsum(size) - size
                whole, cut = variant_keys(points, start, size, _SEEDS[0])
                if places:
                    by = np.concatenate([np.arange(b - a), np.repeat(np.arange(b - a), size)])
                    at = np.concatenate([np.full(b - a, -1), np.arange(len(points)) - np.repeat(start, size)])
                    keys = np.concatenate([whole, cut]), np.concatenate(variant_keys(points, start, size, _SEEDS[1]))
                    own = pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a) for c in _LINE], names=_LINE).take(pa.array(by))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(at.astype(np.int32)), *(pa.array(k.view(np.int64)) for k in keys)], names=[*_LINE, "at", "key", "key2"])
                else:  # in a run of one character, leaving out any gives the same
                    new = np.ones(len(points), bool)
                    new[1:] = points[1:] != points[:-1]
                    new[start] = True
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([whole, cut[new]]).view(np.int64))], names=["key"])
                release()

    return run


def _named(prefix: str, of: str = "") -> list[F.Column]:
    """The key's columns (of a struct, if named) under other names."""
    return [F.col(of + c).alias(prefix + c) for c in _LINE]


def _similar(spark: SparkSession, few: DataFrame) -> DataFrame:
    """Keys of lines of few (h, g, n, s, first; distinct) that have a similar one earlier."""
    text = few.select(*_LINE, "s")
    many = saved(spark, text.mapInArrow(_variants(False), "key long").groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key"), "keys")
    met = text.mapInArrow(_variants(True), "h long, g long, n int, at int, key long, key2 long").join(broadcast_if_small(many), "key", "left_semi")
    met = saved(spark, met.join(few.select(*_LINE, "first"), _LINE), "met")
    line = F.struct("first", *_LINE)
    other = (F.col("h") != F.col("lo.h")) | (F.col("g") != F.col("lo.g"))
    cut = met.filter("at >= 0")
    # one character changed: all that share key and place are alike
    place = ["key", "key2", "n", "at"]
    least = cut.groupBy(*place).agg(F.min(line).alias("lo"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    changed = cut.join(least, place).filter(other).select(*_LINE, *_named("a_", "lo."))
    # one character more: a star around the shorter line
    whole = met.filter("at < 0").select("key", "key2", *_named("w_"), F.col("first").alias("fw"))
    star = cut.join(whole, ["key", "key2"]).filter(F.col("w_n") == F.col("n") - 1)
    longer = star.filter(F.col("fw") < F.col("first")).select(*_LINE, *[F.col(f"w_{c}").alias(f"a_{c}") for c in _LINE])
    shorter = star.filter(F.col("first") < F.col("fw")).groupBy(*[F.col(f"w_{c}").alias(c) for c in _LINE]).agg(F.min(line).alias("lo")).select(*_LINE, *_named("a_", "lo."))
    links = saved(spark, changed.unionByName(longer).unionByName(shorter).distinct(), "links")
    earlier = text.select(*_named("a_"), F.col("s").alias("sa"))
    found = links.join(text, _LINE).join(earlier, [f"a_{c}" for c in _LINE]).filter(F.levenshtein("s", "sa", EDITS) >= 0).select(*_LINE).distinct()
    out = saved(spark, found.withColumn("late", F.lit(True)), "similar")
    drop(spark, many, met, links)
    return out


def line_plan(spark: SparkSession, docs: DataFrame, at_least: int = MIN) -> tuple[DataFrame, DataFrame]:
    """All lines, and (h, g, n, first, late) of lines of which something is to be removed: their first place, and whether a similar one stands earlier."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid", "line")
    lines = _lines(docs)
    repeated = saved(spark, lines.groupBy(*_LINE).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows"), "repeated")
    keyed = lines.filter(F.col("n") >= at_least).select(*_LINE, F.explode(_halves()).alias("key"))
    shared = saved(spark, keyed.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi").select("key"), "halves")
    near = saved(spark, keyed.join(broadcast_if_small(shared), "key", "left_semi").select(*_LINE).distinct(), "near")
    # texts of lines are moved for these only
    few = saved(spark, lines.join(broadcast_if_small(near), _LINE, "left_semi").groupBy(*_LINE).agg(F.first("s").alias("s"), F.min(place).alias("first")), "few")
    drop(spark, shared, near)
    late = _similar(spark, few)
    hits = saved(spark, repeated.join(late, _LINE, "full").withColumn("late", F.coalesce("late", F.lit(False))), "hits")
    drop(spark, repeated, few, late)
    return lines, hits


def line_dedup(spark: SparkSession, docs: DataFrame, at_least: int = MIN) -> DataFrame:
    """doc_id, text without the removed lines, n_lines (not blank), n_removed; a row for each row of docs."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if own.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count():
        own = saved(spark, own.withColumn("uid", F.monotonically_increasing_id()), "rows")
    else:
        own = own.withColumn("uid", F.col("doc_id"))
    lines, hits = line_plan(spark, own, at_least)
    here = (F.col("first.uid") == F.col("uid")) & (F.col("first.line") == F.col("line"))
    gone = lines.select("uid", "line", *_LINE).join(broadcast_if_small(hits), _LINE).filter(F.col("late") | ~here)
    removed = saved(spark, gone.groupBy(F.col("uid").alias("at")).agg(F.collect_set("line").alias("cut")), "removed")
    out = own.join(broadcast_if_small(removed), F.col("uid") == F.col("at"), "left")
    parts, n = F.split("text", "\n"), F.coalesce(F.size("cut"), F.lit(0))
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.coalesce("cut", F.array().cast("array<int>")))
    kept = F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")
    return out.select("doc_id", F.when(F.col("cut").isNull(), F.col("text")).otherwise(kept).alias("text"), F.coalesce(F.size(F.filter(parts, lambda x: F.trim(x) != "")), F.lit(0)).alias("n_lines"), F.greatest(n, F.lit(0)).alias("n_removed"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, text (cleaned)."""
    return line_dedup(spark, table(spark, sf_dir, "documents"))
