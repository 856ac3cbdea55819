"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF word shingles, banded, verified.

Weights are counts times a damped idf: 1 + DAMP at most, 1 at least, from the exact number of documents of each shingle
that more than RARE of all documents have. Those number at most (mean shingles per document) / RARE, whatever the
input, and so are broadcast; all others weigh alike. The damping keeps near copies of a very large group alike: with
the plain logarithm, the few words changed in one copy would outweigh all that the group shares.

Documents with equal texts form a group first (by a 128-bit hash). Verified pairs are joined to components, and
a pair inside one component needs no check. So buckets are settled by rounds: STARS times, each member is compared with
one member of its bucket, a hub, if that is of another component. Of buckets that still hold several components,
small ones (WIDE members at most) compare all members of the smaller components with the rest. The documents of wide ones
are sorted out in two steps without making their pairs: (1) a document less than SIMILARITY of whose weight lies in
shingles that other components' documents have can't be alike to any of them, and goes (exact); (2) the others draw POOL
further samples, are banded by 16 of them (FINE_BANDS times) and settled by rounds again, where only pairs meet whose
sketches (some bits of each sample) agree as a pair above the bound does but for 3 in 100,000; what is left is verified exactly.
A document's class is its component's smallest doc_id.

A null text counts as empty. Texts without words are alike only if equal. Shorter texts than K words have one shingle.
Rows with a null doc_id form no class (class_id null). Repeated rows fall in one class; different texts of one doc_id are
documents of their own (named alike where classes are reported). Other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SMALL, bound_batches, broadcast_if_small, components, drop, fresh, partitions, saved, table
from .words import blocks, each, mix

K, SIMILARITY, RARE, DAMP, BANDS, ROWS = 5, 0.8, 1e-3, 0.25, 14, 4
#: Rounds of stars; members up to which a bucket compares its components directly; samples of the documents of wider ones.
STARS, WIDE, POOL, FINE_BANDS, FINE_ROWS = 2, 32, 1024, 288, 16
#: Distinct hashes a task holds before it hands them on; members that share one copy of those they are compared with.
_HOLD, _BLOCK, _EPS = 1 << 20, 512, 1e-9
#: Shared fine keys of a task.
_MEET = 1 << 13
#: Bits that a sketch holds of each sample, and the samples of two sketches that may differ: the mean at SIMILARITY and
#: four standard deviations.
_PLANE = ("p0", "p1", "p2", "p3")
_UNLIKE = (1 - SIMILARITY) * (1 - 2.0 ** -len(_PLANE))
_DIFFER = int(POOL * _UNLIKE + 4 * (POOL * _UNLIKE * (1 - _UNLIKE)) ** 0.5)


def _gamma2(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at the middles of n equal parts."""
    p = (np.arange(n) + 0.5) / n
    lo, hi = np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        x = (lo + hi) / 2
        below = 1 - (1 + x) * np.exp(-x) < p
        lo, hi = np.where(below, x, lo), np.where(below, hi, x)
    return (lo + hi) / 2


_tables: list[np.ndarray] = []


def _lookup() -> list[np.ndarray]:
    if not _tables:
        g = _gamma2()
        _tables.extend([g.astype(np.float32), (1 / g).astype(np.float32), np.log(g).astype(np.float32)])
    return _tables


_SEEDS = mix(np.arange(1, 1 + BANDS * ROWS, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
_POOL_SEEDS = mix(np.arange(1, 1 + POOL, dtype=np.uint64) * np.uint64(0x8EBC6AF09C88C6E3)) | np.uint64(1)


def sets(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles, counts, offsets) by text, sorted within a text."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return h[first], np.diff(np.append(first, len(h))), np.searchsorted(doc[first], np.arange(len(at)))


class Idf:
    """Weights of shingles: a small table, the rest alike."""

    def __init__(self, hashes: np.ndarray, df: np.ndarray, n: int):
        order = np.argsort(hashes)
        self.h = hashes[order]
        scale = DAMP / np.log(1 / RARE)
        weigh = lambda d: (1 + scale * np.log(np.clip(n / np.maximum(d, 1), 1, 1 / RARE))).astype(np.float32)
        self.w, self.rest = weigh(df[order]), weigh(np.array([max(RARE * n, 1)]))[0]
        self.there = np.zeros(1 << 20, bool)
        self.there[self.h >> np.uint64(44)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.rest, np.float32)
        if len(self.h):
            maybe = np.flatnonzero(self.there[h >> np.uint64(44)])
            at = np.minimum(np.searchsorted(self.h, h[maybe]), len(self.h) - 1)
            hit = self.h[at] == h[maybe]
            out[maybe[hit]] = self.w[at[hit]]
        return out


def _samples(h: np.ndarray, w: np.ndarray, at: np.ndarray, seeds: np.ndarray) -> Iterator[np.ndarray]:
    """For each seed, a code of every text's consistent weighted sample; each text has a shingle."""
    r_of, inv_of, lnc_of = _lookup()
    lnw, start, size = np.log(w).astype(np.float32), at[:-1], np.diff(at)
    for k, seed in enumerate(seeds):
        x = h * seed
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        lo = x.view(np.uint16).reshape(-1, 4)
        r, beta = r_of[lo[:, 3]], lo[:, 1].astype(np.float32) * np.float32(2.0**-16)
        t = np.floor(lnw * inv_of[lo[:, 3]] + beta)
        lna = lnc_of[lo[:, 2]] - r * (t - beta + np.float32(1))
        least = np.minimum.reduceat(lna, start)
        hit = np.flatnonzero(lna == np.repeat(least, size))
        hit = hit[np.searchsorted(hit, start)]
        yield h[hit] + t[hit].astype(np.int64).view(np.uint64) + np.uint64(k)


def sample_bands(h: np.ndarray, w: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Band keys (texts x BANDS) of texts that all have a shingle."""
    keys = np.zeros((len(at) - 1, BANDS), np.uint64)
    for k, code in enumerate(_samples(h, w, at, _SEEDS)):
        b = k // ROWS
        keys[:, b] = mix(keys[:, b] * np.uint64(0x9E3779B97F4A7C15) + code)
    return keys


def fine_bands(h: np.ndarray, w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (texts x FINE_BANDS) of FINE_ROWS of the POOL samples each, and sketches (texts x POOL / 64 x planes): bits of each sample."""
    codes = np.empty((len(at) - 1, POOL), np.uint64)
    for k, code in enumerate(_samples(h, w, at, _POOL_SEEDS)):
        codes[:, k] = mix(code)
    pick = np.random.default_rng(17)
    keys = np.empty((len(codes), FINE_BANDS), np.uint64)
    for b in range(FINE_BANDS):
        key = np.full(len(codes), b, np.uint64)
        for k in pick.choice(POOL, FINE_ROWS, replace=False):
            key = key * np.uint64(0x9E3779B97F4A7C15) + codes[:, k]
        keys[:, b] = mix(key)
    planes = [np.packbits((codes >> np.uint64(63 - p) & np.uint64(1)).astype(np.uint8), axis=1).view(np.uint64) for p in range(len(_PLANE))]
    return keys, np.stack(planes, 2)


def _pack(h: np.ndarray) -> bytes:
    import zstandard

    step = np.diff(h, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view(np.uint64))


def _tallied(ranges: int, arrays: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A task's distinct hashes with how many documents have each, by range of the hash: sorted steps in byte planes, so that
    millions of hashes travel as a few rows."""
    held, n = [], 0

    def flush():
        h, c = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        cut = np.searchsorted(h >> np.uint64(32), (np.arange(1, ranges) << 32) // ranges)
        rows = [(i, _pack(x), y.astype(np.uint32).tobytes() if (y > 1).any() else b"") for i, (x, y) in enumerate(zip(np.split(h, cut), np.split(c, cut), strict=True)) if len(x)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([_squeeze(r[2]) for r in rows], pa.binary())], names=["range", "h", "c"])

    for h in arrays:
        held.append(h)
        n += len(h)
        if n >= _HOLD:
            n = 0
            yield flush()
    if n:
        yield flush()


def _count(ranges: int):
    return lambda batches: _tallied(ranges, (sets(*w.shingles(K))[0] for batch in batches for _, _, w in each(batch)))


def _count_keys(ranges: int):
    return lambda batches: _tallied(ranges, (batch.column("bands").flatten().to_numpy().view(np.uint64) for batch in batches))


#: Members up to which a fine bucket is settled in one task.
_SLOTS, _ALONE = 24, 1024


def _slots(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << _SLOTS, bool)
    out[keys >> np.uint64(64 - _SLOTS)] = True
    return out


def _picked(slots: np.ndarray | None):
    """(id, bucket) of the keys of each document, of those only whose slot is marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("bands").flatten().to_numpy().view(np.uint64)
            at = np.repeat(np.arange(len(batch)), FINE_BANDS)
            if slots is not None:
                keep = np.flatnonzero(slots[keys >> np.uint64(64 - _SLOTS)])
                keys, at = keys[keep], at[keep]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array(keys.view(np.int64))], names=["id", "bucket"])

    return run


_MET = {"key": np.uint64, "at": np.int32, "id": np.int64, "label": np.int64, "total": np.float64, "sketch": np.uint64}


def _packed(slots: np.ndarray | None, ranges: int):
    """A batch's marked keys by range of the key, a row each: the keys, whose they are, and what those documents are met by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("bands").flatten().to_numpy().view(np.uint64)
            keep = np.flatnonzero(slots[keys >> np.uint64(64 - _SLOTS)]) if slots is not None else np.arange(len(keys))
            keep = keep[np.argsort(keys[keep])]
            keys, doc = keys[keep], keep // FINE_BANDS
            own = {c: batch.column(c).to_numpy() for c in ("id", "label", "total")}
            flat = batch.column("sketch").flatten()
            own["sketch"] = np.stack([flat.field(p).to_numpy() for p in range(len(_PLANE))], 1).reshape(len(batch), -1)
            cut = np.searchsorted(keys >> np.uint64(32), (np.arange(1, ranges) << 32) // ranges)
            rows = []
            for i, (k, d) in enumerate(zip(np.split(keys, cut), np.split(doc, cut), strict=True)):
                if len(k):
                    there, at = np.unique(d, return_inverse=True)
                    rows.append((i, k.tobytes(), at.astype(np.int32).tobytes(), *(np.ascontiguousarray(x[there]).tobytes() for x in own.values())))
            cols = list(zip(*rows, strict=True)) or [()] * (1 + len(_MET))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(x, pa.binary()) for x in cols[1:])], names=["range", *_MET])

    return run


def _met(star: bool):
    """The pairs of a range's buckets between components that may be alike: of all members with a hub, or else of the members
    outside the largest component with all others. Wider buckets than _ALONE are left out."""

    def run(pdf):
        import pandas as pd

        col = {c: [np.frombuffer(x, t) for x in pdf[c]] for c, t in _MET.items()}
        step = np.cumsum([0, *map(len, col["id"])])
        at = np.concatenate([x + s for x, s in zip(col["at"], step[:-1], strict=True)])
        key, ids, label, total, sketch = (np.concatenate(col[c]) for c in ("key", "id", "label", "total", "sketch"))
        sketch = sketch.reshape(len(ids), -1, len(_PLANE))
        # documents stand in the hubs' order, which is the same in all ranges
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((ids, mix(ids.view(np.uint64))))] = np.arange(len(ids))
        order = np.lexsort((rank[at], key))
        key, at = key[order], at[order]
        cut = np.flatnonzero(np.diff(key)) + 1
        pairs, kept = [], []
        for x in np.split(at, cut):
            if len(x) < 2 or len(x) > _ALONE or (label[x] == label[x[0]]).all():
                continue
            if star:
                pairs.append(np.stack([x[1:], np.full(len(x) - 1, x[0])], 1)[label[x[1:]] != label[x[0]]])
                continue
            names, of, size = np.unique(label[x], return_inverse=True, return_counts=True)
            main = of == np.argmax(size)
            rest = x[~main]
            pairs.append(np.stack(np.broadcast_arrays(rest[:, None], x[main]), 2).reshape(-1, 2))
            i, j = np.triu_indices(len(rest), 1)
            i, j = rest[i], rest[j]
            pairs.append(np.stack([i, j], 1)[label[i] != label[j]])
            if sum(map(len, pairs)) > _HOLD:
                kept.append(_alike(np.concatenate(pairs), ids, total, sketch))
                pairs = []
        if pairs:
            kept.append(_alike(np.concatenate(pairs), ids, total, sketch))
        pairs = np.concatenate(kept) if kept else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"a": ids[pairs].min(1, initial=2**63 - 1), "b": ids[pairs].max(1, initial=-(2**63))})

    return run


def _alike(pairs: np.ndarray, ids: np.ndarray, total: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Those of pairs, each once, whose total weights and sketches let them be alike, as _near has it."""
    pairs = np.sort(pairs, 1)
    pairs = np.unique(pairs[:, 0] * np.int64(len(ids)) + pairs[:, 1])
    pairs = np.stack([pairs // len(ids), pairs % len(ids)], 1)
    t = total[pairs]
    pairs = pairs[t.min(1) >= (SIMILARITY - _EPS) * t.max(1)]
    differ = [np.bitwise_count(np.bitwise_or.reduce(sketch[p[:, 0]] ^ sketch[p[:, 1]], 2)).sum(1, dtype=np.int64) for p in np.split(pairs, range(4096, len(pairs), 4096))]
    return pairs[np.concatenate(differ) <= _DIFFER]


def _squeeze(counts: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(counts) if counts else b""


def _frequent(least: float):
    def run(pdf):
        import pandas as pd
        import zstandard

        h = [_unpack(x) for x in pdf["h"]]
        c = [np.frombuffer(zstandard.ZstdDecompressor().decompress(y), np.uint32) if y else np.ones(len(x), np.uint32) for x, y in zip(h, pdf["c"], strict=True)]
        ids, inv = np.unique(np.concatenate(h), return_inverse=True)
        df = np.bincount(inv, np.concatenate(c), len(ids))
        keep = df > least
        return pd.DataFrame({"h": ids[keep].view(np.int64), "df": df[keep].astype(np.int64)})

    return run


def idf(spark: SparkSession, docs: DataFrame) -> Idf:
    """From all documents: exact counts of every shingle, of which those above the bound are kept."""
    n = docs.count()
    parts = docs.select("text").mapInArrow(_count(4 * partitions(spark)), "range int, h binary, c binary")
    rows = parts.groupBy("range").applyInPandas(_frequent(max(RARE * n, 1)), "h long, df long").toPandas()  # bounded, see above
    return Idf(rows["h"].to_numpy(np.int64).view(np.uint64), rows["df"].to_numpy(np.float64), n)


def _signatures(weigh: Idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in each(batch):
                h, tf, at = sets(*w.shingles(K))
                weight = tf * weigh(h)
                full = np.flatnonzero(np.diff(at))
                keys = np.zeros((b - a, BANDS), np.uint64)
                total = np.zeros(b - a)
                if len(full):
                    keys[full] = sample_bands(h, weight, np.append(at[:-1][full], at[-1]))
                    total[full] = np.add.reduceat(weight, at[:-1][full], dtype=np.float64)
                has = np.zeros(b - a, bool)
                has[full] = True
                text = [hashlib.blake2b(memoryview(w.data)[s:e], digest_size=16).digest() for s, e in zip(w.off[:-1], w.off[1:], strict=True)]
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * BANDS)]).astype(np.int32)), pa.array(keys[has].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(text, pa.binary()), pa.array(total), bands], names=["doc_id", "key", "total", "bands"])

    return run


def _weighted(weigh: Idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in each(batch):
                h, tf, at = sets(*w.shingles(K))
                weight = (tf * weigh(h)).astype(np.float32)
                cut = list(zip(at[:-1], at[1:], strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([h[s:e].tobytes() for s, e in cut], pa.binary()), pa.array([weight[s:e].tobytes() for s, e in cut], pa.binary())], names=["id", "h", "w"])

    return run


def _ends(blobs: pa.Array, width: int) -> np.ndarray:
    """Offsets of binary values, in items of so many bytes."""
    size = np.array([len(x) for x in blobs.to_pylist()], np.int64) // width
    return np.concatenate([[0], np.cumsum(size)])


def _unfolded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of (id, label, h, w)."""
    for batch in batches:
        at = _ends(batch.column("h"), 8)
        row = np.repeat(np.arange(len(batch)), np.diff(at))
        h, w = (np.frombuffer(b"".join(batch.column(c).to_pylist()), t) for c, t in (("h", np.int64), ("w", np.float32)))
        ids = pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label")], names=["id", "label"]).take(pa.array(row))
        yield pa.RecordBatch.from_arrays([ids.column("id"), ids.column("label"), pa.array(h), pa.array(w.astype(np.float64))], names=["id", "label", "x", "w"])


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys and sketch of each (id, h, w)."""
    for batch in batches:
        ends = _ends(batch.column("h"), 8)
        for a, b in blocks(ends, 1 << 17):
            part = batch.slice(a, b - a)
            h, w = (np.frombuffer(b"".join(part.column(c).to_pylist()), t) for c, t in (("h", np.uint64), ("w", np.float32)))
            keys, bits = fine_bands(h, w, ends[a : b + 1] - ends[a])
            words = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(bits[:, :, p]).reshape(-1).view(np.int64)) for p in range(len(_PLANE))], names=list(_PLANE))
            listed = [pa.ListArray.from_arrays(pa.array((np.arange(b - a + 1) * x.shape[1]).astype(np.int32)), flat) for x, flat in ((keys, pa.array(keys.reshape(-1).view(np.int64))), (bits, words))]
            yield pa.RecordBatch.from_arrays([part.column("id"), *listed], names=["id", "bands", "sketch"])


def similarity(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted sets."""
    at = np.minimum(np.searchsorted(ha, hb), max(len(ha) - 1, 0))
    hit = ha[at] == hb
    both = np.minimum(wa[at[hit]], wb[hit]).sum(dtype=np.float64)
    return float(both / max(wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64) - both, 1e-12))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col = {c: batch.column(c) for c in ("ha", "wa", "hb", "wb")}
        sim = np.empty(len(batch))
        for i in range(len(batch)):
            ha, hb = (np.frombuffer(col[c][i].as_buffer(), np.uint64) for c in ("ha", "hb"))
            wa, wb = (np.frombuffer(col[c][i].as_buffer(), np.float32) for c in ("wa", "wb"))
            sim[i] = similarity(ha, wa, hb, wb)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sim)], names=["a", "b", "sim"])


def _similarities(spark: SparkSession, pairs: DataFrame, shingles: DataFrame, what: str) -> DataFrame:
    """(a, b, sim) of pairs (a, b), a table of saved: each pair takes b's shingles, then a's. Only the shingles of documents that
    the pairs name are dealt out. A hub's pairs are many rows of one key beside its one row, which adaptive execution splits."""

    def of(side: str) -> DataFrame:
        named = saved(spark, pairs.select(side).distinct(), "named")
        named_by.append(named)
        return shingles.select(F.col("id").alias(side), F.col("h").alias(f"h{side}"), F.col("w").alias(f"w{side}")).join(broadcast_if_small(named), side, "left_semi")

    named_by: list[DataFrame] = []
    out = saved(spark, pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "ha", "wa", "hb", "wb").mapInArrow(_verify, "a long, b long, sim double"), what)
    drop(spark, *named_by)
    return out


class _Links:
    """What is known so far: compared pairs, and the component of each document that has a link."""

    def __init__(self, spark: SparkSession, shingles: DataFrame):
        self.spark, self.shingles, self.compared, self.labels = spark, shingles, None, None

    def labelled(self, rows: DataFrame) -> DataFrame:
        """rows (id, ..) with label: the component's, or the document's own."""
        if self.labels is None:
            return rows.withColumn("label", F.col("id"))
        return rows.join(broadcast_if_small(self.labels), F.col("id") == F.col("node"), "left").withColumn("label", F.coalesce("label", "id")).drop("node")

    def compare(self, pairs: DataFrame) -> None:
        """Verifies pairs (a, b) that are not known; joins the components of alike ones."""
        if self.compared is not None:
            pairs = pairs.join(self.compared.select("a", "b"), ["a", "b"], "left_anti")
        pairs = saved(self.spark, pairs.select("a", "b"), "pairs")
        if not pairs.limit(1).count():
            drop(self.spark, pairs)
            return
        got = _similarities(self.spark, pairs, self.shingles, "compared")
        drop(self.spark, pairs)
        self.compared = got if self.compared is None else self.compared.unionByName(got)
        if got.filter(F.col("sim") >= SIMILARITY).limit(1).count():
            before, self.labels = self.labels, components(self.spark, self.alike())
            drop(self.spark, before)

    def alike(self) -> DataFrame:
        if self.compared is None:
            return self.spark.createDataFrame([], "a long, b long, sim double")
        return self.compared.filter(F.col("sim") >= SIMILARITY)


_KEY = ["band", "bucket"]


def _near(a: str, b: str, sketched: bool) -> F.Column:
    """Which pairs may be alike: by their total weights, and their sketches."""
    out = F.least(f"{a}.total", f"{b}.total") >= (SIMILARITY - _EPS) * F.greatest(f"{a}.total", f"{b}.total")
    if sketched:
        either = F.zip_with(f"{a}.sketch", f"{b}.sketch", lambda x, y: F.bit_count(reduce(lambda p, q: p.bitwiseOR(q), (x[c].bitwiseXOR(y[c]) for c in _PLANE))))
        out &= F.aggregate(either, F.lit(0), lambda x, y: x + y) <= _DIFFER
    return out


_PAIR = ("least(x.id, y.id) AS a", "greatest(x.id, y.id) AS b")


def _star(rows: DataFrame, turn: int, sketched: bool) -> DataFrame:
    """Pairs of each member and its bucket's hub of another component; the hub is the same in most of a document's bands."""
    order = F.struct(F.lit(0).cast("long") if turn == 0 else F.xxhash64("id", F.lit(turn)), "id")
    hubs = rows.groupBy(*_KEY).agg(F.min_by(F.struct("id", "label", *(c for c in rows.columns if c in ("total", "sketch"))), order).alias("y"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select(*_KEY, "y.*")
    x, y = rows.alias("x"), hubs.alias("y")
    return x.join(y, _KEY).filter((F.col("x.label") != F.col("y.label")) & _near("x", "y", sketched)).selectExpr(*_PAIR).distinct()


def _open(rows: DataFrame) -> DataFrame:
    """Buckets that hold several components: members, and the component of most of them."""
    by = rows.groupBy(*_KEY, "label").agg(F.count(F.lit(1)).alias("c"))
    return by.groupBy(*_KEY).agg(F.sum("c").alias("n"), F.max_by("label", F.struct("c", "label")).alias("main"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")


def _across(rows: DataFrame, open_: DataFrame, sketched: bool) -> DataFrame:
    """Pairs of components: the members outside the main one meet blocks of all members."""
    met = rows.join(open_, _KEY).withColumn("blocks", F.ceil(F.col("n") / _BLOCK).cast("int"))
    x = met.filter("label <> main").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("x")
    y = met.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).alias("y")
    new = (F.col("x.label") != F.col("y.label")) & ((F.col("y.label") == F.col("y.main")) | (F.col("x.id") < F.col("y.id")))
    return x.join(y, [*_KEY, "block"]).filter(new & _near("x", "y", sketched)).selectExpr(*_PAIR).distinct()


def _fine(spark: SparkSession, links: _Links, hot: DataFrame) -> None:
    """Settles the documents hot (id, total) of wide buckets, see above."""
    own = saved(spark, links.labelled(hot).join(links.shingles, "id"), "hot")
    bare = own.select("id", "label", "h", "w").repartition(partitions(spark)).mapInArrow(_unfolded, "id long, label long, x long, w double")
    spread = bare.groupBy("x").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("x")
    may = bare.join(spread, "x").groupBy("id").agg(F.sum("w").alias("common")).withColumnRenamed("id", "may")
    left = own.join(may, F.col("id") == F.col("may")).filter(F.col("common") >= (SIMILARITY - 1e-6) * F.col("total")).select("id", "total", "h", "w")
    keyed = left.repartition(partitions(spark)).mapInArrow(_finer, f"id long, bands array<long>, sketch array<struct<{', '.join(f'{c}: long' for c in _PLANE)}>>")
    keyed = saved(spark, keyed.join(hot, "id"), "finer")
    ranges = 4 * partitions(spark)
    counts = keyed.select("bands").mapInArrow(_count_keys(ranges), "range int, h binary, c binary")
    several = saved(spark, counts.groupBy("range").applyInPandas(_frequent(1), "h long, df long"), "shared")
    n = several.agg(F.sum("df")).first()[0] or 0
    slots = None
    if several.limit(SMALL + 1).count() <= SMALL:  # else all keys are dealt out
        slots = _slots(several.select("h").toArrow()["h"].to_numpy().view(np.uint64))
    parts = min(ranges, max(6, n // _MEET))
    for star in (True, False):
        packed = links.labelled(keyed).select("id", "label", "total", "bands", "sketch").mapInArrow(_packed(slots, parts), "range int, " + ", ".join(f"{c} binary" for c in _MET))
        links.compare(packed.groupBy("range").applyInPandas(_met(star), "a long, b long").distinct())
    wider = saved(spark, several.filter(F.col("df") > _ALONE).select("h"), "wider")
    if wider.limit(1).count():
        rows = keyed.select("id", "bands").mapInArrow(_picked(slots), "id long, bucket long").join(broadcast_if_small(wider), F.col("bucket") == F.col("h"), "left_semi")
        rows = saved(spark, rows.select("id", F.lit(0).alias("band"), "bucket").join(keyed.select("id", "total", "sketch"), "id"), "fine")
        links.compare(_star(links.labelled(rows), 1, True))
        again = links.labelled(rows)
        links.compare(_across(again, _open(again), True))
        drop(spark, rows)
    drop(spark, own, keyed, several, wider)


def _numbered(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number column, and its name: one number for each (doc_id, text), in the order of doc_id, null ids last; written once."""
    number = fresh(docs, "number")
    pair = (F.col("doc_id").cast("long").alias("i"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256).alias("t"))
    pairs = docs.select(*pair).distinct().orderBy(F.asc_nulls_last("i"), "t")
    numbers = saved(spark, pairs.withColumn("n", F.monotonically_increasing_id()), "numbers")
    met = docs.select(F.struct(*docs.columns).alias("row"), *pair).alias("x").join(numbers.alias("y"), F.col("x.i").eqNullSafe(F.col("y.i")) & (F.col("x.t") == F.col("y.t")))
    return saved(spark, met.select("row.*", F.col("y.n").alias(number)), "numbered"), number


def near_classes(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, class_id) of every row, and the links (a, b, sim) found between documents of different texts: they join
    each class, but not all pairs of a class are compared."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1").limit(1).count():
        return _classes(spark, docs)
    # an id may stand on several texts: each (doc_id, text) is a document
    rows, number = _numbered(spark, docs)
    out, links = _classes(spark, rows.select(F.when(F.col("doc_id").isNotNull(), F.col(number)).alias("doc_id"), "text"))
    ids = rows.filter(F.col("doc_id").isNotNull()).select(number, "doc_id").distinct()
    name = lambda df, c: df.withColumnRenamed(c, "_n").join(ids.withColumnRenamed("doc_id", c), F.col("_n") == F.col(number), "left").drop("_n", number)
    return name(name(out, "doc_id"), "class_id").select("doc_id", "key", "class_id"), name(name(links, "a"), "b").select("a", "b", "sim")


def _classes(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """near_classes of docs (doc_id, text) whose ids stand on one text each."""
    bound_batches(spark)
    weigh = idf(spark, docs)
    marks = saved(spark, docs.mapInArrow(_signatures(weigh), "doc_id long, key binary, total double, bands array<long>"), "marks")
    # equal texts: the smallest doc_id stands for them
    firsts = saved(spark, marks.filter(F.col("doc_id").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("id"), F.first("total").alias("total"), F.first("bands").alias("bands")), "firsts")
    rows = firsts.select("id", "total", F.posexplode("bands").alias("band", "bucket"))
    shared = rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    rows = saved(spark, rows.join(shared, _KEY), "members")
    ids = saved(spark, rows.select("id").distinct(), "ids")
    texts = docs.join(broadcast_if_small(ids), docs.doc_id == ids.id).select("doc_id", "text")
    shingles = saved(spark, texts.mapInArrow(_weighted(weigh), "id long, h binary, w binary").dropDuplicates(["id"]), "shingles")
    links = _Links(spark, shingles)
    for turn in range(STARS):
        links.compare(_star(links.labelled(rows), turn, False))
    known = links.labelled(rows)
    open_ = saved(spark, _open(known), "open")
    links.compare(_across(known, open_.filter(F.col("n") <= WIDE), False))
    wide = open_.filter(F.col("n") > WIDE)
    if wide.limit(1).count():
        hot = saved(spark, rows.join(broadcast_if_small(wide.select(*_KEY)), _KEY, "left_semi").select("id", "total").distinct(), "wide")
        _fine(spark, links, hot)
        drop(spark, hot)
    drop(spark, rows, ids, shingles, open_)
    labels = links.labels if links.labels is not None else spark.createDataFrame([], "node long, label long")
    classes = firsts.select("key", "id").join(labels, F.col("id") == F.col("node"), "left").select("key", F.coalesce("label", "id").alias("class_id"))
    known_ids = F.col("doc_id").isNotNull()
    out = marks.select("doc_id", "key").join(classes, "key", "left").select("doc_id", "key", F.when(known_ids, F.col("class_id")).alias("class_id"))
    return out, links.alike()


def near_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Keeps the first document of each class, a row each; all of docs' columns. Rows are told apart by doc_id and text, so
    that different texts of one id stay; a row with a null doc_id goes if it is a copy, after all others in order."""
    if docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count():
        rows, key = _numbered(spark, docs)
    else:
        rows, key = docs, "doc_id"
    name = fresh(rows, "gone_id")
    classes, _ = _classes(spark, rows.select(F.col(key).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    gone = saved(spark, classes.filter(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias(name)).distinct(), "gone")
    kept = rows.join(broadcast_if_small(gone), F.col(key).cast("long") == F.col(name), "left_anti")
    return kept if key == "doc_id" else kept.dropDuplicates([key]).select(*docs.columns)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, class_id."""
    return near_classes(spark, table(spark, sf_dir, "documents"))[0].select("doc_id", "class_id")
