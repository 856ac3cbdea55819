"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is its hashed character n-grams and itself; a window of words is the average of their embeddings, and a linear
softmax gives the window's probability. A text scores as its likeliest window does, so that a few words in a long text
still count; training sends the gradient through that window. Unseen misspellings share n-gram vectors with what was
learned. The labelled rows learned from are a bounded sample (TRAIN rows, half of each label where there are enough).

Every text is scored whole. Empty or null texts score as the empty window (bias only, at most 0.5 - predicted 0);
nothing to learn from: 0. Repeated labels of a document count once (the largest); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, held_out, table
from .words import BLOCK, Words, blocks, mix, utf8

BITS, DIM, NS, WINDOW, STRIDE = 20, 8, (3, 4, 5), 2, 1
BUCKETS = 1 << BITS
TRAIN, EPOCHS, STEPS, RATE, THRESHOLD, SEED = 2400, 12, 300, 0.3, 0.7, 11
_CACHE_WORDS = 1 << 19


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets by word): all n-grams of <word> and the word itself."""
    text = b"".join(b"<" + w + b">" for w in words)
    data = np.frombuffer(text, np.uint8).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    end = np.cumsum(size)
    start = end - size
    word = np.repeat(np.arange(len(words)), size)
    left = end[word] - np.arange(len(data))  # bytes to the word's end
    parts, owner, code = [], [], np.zeros(len(data), np.uint64)
    for n in range(1, max(NS) + 1):
        code = code[: len(data) - n + 1] * np.uint64(1000003) + data[n - 1 :] + np.uint64(1)
        if n in NS:
            at = np.flatnonzero(left[: len(code)] >= n)
            parts.append(mix(code[at] + np.uint64(n << 56)))
            owner.append(word[at])
    whole = Words(np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum(size - 2)]))
    own = np.zeros(len(words), np.uint64)
    own[np.flatnonzero(np.diff(whole.at) == 1)] = whole.hashes[whole.at[:-1][np.diff(whole.at) == 1]]
    parts.append(own)
    owner.append(np.arange(len(words)))
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    buckets = (np.concatenate(parts)[order] >> np.uint64(64 - BITS)).astype(np.int32)
    return buckets, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))]).astype(np.int64)


def coded(column: pa.Array) -> Iterator[tuple[int, int, list[bytes], np.ndarray, np.ndarray]]:
    """Blocks of texts: first and last row, distinct words, each word's number among them, words' offsets by text."""
    data, off = utf8(column)
    for a, b in blocks(off, BLOCK):
        w = Words(data[off[a] : off[b]], off[a : b + 1])
        _, first, code = np.unique(w.hashes, return_index=True, return_inverse=True)
        raw = w.data
        yield a, b, [bytes(_low(raw[s:e])) for s, e in zip(w.starts[first], w.ends[first], strict=True)], code, w.at


def _low(x: np.ndarray) -> bytes:
    return x.tobytes().lower()  # bytes.lower() changes A-Z only


def windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end word, offsets by text) of every window; each text has one at least."""
    n = np.diff(at)
    count = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
    off = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(n)), count)
    first = at[text] + STRIDE * (np.arange(off[-1]) - off[text])
    return first, np.minimum(first + WINDOW, at[text + 1]), off


def fit(texts: list[str], labels: list[int]) -> np.ndarray | None:
    """Each bucket's difference of logits; the bias last."""
    y = np.array(labels)
    if len(set(labels)) < 2:
        return None
    weight = len(y) / (2 * np.bincount(y, minlength=2))
    rng = np.random.default_rng(SEED)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    soft, bias = rng.normal(0, 0.5, (2, DIM)).astype(np.float32), np.zeros(2, np.float32)
    ge, gs, gb = np.full(BUCKETS, 1e-9, np.float32), np.full((2, DIM), 1e-6, np.float32), np.full(2, 1e-4, np.float32)
    blocks_ = []
    for lo in range(0, len(texts), 100):
        column = pa.array(texts[lo : lo + 100], pa.string())
        for a, b, words, code, at in coded(column):
            if len(code):
                blocks_.append((*grams(words), code, at, *windows(at), y[lo + a : lo + b]))
    for _ in range(max(EPOCHS, STEPS // max(1, len(blocks_)))):
        for k in rng.permutation(len(blocks_)):
            bucket, goff, code, at, first, end, woff, target = blocks_[k]
            size = np.diff(goff).astype(np.float32)
            vec = np.add.reduceat(emb[bucket], goff[:-1]) / size[:, None]
            # logits of words; a window's is the mean of its words'
            diff = vec @ (soft[1] - soft[0])
            run = np.concatenate([[0], np.cumsum(diff[code], dtype=np.float64)])
            n = np.maximum(end - first, 1)
            z = (run[end] - run[first]) / n
            top = np.array([woff[i] + z[woff[i] : woff[i + 1]].argmax() for i in range(len(target))])
            p = 1 / (1 + np.exp(-np.clip(z[top] + bias[1] - bias[0], -30, 30)))
            err = (p - target) * weight[target] / len(target)
            # back through the likeliest windows
            wid = np.concatenate([np.arange(s, e) for s, e in zip(first[top], end[top], strict=True)])
            who = np.repeat(np.arange(len(target)), (end - first)[top])
            share = (err / n[top])[who].astype(np.float32)
            gword = np.bincount(code[wid], share, len(size)).astype(np.float32)  # d loss / d word's logit difference
            used = np.flatnonzero(gword)
            gvec = gword[used]
            gsoft = (gvec[:, None] * vec[used]).sum(0)
            rows = np.concatenate([bucket[goff[u] : goff[u + 1]] for u in used]) if len(used) else np.empty(0, np.int32)
            each = np.repeat(gvec / size[used], np.diff(goff)[used])
            ids, inv = np.unique(rows, return_inverse=True)
            gemb = np.bincount(inv, each, len(ids)).astype(np.float32)[:, None] * (soft[1] - soft[0])
            ge[ids] += (gemb**2).mean(1)
            emb[ids] -= RATE * gemb / np.sqrt(ge[ids])[:, None]
            for sign, c in ((-1, 0), (1, 1)):
                gs[c] += gsoft**2
                soft[c] -= RATE * 0.2 * sign * gsoft / np.sqrt(gs[c])
                g = sign * err.sum()
                gb[c] += g * g
                bias[c] -= RATE * 0.2 * g / np.sqrt(gb[c])
    return np.append(emb @ (soft[1] - soft[0]), bias[1] - bias[0]).astype(np.float32)


def scores(model: np.ndarray, column: pa.Array, cache: dict[bytes, float]) -> np.ndarray:
    out = np.zeros(len(column))
    for a, b, words, code, at in coded(column):
        new = [w for w in words if w not in cache]
        if len(cache) + len(new) > _CACHE_WORDS:
            cache.clear()
            new = words
        if new:
            bucket, goff = grams(new)
            cache.update(zip(new, (np.add.reduceat(model[bucket], goff[:-1]) / np.diff(goff)).tolist(), strict=True))
        diff = np.fromiter(map(cache.__getitem__, words), np.float64, len(words))
        run = np.concatenate([[0], np.cumsum(diff[code])]) if len(words) else np.zeros(1)
        first, end, woff = windows(at)
        z = (run[end] - run[first]) / np.maximum(end - first, 1)
        out[a:b] = 1 / (1 + np.exp(-np.clip(np.maximum.reduceat(z, woff[:-1]) + model[-1], -30, 30)))
    return out


def _score(model):
    cache: dict[bytes, float] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = scores(model, batch.column("text"), cache) if model is not None else np.zeros(len(batch))
            if model is not None:
                empty = pc.equal(pc.fill_null(pc.utf8_length(batch.column("text")), 0), 0).to_numpy(zero_copy_only=False)
                s = np.where(empty, np.minimum(s, 0.5), s)
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=[*keep, "score", "predicted"])

    return run


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> np.ndarray | None:
    """Only rows whose crc32 remainder is not 1; at most TRAIN of them, picked by a hash of doc_id."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max(label).alias("y"))
    part = known.withColumn("o", F.xxhash64(F.col("doc_id"), F.lit(3))).withColumn("part", F.pmod("o", F.lit(64)))
    top = part.withColumn("r", F.row_number().over(Window.partitionBy("y", "part").orderBy("o", "doc_id"))).filter(F.col("r") <= TRAIN)
    top = top.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy("o", "doc_id"))).orderBy("r", "y").limit(TRAIN)
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(top.select("doc_id", "y")), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).collect()  # at most TRAIN rows
    rows.sort(key=lambda r: r.doc_id)
    return fit([r.text for r in rows], [int(r.y) for r in rows])


def toxicity(spark: SparkSession, docs: DataFrame, train_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    bound_batches(spark)
    model = learn(train_docs, labels)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), F.col("text").cast("string").alias("text"))
    return out.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(spark, docs, docs, table(spark, sf_dir, "labels"))
