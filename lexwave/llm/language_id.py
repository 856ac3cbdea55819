"""Language ID: blended-spectrum string kernel, Nyström landmarks, one-versus-rest kernel ridge regression.

A text is the set of its byte n-grams (n of NS, A-Z lower-cased), hashed to WIDTH places; k(x, z) is the number of
n-grams that both have over the root of the product of their numbers. Landmarks and training rows are bounded samples
of the labelled rows (fixed numbers; every language of the at most TRAIN rows is learned, chosen by a hash of doc_id, the rarer languages as often as the others); every
text is then scored whole, by products of presence matrices.

A text that is null or has no letter gets `und` and score 0; so does every text if there is nothing to learn from.
Null labels are not learned; of several texts of one doc_id the first in order is. Repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, held_out, table
from .words import LOWER, blocks, release, utf8

NS, WIDTH, LANDMARKS, TRAIN, RIDGE, UND = (1, 2, 3), 1 << 13, 192, 1600, 1e-3, "und"
_STEP, _LETTER = 128, np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def presence(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Unit rows: which n-grams each text has."""
    out = np.zeros((len(off) - 1, WIDTH), np.float32)
    for i in range(len(off) - 1):
        x, row = LOWER[data[off[i] : off[i + 1]]].astype(np.uint32), out[i]
        code = np.zeros(len(x), np.uint32)
        for n in range(1, max(NS) + 1):
            if len(x) < n:
                break
            code = (code[: len(x) - n + 1] * np.uint32(257)) + x[n - 1 :] + np.uint32(1)
            if n in NS:
                row[(code * np.uint32(2654435761)) >> np.uint32(32 - 13)] = 1
    norm = np.sqrt(np.maximum(out.sum(1, keepdims=True), 1))
    out /= norm
    return out


def sample(docs: DataFrame, label: str, n: int) -> DataFrame:
    """At most n rows (doc_id, text, label), each label with about as many as the others; bounded top-n heaps, first by part, then over parts."""
    order = F.xxhash64(F.col("doc_id"), F.lit(7))
    rows = docs.filter(F.col(label).isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id")).select("doc_id", label, order.alias("o"))
    part = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    pre = part.withColumn("r", F.row_number().over(Window.partitionBy(label, "part").orderBy("o", "doc_id"))).filter(F.col("r") <= n)
    top = pre.withColumn("r", F.row_number().over(Window.partitionBy(label).orderBy("o", "doc_id"))).filter(F.col("r") <= n).orderBy("r", label).limit(n)
    return top.select(F.col("doc_id").alias("id"), F.col(label).alias("y"))


def fit(texts: list[str], langs: list[str]) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """(languages, landmarks' presence rows, weights from kernel values to one score per language)."""
    names = sorted(set(langs))
    if not names:
        return None
    data, off = utf8(pa.array(texts, pa.string()))
    x = presence(data, off)
    y = np.array([[1.0 if v == c else -1.0 for c in names] for v in langs])
    z = x[: LANDMARKS]
    kzz = (z @ z.T).astype(np.float64)
    val, vec = np.linalg.eigh(kzz)
    keep = val > 1e-6 * val.max()
    root = vec[:, keep] / np.sqrt(val[keep])
    phi = np.hstack([(x @ z.T).astype(np.float64) @ root, np.ones((len(x), 1))])
    share = np.array([sum(v == c for v in langs) for c in names]) / len(langs)
    weight = np.array([1 / (len(names) * share[names.index(v)]) for v in langs])
    w = np.linalg.solve(phi.T @ (phi * weight[:, None]) + RIDGE * len(x) * np.eye(phi.shape[1]), phi.T @ (y * weight[:, None]))
    return names, z, np.vstack([root @ w[:-1], w[-1:]])


def _letterless(texts: pa.Array, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which texts are null or have no letter."""
    out = np.ones(len(off) - 1, bool)
    for a, b in blocks(off):
        total = np.concatenate([[0], np.cumsum(_LETTER[data[off[a] : off[b]]], dtype=np.int32)])
        out[a:b] = total[off[a + 1 : b + 1] - off[a]] == total[off[a:b] - off[a]]
    for i in np.flatnonzero(out):
        out[i] = not any(c.isalpha() for c in texts[int(i)].as_py() or "")
    return out


def _predicted(model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text."""
    data, off = utf8(texts)
    n = len(off) - 1
    lang, score = np.full(n, UND, object), np.zeros(n)
    if model is not None:
        names, z, w = model
        for a in range(0, n, _STEP):
            b = min(n, a + _STEP)
            f = (presence(data[off[a] : off[b]], off[a : b + 1] - off[a]) @ z.T).astype(np.float64) @ w[:-1] + w[-1]
            best = f.argmax(1)
            lang[a:b] = np.array(names, object)[best]
            score[a:b] = np.clip((f[np.arange(b - a), best] + 1) / 2, 0, 1)
    bare = _letterless(texts, data, off)
    lang[bare], score[bare] = UND, 0.0
    return lang, score


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = _predicted(model, batch.column("text"))
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(lang, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])
            release()

    return run


def learn(docs: DataFrame, label: str = "lang"):
    top = sample(docs, label, TRAIN)
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(top), F.col("doc_id") == F.col("id")).groupBy("doc_id").agg(F.min(F.struct("y", "text")).alias("r")).select("doc_id", "r.text", "r.y").collect()  # at most TRAIN rows
    by: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        by.setdefault(r.y, []).append(r)
    turn = [x for i in range(max(map(len, by.values()), default=0)) for v in sorted(by) for x in by[v][i : i + 1]]  # landmarks: the languages by turns
    return fit([r.text for r in turn], [r.y for r in turn])


def language_id(spark: SparkSession, docs: DataFrame, train: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs; the model is learned from train (doc_id, text, lang)."""
    bound_batches(spark)
    model = learn(train)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), F.col("text").cast("string").alias("text"))
    return out.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id(spark, docs, docs)


def _kept(model):
    """Whether a text stays: only texts go to Python, and flags come back."""

    @F.arrow_udf("boolean")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            yield pa.array(~_letterless(text, *utf8(text)) if model is None else _predicted(model, text)[0] != UND)
            release()

    return run


def with_language(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without those that get `und`; all their columns. The model is learned from docs' own text and lang; without one,
    only texts that are null or have no letter go."""
    bound_batches(spark)
    return docs.filter(_kept(learn(docs))(F.col("text").cast("string")))
