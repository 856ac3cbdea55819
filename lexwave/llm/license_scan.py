"""License scan by diagonal voting.

All rolling word k-gram hashes of every whole text are joined with the template positions; a match votes for the
diagonal (position in the text minus position in the template). Neighbouring diagonals are merged, and the k-grams'
own words are compared, so that a hash alone never decides.

A null or empty text has no words, no labels and score 0; repeated rows and repeated doc_ids each give a row of their
own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .words import Words, each

#: Phrases whose every place counts, with their labels.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: Well-known public notices; a part of one is enough (COVERAGE of its k-grams).
OWN = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
)
K, COVERAGE, NEAR = 3, 0.8, 2
_BITS = 20


def _templates() -> list[dict]:
    """One row for each k-gram of each template."""
    rows = []
    for tid, (label, text) in enumerate([*BASE, *OWN]):
        n = len(text.split())
        k = min(K, n)
        w = Words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        h, _ = w.grams(k)
        rows += [{"tid": tid, "label": label, "base": tid < len(BASE), "k": k, "tpos": p, "grams": n - k + 1, "h": int(np.int64(np.uint64(x).view(np.int64))), "gram": w.text(p, k)} for p, x in enumerate(h)]
    return rows


def _scan(rows: list[dict]):
    """Emits each text's word count and the places whose k-gram may be a template's: a bitmap over the hashes' top bits drops the rest before the join."""
    maps = {k: np.zeros(1 << _BITS, bool) for k in {r["k"] for r in rows}}
    for r in rows:
        maps[r["k"]][np.int64(r["h"]).view(np.uint64) >> np.uint64(64 - _BITS)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in each(batch):
                found = []
                for k, there in maps.items():
                    h, ok = w.grams(k)
                    at = np.flatnonzero(there[h >> np.uint64(64 - _BITS)] & ok)
                    found.append((np.full(len(at), k), at, h[at].view(np.int64)))
                ks, at, h = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(at, kind="stable")
                ks, at, h = ks[order], at[order], h[order]
                cut = np.searchsorted(at, w.at)
                doc = np.repeat(np.arange(b - a), np.diff(cut))
                hits = pa.StructArray.from_arrays([pa.array(ks.astype(np.int32)), pa.array(at - w.at[doc]), pa.array(h), pa.array([w.text(i, k) for i, k in zip(at, ks, strict=True)], pa.string())], names=["k", "pos", "h", "gram"])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("doc_id"), pa.array(np.diff(w.at)), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), hits)], names=["uid", "doc_id", "n_words", "hits"])

    return run


def license_spans(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Rows (uid, doc_id, n_words, label, base, start, coverage): verified spans; one row with null label for a text without any."""
    rows = _templates()
    # the templates are constants of this module: a few hundred rows
    templates = spark.createDataFrame(rows, "tid int, label string, base boolean, k int, tpos long, grams long, h long, gram string").withColumnRenamed("gram", "tgram")
    places = (
        docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(_scan(rows), "uid long, doc_id long, n_words long, hits array<struct<k:int,pos:long,h:long,gram:string>>")
        .select("uid", "doc_id", "n_words", F.explode_outer("hits").alias("hit"))
        .select("uid", "doc_id", "n_words", "hit.*")
    )
    votes = places.join(F.broadcast(templates), (places.h == templates.h) & (places.k == templates.k) & (places.gram == templates.tgram), "left")
    one = ["uid", "doc_id", "n_words"]
    diagonals = votes.groupBy(*one, "tid", "label", "base", "grams", (F.col("pos") - F.col("tpos")).alias("diag")).agg(F.collect_set("tpos").alias("seen"), F.min("pos").alias("start"))
    near = Window.partitionBy(*one, "tid").orderBy("diag")
    islands = diagonals.withColumn("new", F.when(F.col("base") | (F.col("diag") - F.lag("diag").over(near) > NEAR), 1).otherwise(0)).withColumn("island", F.sum("new").over(near))
    spans = islands.groupBy(*one, "tid", "label", "base", "grams", "island").agg(F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("n"), F.min("start").alias("start"))
    return spans.select(*one, "label", "base", "start", F.when(F.col("tid").isNotNull(), F.least(F.lit(1.0), F.col("n") / F.col("grams"))).alias("coverage"))


def license_scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    good = F.col("coverage") >= F.when(F.col("base"), 1.0).otherwise(COVERAGE)
    base = good & F.col("base")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return (
        license_spans(spark, docs)
        .groupBy("uid", "doc_id", "n_words")
        .agg(
            F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
            joined(base).alias("base_labels"), joined(good).alias("labels"), F.coalesce(F.max(F.when(F.col("base") & ~good, 0.5 * F.col("coverage")).otherwise(F.col("coverage"))), F.lit(0.0)).alias("score"),
        )
        .drop("uid")
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark, table(spark, sf_dir, "documents"))
