"""Each operator on a small table with every odd case, against plain Python where SQL can't express it."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexwave.llm import ann, common, decontaminate, language_id, license_scan, line_dedup, mixing, near_dedup, preferences, token_store, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, a int, label int, id string, p double, mix_words long, times int, bad_id long, gone_id long, number long, row string, uid long, row_number long, n_words int, size int, h string"


def docs(spark, texts, langs=None, sources=None):
    out = [(i if t != "no id" else None, t, (langs or {}).get(i, "en"), (sources or {}).get(i, "s"), len(t or ""), "k", 1, 0, "x", 0.5, 7, 7, i, i, 0, "r", 0, 0, 1, 2, "h") for i, t in enumerate(texts)]
    return spark.createDataFrame(out, SCHEMA)


def sentence(seed, n=60):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


ODD = [None, "", "   \n ", "...", "no id", "é" * 50, "a " * 20000, "one", sentence(1), sentence(1)]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD).union(docs(spark, ODD).filter("doc_id = 8"))


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, ["x"]).filter("doc_id < 0")


def test_toxicity(spark, odd, none):
    bad, good = ["grumptard", "snorfidiot"], ["flower", "garden", "river", "bread"]
    rng = random.Random(3)
    texts = [" ".join(rng.choices(good, k=30) + ([rng.choice(bad)] if i % 3 == 0 else [])) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int")
    d = docs(spark, texts)
    got = {r.doc_id: r for r in toxicity.toxicity(spark, d, d, labels).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in set(held)) for i in got)
    assert np.mean([got[i].predicted == (i % 3 == 0) for i in held]) > 0.95
    new = docs(spark, ["the grumptardd garden", "bread river"])
    score = {r.doc_id: r.score for r in toxicity.toxicity(spark, new, d, labels).collect()}
    assert score[0] > score[1]
    assert toxicity.toxicity(spark, odd, d, labels).count() == len(ODD) + 1
    assert {r.score for r in toxicity.toxicity(spark, odd, odd, labels.filter("toxic = 5")).collect()} == {0.0}
    assert toxicity.toxicity(spark, none, d, labels).count() == 0


def test_token_store(spark, odd, none):
    plain = Tokenizer.from_file(token_store.tokenizer_path())
    odd = odd.union(docs(spark, ["a <|endoftext|> b", "it's 42's '<|end x|>'s", "tab\tand\x1cmore \x85 (x)'ll"]))
    got = sorted(token_store.token_store(spark, odd).collect(), key=lambda r: r.start)
    at = 0
    want = Counter()
    for r in odd.collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [2]
        want[r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id or -1 for r in got] == sorted(r.doc_id or -1 for r in got)
    assert token_store.token_store(spark, none).count() == 0
    import zstandard

    ids = np.random.default_rng(0).integers(0, 50257, 200_001).astype(np.int32)
    frames, planes = token_store.pack(ids, zstandard.ZstdCompressor().compress)
    assert (token_store.unpack(frames, planes, zstandard.ZstdDecompressor().decompress) == ids).all()


def test_encoder_pieces():
    import pyarrow as pa

    enc, plain = token_store.Encoder(token_store.tokenizer_path()), Tokenizer.from_file(token_store.tokenizer_path())
    texts = ["", "a<|endoftext|>b, c", "(a) b's 'll x'll 'd'", "1a2 a1 _x -- ab-cd", "a\x0bb \x0c c\x1c", "² ½ a² 1²", "ǅ ʰ a\u0301 ١٢ 中文 x中 中1", "\x85 a\x85b", " a", "a ", "foo  bar", "x\ny", "x\n\ny", "end.\n", "hi, there. ok", "don't", "e.g., a.b,", "<|endoftext|> x", "ünï. é", "\t t", "3.5, 4,", "A,", "...", "!!, a!!,", "a\x01b", ",a", "\n", "a.\nb,c\n d", "x y ,z"]
    ids, off = enc(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_encoder_random():
    """Random joins of awkward parts, the cache cleared now and then, against the untouched tokenizer."""
    import pyarrow as pa

    enc, plain = token_store.Encoder(token_store.tokenizer_path()), Tokenizer.from_file(token_store.tokenizer_path())
    rng = random.Random(5)
    parts = ["word", " ", "  ", "\n", ",", ".", "'s", "'", "12", "é", "中", "x1", "\t", "-", "\u00a0", "<|endoftext|>", "$", "ʼ", "\r\n", "Ab", "\x01", "'LL", "\u2028", "٣"]
    for _ in range(30):
        texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(100)]
        ids, off = enc(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[off[i] : off[i + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids, t
        if rng.random() < 0.2:
            enc.clear()


def test_line_dedup(spark, odd, none):
    texts = ["alpha beta gamma\nshort\nalpha beta gamma", "alpha beta gamna\nother line here", "alpha beta gaxxa\nshort", "alpha beta gamm\n\nother  line here", None]
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark, docs(spark, texts)).collect()}
    assert [got[i].n_removed for i in range(5)] == [1, 1, 1, 2, 0]
    assert got[0].text == "alpha beta gamma\nshort" and got[3].text == "" and got[4].text is None
    assert line_dedup.line_dedup(spark, odd).count() == len(ODD) + 1
    assert line_dedup.line_dedup(spark, none).count() == 0


def test_line_dedup_layout(spark, tmp_path):
    """The plan made under one split of the input, the result read under another; with unique and with repeated doc_ids."""
    texts = [f"{sentence(i % 40, 6)}\n{sentence(100 + i, 6)}\n{sentence(i % 40, 5)}x" for i in range(400)]
    for k, rows in enumerate((docs(spark, texts), docs(spark, texts).withColumn("doc_id", F.col("doc_id") % 150))):
        rows.repartition(12).write.parquet(path := f"{tmp_path}/{k}")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        try:
            want = Counter(map(tuple, line_dedup.line_dedup(spark, spark.read.parquet(path)).collect()))
            spark.conf.set("spark.sql.files.minPartitionNum", "8")
            planned = line_dedup.line_dedup(spark, spark.read.parquet(path))
            spark.conf.set("spark.sql.files.minPartitionNum", "3")
            got = Counter(map(tuple, planned.collect()))
        finally:
            spark.conf.unset("spark.sql.files.minPartitionNum")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert sum(r[3] for r in got.elements()) == 360 + 360 and (k or got == want)


def test_line_dedup_brute_force(spark):
    rng = random.Random(7)
    seeds = ["aabbaabbaa", "abababababab", "ääßß€€öö", "line with words", "aaaaaaaaaaaa"]

    def edited(s):
        i, c = rng.randrange(len(s)), rng.choice("ab€")
        return rng.choice([s, s[:i] + s[i + 1 :], s[:i] + c + s[i + 1 :], s[:i] + c + s[i:]])

    texts = ["\n".join(edited(edited(rng.choice(seeds))) for _ in range(rng.randrange(1, 5))) for _ in range(120)]
    texts += ["\n".join("".join(rng.choices("abc", k=rng.randrange(1, 7))) for _ in range(3)) for _ in range(40)]

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    for least in (line_dedup.MIN, 0):
        seen, want = [], {}
        for i, t in enumerate(texts):
            keep = []
            for s in t.split("\n"):
                x = s.strip(" ")
                if not any(x == y or min(len(x), len(y)) >= least and near(x, y) for y in seen):
                    keep.append(s)
                seen.append(x)
            want[i] = "\n".join(keep)
        got = {r.doc_id: r.text for r in line_dedup.line_dedup(spark, docs(spark, texts), least).collect()}
        assert got == want and len({*want.values()}) > 20


def test_language_id(spark, odd, none):
    words = {"en": ["the", "of", "thing", "with"], "de": ["der", "schön", "nicht", "über"], "fr": ["le", "été", "que", "aux"]}
    rng = random.Random(1)
    langs = {i: rng.choice(list(words)) for i in range(300)}
    d = docs(spark, [" ".join(rng.choices(words[langs[i]], k=20)) for i in range(300)], langs)
    got = language_id.language_id(spark, d, d).collect()
    assert all(r.lang_pred == langs[r.doc_id] and 0 <= r.score <= 1 for r in got)
    out = language_id.language_id(spark, odd, d).collect()
    assert len(out) == len(ODD) + 1 and {r.lang_pred for r in out if r.doc_id in (0, 1, 2, 3)} == {"und"}
    assert {r.lang_pred for r in language_id.language_id(spark, odd, odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.language_id(spark, none, d).count() == 0
    kept = language_id.with_language(spark, odd.union(d))
    assert kept.columns == odd.columns and not {0, 1, 2, 3} & {r.doc_id for r in kept.filter("text is null or length(text) < 6").collect() if r.text in ODD[:4]}


def test_language_stage_unlearned(spark, odd, none):
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    kept = language_id.with_language(spark, unlabelled)
    assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.collect()) == Counter([None, 5, 6, 7, 8, 8, 9])
    assert language_id.with_language(spark, none).count() == 0


def test_language_many(spark):
    words = {f"l{i:02}": [sentence(5000 + 10 * i + j, 1).translate(str.maketrans("0123456789", "abcdefghij")) for j in range(6)] for i in range(70)}
    rng = random.Random(2)
    langs = {i: sorted(words)[i % 70] for i in range(840)}
    d = docs(spark, [" ".join(rng.choices(words[langs[i]], k=15)) for i in range(840)], langs)
    got = language_id.language_id(spark, d, d).collect()
    last = [r for r in got if langs[r.doc_id] >= "l64"]
    assert len(last) == 72 and sum(r.lang_pred == langs[r.doc_id] for r in last) >= 70
    assert sum(r.lang_pred == langs[r.doc_id] for r in got) >= 820


def test_license_scan(spark, odd, none):
    texts = ["x CC-BY y. All rights\nreserved", "Licensed under the GNU general PUBLIC license", "Released under the MIT License.", "Permission is hereby granted free of charge to any other person obtaining a copy of this software and associated documentation files", "cc  by cc by", "rights reserved all"]
    got = {r.doc_id: r for r in license_scan.license_scan(spark, docs(spark, texts)).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (2, 1, 4, "cc-by,reserved")
    assert got[1].labels == "gpl" and got[2].labels == "mit" and got[2].n_base == 0 and got[2].base_labels == ""
    assert got[3].labels == "mit" and got[4].n_base == 2 and got[5].labels == "" and got[5].first_word is None
    assert license_scan.license_scan(spark, odd).count() == len(ODD) + 1
    assert license_scan.license_scan(spark, none).count() == 0


def test_license_scan_brute_force(spark):
    rng = random.Random(11)
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    parts = ["CC", "by", "cc-BY", "All", "rights", "Reserved.", "general", "public", "license", "é", "x\n", "ALL RIGHTS RESERVED", "\u2028", "-", "general  public\tLicense"]
    texts = [" ".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(200)]
    got = {r.doc_id: r for r in license_scan.license_scan(spark, docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        words = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        hits = [(at, name) for p, name in phrases.items() for at in range(len(words)) if words[at : at + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(hits), ",".join(sorted({n for _, n in hits})))
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert {n for _, n in hits} <= set(r.labels.split(","))


def test_near_dedup(spark, odd, none):
    base = [sentence(i, 120) for i in range(12)]
    texts = []
    for i, t in enumerate(base):
        w = t.split()
        texts += [t, t, " ".join(w[:-4]), " ".join(w[: 40 + i * 5] + [f"new{i}"] + w[41 + i * 5 :]), " ".join(w[:60] + sentence(100 + i, 60).split())]
    out, links = near_dedup.near_classes(spark, docs(spark, texts))
    got = {r.doc_id: r.class_id for r in out.collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    label = list(range(len(texts)))
    find = lambda i: i if label[i] == i else find(label[i])
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in range(len(texts))}
    kept = near_dedup.near_dedup(spark, odd)
    assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.collect()) == Counter([0, 2, None, 5, 6, 7, 8, 3])
    assert near_dedup.near_dedup(spark, none).count() == 0


def weighted_classes(texts):
    """Components of weighted Jaccard similarity 0.8 or more over all pairs, in plain Python."""
    bags = [Counter(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for t in texts]
    df, n = Counter(s for b in bags for s in b), len(texts)
    weigh = lambda s: 1 + near_dedup.DAMP / math.log(1 / near_dedup.RARE) * math.log(min(n / df[s], 1 / near_dedup.RARE))
    bags = [{s: c * weigh(s) for s, c in b.items()} for b in bags]
    total, label = [sum(b.values()) for b in bags], list(range(n))

    def find(i):
        return i if label[i] == i else find(label[i])

    for i in range(n):
        for j in range(i):
            both = sum(min(w, bags[j].get(s, 0)) for s, w in bags[i].items())
            if both / (total[i] + total[j] - both) >= 0.8:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(n)}


def test_near_dedup_wide(spark, monkeypatch):
    """A loose group: most pairs 0.5 to 0.9 alike, in buckets of many documents, with repeated shingles."""
    monkeypatch.setattr(near_dedup, "WIDE", 4)
    rng, passage = random.Random(4), sentence(900, 100).split()
    texts = [" ".join(passage[: rng.randrange(80, 100)] + sentence(9000 + i, rng.randrange(2, 30)).split() + passage[:6] * rng.randrange(2)) for i in range(140)]
    want = weighted_classes(texts)
    out, _ = near_dedup.near_classes(spark, docs(spark, texts))
    got = {r.doc_id: r.class_id for r in out.collect()}
    assert got == want and 20 < len({*want.values()}) < 130


def test_near_dedup_wide_rows(spark, monkeypatch):
    """The fine keys of a loose group make no rows of their own; buckets too wide for one task give the same classes."""
    rows, saved = Counter(), near_dedup.saved

    def counted(session, df, what):
        out = saved(session, df, what)
        rows[what] += out.count()
        return out

    monkeypatch.setattr(near_dedup, "saved", counted)
    monkeypatch.setattr(near_dedup, "WIDE", 4)
    rng, passage = random.Random(4), sentence(900, 100).split()
    texts = [" ".join(passage[: rng.randrange(80, 100)] + sentence(9000 + i, rng.randrange(2, 30)).split()) for i in range(140)]
    want = weighted_classes(texts)
    out, _ = near_dedup.near_classes(spark, docs(spark, texts))
    assert {r.doc_id: r.class_id for r in out.collect()} == want and rows["finer"] > 20 and not rows["fine"]
    monkeypatch.setattr(near_dedup, "_ALONE", 3)
    out, _ = near_dedup.near_classes(spark, docs(spark, texts))
    assert {r.doc_id: r.class_id for r in out.collect()} == want and rows["fine"]


def test_components(spark, monkeypatch):
    """Few edges are joined by the driver and written once; more are joined in Spark with the same labels."""
    made, saved = [], common.saved
    monkeypatch.setattr(common, "saved", lambda session, df, what: made.append(what) or saved(session, df, what))
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)] + [(900, 7), (900, 8), (-3, 8), (2**60, 2**60 + 1)]
    label = {x: x for e in edges for x in e}
    while any(label[a] != label[b] for a, b in edges):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    table = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.label for r in common.components(spark, table).collect()} == label and made == ["labels"]
    assert {r.node: r.label for r in common.components(spark, table, 3).collect()} == label and len(made) > 3
    assert common.components(spark, table.limit(0)).count() == 0


def test_near_dedup_ids(spark):
    a, b, c, d = (sentence(7000 + i, 80) for i in range(4))
    near = " ".join(a.split()[:-3])
    texts = [(1, a), (7, near), (7, b), (7, c), (7, c), (3, b), (9, c), (9, d)]
    ids = spark.createDataFrame(texts, "doc_id long, text string")
    kept = [tuple(r) for r in near_dedup.near_dedup(spark, ids).collect()]
    assert sorted(kept) == sorted([(1, a), (3, b), (7, c), (9, d)])
    out, _ = near_dedup.near_classes(spark, ids)
    assert Counter((r.doc_id, r.class_id) for r in out.collect()) == Counter([(1, 1), (7, 1), (7, 3), (7, 7), (7, 7), (3, 3), (9, 7), (9, 9)])


def test_preferences(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, 2, "user", None), (2, 0, "user", "x"), (None, 0, "user", "y"), (3, None, "user", "z")]
    rej = [(1, 0, "user", "hi"), (1, 1, "assistant", "b"), (4, 0, "assistant", "only")]
    schema = "pair_id long, turn long, role string, text string"
    got = {r.pair_id: r for r in preferences.preference_pairs(spark.createDataFrame(rows, schema), spark.createDataFrame(rej, schema)).collect()}
    assert set(got) == {1, 2, 4}
    assert got[1].prompt == "<|user|>\nhi\n" and got[1].chosen == "<|assistant|>\na\n<|user|>\n\n" and got[1].rejected == "<|assistant|>\nb\n"
    assert [(m["from"], m["to"]) for m in got[1].chosen_mask] == [(0, 16)] and got[2].prompt == "" and got[4].chosen == ""


def test_mixing(spark, odd, none):
    rng = random.Random(2)
    sources = {i: ["a", "b", None, "c", "hot"][min(4, i % 7)] for i in range(600)}
    d = docs(spark, [sentence(i, rng.randrange(5, 80)) for i in range(600)], sources=sources)
    rows = mixing.mix(spark, d).collect()
    again = {r.doc_id: r.times for r in mixing.mix(spark, d).collect()}
    assert {r.doc_id: r.times for r in rows} == again
    size, taken, goal = Counter(), Counter(), {}
    for r in rows:
        size[r.source] += r.size
        taken[r.source] += r.size * r.times
        goal[r.source] = r.target
        assert 0 <= r.times <= 2
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    cap, want, left = {s: 2.0 * size[s] for s in size}, {}, 1.5 * sum(size.values())
    while True:
        free = [s for s in size if s not in want]
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > cap[s]]
        if not over:
            break
        for s in over:
            want[s] = cap[s]
        left = 1.5 * sum(size.values()) - sum(want.values())
    want |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    for s in size:
        assert goal[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 170
    assert mixing.mixed(spark, odd).columns == odd.columns
    assert mixing.mixed(spark, none).count() == 0


def test_cube():
    rng = np.random.default_rng(0)
    for _ in range(5):
        size, p = rng.integers(1, 50, 200).astype(float), np.full(200, rng.random())
        out = mixing.flight(size, p, rng)
        assert ((out > 0) & (out < 1)).sum() <= 2 and abs((out * size).sum() - (p * size).sum()) < 1e-6 and abs(out.sum() - p.sum()) < 1e-6


def test_ann(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000 + i, [1.0] * 16) for i in range(30)]
    rows += [(9000, None), (9100, [0.0] * 16), (9200, [float("nan")] + [0.0] * 15), (9300, [None] + [1.0] * 15), (9400, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("part", F.lit(1))
    got = {}
    for r in ann.nearest(spark, table, table.filter("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids = np.array([r[0] for r in rows[:3030]])
    full = np.array([np.float32(r[1]) for r in rows[:3030]], np.float64)
    hit = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((full - full[ids == q][0]) ** 2).sum(1))
        want = [i for i in ids[np.lexsort((ids, d))] if i != q][:10]
        mine = [v for _, v, _ in sorted(got[q])]
        assert len(mine) == 10
        hit += len(set(want) & set(mine))
        if q == 5000:
            assert mine == list(range(5001, 5011))
    assert hit / (10 * len(got)) >= 0.9 and set(got) == set(ids[ids % 100 == 0].tolist())
    few = ann.nearest(spark, table.filter("vec_id < 4"), table.filter("vec_id = 0")).collect()
    assert len(few) == 3
    assert ann.nearest(spark, table.filter("vec_id < 0"), table.filter("vec_id < 0")).count() == 0


def test_decontaminate(spark, odd, none):
    items = [sentence(1000 + i, 30) for i in range(4)] + ["two words", None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    w = items[1].split()
    texts = [f"{sentence(1)} {items[0]} {sentence(2)}", " ".join(w[15:] + ["zz"] + w[:15]), " ".join(w[:12]), sentence(3), "has two words", None, "no id"]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(spark, docs(spark, texts), bench).collect()}
    assert set(got) == {(0, 0), (1, 1), (4, 4)} and got[1, 1].n_tiles == 2
    kept = decontaminate.decontaminate(spark, docs(spark, texts), bench)
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 2), (False, 3), (False, 5), (True, None)]
    assert decontaminate.decontaminate(spark, odd, bench).count() == len(ODD) + 1 and decontaminate.decontaminate(spark, none, bench).count() == 0


def test_null_ids(spark):
    item, other = sentence(8000, 30), sentence(8001, 60)
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    d = spark.createDataFrame([(None, f"{sentence(1)} {item}"), (None, other), (None, other), (1, sentence(2)), (2, item), (None, None)], "doc_id long, text string")
    kept = decontaminate.decontaminate(spark, d, bench)
    assert kept.columns == d.columns and Counter(map(tuple, kept.collect())) == Counter([(None, other), (None, other), (1, sentence(2)), (None, None)])
    deduped = near_dedup.near_dedup(spark, kept.unionByName(spark.createDataFrame([(3, other)], d.schema)))
    assert Counter(map(tuple, deduped.collect())) == Counter([(3, other), (1, sentence(2)), (None, None)])


def naive_tiles(item, text, k):
    """Greedy string tiling by the definition: the longest match of unmarked words, first in item, then in text, again and again."""
    in_item, in_text, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(text)):
                n = 0
                while i + n < len(item) and d + n < len(text) and item[i + n] == text[d + n] and i + n not in in_item and d + n not in in_text:
                    n += 1
                best = max(best, (n, -i, -d))
        n, i, d = best[0], -best[1], -best[2]
        if n < k:
            return out
        out.append((i, d, n))
        in_item.update(range(i, i + n))
        in_text.update(range(d, d + n))


def test_decontaminate_brute_force(spark):
    rng = random.Random(6)
    items = [rng.choices("abcd", k=rng.randrange(6, 14)) for _ in range(6)] + [list("aaaaaaaa"), list("abababab")]
    texts = []
    for _ in range(60):
        parts = [x[a:] for x in items for a in [rng.randrange(6)] if rng.random() < 0.4] + [rng.choices("abcde", k=rng.randrange(8)), ["a"] * rng.randrange(12)]
        rng.shuffle(parts)
        texts.append([w for p in parts for w in p])
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_tiles, r.covered) for r in decontaminate.matches(spark, docs(spark, [" ".join(t) for t in texts]), bench).collect()}
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            tiles = naive_tiles(x, t, decontaminate.K)
            assert got.get((d, i), (0, 0)) == (len(tiles), sum(n for _, _, n in tiles)), (d, i)


def test_tiles():
    assert sorted(decontaminate.tiles([(0, 10, 5), (1, 11, 5), (0, 30, 5)])) == [(0, 10, 6)]
    assert sorted(t[2] for t in decontaminate.tiles([(0, 7, 5), (1, 8, 5), (6, 0, 5), (7, 1, 5)])) == [6, 6]
