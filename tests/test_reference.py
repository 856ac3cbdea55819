import functools
import hashlib
import json
import math
import operator
import re
from datetime import datetime, timezone

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexwave.functions import enrich as E
from lexwave.functions import text as T
from lexwave.operators import backfill as B
from lexwave.operators import calibration as C
from lexwave.operators import inbox as I
from lexwave.operators import ledger as G
from lexwave.operators import lineage as L
from lexwave.operators import receipts as P
from lexwave.operators import simulate as M
from lexwave.operators import vectors as V
from lexwave.plans import catalogue, oracle, records  # noqa: F401
from lexwave.plans.analysis import observed
from lexwave.sources import signals as S
from lexwave.streaming import log as R

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df, cols):
    put = lambda v: None if pd.isna(v) else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(str, (put(v) for v in r))) for r in df[cols].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", ["lineage_best", "neologisms", "typology_scores", "semantic_variation", "forecasts", "ledger_stats", "murphy", "yates_vieira", "chain_tampered", "vector_topk", "stage_feedback", "clean_documents", "scan_plan", "sources_resolved", "typology_tags", "receipt_diff", "receipt_emit", "settle_log", "registry_delta", "stream_settled", "transmission", "vector_neighbors"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    a, b = catalogue.QUERIES[name](spark, SF).toPandas(), con.execute(oracle.SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a, sorted(a.columns)) == rows(b, sorted(a.columns))


def test_published_receipt(spark):
    df = spark.createDataFrame([("hodl diamond hands rekt degen moon",)], "query string").withColumn("raw", S.mock_text(F.col("query"))).withColumn("id", F.lit(1))
    got = L.best(L.candidates(df, "id", F.col("raw"), L.registry(spark)), "id").first()
    assert (got.family_id, got.n_hits, got.confidence) == ("crypto-degen", 6, 0.98)
    assert got.specificity == pytest.approx(0.533, abs=1e-3) and got.coverage == pytest.approx(0.462, abs=1e-3)
    v = df.select(*[c.alias(n) for n, c in T.virality(F.col("raw")).items()]).first()
    assert (v.velocity, v.acceleration) == (0.475, 0.68) and v.hybrid == pytest.approx(0.639, abs=1e-3)


@pytest.mark.parametrize(("text", "want"), [("sigma rizz locked in", ["sigma", "rizz", "locked in"]), ("agentic slop skill issue", ["agentic", "slop", "skill issue"]), ("sharp steam revenge", ["sharp", "steam", "revenge"]), ("locked in crash out", ["locked in", "crash out"]), ("rizz, sigmar", []), ("", []), ("rizz rizz", ["rizz"])])
def test_split(spark, text, want):
    terms, _ = T.split_terms(F.lit(text))
    assert spark.range(1).select(terms.alias("t")).first().t == want


def test_golden_series(spark):
    f = spark.createDataFrame([("a1", "s", 0.8), ("a2", "s", 0.3), ("a3", "s", 0.5), ("void", "s", 0.7), ("open", "s", 0.1)], "forecast_id string, signal_key string, probability double")
    s = spark.createDataFrame([("a1", 1.0, "TRUE"), ("a2", 0.0, "false"), ("a3", 1.0, "TRUE"), ("void", 0.0, "VOID")], "forecast_id string, outcome double, settlement_decision string")
    pairs = C.settled_pairs(f, s)
    got = C.series(pairs, []).first()
    assert got.n == 3 and got.brier == pytest.approx(0.12666666666666668)
    assert got.skill == pytest.approx(0.43) and got.slope == pytest.approx(0.35) and got.bias_squared == pytest.approx(0.0177778, abs=1e-6)
    m = C.murphy(pairs, ["signal_key"]).first()
    assert m.reliability == pytest.approx(0.1266667, abs=1e-6) and m.resolution == pytest.approx(0.2222222, abs=1e-6)
    assert [r.forecast_id for r in C.pending(f, s).collect()] == ["open"]
    assert pairs.filter("forecast_id = 'void'").first().atomic is None


def test_chain(spark):
    log = spark.createDataFrame([("c", i, f"b{i}") for i in range(6)], "chain string, seq int, body string")
    built = G.append_chain(log, "chain", "seq", "body")
    assert G.verify_chain(built, "chain", "seq", "body").first().ok
    edited = built.withColumn("body", F.when(F.col("seq") == 3, "x").otherwise(F.col("body")))
    bad = G.verify_chain(edited, "chain", "seq", "body").first()
    assert (bad.broken_at, bad.reason) == (3, "record_hash mismatch")
    gone = G.verify_chain(built.filter("seq <> 2"), "chain", "seq", "body").first()
    assert (gone.broken_at, gone.reason) == (2, "prev_hash mismatch")


def test_simulations(spark):
    runs = spark.createDataFrame([(1, 0.35, 0.08, 0.5)], "run_id int, beta double, gamma double, hybrid double")
    got = M.transmission(runs).first()
    assert (round(got.final_mean, 4), got.peak, got.time_to_peak) == (0.1912, 0.85, 0)
    assert [a[0] for a in M.population(20, None)].count("mainstream") == 9
    assert M.scenarios(spark).filter("step = 0").count() == 5


def test_embedding():
    a, b, none, missing = V.embeddings(["aura farming", "Aura  farmer!", "", None])
    assert math.isclose(float(a @ a), 1.0) and float(a @ b) > 0.3 and not none.any() and not missing.any()
    # by hand: one word of two letters is itself, two edges and two trigrams
    want = np.zeros(256)
    for token, w in (("yo", 1.0), ("yo#", 0.5), ("#yo", 0.5), ("c3:^yo", 0.35), ("c3:yo$", 0.35)):
        want[hashlib.blake2b(token.encode(), digest_size=8).digest()[0]] += w
    assert V.embeddings(["yo"])[0] == pytest.approx(want / np.sqrt((want**2).sum()))


def test_boosts(spark):
    terms = [("a", "aura farming"), ("a", "aura"), ("b", "skill issue"), ("c", "token")]
    rows = spark.createDataFrame([("aura farmer",), ("skill",), ("",)], "q string")
    got = {(r.q, r.family_id): r.boost for r in V.text_boosts(rows, "q", "q", terms).collect()}
    x, y = V.embeddings(["aura farmer", "skill"]).astype(np.float32).astype(float), V.embeddings([t for _, t in terms]).astype(np.float32).astype(float)
    for q, v in zip(("aura farmer", "skill"), x @ y.T, strict=True):
        mass = {}
        for (f, _), s in zip(terms, v, strict=True):
            if s >= 0.12:
                mass[f] = mass.get(f, 0) + s
        assert {f: b for (k, f), b in got.items() if k == q} == pytest.approx({f: 0.12 * m / max(mass.values()) for f, m in mass.items()})
    assert not any(k == "" for k, _ in got)


def test_settle(spark):
    rows = spark.createDataFrame([(1, 1.0, "true", "t"), (2, 0.5, "TRUE", "t"), (3, 0.0, "maybe", "t"), (4, None, "VOID", "t"), (5, 0.0, "conflict", "t")], "forecast_id long, outcome double, settlement_decision string, settled_at string")
    got = {r.forecast_id: r for r in C.settle(rows).collect()}
    assert got[1].settlement_id == hashlib.sha256(b"1|1.0|TRUE|t").hexdigest()[:16] and got[5].error is None
    assert all(got[i].settlement_id is None and got[i].error for i in (2, 3, 4))


def test_foreign_receipts(spark):
    body = {"b": 1.50, "a": "é", "n": {"y": [1, 2], "x": None}}
    good = body | {"receipt": {"integrity": hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]}}
    rows = spark.createDataFrame([(1, json.dumps(good)), (2, json.dumps(good | {"b": 2})), (3, "{broken"), (4, "[1]"), (5, None)], "id int, t string")
    assert {r.id: r.ok for r in P.verify_foreign(rows, "t").collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}
    records_, prev = [], "0" * 64
    for i in range(5):
        rec = {"schema": "s", "event": "receipt", "logged_at": "t", "prev_hash": prev, "body": {"i": i, "q": "ü"}}
        prev = P.foreign_hash(rec)
        records_.append(rec | {"record_hash": prev})
    log = lambda rs: spark.createDataFrame([("c", i, json.dumps(r)) for i, r in enumerate(rs)], "chain string, seq int, t string")
    assert P.verify_foreign_log(log(records_), "chain", "seq", "t").first().ok
    edited = [*records_[:3], records_[3] | {"body": {}}, records_[4]]
    assert P.verify_foreign_log(log(edited), "chain", "seq", "t").first()[2:] == (False, 3, "record_hash mismatch")
    assert P.verify_foreign_log(log([*records_[:2], *records_[3:]]), "chain", "seq", "t").first()[2:] == (False, 2, "prev_hash mismatch")


def test_inbox(spark, tmp_path):
    rows = spark.createDataFrame([(1, "high"), (2, "low"), (3, None), (4, "critical"), (5, "odd")], "signal_id int, priority string")
    path = f"{tmp_path}/inbox"
    all_ = I.push(rows, path)
    assert [r.signal_id for r in I.listed(all_, "high").collect()] == [4, 1] and I.listed(all_, "odd", 0).count() == 5 and I.listed(all_, limit=2).count() == 2
    assert I.clear(spark, path, dry_run=True) == 5 and I.clear(spark, path) == 5 and I.clear(spark, path) == 0


def test_stream_late_rows(spark, tmp_path):
    """A row that comes after the watermark passed its window is dropped; one within it counts."""
    at = lambda s: f"2026-01-01 {s}"
    for i, rows in enumerate(([("10:05", 1.0), ("10:10", 1.0)], [("18:00", 1.0)], [("10:20", 1.0), ("17:30", 1.0)])):
        spark.createDataFrame([(at(t), v) for t, v in rows], "t string, v double").selectExpr("CAST(t AS timestamp) AS at", "'k' AS k", "v").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = R.windows(R.log_stream(spark, f"{tmp_path}/in", 1), "at", "1 hour", "2 hours", "k", "v", f"{tmp_path}/state")
    got = {r.window_start.strftime("%H:%M"): (r.n, r.total) for r in out.collect()}
    assert got == {"10:00": (2, 2.0), "18:00": (1, 1.0), "17:00": (1, 1.0)}


def test_enrich(spark):
    rows = spark.createDataFrame([('noise {"candidates":[{"term":"Rizz","confidence":0.99},{"term":"newword","confidence":0.99},{"term":" "}]} tail',), ("no json",)], "raw string")
    found = F.array(F.struct(F.lit("rizz").alias("term"), F.lit("f").alias("formation"), F.lit(0.7).alias("confidence")))
    got = [[(t.term, t.confidence) for t in r.m] for r in rows.select(E.enriched(found, F.col("raw")).alias("m")).collect()]
    assert got == [[("rizz", 0.7), ("newword", 0.85)], [("rizz", 0.7)]]
    echo = rows.select(E.parsed(E.echo(F.lit("this mock channel has memes and memes-again okay"))).alias("c")).first().c
    assert [c.term for c in echo] == ["memes", "memes-again", "okay"]


def test_readers(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"seq": 1}\n\n{broken\n{"seq": 2}\n')
    assert sorted(r.seq for r in S.read_log(spark, f"{tmp_path}/log.jsonl", "seq int").filter("seq IS NOT NULL").collect()) == [1, 2]
    for month in (1, 2):
        (tmp_path / f"p{month}.json").write_text(json.dumps({"year": 2026, "month": month, "label": f"2026-0{month}", "terms": [{"term": f"t{month}", "family_id": "f"}]}))
    paths = f"{tmp_path}/p*.json"
    assert S.read_packs(spark, paths).count() == 2 and [r.term for r in S.read_packs(spark, paths, (2026, 1)).collect()] == ["t1"]
    (tmp_path / "d.json").write_text(json.dumps({"domain_id": "fin", "roots": [{"id": "r"}], "trunks": [{"id": "t", "family_id": "f"}], "leaves": [{"term": "x", "family_id": "f"}], "cross_edges": [{"from": "x", "to": "y", "operator": "o"}]}))
    packs = spark.read.schema(B.DOMAIN).option("multiLine", True).json(f"{tmp_path}/d.json")
    assert tuple(B.domain_sizes(packs).first()) == ("fin", 1, 1, 1, 1) and {tuple(r)[1:] for r in B.domain_edges(packs).collect()} == {("t", "x", "branch"), ("x", "y", "o")}


def test_scenarios(spark):
    rows = M.ranked(M.scenarios(spark)).orderBy("rank").collect()
    assert [r.final_rate for r in rows] == sorted((r.final_rate for r in rows), reverse=True) and all(not r.cascade or r.final_rate >= 0.5 for r in rows)
    roles = M.scenarios(spark).filter("step = 0").collect()
    assert all(sum(r.by_role.values()) == r.n_adopted for r in roles)


def test_clean_documents_whole(spark, tmp_path):
    text = "word " * 100 + "pivotal  end"
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.observed for r in catalogue.QUERIES["clean_documents"](spark, str(tmp_path)).collect()}
    assert got == {1: "word " * 100 + "end", 2: None}
    assert observed(spark, SF).agg(F.max(F.length("observed"))).first()[0] <= 280


@pytest.mark.parametrize(("name", "least", "k", "label"), [("topk", 0.15, 10, None), ("filtered", 0.05, 10, 3), ("family_boost", 0.12, 8, None)])
def test_vector_queries_all(spark, name, least, k, label):
    table = pd.read_parquet("/root/testdata/sf0.01/embeddings.parquet").sort_values("vec_id")
    x = np.stack(list(table.embedding)).astype(float)
    want = {}
    for q in table.vec_id[table.vec_id % 100 == 0]:
        score = x @ x[list(table.vec_id).index(q)]
        found = sorted((-s, i, c) for s, i, c in zip(score, table.vec_id, table.label, strict=True) if s >= least and label in (None, c))[:k]
        if name == "family_boost":
            sums = {c: sum(-s for s, _, d in found if c == d) for _, _, c in found}
            want |= {(q, c): 0.12 * s / max(sums.values()) for c, s in sums.items()}
        else:
            want |= {(q, rank, i): -s for rank, (s, i, _) in enumerate(found, 1)}
    got = catalogue.QUERIES[f"vector_{name}_all"](spark, "/root/testdata/sf0.01").collect()
    keys = {(r.query_id, r.label): r.boost for r in got} if name == "family_boost" else {(r.query_id, r.rank, r.vec_id): r.score for r in got}
    assert len(got) == len(want) and len({r.query_id for r in got}) > 1 and keys == pytest.approx(want, abs=2e-6)


def rows_of_joins(df):
    """Rows that the joins of the plan make in all, when it runs."""
    df.collect()

    def count(p):
        inner = [getattr(p, name)() for name in ("executedPlan", "plan") if name in dir(p)]
        rows = p.metrics().get("numOutputRows") if re.search("Join|Cartesian", p.nodeName()) else None
        children = p.children()
        return (rows.get().value() if rows is not None and rows.isDefined() else 0) + sum(map(count, inner or [children.apply(i) for i in range(children.size())]))

    return count(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("name", ["vector_family_boost_all", "vector_topk_all"])
def test_vector_searches_without_pairs(spark, name):
    table = pd.read_parquet("/root/testdata/sf0.1/embeddings.parquet")
    queries = (table.vec_id % 100 == 0).sum()
    assert queries > 10 and 0 < rows_of_joins(catalogue.QUERIES[name](spark, "/root/testdata/sf0.1")) <= 2 * (len(table) + queries)


def test_top_k_each_in_blocks(spark, monkeypatch):
    """Many blocks, copies on both sides, null, short, empty and non-finite vectors, a null id, other columns: as plain Python finds them."""
    monkeypatch.setattr(V, "QUERY_BLOCK", 5)
    monkeypatch.setattr(V, "LEAST_ROWS", 20)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.float32(rng.integers(-2, 3, 3) / 3)], i % 4) for i in range(200)]
    rows += [(1000, None, 1), (1001, [], 1), (1100, [1.0, None, 0.0], 1), (1101, [0.5], 1), (1200, [math.nan, 1.0, 0.0], None), (1201, [math.inf, 1.0, 1.0], 2), (None, [1.0, 0.0, 0.0], 3)]
    rows = [(i, v, label, datetime(2026, 1, 1, tzinfo=timezone.utc), {"n": str(i)}) for i, v, label in rows]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, at timestamp, meta map<string,string>").repartition(3)
    asked = table.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    want = []
    for q, x in [(i, v) for i, v, *_ in rows if i is not None and i % 20 == 0 and v is not None]:
        score = [(functools.reduce(operator.add, (a * b for a, b in zip(x, y, strict=True)), 0.0), i) for i, y, *_ in rows if y is not None and len(x) == len(y) and None not in (*x, *y)]
        found = sorted((not math.isnan(s), -s if s == s else 0, -1 if i is None else i, s) for s, i in score if not s < 0.15)[:7]
        want += [(q, rank, None if i == -1 else i, str(s + 0.0)) for rank, (_, _, i, s) in enumerate(found, 1)]
    got = V.top_k_each(table, asked, 7)
    assert got.columns == ["vec_id", "label", "at", "meta", "query_id", "score", "rank"]
    assert sorted(map(str, want)) == sorted(str((r.query_id, r["rank"], r.vec_id, str(r.score))) for r in got.collect()) and all(r.meta == {"n": str(r.vec_id)} for r in got.collect())


@pytest.mark.parametrize(("rows", "kinds", "k"), [(900, 900, 10), (900, 7, 10), (900, 40, 3), (5, 5, 10), (300, 300, 299)])
def test_best_rows(monkeypatch, rows, kinds, k):
    """The products' tiles against sums in order, to the last bit."""
    monkeypatch.setattr(V, "TILE", (16, 128))
    rng = np.random.default_rng(rows + kinds)
    y = rng.normal(size=(kinds, 24)).astype(np.float32).astype(float)[rng.integers(0, kinds, rows)] / 5
    y[::50, 3] = np.resize([1e200, np.inf, np.nan, -0.0], len(y[::50]))
    x = y[:40]
    want = []
    for i in range(len(x)):
        score = np.zeros(rows)
        with np.errstate(all="ignore"):
            for c in range(24):
                score = score + x[i, c] * y[:, c]
        kept = np.flatnonzero(~(score < 0.1))
        want += [(i, j, str(score[j])) for j in kept[np.lexsort((kept, -score[kept], ~np.isnan(score[kept])))][:k]]
    assert [(i, j, str(s)) for i, j, s in zip(*V.best_rows(x, y, k, 0.1), strict=True)] == want


def test_verbs():
    from lexwave.api import VERBS

    assert len(VERBS) > 40 and all(callable(f) for f in VERBS.values())
