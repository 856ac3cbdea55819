"""Queries over receipts, ledgers, settlements, packs, inbox, archive and source reads; they join the catalogue's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
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
from lexwave.plans import catalogue as K
from lexwave.plans.analysis import analysed, analysed_queries, by_query, distinct_observed
from lexwave.plans.catalogue import query, r6
from lexwave.sources import catalog as A
from lexwave.sources import lexicon as X
from lexwave.sources import signals as S
from lexwave.sources import store


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# reads


@query
def sources_resolved(spark, sf_dir):
    """Every event asks for a source by some name, each fourth user by a route."""
    names, routes = [*sorted(A.ALIASES), "nowhere"], [*A.ROUTES, "moon"]
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(n, F.lit(len(xs))) + 1).cast("int"))
    rows = _table(spark, sf_dir, "events").select("event_id", pick(names, F.col("event_id")).alias("source"), F.when(F.col("user_id") % 4 == 0, pick(routes, F.col("event_id"))).alias("route"))
    return rows.withColumns(A.resolved(F.col("source"), F.col("route"))).withColumn("offline", A.resolved(F.col("source"), F.col("route"), True)["resolved"])


@query
def sources_list(spark, sf_dir):
    return A.listed(spark).select("name", "kind", "network", F.array_join("aliases", ",").alias("aliases"))


@query
def extracted_terms(spark, sf_dir):
    rows = distinct_observed(spark, sf_dir).select("query", F.array_join(S.extracted_terms(F.col("raw")), ",").alias("terms"))
    return by_query(spark, sf_dir, rows).select("signal_id", "terms")


@query
def glossary_signals(spark, sf_dir):
    q = F.col("query")
    parts = [S.filled(X.GLOSSARIES[0], q), S.filled(X.GLOSSARIES[2], q), F.lit(None).cast("string"), F.lit(None).cast("string"), S.filled(X.SOCIAL_STUB, q), F.lit(None).cast("string")]
    return S.signals(spark, sf_dir).select("signal_id", S.glossaries(q).alias("glossaries"), S.combined(parts).alias("combined"))


@query
def glossary_pages(spark, sf_dir):
    terms = S.glossary_terms(F.col("html"))
    return _table(spark, sf_dir, "pages").select("page_id", F.size(terms).alias("n_terms"), F.array_join(F.slice(terms, 1, 8), ", ").alias("terms"))


@query
def scan_list(spark, sf_dir):
    rows = S.signals(spark, sf_dir).select("query", F.col("signal_id").alias("pos"))
    return S.scan_queries(rows, "query", "pos")


@query
def enriched_neologisms(spark, sf_dir):
    """Neologisms with the echo provider's candidates."""
    rows = distinct_observed(spark, sf_dir).withColumn("found", T.neologisms(F.col("observed"))).withColumn("merged", E.enriched(F.col("found"), E.echo(F.col("observed"))))
    new = F.transform(F.filter("merged", lambda t: t["formation"] == "llm_echo"), lambda t: t["term"])
    return by_query(spark, sf_dir, rows).select("signal_id", F.size("merged").alias("n"), F.array_join(new, ",").alias("added"))


# reports of signals


@query
def typology_tags(spark, sf_dir):
    tags = T.typology_tags(F.col("typology"), F.col("type_scores"), F.col("family"), F.col("drivers"), F.col("stage"))
    return analysed(spark, sf_dir).select("signal_id", F.array_join(tags, ",").alias("tags"))


@query
def propagation_vector(spark, sf_dir):
    return analysed(spark, sf_dir).select("signal_id", F.array_join(T.propagation(F.col("family"), F.col("community"), F.lit("mock")), ",").alias("platforms"))


@query
def signal_report(spark, sf_dir):
    """What a report is put together from: header, tags, platforms and hints."""
    tags = T.typology_tags(F.col("typology"), F.col("type_scores"), F.col("family"), F.col("drivers"), F.col("stage"))
    header = T.integrity_header(F.lit("mock"), F.col("stage"))
    hints = T.action_hints(F.col("tier"), F.col("stage"))
    return analysed(spark, sf_dir).select("signal_id", "observed", *[c.alias(n) for n, c in header.items()], F.size(tags).alias("n_tags"), F.array_join(hints, " ").alias("hints"))


@query
def primary_term(spark, sf_dir):
    """The term of a query with the best lineage of its own, the first of equal ones; without any, the first term."""
    terms = K.per_term_lineage(spark, sf_dir).select("term", "confidence")
    rows = distinct_observed(spark, sf_dir).select("query", F.posexplode(F.array_distinct(T.split_matched(F.col("query")))).alias("pos", "term"))
    best = rows.join(F.broadcast(terms), "term", "left").groupBy("query").agg(F.max_by("term", F.struct(F.coalesce("confidence", F.lit(-1.0)), -F.col("pos"))).alias("primary_term"), F.count(F.lit(1)).alias("n_terms"))
    return by_query(spark, sf_dir, best).select("signal_id", "primary_term", "n_terms")


@query
def scan_queries(spark, sf_dir):
    rows = analysed(spark, sf_dir).withColumn("most", T.policy(F.col("tier"))["max_queries"])
    return rows.select("signal_id", "tier", F.array_join(T.planned_queries(F.col("query"), F.col("most")), ",").alias("queries"))


@query
def scan_recommended(spark, sf_dir):
    """The tier that a finished scan recommends, by its share of lineages and its families."""
    g = analysed(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("family").isNotNull().cast("double")).alias("c"), F.countDistinct("family").alias("families"))
    return g.select("event_type", "n", T.half_up(F.col("c"), 3).alias("coverage"), "families", F.when((F.col("c") >= 0.85) & (F.col("families") >= 4), "ELEVATED").when(F.col("c") >= 0.5, "MODERATE").otherwise("LOW").alias("tier"))


@query
def relay_envelopes(spark, sf_dir):
    """Scan, signal and attractor envelopes with their claims."""
    scan, signal, attractor, _, _ = X.RUNES
    claims = lambda *pairs: F.concat_ws("|", *[F.concat(F.lit(f"{s}:"), v) for s, v in pairs])
    none, inferred, speculative = F.lit("NOT_COMPUTABLE"), F.lit("INFERRED"), F.lit("SPECULATIVE")
    put = lambda rune, c: F.struct(F.lit(rune).alias("rune_id"), F.lit(X.RUNES[rune]).alias("role"), c.alias("claims"))
    rows = F.array(
        put(scan, claims(("scan_completed", F.lit("OBSERVED")), ("lineage_match", F.when(F.col("family").isNotNull(), inferred).otherwise(none)), ("brier", none))),
        put(signal, claims(("virality_boost", inferred), ("hyperstition_risk", speculative), ("actionable", inferred))),
        F.when(F.col("stage").isin("ACTUALIZING", "EMERGENT"), put(attractor, claims(("attractor_candidate", speculative), ("hyperstition_stage", inferred), ("brier", none)))),
    )
    return analysed(spark, sf_dir).select("signal_id", "fingerprint_id", F.inline(F.filter(rows, lambda x: x.isNotNull()))).select("signal_id", "rune_id", "role", "claims", F.substring(F.sha2(F.concat_ws("|", "rune_id", "fingerprint_id", "claims"), 256), 1, 20).alias("envelope_id"))


@query
def relay_series(spark, sf_dir):
    """The calibration envelope of each series: scored ones are the operator's and observed."""
    rune = "RUNE.HLX.CALIBRATION_SERIES"
    scored = F.col("status") == "SCORED"
    return K._by_signal(spark, sf_dir).select("signal_key", F.lit(rune).alias("rune_id"), F.lit(X.RUNES[rune]).alias("role"), F.when(scored, "operator").otherwise("advisory").alias("authority"), F.concat(F.lit("series_brier:"), F.when(scored, "OBSERVED").otherwise("NOT_COMPUTABLE"), F.lit("|n:"), F.when(F.col("n") > 0, "OBSERVED").otherwise("NOT_COMPUTABLE")).alias("claims"))


# lineage with other registries and with vectors


@query
def lineage_override(spark, sf_dir):
    """A registry of the caller's own: frequent words of the corpus, in families."""
    own = [("function", ["that", "with", "from"]), ("noun", ["thing", "tion", "thor"]), ("phrase", ["of the", "in the", "que la"])]
    rows = [(i, f, "override", j, t, X.weight(t), len(ts)) for i, (f, ts) in enumerate(own) for j, t in enumerate(ts)]
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return L.best(L.candidates(docs, "doc_id", F.col("text"), spark.createDataFrame(rows, L.FAMILY_TERMS), min_confidence=0.45), "doc_id").select("doc_id", "family_id", "n_hits", "confidence", "matched")


@query
def hybrid_lineage(spark, sf_dir):
    """Lineage with boosts from the terms nearest to the text by hashed embedding."""
    rows = distinct_observed(spark, sf_dir).select("query", "observed", F.lower("observed").alias("low"))
    boosts = V.text_boosts(rows, "query", "low", [(f, t) for f, _, ts in X.FAMILIES for t in ts])
    found = L.hybrid_best(L.candidates(rows, "query", F.col("observed"), L.registry(spark), boosts), "query")
    return by_query(spark, sf_dir, found.select("query", "family_id", "confidence", r6("boost", "boost"), "hybrid", "lexical_family", "flipped")).drop("query", "user_id", "event_type", "ts")


# packs


def packs(spark, sf_dir) -> DataFrame:
    """Packs made of parts: a month by key, brands and parts of names as terms, some alike but for case, some already known."""
    terms = F.array(*map(F.lit, X.terms()))
    month = F.lpad((F.col("p_partkey") % 8 + 1).cast("string"), 2, "0")
    term = F.when(F.col("p_partkey") % 5 == 0, F.element_at(terms, (F.col("p_partkey") % len(X.terms()) + 1).cast("int"))).when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.lower("p_brand"))
    families = F.array(*[F.lit(f) for f, _, _ in X.FAMILIES], F.lit(None).cast("string"))
    label = F.concat(F.lit("2026-"), month)
    return _table(spark, sf_dir, "part").select(
        (F.col("p_partkey") % 8 * 1000000000 + F.col("p_partkey")).alias("pos"), F.lit(2026).alias("year"), (F.col("p_partkey") % 8 + 1).cast("int").alias("month"), label.alias("label"), term.alias("term"), F.get(families, (F.col("p_size") % 9).cast("int")).alias("family_id"),
        F.lit(None).cast("string").alias("first_seen_month"), F.when(F.col("p_size") % 4 != 0, F.element_at(F.array(*map(F.lit, ["high", "medium", "low"])), (F.col("p_size") % 3 + 1).cast("int"))).alias("prominence"), F.when(F.col("p_partkey") % 2 == 0, "OBSERVED").alias("provenance"),
    )


@query
def backfill_inventory(spark, sf_dir):
    return B.inventory(packs(spark, sf_dir))


@query
def backfill_through(spark, sf_dir):
    """The inventory of the first five months' packs."""
    return B.inventory(packs(spark, sf_dir).filter(F.struct("year", "month") <= F.struct(F.lit(2026).alias("year"), F.lit(5).alias("month"))))


@query
def backfill_first_seen(spark, sf_dir):
    return B.first_seen(packs(spark, sf_dir)).select("family_id", F.col("key").alias("term"), "first_seen_month")


@query
def registry_delta(spark, sf_dir):
    return B.delta(L.registry(spark), packs(spark, sf_dir)).select("family_id", "n_before", "n_after", F.size("added").alias("n_added"), F.array_join("added", ",").alias("added"))


@query
def family_terms(spark, sf_dir):
    return B.terms_for_family(packs(spark, sf_dir), "gaming-meta")


@query
def phylogeny_nodes(spark, sf_dir):
    return B.phylogeny_nodes(L.registry(spark), B.first_seen(packs(spark, sf_dir)))


# settlements and the score log


def _decisions(spark, sf_dir):
    """Labels as decisions, some of them not allowed."""
    i = F.col("doc_id")
    decision = F.when(i % 11 == 3, "maybe").when(F.col("toxic") == 1, "void").when(F.col("quality") == 1, "true").otherwise("FALSE")
    return _table(spark, sf_dir, "labels").select(i.alias("forecast_id"), F.when(i % 13 == 5, 0.5).otherwise(F.col("quality").cast("double")).alias("outcome"), decision.alias("settlement_decision"), F.lit("2026-01-01T00:00:00+00:00").alias("settled_at"))


@query
def settlements(spark, sf_dir):
    return C.settle(_decisions(spark, sf_dir)).select("forecast_id", "outcome", "settlement_decision", "settlement_id", "error")


def _score_log(spark, sf_dir) -> DataFrame:
    """A log that has every third forecast, with all labels settled on top; numbered."""
    forecasts = K._forecasts(spark, sf_dir)
    first = C.forecast_records(forecasts.filter("forecast_id % 3 = 0")).withColumn("seq", F.col("forecast.forecast_id"))
    new = C.settle_and_log(first, forecasts, C.settle(_decisions(spark, sf_dir)))
    at = F.coalesce("forecast.forecast_id", "settlement.forecast_id")
    return first.drop("step").unionByName(new.withColumn("seq", (at + 1) * 1000000000 + F.col("step")).drop("step"))


@query
def settle_log(spark, sf_dir):
    """Events of the log, and whether its chain (one a signal) holds, as written and read again."""
    log = _score_log(spark, sf_dir).withColumn("chain", F.col("forecast.signal_key"))
    body = F.concat_ws("|", "event", F.col("forecast.forecast_id").cast("string"), F.format_string("%.6f", "forecast.probability"), "settlement.settlement_decision", F.format_string("%.6f", "atomic"))
    path = store.new_path(spark, "score-log")
    back = store.append(G.append_chain(log.select("chain", "seq", "event", body.alias("body")), "chain", "seq", "body"), path)
    counts = back.groupBy("chain").agg(*[F.count_if(F.col("event") == e).alias(f"n_{e}") for e in ("forecast", "settlement", "score")])
    return counts.join(G.verify_chain(back, "chain", "seq", "body").select("chain", "ok", "broken_at"), "chain")


@query
def log_series(spark, sf_dir):
    """The series made again from the log's forecasts and settlements."""
    return C.series(C.log_pairs(_score_log(spark, sf_dir)), ["signal_key"]).select("signal_key", "n", r6("brier", "brier"))


@query
def skill_score(spark, sf_dir):
    out = C.skill(K._pairs(spark, sf_dir), ["signal_key"], "forecast_id")
    return out.select("signal_key", "n", *[r6(c, c) for c in ("skill", "skill_persistence", "skill_before")])


@query
def shifted_series(spark, sf_dir):
    """Each signal's series after its probabilities are moved by its mean shift."""
    pairs, g = K._pairs(spark, sf_dir), K._by_signal(spark, sf_dir).select("signal_key", F.col("mean_shift").alias("shift"))
    moved = C.mean_shifted(pairs.join(F.broadcast(g), "signal_key"), -F.col("shift"))
    return C.series(moved, ["signal_key"]).select("signal_key", "n", r6("brier", "brier"))


@query
def forecasts_override(spark, sf_dir):
    """Stage forecasts under another stage map."""
    rows = C.extract_forecasts(analysed(spark, sf_dir), {"EMERGENT": 0.2, "ACTUALIZING": 0.9})
    return rows.filter("signal_key = 'hyperstition.stage'").select("signal_id", "forecast_id", "probability")


@query
def ledger_entry(spark, sf_dir):
    rows = K._pairs(spark, sf_dir).filter("status = 'SCORED'")
    return rows.select("forecast_id", *[c.alias(n) for n, c in C.ledger_entry().items()])


# receipts, ledger, inbox, archive


def _receipts(spark, sf_dir):
    return P.receipts(analysed(spark, sf_dir))


@query
def receipt_emit(spark, sf_dir):
    """Receipts written in two goes, indexed in one ledger, read back and verified: a row a chain."""
    rows, folder, ledger = _receipts(spark, sf_dir), store.new_path(spark, "receipts"), store.new_path(spark, "ledger")
    P.emit(spark, rows.filter("signal_id % 2 = 0"), folder, ledger)
    back, index = P.emit(spark, rows.filter("signal_id % 2 = 1"), folder, ledger)
    good = P.verify(back).groupBy("chain").agg(F.count_if("ok").alias("n_valid"))
    return G.verify_chain(index, "chain", "seq", "body").join(good, "chain").select("chain", "n", "n_valid", "ok", "broken_at")


@query
def receipt_verify(spark, sf_dir):
    """Receipts of which some were edited, some lost their hash."""
    rows = _receipts(spark, sf_dir).withColumn("stage", F.when(F.col("signal_id") % 50 == 7, "EDITED").otherwise(F.col("stage"))).withColumn("integrity", F.when(F.col("signal_id") % 50 == 9, "").otherwise(F.col("integrity")))
    return P.verify(rows).groupBy("ok", "message").agg(F.count(F.lit(1)).alias("n"))


@query
def receipt_list(spark, sf_dir):
    return P.listed(_receipts(spark, sf_dir), 50, "crypto-degen").select("signal_id", "family", "stage", "name")


@query
def receipt_index(spark, sf_dir):
    return _receipts(spark, sf_dir).select("signal_id", "canonical_hash", "integrity")


@query
def receipt_diff(spark, sf_dir):
    """Receipts under the registry against those under one without its third family, field by field."""
    rows, terms = distinct_observed(spark, sf_dir), L.registry(spark)
    one = lambda t: P.receipts(by_query(spark, sf_dir, analysed_queries(rows, t)))
    return P.diff(one(terms), one(terms.filter("family_pos <> 2")), ["signal_id"])


@query
def receipt_violations(spark, sf_dir):
    rows = _receipts(spark, sf_dir).withColumn("stage", F.when(F.col("signal_id") % 40 == 1, "UNKNOWN").otherwise(F.col("stage")))
    return P.violations(rows, "signal_id", ["integrity", "family"], {"stage": ["EMERGENT", "ACTUALIZING"]})


@query
def foreign_json(spark, sf_dir):
    """Canonical hashes of the events' JSON."""
    rows = _table(spark, sf_dir, "events").select("event_id", "props")
    return rows.select("event_id", F.sha2(P.canonical_json(F.col("props")), 256).alias("canonical_hash"))


@query
def inbox_priority(spark, sf_dir):
    """Signals pushed to the inbox, those of high priority, the last 50."""
    rows = I.candidates(analysed(spark, sf_dir), "EMERGENT").select("signal_id", "stage", "priority", "family")
    return I.listed(I.push(rows, store.new_path(spark, "inbox")), "high", 50).select("signal_id", "stage", "priority")


@query
def archive_summary(spark, sf_dir):
    rows = analysed(spark, sf_dir).select("signal_id", P.canonical_hash().alias("canonical_hash"), "family", "typology", "stage", "hybrid", "lineage_confidence", F.substring("observed", 1, 240).alias("preview"))
    return rows.withColumn("lineage_label", F.when(F.col("family").isNotNull(), "INFERRED").otherwise("NOT_COMPUTABLE"))


@query
def archive_catalog(spark, sf_dir):
    """Summaries written as one snapshot a day and catalogued, the newest first."""
    rows = P.receipts(analysed(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "day")
    named = rows.select(F.col("chain").alias("day"), "integrity", "family", "lineage_confidence")
    archive = P.write_archive(named, "day", store.new_path(spark, "archive"))
    return P.archive_catalog(archive).select(F.date_format("snapshot_id", "yyyy-MM-dd").alias("snapshot_id"), "n_receipts", "n_with_lineage", "n_families", r6("mean_confidence", "mean_confidence"), "rank")


# vectors


def _stored(spark, sf_dir) -> DataFrame:
    return V.seeds(L.registry(spark), B.named(packs(spark, sf_dir)), analysed(spark, sf_dir).withColumn("canonical_hash", P.canonical_hash()).withColumn("integrity", P.integrity()))


@query
def vector_seed(spark, sf_dir):
    return _stored(spark, sf_dir).groupBy("kind", "source").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query
def vector_index(spark, sf_dir):
    return V.index_rows(analysed(spark, sf_dir))


@query
def vector_export(spark, sf_dir):
    """The vectors written as JSON lines, read again strictly, synchronised into a store that has the even ones, without one kind."""
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.concat(F.lit("k"), F.col("label").cast("string")).alias("kind"), F.lit("").alias("text"), F.lit(None).cast("string").alias("family_id"), F.lit("m").alias("model"), "embedding")
    path = store.new_path(spark, "vectors")
    V.export(rows, path)
    back = S.read_vectors_json(spark, path, V.ROW)
    both = V.sync(back, rows.filter("CAST(id AS BIGINT) % 2 = 0"))
    return V.without_kind(both, "k3").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim"))


@query
def neighbor_edges(spark, sf_dir):
    found = V.label_neighbours(_table(spark, sf_dir, "embeddings"))
    return V.neighbour_edges(found).select("label", "a", "b", r6("score", "score"))


# scenarios


def _phase5(spark, sf_dir) -> DataFrame:
    """Every query's terms simulated apart: transmission, agents and risk by term."""
    rows = analysed_queries(distinct_observed(spark, sf_dir), L.registry(spark)).select("query", "hybrid", "predicted", "lineage_confidence", "memetic_score", "stage")
    rows = store.append(rows, store.new_path(spark, "analysed"))  # read twice; joins on computed columns would push them into every filter
    runs = rows.select(F.lit(0.35).alias("beta"), F.lit(0.08).alias("gamma"), "hybrid").distinct().withColumn("run_id", F.col("hybrid"))
    sim = M.transmission(runs).select(F.col("run_id").alias("hybrid"), "peak", "reach")
    rows = rows.join(sim, "hybrid").withColumn("memetic", F.round(F.col("memetic_score") * 100).cast("int")).join(F.broadcast(M.default_cascades(spark)), "memetic")
    rows = rows.withColumn("risk", T.risk(F.col("stage"), F.col("hybrid"), F.col("predicted"), F.col("lineage_confidence"), F.col("memetic_score"), F.col("peak"), F.col("reach"), F.col("agent_rate"), F.col("cascade")))
    terms = distinct_observed(spark, sf_dir).select("query", F.explode(F.array_distinct(T.split_matched(F.col("query")))).alias("term"))
    return by_query(spark, sf_dir, rows.withColumn("tier", T.risk_tier(F.col("risk"))).join(terms, "query"))


@query
def phase5_terms(spark, sf_dir):
    return _phase5(spark, sf_dir).select("signal_id", "term", r6("peak", "peak"), r6("reach", "reach"), "cascade", "risk", "tier")


@query
def phase5_multi(spark, sf_dir):
    """The most severe tier of a signal's terms."""
    order = F.array_position(F.array(*[F.lit(t) for t, *_ in X.TIERS]), F.col("tier"))
    return _phase5(spark, sf_dir).groupBy("signal_id").agg(F.count(F.lit(1)).alias("n_terms"), F.max_by("tier", order).alias("top_tier"))


@query
def stage_cells(spark, sf_dir):
    """Forecast pairs by stage of calibration: how many wait, how many are settled, by signal."""
    state = F.when(F.col("settlement_decision").isNull(), "pending").when(F.upper("settlement_decision").isin("TRUE", "FALSE"), "settled").otherwise("void")
    both = K._forecasts(spark, sf_dir).join(K._settlements(spark, sf_dir), "forecast_id", "left")
    return both.groupBy("signal_key", state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query
def pending_first(spark, sf_dir):
    """The first 20 forecasts that wait, by signal."""
    rows = C.pending(K._forecasts(spark, sf_dir), K._settlements(spark, sf_dir))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("signal_key").orderBy("forecast_id"))).filter("rank <= 20").select("signal_key", "rank", "forecast_id")
