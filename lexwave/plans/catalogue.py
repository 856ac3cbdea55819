"""All queries over the driver's tables, each with its DuckDB twin where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexwave.functions import text as T
from lexwave.operators import calibration as C
from lexwave.operators import ledger as G
from lexwave.operators import lineage as L
from lexwave.operators import simulate as M
from lexwave.operators import vectors as V
from lexwave.plans.analysis import analysed, by_query, distinct_observed, observed
from lexwave.sources import lexicon as X
from lexwave.sources import signals as S
from lexwave.sources import store
from lexwave.streaming import log as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
r6 = lambda c, name: T.half_up(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _candidates(spark: SparkSession, sf_dir: str, min_confidence: float = X.THRESHOLD) -> DataFrame:
    """Candidates of each distinct query."""
    return L.candidates(distinct_observed(spark, sf_dir), "query", F.col("observed"), L.registry(spark), min_confidence=min_confidence)


@query
def lineage_best(spark, sf_dir):
    return by_query(spark, sf_dir, L.best(_candidates(spark, sf_dir), "query")).select("signal_id", "family_id", "branch_operator", "n_hits", r6("specificity", "specificity"), r6("raw_score", "raw_score"), "confidence", "matched")


@query
def lineage_candidates(spark, sf_dir):
    return by_query(spark, sf_dir, _candidates(spark, sf_dir)).select("signal_id", "family_id", "n_hits", r6("specificity", "specificity"), r6("coverage", "coverage"), "hit_bonus", r6("density", "density"), r6("raw_score", "raw_score"), "confidence")


@query
def lineage_strict(spark, sf_dir):
    return by_query(spark, sf_dir, _candidates(spark, sf_dir, 0.6)).select("signal_id", "family_id", "confidence")


@query
def lineage_documents(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return L.best(L.candidates(rows, "doc_id", F.col("text"), L.registry(spark)), "doc_id").select("doc_id", "family_id", "n_hits", "confidence", "matched")


@query
def lineage_pages(spark, sf_dir):
    rows = _table(spark, sf_dir, "pages").select("page_id", "html")
    return L.best(L.candidates(rows, "page_id", F.col("html"), L.registry(spark)), "page_id").select("page_id", "family_id", "n_hits", "confidence", "matched")


@query
def per_term_lineage(spark, sf_dir):
    rows = spark.createDataFrame([(t,) for t in X.terms()], "key string").withColumn("twice", F.concat_ws(" ", "key", "key"))
    return L.best(L.candidates(rows, "key", F.col("twice"), L.registry(spark)), "key").select(F.col("key").alias("term"), "family_id", "n_hits", "confidence")


@query
def term_split(spark, sf_dir):
    rows = distinct_observed(spark, sf_dir).select("query", F.array_join(T.split_matched(F.col("query")), "|").alias("matched"))
    return by_query(spark, sf_dir, rows).select("signal_id", "matched")


@query
def mock_signals(spark, sf_dir):
    return observed(spark, sf_dir).select("signal_id", "query", "raw", "observed")


@query
def fingerprints(spark, sf_dir):
    return S.fingerprints(S.signals(spark, sf_dir))


@query
def clean_documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.clean(F.col("text")).alias("observed"))


@query
def virality_documents(spark, sf_dir):
    v = T.virality(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in v.items()])


@query
def virality(spark, sf_dir):
    return analysed(spark, sf_dir).select("signal_id", "velocity", "acceleration", "spread_cues", "hybrid", "predicted", "predicted_confidence", "delta")


@query
def hyperstition_stage(spark, sf_dir):
    return observed(spark, sf_dir).select("signal_id", T.stage(F.col("observed")).alias("stage"))


@query
def neologisms(spark, sf_dir):
    kind = lambda *names: F.transform(F.filter("neologisms", lambda x: x["formation"].isin(*names)), lambda x: x["term"])
    rows = distinct_observed(spark, sf_dir).withColumn("neologisms", T.neologisms(F.col("observed")))
    return by_query(spark, sf_dir, rows).select("signal_id", F.array_join(F.array_sort(kind("compound_phrase")), ",").alias("phrases"), F.array_join(kind("platform_compression"), ",").alias("stems"), F.array_join(F.array_sort(kind("extra-grammatical", "derivational", "grammatical")), ",").alias("tails"), F.size("neologisms").alias("n_neologisms"))


@query
def typology(spark, sf_dir):
    return analysed(spark, sf_dir).select("signal_id", "family", "typology", "n_types", "is_memetic", "memetic_score")


@query
def typology_scores(spark, sf_dir):
    return analysed(spark, sf_dir).select("signal_id", F.explode("type_scores").alias("t")).select("signal_id", F.col("t.id").alias("typology"), F.col("t.s").alias("score"))


@query
def semantic_variation(spark, sf_dir):
    return analysed(spark, sf_dir).select("signal_id", "sense", "community", F.array_join("drivers", " + ").alias("driver"))


@query
def compression_metrics(spark, sf_dir):
    lc, h, n, ms = F.coalesce("lineage_confidence", F.lit(0.0)), F.greatest("hybrid", "predicted"), F.col("n_neologisms"), F.col("memetic_score")
    cap = lambda c: T.level(F.least(F.lit(1.0), c))
    return analysed(spark, sf_dir).select(
        "signal_id", cap(0.35 + 0.12 * F.least(F.lit(5), n) + 0.25 * lc).alias("semantic_density"), cap(ms * 0.85 + 0.15).alias("emotional_density"), T.level(h).alias("virality_potential"), cap(lc * 0.7 + ms * 0.3).alias("identity_signaling"),
        cap(0.4 + 0.15 * F.least(F.lit(4), n) + F.when(lc >= X.THRESHOLD, 0.2).otherwise(0.0)).alias("compression_efficiency"), cap(F.when(F.col("stage") == "ACTUALIZING", 0.55).otherwise(0.35) + F.when(h > 0.7, 0.15).otherwise(0.0)).alias("drift_probability"),
    )


@query
def risk_score(spark, sf_dir):
    return analysed(spark, sf_dir).select("signal_id", "risk", "tier")


@query
def scan_plan(spark, sf_dir):
    return analysed(spark, sf_dir).select("signal_id", "tier", *[c.alias(n) for n, c in T.policy(F.col("tier")).items()])


@query
def scan_aggregate(spark, sf_dir):
    return analysed(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("family").isNotNull().cast("double")), "coverage"), F.countDistinct("family").alias("families"), r6(F.avg("risk"), "mean_risk"), F.count_if(F.col("tier") == "CRITICAL").alias("critical"))


@query
def market_signal(spark, sf_dir):
    act = F.col("stage") == "ACTUALIZING"
    return analysed(spark, sf_dir).select("signal_id", T.rounded(0.7 * F.col("hybrid") + F.when(act, 0.25).otherwise(0.05), 3).alias("confidence"), F.when(act & (F.col("hybrid") >= 0.6), "ESCALATE").when(act | (F.col("hybrid") >= 0.55), "MONITOR").otherwise("IGNORE").alias("actionable"))


@query
def attractors(spark, sf_dir):
    return analysed(spark, sf_dir).filter("stage = 'ACTUALIZING'").select("signal_id", "family", "hybrid", "lineage_confidence", F.substring(F.sha2(F.concat_ws("|", "fingerprint_id", "stage"), 256), 1, 16).alias("attractor_id"))


@query
def envelopes(spark, sf_dir):
    roles = F.filter(F.array(F.lit("analysis"), F.when(F.col("family").isNotNull(), "lineage"), F.when(F.col("stage") == "ACTUALIZING", "loop")), lambda x: x.isNotNull())
    return analysed(spark, sf_dir).select("signal_id", "fingerprint_id", F.explode(roles).alias("role")).select("signal_id", "role", F.substring(F.sha2(F.concat_ws("|", "fingerprint_id", "role"), 256), 1, 16).alias("envelope_id"))


@query
def forecasts(spark, sf_dir):
    return C.extract_forecasts(analysed(spark, sf_dir)).withColumn("probability", F.round("probability", 6))


@query
def pipeline_rollup(spark, sf_dir):
    n = (F.col("lineage_confidence").isNotNull()).cast("long") + 2
    return analysed(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n_ok"), F.sum(n).alias("n_forecasts"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), r6(F.avg("predicted"), "mean_predicted"))


@query
def ledger_stats(spark, sf_dir):
    return G.stats(analysed(spark, sf_dir).select("family", "stage", "event_type", "lineage_confidence"))


@query
def lineage_distribution(spark, sf_dir):
    return analysed(spark, sf_dir).groupBy(F.coalesce("family", F.lit("(none)")).alias("family")).agg(F.count(F.lit(1)).alias("n"), T.half_up(F.avg("lineage_confidence"), 3).alias("mean_confidence"))


@query
def receipt_timeline(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("signal_id")
    return analysed(spark, sf_dir).select("user_id", "signal_id", "family", F.lead("signal_id").over(w).alias("next_signal"), (~F.lead("family").over(w).eqNullSafe(F.col("family"))).alias("changed"))


@query
def family_terms_top(spark, sf_dir):
    rows = analysed(spark, sf_dir).filter("family IS NOT NULL").select("family", F.explode(F.split("matched", ",")).alias("term")).groupBy("family", "term").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("family").orderBy(F.desc("n"), "term"))).filter("r <= 8").drop("r")


@query
def backprop_changes(spark, sf_dir):
    rows, terms = distinct_observed(spark, sf_dir), L.registry(spark)
    one = lambda text, f, c: L.best(L.candidates(rows.withColumn("own", F.col(text)), "query", F.col("own"), terms), "query").select("query", F.col("family_id").alias(f), F.col("confidence").alias(c))
    both = S.signals(spark, sf_dir).select("query").join(one("query", "f1", "c1"), "query", "left").join(one("observed", "f2", "c2"), "query", "left")
    f1, f2 = F.col("f1"), F.col("f2")
    change = F.when(f1.isNull() & f2.isNull(), "unchanged").when(f1.isNull(), "gained").when(f2.isNull(), "lost").when(f1 != f2, "reclassified").when(F.abs(F.col("c1") - F.col("c2")) >= 0.02, "confidence_shift").otherwise("unchanged")
    return both.groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("n"))


def _forecasts(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("forecast_id"), F.col("lang").alias("signal_key"), ((F.col("n_chars") % 1000) / 1000.0).alias("probability"))


def _settlements(spark, sf_dir):
    decision = F.when(F.col("toxic") == 1, "VOID").when(F.col("quality") == 1, "TRUE").otherwise("FALSE")
    return _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("forecast_id"), F.col("quality").cast("double").alias("outcome"), decision.alias("settlement_decision"))


def _pairs(spark, sf_dir):
    return C.settled_pairs(_forecasts(spark, sf_dir), _settlements(spark, sf_dir))


@query
def settled_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("forecast_id", "signal_key", "probability", "outcome", "status", r6("atomic", "atomic"))


@query
def pending_forecasts(spark, sf_dir):
    return C.pending(_forecasts(spark, sf_dir), _settlements(spark, sf_dir))


@query
def brier_series(spark, sf_dir):
    return C.series(_pairs(spark, sf_dir), []).select("n", r6("brier", "brier"), r6("skill", "skill"))


def _by_signal(spark, sf_dir):
    return C.series(_pairs(spark, sf_dir), ["signal_key"])


@query
def brier_by_signal(spark, sf_dir):
    return _by_signal(spark, sf_dir).select("signal_key", "n", r6("brier", "brier"), r6("skill", "skill"), r6("slope", "slope"))


@query
def yates(spark, sf_dir):
    return _by_signal(spark, sf_dir).select("signal_key", r6("bias_squared", "bias_squared"), r6("var_f", "excess_variance"), r6("covariance_deficit", "covariance_deficit"))


@query
def yates_vieira(spark, sf_dir):
    return _by_signal(spark, sf_dir).select("signal_key", *[r6(c, c) for c in ("variance_mismatch", "correlation_deficit", "bias_squared", "rho")])


@query
def mean_shift(spark, sf_dir):
    return _by_signal(spark, sf_dir).select("signal_key", r6("mean_shift", "mean_shift"), "elevated")


@query
def murphy(spark, sf_dir):
    names = ("reliability", "resolution", "uncertainty", "reliability_ff", "resolution_ff", "uncertainty_ff")
    return C.murphy(_pairs(spark, sf_dir), ["signal_key"]).select("signal_key", "n", *[r6(c, c) for c in names])


@query
def stage_feedback(spark, sf_dir):
    return C.stage_feedback(_by_signal(spark, sf_dir)).select("signal_key", "stage", "prior", r6("adjusted", "adjusted"))


@query
def operator_review(spark, sf_dir):
    b = F.col("bias_squared")
    return _by_signal(spark, sf_dir).select("signal_key", r6(1 - b, "score"), F.when(b >= 0.01, "apply_mean_shift").otherwise("none").alias("suggestion"), r6(F.when(b >= 0.01, -F.col("mean_shift")), "suggested_shift"))


@query
def score_packets(spark, sf_dir):
    key = F.concat_ws("|", F.col("forecast_id").cast("string"), F.format_string("%.6f", "probability"), F.col("outcome").cast("int").cast("string"), F.format_string("%.6f", F.round("atomic", 6)))
    return _pairs(spark, sf_dir).filter("status = 'SCORED'").select("forecast_id", F.substring(F.sha2(key, 256), 1, 16).alias("score_hash"))


@query
def log_last_write(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value").withColumn("key", F.struct("user_id", "event_type"))
    return C.last_write(rows, "key", "event_id").select("user_id", "event_type", "event_id", r6("value", "value"))


def _linked(spark, sf_dir):
    body = G.body_hash(F.col("event_id").cast("string"), F.col("event_type"), F.coalesce("props", F.lit("")))
    return G.linked(_table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "props"), "user_id", "event_id", body)


@query
def chain_verify(spark, sf_dir):
    return G.verify_links(_linked(spark, sf_dir), "user_id", "event_id")


@query
def chain_tampered(spark, sf_dir):
    return G.verify_links(_linked(spark, sf_dir).filter("event_id % 97 <> 5"), "user_id", "event_id")


@query
def chain_built(spark, sf_dir):
    """A recursive chain of records, built and verified again."""
    rows = _table(spark, sf_dir, "events").select("user_id", "event_id", F.concat_ws("|", "event_type", F.coalesce("props", F.lit(""))).alias("body"))
    return G.verify_chain(G.append_chain(rows, "user_id", "event_id", "body"), "user_id", "event_id", "body")


def _vectors(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings")


def _asked(spark, sf_dir):
    return _vectors(spark, sf_dir).filter("vec_id = 0").select(F.col("embedding").alias("qv"))


@query
def vector_topk(spark, sf_dir):
    return V.top_k(_vectors(spark, sf_dir), _asked(spark, sf_dir)).select("vec_id", "label", r6("score", "score"))


@query
def vector_filtered(spark, sf_dir):
    return V.top_k(_vectors(spark, sf_dir), _asked(spark, sf_dir), min_score=0.05, where=F.col("label") == 3).select("vec_id", "label", r6("score", "score"))


@query
def vector_family_boost(spark, sf_dir):
    return V.family_boosts(V.top_k(_vectors(spark, sf_dir), _asked(spark, sf_dir), 8, 0.12)).select("label", r6("boost", "boost"))


def _asked_all(spark, sf_dir):
    return _vectors(spark, sf_dir).filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))


@query
def vector_topk_all(spark, sf_dir):
    """vector_topk for every row whose id is divisible by 100; the SQL twin of vector_topk fixes id 0."""
    return V.top_k_each(_vectors(spark, sf_dir), _asked_all(spark, sf_dir)).select("query_id", "rank", "vec_id", "label", r6("score", "score"))


@query
def vector_filtered_all(spark, sf_dir):
    return V.top_k_each(_vectors(spark, sf_dir), _asked_all(spark, sf_dir), min_score=0.05, where=F.col("label") == 3).select("query_id", "rank", "vec_id", "label", r6("score", "score"))


@query
def vector_family_boost_all(spark, sf_dir):
    return V.family_boosts(V.top_k_each(_vectors(spark, sf_dir), _asked_all(spark, sf_dir), 8, 0.12), by=["query_id"]).select("query_id", "label", r6("boost", "boost"))


@query
def vector_neighbors(spark, sf_dir):
    return V.label_neighbours(_vectors(spark, sf_dir)).select("label", "a", "b", r6("score", "score"), "rank")


@query
def vector_stats(spark, sf_dir):
    return _vectors(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"), F.max(F.size("embedding")).alias("dim"))


@query
def vector_upsert(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select(F.col("label").alias("kind"), F.col("vec_id").alias("latest"))
    return V.upsert(rows.filter("latest % 2 = 0"), rows.filter("latest % 2 = 1"), "kind", "latest")


@query
def hash_embed_search(spark, sf_dir):
    """The lexicon's terms nearest to one of them by the hashed text embedding."""
    rows = V.embed(L.registry(spark).select(F.concat_ws(":", "family_id", "term").alias("vec_id"), "term"), "term")
    asked = rows.filter("vec_id = 'brainrot-aura:aura farming'").select(F.col("embedding").alias("qv"))
    return V.top_k(rows, asked).select("vec_id", r6("score", "score"))


@query
def lexicon_weights(spark, sf_dir):
    return L.registry(spark).select("family_id", "term", r6("weight", "weight"))


@query
def lineage_map_cross(spark, sf_dir):
    a, b = L.registry(spark).alias("a"), L.registry(spark).alias("b")
    return a.join(b, (F.col("a.term") == F.col("b.term")) & (F.col("a.family_pos") < F.col("b.family_pos"))).select("a.term", F.col("a.family_id").alias("family_a"), F.col("b.family_id").alias("family_b"))


@query
def phylogeny_edges(spark, sf_dir):
    trunk = F.col("term_pos") < F.greatest(F.lit(1), F.floor(F.col("n_terms") / 2))
    return L.registry(spark).select("family_id", F.when(trunk, F.concat("family_id", F.lit(":trunk"))).otherwise(F.concat("family_id", F.lit(":root"))).alias("parent"), F.concat_ws(":", "family_id", "term").alias("child"))


@query
def registry_merge(spark, sf_dir):
    """The registry with a pack's terms (brands, and first terms in capitals), alike but for case counted once."""
    own = L.registry(spark).select("family_id", F.lower("term").alias("term"), F.lit(0).alias("src"))
    brands = _table(spark, sf_dir, "part").select(F.lit("part-brand").alias("family_id"), F.lower("p_brand").alias("term"))
    pack = brands.unionByName(L.registry(spark).filter("term_pos = 0").select("family_id", F.upper("term").alias("term"))).select("family_id", F.lower("term").alias("term"), F.lit(1).alias("src"))
    merged = own.unionByName(pack).groupBy("family_id", "term").agg(F.min("src").alias("src"))
    return merged.groupBy("family_id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("src").alias("added"))


@query
def mutations_topk(spark, sf_dir):
    """The likeliest mutations of each term, eight at most."""
    terms = L.registry(spark)
    seed = F.col("term")
    rows = [F.struct(T.vowel_drop(seed).alias("form"), F.lit("platform_compression").alias("operator"), F.lit(0.38).alias("conf"))]
    base = F.when(seed.endswith("e") & (F.length(seed) > 3), F.regexp_replace(seed, "e+$", "")).otherwise(seed)
    put = lambda form, op, conf: F.struct(form.alias("form"), F.lit(op).alias("operator"), F.lit(conf).alias("conf"))
    rows += [put(F.when(~seed.endswith(s), F.concat(base, F.lit(s))), "derivational", 0.40) for s in X.GENERAL_SUFFIXES]
    for family, some in X.FAMILY_SUFFIXES.items():
        rows += [put(F.when((F.col("family_id") == family) & ~seed.endswith(s), F.concat(seed, F.lit(s))), "derivational", 0.40) for s in some]
    flips = F.col("family_id").isin("brainrot-aura", "political-status", "gaming-meta") | (F.col("branch_operator") == "irony_inversion")
    rows += [put(F.when(flips, form), "irony_inversion", c) for form, c in ((F.concat(F.lit("negative "), seed), 0.44), (F.concat(seed, F.lit(" points")), 0.41), (F.concat(F.lit("mid "), seed), 0.36))]
    made = terms.select("family_id", "term", F.inline(F.filter(F.array(*rows), lambda x: x["form"].isNotNull())))
    co = terms.select("family_id", F.col("term").alias("co"), F.col("term_pos").alias("p"))
    near = terms.select("family_id", "term").join(F.broadcast(co), "family_id").filter("co <> term").withColumn("r", F.row_number().over(Window.partitionBy("family_id", "term").orderBy("p"))).filter("r <= 4")
    pairs = near.select("family_id", "term", F.inline(F.array(put(F.concat_ws(" ", "term", "co"), "compound_phrase", 0.37), put(F.concat_ws(" ", "co", "term"), "compound_phrase", 0.35))))
    known = terms.select("family_id", F.lower("term").alias("form"), F.lit(True).alias("attested"))
    rows_ = made.unionByName(pairs).join(F.broadcast(known), ["family_id", "form"], "left").withColumn("conf", F.round(F.when(F.col("attested"), F.col("conf") * 0.45).otherwise(F.col("conf")), 4))
    one = rows_.groupBy("family_id", "term", "form").agg(F.max(F.struct("conf", "operator")).alias("m")).select("family_id", "term", "form", F.col("m.conf").alias("confidence"), F.col("m.operator").alias("operator"))
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("family_id", "term").orderBy(F.desc("confidence"), "form"))).filter("rank <= 8")


@query
def transmission(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("run_id"), F.lit(0.35).alias("beta"), F.lit(0.08).alias("gamma"), (F.col("p_size") / 50.0).alias("hybrid"))
    return M.transmission(rows).withColumns({c: F.round(c, 6) for c in ("final_mean", "peak", "max_mean", "reach")})


@query
def transmission_grid(spark, sf_dir):
    rows = _pairs(spark, sf_dir).filter("status = 'SCORED'").select(F.col("forecast_id").alias("run_id"), F.col("probability").alias("hybrid"), "outcome")
    return M.grid_search(rows, [0.15, 0.25, 0.35, 0.45, 0.55, 0.65], [0.04, 0.08, 0.12, 0.16])


@query
def transmission_best(spark, sf_dir):
    """The five cells of the grid with the least error, the first of equal ones first."""
    return M.best_cells(transmission_grid(spark, sf_dir)).select("rank", "beta", "gamma", "mae")


@query
def scenario_compare(spark, sf_dir):
    return M.ranked(M.scenarios(spark))


@query
def agents(spark, sf_dir):
    return M.scenarios(spark).drop("by_role")


@query
def agents_by_role(spark, sf_dir):
    return M.scenarios(spark).select("scenario", "step", F.explode("by_role").alias("role", "n"))


@query
def stream_log_lww(spark, sf_dir):
    rows = R.log_stream(spark, f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    return R.latest(rows, ["user_id", "event_type"], "event_id", ["value"], store.new_path(spark, "stream")).select("user_id", "event_type", "event_id", r6("value", "value"))


@query
def stream_scan_windows(spark, sf_dir):
    rows = R.log_stream(spark, f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("at"), "event_type", "value")
    out = R.windows(rows, "at", "1 hour", "2 days", "event_type", "value", store.new_path(spark, "stream"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query
def stream_settled(spark, sf_dir):
    """Even events as forecasts, the next odd ones as their settlements, within an hour."""
    rows = lambda: R.log_stream(spark, f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("at"), "value")
    forecasts = rows().filter("event_id % 2 = 0").select(F.col("event_id").alias("forecast_id"), F.col("at").alias("made_at"))
    settlements = rows().filter("event_id % 2 = 1").select((F.col("event_id") - 1).alias("settled_id"), F.col("at").alias("settled_at"), "value")
    out = R.settled(forecasts, settlements, "2 days", "1 HOUR", store.new_path(spark, "stream"))
    return out.select("forecast_id", F.date_format("settled_at", "yyyy-MM-dd HH:mm:ss").alias("settled_at"), r6("value", "value"))

