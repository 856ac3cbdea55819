"""Forecasts, settlements and scores. A score is NULL, with a status beside it, until an outcome is settled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAGE_MAP = {"EMERGENT": 0.35, "ACTUALIZING": 0.70}


def extract_forecasts(analysis: DataFrame, stage_map: dict[str, float] | None = None) -> DataFrame:
    """Up to three forecasts a row: (signal_id, forecast_id, signal_key, probability)."""
    stages = F.create_map(*[F.lit(x) for kv in (stage_map or STAGE_MAP).items() for x in kv])
    rows = F.array(
        F.struct(F.lit("lineage.confidence").alias("signal_key"), F.col("lineage_confidence").alias("probability")),
        F.struct(F.lit("virality.hybrid_score").alias("signal_key"), F.col("hybrid").alias("probability")),
        F.struct(F.lit("hyperstition.stage").alias("signal_key"), F.element_at(stages, F.col("stage")).alias("probability")),
    )
    out = analysis.select("signal_id", "fingerprint_id", F.inline(rows)).filter(F.col("probability").between(0, 1))
    key = F.concat_ws("|", "fingerprint_id", "signal_key", F.format_string("%.6f", "probability"), F.lit("v1"))
    return out.select("signal_id", F.substring(F.sha2(key, 256), 1, 16).alias("forecast_id"), "signal_key", "probability")


def last_write(log: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """The row of each key with the largest seq."""
    return log.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))).filter("_r = 1").drop("_r")


def settled_pairs(forecasts: DataFrame, settlements: DataFrame) -> DataFrame:
    """forecast ⋈ settlement on forecast_id; only TRUE and FALSE decisions score."""
    scorable = F.upper("settlement_decision").isin("TRUE", "FALSE")
    return forecasts.join(settlements, "forecast_id").withColumn("status", F.when(scorable, "SCORED").otherwise("NOT_COMPUTABLE")).withColumn("atomic", F.when(scorable, F.pow(F.col("probability") - F.col("outcome"), 2)))


def pending(forecasts: DataFrame, settlements: DataFrame) -> DataFrame:
    return forecasts.join(settlements.select("forecast_id"), "forecast_id", "left_anti")


DECISIONS = ["TRUE", "FALSE", "VOID", "CONFLICT"]


def settle(decisions: DataFrame) -> DataFrame:
    """Settlements of (forecast_id, outcome, settlement_decision, settled_at): decision in capitals, a settlement_id, or an
    error and no id where the outcome isn't 0 or 1 or the decision isn't known. Outcome and decision needn't agree."""
    decision = F.upper("settlement_decision")
    error = F.when(~F.coalesce(F.col("outcome").isin(0.0, 1.0), F.lit(False)), "outcome must be 0.0 or 1.0").when(~F.coalesce(decision.isin(DECISIONS), F.lit(False)), f"decision must be {'|'.join(DECISIONS)}")
    raw = F.concat_ws("|", F.col("forecast_id").cast("string"), F.col("outcome").cast("string"), decision, "settled_at")
    return decisions.withColumn("settlement_decision", decision).withColumn("error", error).withColumn("settlement_id", F.when(error.isNull(), F.substring(F.sha2(raw, 256), 1, 16)))


#: A record of the score log: what its event is about, and what else it carries.
RECORD = "event string, forecast struct<forecast_id: bigint, signal_key: string, probability: double>, settlement struct<forecast_id: bigint, outcome: double, settlement_decision: string>, atomic double"


def forecast_records(forecasts: DataFrame) -> DataFrame:
    fc = F.struct(F.col("forecast_id").cast("long").alias("forecast_id"), "signal_key", F.col("probability").cast("double").alias("probability"))
    return forecasts.select(F.lit("forecast").alias("event"), fc.alias("forecast"), F.lit(None).cast("struct<forecast_id: bigint, outcome: double, settlement_decision: string>").alias("settlement"), F.lit(None).cast("double").alias("atomic"), F.lit(0).alias("step"))


def settle_and_log(log: DataFrame, forecasts: DataFrame, settlements: DataFrame) -> DataFrame:
    """Records to add to log (event, forecast, settlement, atomic; step orders those of one forecast): the forecast where the log
    has none, the settlement, and its score, which is NULL unless the decision is TRUE or FALSE."""
    pairs = settled_pairs(forecasts, settlements.filter("error IS NULL"))
    fc = F.struct(F.col("forecast_id").cast("long").alias("forecast_id"), "signal_key", F.col("probability").cast("double").alias("probability"))
    st = F.struct(F.col("forecast_id").cast("long").alias("forecast_id"), F.col("outcome").cast("double").alias("outcome"), "settlement_decision")
    rows = pairs.select(fc.alias("forecast"), st.alias("settlement"), "atomic", F.posexplode(F.array(F.lit("settlement"), F.lit("score"))).alias("step", "event"))
    rows = rows.select("event", "forecast", "settlement", F.when(F.col("event") == "score", F.col("atomic")).alias("atomic"), (F.col("step") + 1).alias("step"))
    known = index_forecasts(log).select("forecast_id")
    new = forecasts.join(pairs.select("forecast_id"), "forecast_id", "left_semi").join(known, "forecast_id", "left_anti")
    return forecast_records(new).unionByName(rows)


def index_forecasts(log: DataFrame) -> DataFrame:
    """The latest forecast of each id, of whatever event carries one."""
    last = log.filter("forecast.forecast_id IS NOT NULL").groupBy("forecast.forecast_id").agg(F.max_by("forecast", "seq").alias("f"))
    return last.select("f.*")


def index_settlements(log: DataFrame) -> DataFrame:
    """The latest settlement of each id, of settlement events only."""
    last = log.filter("event = 'settlement' AND settlement.forecast_id IS NOT NULL").groupBy("settlement.forecast_id").agg(F.max_by("settlement", "seq").alias("s"))
    return last.select("s.*")


def log_pairs(log: DataFrame, signal_key: str | None = None, contains: str | None = None) -> DataFrame:
    """Forecast and settlement pairs of a log, of one signal or of those whose key holds a text."""
    pairs = settled_pairs(index_forecasts(log), index_settlements(log))
    if signal_key is not None:
        pairs = pairs.filter(F.col("signal_key") == signal_key)
    return pairs if contains is None else pairs.filter(F.lower("signal_key").contains(contains.lower()))


def skill(pairs: DataFrame, by: list[str], order: str) -> DataFrame:
    """Skill scores against three references: climatology; persistence as published, whose reference is the outcomes themselves
    (so it is 0 for a perfect series, else NULL); and persistence of the outcome before, in order."""
    p, o = F.col("probability"), F.col("outcome")
    rows = _pairs(pairs).withColumn("before", F.lag("outcome").over(Window.partitionBy(*by).orderBy(order)))
    g = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(p - o, 2)).alias("brier"), F.var_pop(o).alias("ref"), F.avg(F.pow(F.col("before") - o, 2)).alias("ref_before"), F.avg(F.when(F.col("before").isNotNull(), F.pow(p - o, 2))).alias("brier_after"))
    against = lambda b, ref: F.when(ref != 0, 1 - b / ref).when(b == 0, 0.0)
    return g.select(*by, "n", against(F.col("brier"), F.col("ref")).alias("skill"), F.when((F.col("n") >= 2) & (F.col("brier") == 0), 0.0).alias("skill_persistence"), against(F.col("brier_after"), F.col("ref_before")).alias("skill_before"))


def ledger_entry(generation: int = 1, note: str = "lexwave.calibration.v1") -> dict[str, Column]:
    """Hashes of a scored pair for a score ledger: forecast, score, calibration, all of them, and the entry's id."""
    fid, p = F.col("forecast_id").cast("string"), F.format_string("%.6f", "probability")
    forecast = F.sha2(F.concat_ws("|", fid, p, "signal_key", F.lit("v1")), 256)
    score = F.sha2(F.concat_ws("|", fid, F.format_string("%.6f", "atomic"), p, F.format_string("%.1f", "outcome")), 256)
    calibration = F.sha2(F.concat_ws("|", F.lit(note), "signal_key", F.lit("v1")), 256)
    return {"forecast_hash": forecast, "score_hash": score, "ledger_hash": F.sha2(F.concat_ws("|", forecast, score, calibration, F.lit(str(generation))), 256), "entry_id": F.substring(F.sha2(F.concat_ws("|", fid, F.lit(str(generation))), 256), 1, 32)}


def _pairs(pairs: DataFrame) -> DataFrame:
    return pairs.filter("status = 'SCORED'")


def _bin(p: Column, n: int) -> Column:
    """[i/n, (i+1)/n), the last one closed."""
    out = F.lit(None).cast("int")
    for i in range(n):
        out = F.when((p >= i / n) & ((p < (i + 1) / n) if i < n - 1 else (p <= 1.0)), i).otherwise(out)
    return out


def series(pairs: DataFrame, by: list[str]) -> DataFrame:
    """One row a group: n, brier, skill against climatology, discrimination slope, Yates and Vieira parts, mean shift."""
    p, o = F.col("probability"), F.col("outcome")
    base = _pairs(pairs).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.pow(p - o, 2)).alias("brier"), F.avg(p).alias("mean_p"), F.avg(o).alias("mean_o"), F.var_pop(p).alias("var_f"), F.var_pop(o).alias("var_o"),
        F.covar_pop(p, o).alias("cov"), F.avg(F.when(o == 1, p)).alias("p1"), F.avg(F.when(o == 0, p)).alias("p0"), F.count(F.when(o == 1, 1)).alias("n1"),
    )
    ref = F.col("var_o")  # climatology's own score
    bias2, sf, so = F.pow(F.col("mean_p") - F.col("mean_o"), 2), F.sqrt("var_f"), F.sqrt("var_o")
    return base.withColumns({
        "skill": F.when(ref != 0, 1 - F.col("brier") / ref).when(F.col("brier") == 0, 0.0), "slope": F.col("p1") - F.col("p0"), "bias_squared": bias2,
        "covariance_deficit": F.col("var_o") - 2 * F.col("cov"), "variance_mismatch": F.pow(sf - so, 2), "correlation_deficit": F.greatest(F.lit(0.0), 2 * (sf * so - F.col("cov"))),
        "rho": F.when((sf > 0) & (so > 0), F.col("cov") / (sf * so)), "mean_shift": F.col("mean_p") - F.col("mean_o"), "elevated": bias2 >= 0.01,
        "status": F.when(F.col("n") > 0, "SCORED").otherwise("NOT_COMPUTABLE"),
    })


def murphy(pairs: DataFrame, by: list[str], n_bins: int = 10) -> DataFrame:
    """Reliability, resolution, uncertainty, plain and with the Ferro-Fricker correction."""
    binned = _pairs(pairs).withColumn("bin", _bin(F.col("probability"), n_bins))
    bins = binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("nk"), F.avg("probability").alias("pk"), F.avg("outcome").alias("ok"), F.sum("outcome").alias("so"))
    every = Window.partitionBy(*by)
    bins = bins.withColumn("n", F.sum("nk").over(every)).withColumn("mo", F.sum("so").over(every) / F.sum("nk").over(every)).filter("bin IS NOT NULL")
    within = F.when(F.col("nk") >= 2, F.col("nk") / (F.col("nk") - 1.0) * F.col("ok") * (1 - F.col("ok")) / F.col("n"))
    out = bins.groupBy(*by).agg(
        F.max("n").alias("n"), F.sum(F.col("nk") / F.col("n") * F.pow(F.col("pk") - F.col("ok"), 2)).alias("reliability"), F.sum(F.col("nk") / F.col("n") * F.pow(F.col("ok") - F.col("mo"), 2)).alias("resolution"),
        F.max(F.col("mo") * (1 - F.col("mo"))).alias("uncertainty"), F.coalesce(F.sum(within), F.lit(0.0)).alias("within"),
    )
    extra = F.when(F.col("n") >= 2, F.col("uncertainty") / (F.col("n") - 1.0)).otherwise(0.0)
    inside = F.when(F.col("n") >= 2, F.col("within")).otherwise(0.0)
    floor = lambda c: F.greatest(F.lit(0.0), c)
    return out.withColumns({"reliability_ff": floor(F.col("reliability") - inside), "resolution_ff": floor(F.col("resolution") + extra - inside), "uncertainty_ff": floor(F.col("uncertainty") + extra)}).drop("within")


def stage_feedback(scored: DataFrame, step: float = 0.08) -> DataFrame:
    """Each stage's probability moved against the bias by a bounded step."""
    move = F.greatest(F.lit(-step), F.least(F.lit(step), F.col("mean_o") - F.col("mean_p")))
    stages = F.explode(F.array(*[F.struct(F.lit(k).alias("stage"), F.lit(v).alias("prior")) for k, v in STAGE_MAP.items()]))
    return scored.select("*", stages.alias("s")).select("signal_key", "s.stage", "s.prior", F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.col("s.prior") + move)).alias("adjusted"))


def mean_shifted(pairs: DataFrame, shift: Column) -> DataFrame:
    """Probabilities moved by a shift and held in [0, 1]."""
    return pairs.withColumn("probability", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("probability") + shift)))
