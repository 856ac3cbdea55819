"""DuckDB SQL over the same tables, written apart from the Spark plans; only the fixed values are shared."""

from __future__ import annotations

import re

from lexwave.sources import lexicon as X

S = X.sql_str


def any_of(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {S(w)})" for w in words) + ")"


def count_of(col: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({col}, {S(w)}) AS INT)" for w in words) + ")"


def _clean(col: str) -> str:
    out = col
    for w in X.CLEANED:
        out = f"replace({out}, {S(w)}, '')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


_MOCK = "CASE " + " ".join(f"WHEN {any_of('lower(query)', k)} THEN {S(a)} || query || {S(b)}" for k, a, b in X.MOCK) + f" ELSE {S(X.MOCK_REST[0])} || query || {S(X.MOCK_REST[1])} END"
_N = len(X.terms())


def lineage_ctes(source: str, key: str, tag: str = "", rows=None) -> str:
    """cand and best over source(key, low)."""
    out = f"""
fam AS (SELECT * FROM {X.sql_values(rows or X.family_rows(), 'family_pos, family_id, branch_operator, term_pos, term, weight, n_terms')}),
tok AS MATERIALIZED (SELECT DISTINCT {key}, length(low) AS chars, unnest(regexp_split_to_array(low, '[^\\p{{L}}\\p{{N}}_]+')) AS word FROM {source}),
hit AS (SELECT {key}, chars, fam.* FROM tok JOIN fam ON word = fam.term
    UNION ALL SELECT {key}, length(low) AS chars, fam.* FROM {source} JOIN fam ON contains(fam.term, ' ') AND contains(low, fam.term)),
agg AS (SELECT {key}, chars, family_pos, family_id, branch_operator, n_terms, count(*) AS n_hits, avg(weight) AS specificity,
    string_agg(term, ',' ORDER BY term_pos) AS matched FROM hit GROUP BY ALL),
raw1 AS (SELECT *, n_hits / n_terms AS coverage,
    CASE n_hits WHEN 1 THEN 0.12 WHEN 2 THEN 0.22 WHEN 3 THEN 0.30 WHEN 4 THEN 0.36 ELSE 0.38 END::DOUBLE AS hit_bonus,
    CASE WHEN n_hits >= 2 THEN least(0.18::DOUBLE, 0.06::DOUBLE * (n_hits - 1) * (0.5::DOUBLE + 0.5::DOUBLE * greatest(0.0::DOUBLE, 1.0::DOUBLE - chars / 600.0::DOUBLE))) ELSE 0.0::DOUBLE END AS density FROM agg),
raw2 AS (SELECT *, 0.18::DOUBLE + 0.38::DOUBLE * specificity + 0.22::DOUBLE * coverage + hit_bonus + density AS raw_score FROM raw1),
cand AS (SELECT *, round(greatest(0.0::DOUBLE, least(0.98::DOUBLE, raw_score)), 3) AS confidence FROM raw2),
best AS (SELECT * FROM cand WHERE confidence >= 0.42 QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY confidence DESC, family_pos) = 1)"""
    for name in ("fam", "tok", "hit", "agg", "raw1", "raw2", "cand", "best") if tag else ():
        out = re.sub(rf"\b{name}\b(?!_)", name + tag, out)
    return out


_T = X.sql_list(X.terms())
SIGNALS = f"""
WITH sig0 AS (SELECT event_id AS signal_id, user_id, event_type, ts,
    CASE WHEN user_id % 3 = 0 THEN ({_T})[event_id % {_N} + 1] || ' ' || ({_T})[(event_id * 7 + user_id) % {_N} + 1] ELSE ({_T})[event_id % {_N} + 1] END AS query FROM events),
sig1 AS (SELECT *, {_MOCK} AS raw FROM sig0),
sig AS MATERIALIZED (SELECT *, {_clean('substr(raw, 1, 280)')} AS observed, lower({_clean('substr(raw, 1, 280)')}) AS low FROM sig1)"""

_WORDS = "CASE WHEN trim(observed) = '' THEN 0 ELSE len(string_split(trim(observed), ' ')) END"
_B = r"(^|[^a-z0-9_])"


def _typology() -> tuple[str, str]:
    """(struct list of scores, unsorted; with the prior)."""
    rows = []
    for pos, (name, w, cues) in enumerate(X.TYPOLOGY):
        m = count_of("(' ' || low || ' ')", cues)
        base = f"CASE WHEN {m} > 0 THEN stored_round({w}::DOUBLE * least(1.0::DOUBLE, 0.35::DOUBLE + 0.2::DOUBLE * {m}), 3) END"
        fams = [f for f, t in X.PRIOR.items() if t == name]
        prior = f"coalesce(family IN ({', '.join(map(S, fams))}), false)" if fams else "false"
        rows.append(f"SELECT signal_id, {S(name)} AS id, CASE WHEN {base} IS NULL THEN {-100 - pos} ELSE {-pos} END AS p, CASE WHEN {prior} THEN stored_round(coalesce({base}, 0.0) + 0.15::DOUBLE, 3) ELSE {base} END AS s FROM joined")
    return " UNION ALL ".join(rows), ""


_SENSE = lambda at: "CASE " + " ".join(f"WHEN {any_of('low', k)} THEN {at(s, c, d)}" for k, s, c, d in X.SENSES)
_NEO = f"""
phr AS (SELECT signal_id, list_distinct(regexp_extract_all(low, '\\b({'|'.join(x.replace("'", "''") for x in X.PHRASES)})\\b', 1)) AS l FROM sig),
neo AS (SELECT sig.signal_id, list_sort(phr.l) AS phrases,
    list_filter({X.sql_list(X.STEMS)}, lambda x: regexp_matches(low, '\\b' || x || '\\b') AND NOT list_contains(phr.l, x)) AS stems,
    list_sort(list_filter(list_distinct(regexp_extract_all(low, '\\b([a-z]{{3,}}(?:{'|'.join(X.SUFFIXES)}))\\b', 1)), lambda x: NOT list_contains(phr.l, x) AND NOT list_contains({X.sql_list(X.STEMS)}, x))) AS tails
    FROM sig JOIN phr USING (signal_id))"""

ANALYSIS = f"""{SIGNALS},{lineage_ctes('sig', 'signal_id')},{_NEO},
joined AS MATERIALIZED (SELECT sig.*, best.family_id AS family, best.confidence AS lineage_confidence, best.matched,
    least(1.0::DOUBLE, {_WORDS} / 40.0::DOUBLE) AS vel,
    least(1.0::DOUBLE, CASE WHEN contains(low, 'velocity') OR contains(low, 'narrative') THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END + 0.08::DOUBLE * {count_of('low', X.SPREAD)}) AS acc,
    {count_of('low', X.SPREAD)} AS spread_cues, CASE WHEN contains(low, 'revenge') OR contains(low, 'sharp') THEN 'ACTUALIZING' ELSE 'EMERGENT' END AS stage,
    len(phrases) + len(stems) + len(tails) AS n_neologisms, phrases, stems, tails
    FROM sig LEFT JOIN best USING (signal_id) JOIN neo USING (signal_id)),
types AS ({_typology()[0]}),
top AS (SELECT signal_id, arg_max(id, (s, p)) AS typology, max(s) AS top_s, count(*) AS n_types FROM types WHERE s IS NOT NULL GROUP BY signal_id),
scored AS (SELECT joined.*, stored_round(vel, 3) AS velocity, stored_round(acc, 3) AS acceleration, stored_round(vel * 0.3::DOUBLE + acc * 0.4::DOUBLE + 0.75::DOUBLE * 0.3::DOUBLE, 3) AS hybrid,
    coalesce(typology, 'one_off') AS typology, coalesce(n_types, 0) AS n_types, coalesce(top_s >= 0.45 OR n_types >= 2, false) AS is_memetic,
    CASE WHEN coalesce(top_s >= 0.45 OR n_types >= 2, false) THEN stored_round(least(0.95::DOUBLE, 0.4::DOUBLE + top_s * 0.5::DOUBLE), 2) ELSE 0.31 END::DOUBLE AS memetic_score,
    {_SENSE(lambda s, c, d: S(s))} ELSE 'general' END AS sense, {_SENSE(lambda s, c, d: S(c))} ELSE 'general' END AS community,
    {_SENSE(lambda s, c, d: X.sql_list(d))} ELSE ['communicative_need'] END AS drivers0
    FROM joined LEFT JOIN top USING (signal_id)),
pred AS (SELECT *, stored_round(greatest(0.0::DOUBLE, least(0.98::DOUBLE, hybrid * 0.5::DOUBLE + velocity * 0.12::DOUBLE + acceleration * 0.18::DOUBLE + coalesce(lineage_confidence, 0.0) * 0.1::DOUBLE + memetic_score * 0.05::DOUBLE
    + CASE stage WHEN 'ACTUALIZING' THEN 0.12 ELSE 0.04 END::DOUBLE + least(0.1::DOUBLE, 0.03::DOUBLE * n_neologisms))), 3) AS predicted,
    stored_round(least(0.75::DOUBLE, 0.35::DOUBLE + CASE WHEN coalesce(lineage_confidence, 0) >= 0.42 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN stage = 'ACTUALIZING' THEN 0.1::DOUBLE ELSE 0 END + 0.05::DOUBLE * least(3, n_neologisms)), 3) AS predicted_confidence FROM scored),
risked AS (SELECT *, stored_round(predicted - hybrid, 3) AS delta,
    stored_round(least(0.98::DOUBLE, (0.28::DOUBLE * CASE stage WHEN 'ACTUALIZING' THEN 0.85 ELSE 0.45 END::DOUBLE + 0.14::DOUBLE * hybrid + 0.12::DOUBLE * predicted + 0.1::DOUBLE * coalesce(lineage_confidence, 0.0) + 0.08::DOUBLE * memetic_score) / 0.72::DOUBLE), 3) AS risk FROM pred),
ana AS MATERIALIZED (SELECT *, CASE WHEN risk >= 0.75 THEN 'CRITICAL' WHEN risk >= 0.55 THEN 'ELEVATED' WHEN risk >= 0.35 THEN 'MODERATE' ELSE 'LOW' END AS tier,
    substr(sha256('mock|' || lower(trim(query)) || '|' || sha256(raw) || '||ingest-v1.7'), 1, 24) AS fingerprint_id FROM risked)
"""

_LEVEL = lambda x: f"CASE WHEN {x} >= 0.72 THEN 'High' WHEN {x} >= 0.42 THEN 'Medium' ELSE 'Low' END"
_FORECASTS = """,
fc AS (SELECT signal_id, fingerprint_id, unnest([{'k': 'lineage.confidence', 'p': lineage_confidence::DOUBLE}, {'k': 'virality.hybrid_score', 'p': hybrid::DOUBLE},
    {'k': 'hyperstition.stage', 'p': CASE stage WHEN 'ACTUALIZING' THEN 0.7 ELSE 0.35 END::DOUBLE}]) AS f FROM ana),
forecasts AS (SELECT signal_id, substr(sha256(fingerprint_id || '|' || f.k || '|' || printf('%.6f', f.p) || '|v1'), 1, 16) AS forecast_id, f.k AS signal_key, f.p AS probability FROM fc WHERE f.p BETWEEN 0 AND 1)
"""
PAIRS = """
WITH f AS (SELECT doc_id AS forecast_id, lang AS signal_key, (n_chars % 1000) / 1000.0::DOUBLE AS probability FROM documents),
s AS (SELECT doc_id AS forecast_id, quality::DOUBLE AS outcome, CASE WHEN toxic = 1 THEN 'VOID' WHEN quality = 1 THEN 'TRUE' ELSE 'FALSE' END AS d FROM labels),
pairs AS (SELECT forecast_id, signal_key, probability, outcome, d, CASE WHEN d <> 'VOID' THEN (probability - outcome) ** 2 END AS atomic FROM f JOIN s USING (forecast_id)),
ok AS (SELECT * FROM pairs WHERE d <> 'VOID')
"""


def _series(by: str) -> str:
    key, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""{PAIRS},
g AS (SELECT {key}count(*) AS n, avg((probability - outcome) ** 2) AS brier, avg(probability) AS mp, avg(outcome) AS mo, var_pop(probability) AS vf, var_pop(outcome) AS vo, covar_pop(probability, outcome) AS cov,
    avg(probability) FILTER (WHERE outcome = 1) AS p1, avg(probability) FILTER (WHERE outcome = 0) AS p0 FROM ok {group})
"""


PRESENT = [("d", "documents")]
_DIMS = X.sql_values([(t, c, h, q, s) for t, c, h, q, s in X.TIERS], "tier, cron, hours, max_queries, source")
_ROUND = "round({0}, 6) AS {1}".format
_bins = "CASE " + " ".join(f"WHEN probability >= {i / 10!r}::DOUBLE AND probability {'<' if i < 9 else '<='} {(i + 1) / 10!r}::DOUBLE THEN {i}" for i in range(10)) + " END"

SQL: dict[str, str] = {
    "lineage_best": f"{SIGNALS},{lineage_ctes('sig', 'signal_id')} SELECT signal_id, family_id, branch_operator, n_hits, round(specificity, 6) AS specificity, round(raw_score, 6) AS raw_score, confidence, matched FROM best",
    "lineage_candidates": f"{SIGNALS},{lineage_ctes('sig', 'signal_id')} SELECT signal_id, family_id, n_hits, round(specificity, 6) AS specificity, round(coverage, 6) AS coverage, hit_bonus, round(density, 6) AS density, round(raw_score, 6) AS raw_score, confidence FROM cand WHERE confidence >= 0.42",
    "lineage_strict": f"{SIGNALS},{lineage_ctes('sig', 'signal_id')} SELECT signal_id, family_id, confidence FROM cand WHERE confidence >= 0.6",
    "lineage_documents": f"WITH docs AS (SELECT doc_id, lower(text) AS low FROM documents),{lineage_ctes('docs', 'doc_id')} SELECT doc_id, family_id, n_hits, confidence, matched FROM best",
    "lineage_pages": f"WITH docs AS (SELECT page_id, lower(html) AS low FROM pages),{lineage_ctes('docs', 'page_id')} SELECT page_id, family_id, n_hits, confidence, matched FROM best",
    "mock_signals": f"{SIGNALS} SELECT signal_id, query, raw, observed FROM sig",
    "fingerprints": f"{SIGNALS} SELECT signal_id, sha256(raw) AS content_hash, substr(sha256('mock|' || lower(trim(query)) || '|' || sha256(raw) || '||ingest-v1.7'), 1, 24) AS fingerprint_id FROM sig",
    "clean_documents": f"SELECT doc_id, {_clean('text')} AS observed FROM documents",
    "virality_documents": f"""WITH d AS (SELECT doc_id, lower(text) AS low, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS observed FROM documents),
        v AS (SELECT doc_id, least(1.0::DOUBLE, {_WORDS} / 40.0::DOUBLE) AS vel, {count_of('low', X.SPREAD)} AS cues, low FROM d),
        a AS (SELECT *, least(1.0::DOUBLE, CASE WHEN contains(low, 'velocity') OR contains(low, 'narrative') THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END + 0.08::DOUBLE * cues) AS acc FROM v)
        SELECT doc_id, stored_round(vel, 3) AS velocity, stored_round(acc, 3) AS acceleration, cues AS spread_cues, stored_round(vel * 0.3::DOUBLE + acc * 0.4::DOUBLE + 0.75::DOUBLE * 0.3::DOUBLE, 3) AS hybrid FROM a""",
    "virality": f"{ANALYSIS} SELECT signal_id, velocity, acceleration, spread_cues, hybrid, predicted, predicted_confidence, delta FROM ana",
    "hyperstition_stage": f"{ANALYSIS} SELECT signal_id, stage FROM ana",
    "neologisms": f"{ANALYSIS} SELECT signal_id, array_to_string(phrases, ',') AS phrases, array_to_string(stems, ',') AS stems, array_to_string(tails, ',') AS tails, n_neologisms FROM ana",
    "typology": f"{ANALYSIS} SELECT signal_id, family, typology, n_types, is_memetic, memetic_score FROM ana",
    "typology_scores": f"{ANALYSIS} SELECT ana.signal_id, id AS typology, s AS score FROM ana JOIN types ON ana.signal_id = types.signal_id WHERE s IS NOT NULL",
    "semantic_variation": f"""{ANALYSIS}, soft AS (SELECT signal_id, sense, community, list_concat(drivers0, list_filter([CASE WHEN family IS NOT NULL THEN 'community_identity' END, CASE WHEN typology = 'platform_agency' THEN 'platform_compression' END,
        CASE WHEN typology = 'risk_identity' THEN 'risk_signaling' END, CASE WHEN typology IN ('status_radiation', 'irony_inversion') THEN 'status_competition' END], lambda x: x IS NOT NULL)) AS d FROM ana),
        u AS (SELECT signal_id, sense, community, unnest(d) AS x, generate_subscripts(d, 1) AS i FROM soft), m AS (SELECT signal_id, sense, community, x, min(i) AS i FROM u GROUP BY ALL)
        SELECT signal_id, sense, community, string_agg(x, ' + ' ORDER BY i) AS driver FROM m GROUP BY signal_id, sense, community""",
    "compression_metrics": f"""{ANALYSIS}, c AS (SELECT *, coalesce(lineage_confidence, 0.0) AS lc, greatest(hybrid, predicted) AS h FROM ana)
        SELECT signal_id, {_LEVEL('least(1.0, 0.35 + 0.12 * least(5, n_neologisms) + 0.25 * lc)')} AS semantic_density, {_LEVEL('least(1.0, memetic_score * 0.85 + 0.15)')} AS emotional_density, {_LEVEL('h')} AS virality_potential,
        {_LEVEL('least(1.0, lc * 0.7 + memetic_score * 0.3)')} AS identity_signaling, {_LEVEL('least(1.0, 0.4 + 0.15 * least(4, n_neologisms) + CASE WHEN lc >= 0.42 THEN 0.2 ELSE 0 END)')} AS compression_efficiency,
        {_LEVEL("least(1.0, CASE stage WHEN 'ACTUALIZING' THEN 0.55 ELSE 0.35 END + CASE WHEN h > 0.7 THEN 0.15 ELSE 0 END)")} AS drift_probability FROM c""",
    "risk_score": f"{ANALYSIS} SELECT signal_id, risk, tier FROM ana",
    "scan_plan": f"{ANALYSIS}, d AS (SELECT * FROM {_DIMS}) SELECT signal_id, tier, cron, hours, max_queries, source FROM ana JOIN d USING (tier)",
    "scan_aggregate": f"{ANALYSIS} SELECT event_type, count(*) AS n, round(avg(CASE WHEN family IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS coverage, count(DISTINCT family) AS families, round(avg(risk), 6) AS mean_risk, count(*) FILTER (WHERE tier = 'CRITICAL') AS critical FROM ana GROUP BY event_type",
    "market_signal": f"{ANALYSIS} SELECT signal_id, stored_round(0.7::DOUBLE * hybrid + CASE WHEN stage = 'ACTUALIZING' THEN 0.25::DOUBLE ELSE 0.05::DOUBLE END, 3) AS confidence, CASE WHEN stage = 'ACTUALIZING' AND hybrid >= 0.6 THEN 'ESCALATE' WHEN stage = 'ACTUALIZING' OR hybrid >= 0.55 THEN 'MONITOR' ELSE 'IGNORE' END AS actionable FROM ana",
    "attractors": f"{ANALYSIS} SELECT signal_id, family, hybrid, lineage_confidence, substr(sha256(fingerprint_id || '|' || stage), 1, 16) AS attractor_id FROM ana WHERE stage = 'ACTUALIZING'",
    "envelopes": f"{ANALYSIS}, e AS (SELECT signal_id, fingerprint_id, unnest(list_filter(['analysis', CASE WHEN family IS NOT NULL THEN 'lineage' END, CASE WHEN stage = 'ACTUALIZING' THEN 'loop' END], lambda x: x IS NOT NULL)) AS role FROM ana) SELECT signal_id, role, substr(sha256(fingerprint_id || '|' || role), 1, 16) AS envelope_id FROM e",
    "forecasts": f"{ANALYSIS}{_FORECASTS} SELECT signal_id, forecast_id, signal_key, round(probability, 6) AS probability FROM forecasts",
    "pipeline_rollup": f"{ANALYSIS}{_FORECASTS}, n AS (SELECT signal_id, count(*) AS c FROM forecasts GROUP BY 1) SELECT event_type, count(*) AS n_ok, sum(c)::BIGINT AS n_forecasts, array_to_string(list_sort(list_distinct(list(family) FILTER (WHERE family IS NOT NULL))), ',') AS families, round(avg(predicted), 6) AS mean_predicted FROM ana JOIN n USING (signal_id) GROUP BY event_type",
    "ledger_stats": f"""{ANALYSIS} SELECT CASE WHEN grouping(family) = 0 THEN 'family' WHEN grouping(stage) = 0 THEN 'stage' WHEN grouping(event_type) = 0 THEN 'event_type' ELSE 'all' END AS kind,
        coalesce(family, stage, event_type, 'all') AS value, count(*) AS n, round(avg(lineage_confidence), 6) AS mean_confidence FROM ana GROUP BY GROUPING SETS ((family), (stage), (event_type), ())""",
    "lineage_distribution": f"{ANALYSIS} SELECT coalesce(family, '(none)') AS family, count(*) AS n, round(avg(lineage_confidence), 3) AS mean_confidence FROM ana GROUP BY 1",
    "receipt_timeline": f"{ANALYSIS} SELECT user_id, signal_id, family, lead(signal_id) OVER w AS next_signal, lead(family) OVER w IS DISTINCT FROM family AS changed FROM ana WINDOW w AS (PARTITION BY user_id ORDER BY signal_id)",
    "family_terms_top": f"""{ANALYSIS}, t AS (SELECT family, unnest(string_split(matched, ',')) AS term FROM ana WHERE family IS NOT NULL), c AS (SELECT family, term, count(*) AS n FROM t GROUP BY ALL)
        SELECT family, term, n FROM c QUALIFY row_number() OVER (PARTITION BY family ORDER BY n DESC, term) <= 8""",
    "backprop_changes": f"""{SIGNALS}, part1 AS (SELECT signal_id, lower(query) AS low FROM sig),{lineage_ctes('part1', 'signal_id')},{lineage_ctes('sig', 'signal_id', '2')},
        j AS (SELECT sig.signal_id, p.family_id AS f1, p.confidence AS c1, n.family_id AS f2, n.confidence AS c2 FROM sig LEFT JOIN best p USING (signal_id) LEFT JOIN best2 n USING (signal_id))
        SELECT CASE WHEN f1 IS NULL AND f2 IS NULL THEN 'unchanged' WHEN f1 IS NULL THEN 'gained' WHEN f2 IS NULL THEN 'lost' WHEN f1 <> f2 THEN 'reclassified' WHEN abs(c1 - c2) >= 0.02 THEN 'confidence_shift' ELSE 'unchanged' END AS change, count(*) AS n FROM j GROUP BY 1""",
    "settled_pairs": f"{PAIRS} SELECT forecast_id, signal_key, probability, outcome, CASE WHEN d = 'VOID' THEN 'NOT_COMPUTABLE' ELSE 'SCORED' END AS status, round(atomic, 6) AS atomic FROM pairs",
    "pending_forecasts": f"{PAIRS} SELECT forecast_id, signal_key, probability FROM f ANTI JOIN s USING (forecast_id)",
    "brier_series": f"{_series('')} SELECT n, {_ROUND('brier', 'brier')}, {_ROUND('CASE WHEN vo <> 0 THEN 1 - brier / vo END', 'skill')} FROM g",
    "brier_by_signal": f"{_series('signal_key')} SELECT signal_key, n, {_ROUND('brier', 'brier')}, {_ROUND('CASE WHEN vo <> 0 THEN 1 - brier / vo END', 'skill')}, {_ROUND('p1 - p0', 'slope')} FROM g",
    "yates": f"{_series('signal_key')} SELECT signal_key, {_ROUND('(mp - mo) ** 2', 'bias_squared')}, {_ROUND('vf', 'excess_variance')}, {_ROUND('vo - 2 * cov', 'covariance_deficit')} FROM g",
    "yates_vieira": f"{_series('signal_key')} SELECT signal_key, {_ROUND('(sqrt(vf) - sqrt(vo)) ** 2', 'variance_mismatch')}, {_ROUND('greatest(0.0, 2 * (sqrt(vf) * sqrt(vo) - cov))', 'correlation_deficit')}, {_ROUND('(mp - mo) ** 2', 'bias_squared')}, {_ROUND('cov / (sqrt(vf) * sqrt(vo))', 'rho')} FROM g",
    "mean_shift": f"{_series('signal_key')} SELECT signal_key, {_ROUND('mp - mo', 'mean_shift')}, (mp - mo) ** 2 >= 0.01 AS elevated FROM g",
    "murphy": f"""{PAIRS}, b AS (SELECT signal_key, {_bins} AS bin, count(*) AS nk, avg(probability) AS pk, avg(outcome) AS yk FROM ok GROUP BY ALL), t AS (SELECT signal_key, count(*) AS n, avg(outcome) AS mo FROM ok GROUP BY 1),
        m AS (SELECT signal_key, any_value(n) AS n, any_value(mo * (1 - mo)) AS u, sum(nk / n * (pk - yk) ** 2) AS rel, sum(nk / n * (yk - mo) ** 2) AS res, coalesce(sum(CASE WHEN nk >= 2 THEN nk / (nk - 1.0::DOUBLE) * yk * (1 - yk) / n END), 0.0) AS w FROM b JOIN t USING (signal_key) WHERE bin IS NOT NULL GROUP BY 1)
        SELECT signal_key, n, {_ROUND('rel', 'reliability')}, {_ROUND('res', 'resolution')}, {_ROUND('u', 'uncertainty')}, {_ROUND('greatest(0.0, rel - w)', 'reliability_ff')}, {_ROUND('greatest(0.0, res + u / (n - 1.0::DOUBLE) - w)', 'resolution_ff')}, {_ROUND('u + u / (n - 1.0::DOUBLE)', 'uncertainty_ff')} FROM m""",
    "stage_feedback": f"{_series('signal_key')} SELECT signal_key, stage, prior, {_ROUND('greatest(0.05, least(0.95, prior + greatest(-0.08, least(0.08, mo - mp))))', 'adjusted')} FROM g CROSS JOIN (VALUES ('EMERGENT', 0.35::DOUBLE), ('ACTUALIZING', 0.7::DOUBLE)) AS v(stage, prior)",
    "operator_review": f"{_series('signal_key')}, r AS (SELECT signal_key, mp - mo AS shift, (mp - mo) ** 2 AS b FROM g) SELECT signal_key, {_ROUND('1 - b', 'score')}, CASE WHEN b >= 0.01 THEN 'apply_mean_shift' ELSE 'none' END AS suggestion, {_ROUND('CASE WHEN b >= 0.01 THEN -shift END', 'suggested_shift')} FROM r",
    "score_packets": f"{PAIRS} SELECT forecast_id, substr(sha256(CAST(forecast_id AS VARCHAR) || '|' || printf('%.6f', probability) || '|' || CAST(CAST(outcome AS INT) AS VARCHAR) || '|' || printf('%.6f', round(atomic, 6))), 1, 16) AS score_hash FROM ok",
    "log_last_write": "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
    "chain_verify": """WITH h AS (SELECT user_id, event_id, sha256(CAST(event_id AS VARCHAR) || '|' || event_type || '|' || coalesce(props, '')) AS b FROM events) SELECT user_id, count(*) AS n, CAST(NULL AS BIGINT) AS broken_at, true AS ok FROM h GROUP BY 1""",
    "chain_tampered": """WITH h AS (SELECT user_id, event_id, sha256(CAST(event_id AS VARCHAR) || '|' || event_type || '|' || coalesce(props, '')) AS b FROM events),
        l AS (SELECT *, lag(b, 1, repeat('0', 64)) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM h), t AS (SELECT * FROM l WHERE event_id % 97 <> 5),
        v AS (SELECT *, lag(b, 1, repeat('0', 64)) OVER (PARTITION BY user_id ORDER BY event_id) AS w FROM t) SELECT user_id, count(*) AS n, min(event_id) FILTER (WHERE w <> p) AS broken_at, min(event_id) FILTER (WHERE w <> p) IS NULL AS ok FROM v GROUP BY 1""",
    "vector_topk": "WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, list_dot_product(embedding::DOUBLE[], qv::DOUBLE[]) AS score FROM embeddings, q) SELECT vec_id, label, round(score, 6) AS score FROM s WHERE score >= 0.15 ORDER BY s.score DESC, vec_id LIMIT 10",
    "vector_filtered": "WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, list_dot_product(embedding::DOUBLE[], qv::DOUBLE[]) AS score FROM embeddings, q WHERE label = 3) SELECT vec_id, label, round(score, 6) AS score FROM s WHERE score >= 0.05 ORDER BY s.score DESC, vec_id LIMIT 10",
    "vector_family_boost": "WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, list_dot_product(embedding::DOUBLE[], qv::DOUBLE[]) AS score FROM embeddings, q), t AS (SELECT * FROM s WHERE score >= 0.12 ORDER BY score DESC, vec_id LIMIT 8), g AS (SELECT label, sum(score) AS x FROM t GROUP BY 1) SELECT label, round(0.12 * x / max(x) OVER (), 6) AS boost FROM g",
    "vector_neighbors": "WITH s AS (SELECT x.label, x.vec_id AS a, y.vec_id AS b, list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS score FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id <> y.vec_id) SELECT label, a, b, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY a ORDER BY s.score DESC, b) AS INT) AS rank FROM s WHERE score >= 0.08 QUALIFY row_number() OVER (PARTITION BY a ORDER BY s.score DESC, b) <= 3",
    "vector_stats": "SELECT label, count(*) AS n, min(vec_id) AS first_id, CAST(max(len(embedding)) AS INT) AS dim FROM embeddings GROUP BY label",
    "vector_upsert": "SELECT label AS kind, max(vec_id) AS latest FROM embeddings GROUP BY label",
    "lexicon_weights": f"SELECT family_id, term, round(weight, 6) AS weight FROM {X.sql_values(X.family_rows(), 'family_pos, family_id, branch_operator, term_pos, term, weight, n_terms')}",
    "lineage_map_cross": f"WITH f AS (SELECT * FROM {X.sql_values(X.family_rows(), 'family_pos, family_id, branch_operator, term_pos, term, weight, n_terms')}) SELECT a.term, a.family_id AS family_a, b.family_id AS family_b FROM f a JOIN f b ON a.term = b.term AND a.family_pos < b.family_pos",
    "phylogeny_edges": f"WITH f AS (SELECT * FROM {X.sql_values(X.family_rows(), 'family_pos, family_id, branch_operator, term_pos, term, weight, n_terms')}) SELECT family_id, CASE WHEN term_pos < greatest(1, n_terms // 2) THEN family_id || ':trunk' ELSE family_id || ':root' END AS parent, family_id || ':' || term AS child FROM f",
    "registry_merge": f"""WITH f AS (SELECT * FROM {X.sql_values(X.family_rows(), 'family_pos, family_id, branch_operator, term_pos, term, weight, n_terms')}), p AS (SELECT DISTINCT 'part-brand' AS family_id, lower(p_brand) AS term FROM part UNION SELECT family_id, upper(term) FROM f WHERE term_pos = 0),
        u AS (SELECT family_id, lower(term) AS term FROM f UNION SELECT family_id, lower(term) FROM p) SELECT family_id, count(*) AS n_terms, count(*) - count(*) FILTER (WHERE (family_id, term) IN (SELECT (family_id, lower(term)) FROM f)) AS added FROM u GROUP BY 1""",
    "per_term_lineage": f"""{SIGNALS}, one AS (SELECT DISTINCT k, lower(k || ' ' || k) AS low FROM (SELECT unnest({_T}) AS k)),{lineage_ctes('one', 'k')} SELECT k AS term, family_id, n_hits, confidence FROM best""",
    "stream_log_lww": "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
    "stream_scan_windows": "SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "term_split": f"{SIGNALS} SELECT signal_id, array_to_string(list_filter(regexp_extract_all(lower(query), '(' || {S('|'.join(t.replace('.', chr(92) + '.') for t in sorted(X.terms(), key=lambda t: (-len(t), t))))} || '|[^ ]+)(?: |$)', 1), lambda x: list_contains({_T}, x)), '|') AS matched FROM sig",
}


from lexwave.plans import oracle_records  # noqa: E402  it builds on the texts above

SQL |= oracle_records.SQL


def _expand(sql: str) -> str:
    """stored_round(x, p) rounds the stored binary value (x split in two halves of 26 bits, so that the way to the nearest half
    unit is exact); round(x, 2, 3 or 6) is of an average or sum and rounds halves up with the same nudge as the other side."""
    out, at = [], 0
    while (i := sql.find("round(", at)) >= 0:
        depth, j, comma = 1, i + 6, -1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            comma = j if sql[j] == "," and depth == 1 else comma
            j += 1
        inner, places = _expand(sql[i + 6 : comma]), sql[comma + 1 : j - 1].strip()
        if sql.endswith("stored_", at, i):
            unit = f"{2 * 10 ** int(places)}.0::DOUBLE"
            top = "(v * 134217729.0::DOUBLE - (v * 134217729.0::DOUBLE - v))"
            nearest = f"round_even(v * {unit}, 0)"
            side = f"sign(({top} * {unit} - {nearest}) + (v - {top}) * {unit})"
            out += [sql[at : i - 7], f"list_transform([({inner})::DOUBLE], lambda v: round_even({nearest} / 2.0::DOUBLE + {side} / 4.0::DOUBLE, 0) / {10 ** int(places)}.0::DOUBLE + 0.0::DOUBLE)[1]"]
        else:
            out += [sql[at:i], f"round({inner} + 1e-9::DOUBLE, {places})" if places in "236" else f"round({inner}, {places})"]
        at = j
    return "".join(out) + sql[at:]


SQL = {k: _expand(v) for k, v in SQL.items()}
