"""DuckDB SQL of the queries over records (receipts, settlements, packs, inbox, archive, reads)."""

from __future__ import annotations

import re

from lexwave.plans.oracle import _ROUND, ANALYSIS, PAIRS, SIGNALS, S, _series, _T, lineage_ctes
from lexwave.sources import catalog as A
from lexwave.sources import lexicon as X

_FAMILY = X.sql_values(X.family_rows(), "family_pos, family_id, branch_operator, term_pos, term, weight, n_terms")
_FIRST = lambda l: f"list_filter({l}, lambda x, i: list_position({l}, x) = i)"  # noqa: E731  each once, in order
_SPLIT = f"list_filter(regexp_extract_all(lower(query), '(' || {S('|'.join(t for t in sorted(X.terms(), key=lambda t: (-len(t), t))))} || '|[^ ]+)(?: |$)', 1), lambda x: list_contains({_T}, x))"
_SOFT = """list_concat(drivers0, list_filter([CASE WHEN family IS NOT NULL THEN 'community_identity' END, CASE WHEN typology = 'platform_agency' THEN 'platform_compression' END,
    CASE WHEN typology = 'risk_identity' THEN 'risk_signaling' END, CASE WHEN typology IN ('status_radiation', 'irony_inversion') THEN 'status_competition' END], lambda x: x IS NOT NULL))"""
_TAGS = f""", oth AS (SELECT signal_id, list(id ORDER BY s DESC, p DESC) AS others FROM types WHERE s >= 0.45 GROUP BY 1),
tag1 AS (SELECT ana.*, list_concat(CASE WHEN typology <> 'one_off' THEN [typology] ELSE [] END, coalesce(others, []), CASE WHEN family IS NOT NULL THEN ['lineage:' || family] ELSE [] END, {_SOFT}, ['hyperstition_' || lower(stage)]) AS l FROM ana LEFT JOIN oth USING (signal_id)),
tag AS (SELECT *, {_FIRST('l')}[1:8] AS tags FROM tag1)"""
_HASH = "substr(sha256(fingerprint_id || '|' || substr(observed, 1, 100) || '|' || CAST(n_neologisms AS VARCHAR) || '|' || query), 1, 16)"
_F6 = lambda c: f"coalesce(printf('%.6f', {c}), '')"
_INTEGRITY = f"substr(sha256(CAST(signal_id AS VARCHAR) || '|' || query || '|' || observed || '|' || coalesce(family, '') || '|' || {_F6('lineage_confidence')} || '|' || typology || '|' || stage || '|' || {_F6('hybrid')} || '|' || {_F6('predicted')} || '|' || CAST(n_neologisms AS VARCHAR) || '|' || fingerprint_id || '|' || canonical_hash), 1, 12)"
_RECEIPTS = f", rec0 AS (SELECT *, {_HASH} AS canonical_hash FROM ana), rec AS MATERIALIZED (SELECT *, {_INTEGRITY} AS integrity FROM rec0)"

# the analysis under a registry without its third family: the same steps under other names
_NAMES = ("fam", "tok", "hit", "agg", "raw1", "raw2", "cand", "best", "joined", "types", "top", "scored", "pred", "risked", "ana", "rec0", "rec")


def _other_registry() -> str:
    body = lineage_ctes("sig", "signal_id", rows=[r for r in X.family_rows() if r[0] != 2]) + ",\njoined AS" + (ANALYSIS + _RECEIPTS).split("\njoined AS", 1)[1]
    for name in _NAMES:
        body = re.sub(rf"\b{name}\b", f"{name}_b", body)
    return "," + body


PACKS = f"""packs AS (SELECT p_partkey % 8 * 1000000000 + p_partkey AS pos, p_partkey % 8 + 1 AS month, '2026-0' || CAST(p_partkey % 8 + 1 AS VARCHAR) AS label,
    trim(CASE WHEN p_partkey % 5 = 0 THEN ({_T})[p_partkey % {len(X.terms())} + 1] WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE lower(p_brand) END) AS term,
    coalesce(({X.sql_list(f for f, _, _ in X.FAMILIES)})[p_size % 9 + 1], 'unknown') AS family_id,
    CASE WHEN p_size % 4 <> 0 THEN ['high', 'medium', 'low'][p_size % 3 + 1] ELSE 'medium' END AS prominence, CASE WHEN p_partkey % 2 = 0 THEN 'OBSERVED' ELSE 'INFERRED' END AS provenance FROM part)"""
_INVENTORY = "SELECT 'family' AS kind, family_id AS value, count(DISTINCT lower(term)) AS n FROM p GROUP BY 2 UNION ALL SELECT 'provenance', provenance, count(*) FROM p GROUP BY 2 UNION ALL SELECT 'prominence', prominence, count(*) FROM p GROUP BY 2"
_DECISIONS = """d AS (SELECT doc_id AS forecast_id, CASE WHEN doc_id % 13 = 5 THEN 0.5 ELSE quality END::DOUBLE AS outcome, upper(CASE WHEN doc_id % 11 = 3 THEN 'maybe' WHEN toxic = 1 THEN 'void' WHEN quality = 1 THEN 'true' ELSE 'FALSE' END) AS settlement_decision FROM labels),
e AS (SELECT *, CASE WHEN outcome NOT IN (0, 1) THEN 'outcome must be 0.0 or 1.0' WHEN settlement_decision = 'MAYBE' THEN 'decision must be TRUE|FALSE|VOID|CONFLICT' END AS error FROM d)"""
_LOG = f"{PAIRS}, {_DECISIONS}, st AS (SELECT * FROM e JOIN f USING (forecast_id) WHERE error IS NULL)"


def _transmission(runs: str, n: int = 6, steps: int = 12) -> str:
    """sim over runs(run_id, beta, gamma, hybrid): a row a run."""
    state = [f"s{j}" for j in range(n)]
    new = []
    for j in range(n):
        inflow = "(0.0::DOUBLE + " + " + ".join(f"s{i} * {(1.0 / abs(i - j) if abs(i - j) <= 2 else 0.08 / abs(i - j))!r}::DOUBLE" for i in range(n) if i != j) + f") / {n - 1}"
        new.append(f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, s{j} + eff * ({inflow}) * (1 - s{j}) * {1 - (0.05 + 0.12 * j / (n - 1))!r}::DOUBLE - gamma * s{j}))")
    mean = f"round((0.0::DOUBLE + {' + '.join(state)}) / {n}, 4)"
    return f"""
walk AS (SELECT run_id, beta, gamma, hybrid, least(1.0::DOUBLE, beta * (0.55::DOUBLE + 0.9::DOUBLE * hybrid)) AS eff, 0 AS step, {', '.join(f'{0.85 if j == 0 else 0.0}::DOUBLE AS s{j}' for j in range(n))} FROM {runs}
    UNION ALL SELECT run_id, beta, gamma, hybrid, eff, step + 1, {', '.join(new)} FROM walk WHERE step < {steps}),
means AS (SELECT *, {mean} AS m, ({' + '.join(f'CAST(s{j} >= 0.25 AS INT)' for j in range(n))}) / {n}.0::DOUBLE AS share FROM walk),
sim AS (SELECT run_id, any_value(beta) AS beta, any_value(gamma) AS gamma, any_value(hybrid) AS hybrid, arg_max(m, step) AS final_mean, greatest(0.85::DOUBLE, max(m)) AS peak,
    CASE WHEN max(m) > 0.85 THEN arg_min(step, (-m, step)) ELSE 0 END AS time_to_peak, max(m) AS max_mean, arg_max(share, step) AS reach, var_pop(m) FILTER (WHERE step > {steps - 3}) < 0.002 AS stabilizing FROM means GROUP BY run_id)"""


_GRID = f"""{PAIRS.replace('WITH f AS', 'WITH RECURSIVE f AS', 1)}, cells AS (SELECT 4 * i + j AS cell, b AS beta, g AS gamma FROM (VALUES (0, 0.15::DOUBLE), (1, 0.25), (2, 0.35), (3, 0.45), (4, 0.55), (5, 0.65)) AS x(i, b), (VALUES (0, 0.04::DOUBLE), (1, 0.08), (2, 0.12), (3, 0.16)) AS y(j, g)),
    runs AS (SELECT {{'c': cell, 'f': forecast_id, 'o': outcome}} AS run_id, beta, gamma, probability AS hybrid FROM ok, cells), {_transmission('runs')},
    mae AS (SELECT run_id.c AS cell, beta, gamma, round(avg(abs(peak - run_id.o)), 6) AS mae, count(*) AS n FROM sim GROUP BY ALL)"""
_CLAIMS = "['scan_completed:OBSERVED|lineage_match:' || CASE WHEN family IS NOT NULL THEN 'INFERRED' ELSE 'NOT_COMPUTABLE' END || '|brier:NOT_COMPUTABLE', 'virality_boost:INFERRED|hyperstition_risk:SPECULATIVE|actionable:INFERRED', 'attractor_candidate:SPECULATIVE|hyperstition_stage:INFERRED|brier:NOT_COMPUTABLE']"
_OVERRIDE = [(i, f, "override", j, t, X.weight(t), 3) for i, (f, ts) in enumerate([("function", ["that", "with", "from"]), ("noun", ["thing", "tion", "thor"]), ("phrase", ["of the", "in the", "que la"])]) for j, t in enumerate(ts)]
_fill = lambda t: "(" + S(t.split("{}", 1)[0]) + " || query || " + S(t.split("{}", 1)[1]) + ")"
_names, _routes = [*sorted(A.ALIASES), "nowhere"], [*A.ROUTES, "moon"]
_HINT = [S(h) for h in X.HINTS]

SQL = {
    "sources_resolved": f"""WITH e AS (SELECT event_id, ({X.sql_list(_names)})[event_id % {len(_names)} + 1] AS source, CASE WHEN user_id % 4 = 0 THEN ({X.sql_list(_routes)})[event_id % {len(_routes)} + 1] END AS route FROM events),
        al AS (SELECT * FROM {X.sql_values(list(A.ALIASES.items()), 'a, ac')}), ro AS (SELECT * FROM {X.sql_values(list(A.ROUTES.items()), 'r, rc')}), so AS (SELECT * FROM {X.sql_values([(n, k, int(w)) for n, k, w in A.SOURCES], 'sname, kind, net')}),
        x AS (SELECT e.*, CASE WHEN route IS NOT NULL THEN rc ELSE ac END AS found FROM e LEFT JOIN al ON source = a LEFT JOIN ro ON route = r)
        SELECT event_id, source, route, sname AS resolved, found IS NOT NULL AS ok, net = 1 AS network, kind, CASE WHEN net = 1 THEN 'mock' ELSE sname END AS offline FROM x JOIN so ON sname = coalesce(found, 'mock')""",
    "sources_list": f"SELECT name, kind, net = 1 AS network, aliases FROM {X.sql_values([(n, k, int(w), ','.join(sorted(a for a, c in A.ALIASES.items() if c == n and a != n))) for n, k, w in A.SOURCES], 'name, kind, net, aliases')}",
    "extracted_terms": f"{SIGNALS}, l AS (SELECT signal_id, regexp_extract_all(lower(raw), '\\b([a-z]{{4,}}(?:{'|'.join(X.EXTRACTED)}))\\b', 1) AS l FROM sig) SELECT signal_id, array_to_string({_FIRST('l')}[1:8], ',') AS terms FROM l",
    "glossary_signals": f"{SIGNALS} SELECT signal_id, {' || {} || '.format(S(' || ')).join(f'substr({_fill(t)}, 1, 280)' for t in X.GLOSSARIES)} AS glossaries, substr({_fill(X.GLOSSARIES[0])}, 1, 220) || ' | ' || substr({_fill(X.GLOSSARIES[2])}, 1, 220) || ' | ' || substr({_fill(X.SOCIAL_STUB)}, 1, 220) AS combined FROM sig",
    "glossary_pages": f"""WITH a AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '([A-Z][a-zA-Z\\s]{{2,30}}?)\\s*[\u2014\u2013-]\\s*([A-Za-z][^<]{{15,70}})', 1), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 3) AS l FROM pages),
        b AS (SELECT page_id, {_FIRST('l')}[1:12] AS t FROM a), c AS (SELECT page_id, CASE WHEN len(t) > 0 THEN t ELSE {X.sql_list(X.GLOSSARY_REST)} END AS t FROM b) SELECT page_id, CAST(len(t) AS INT) AS n_terms, array_to_string(t[1:8], ', ') AS terms FROM c""",
    "scan_list": f"{SIGNALS} SELECT trim(query) AS query, min(signal_id) AS pos FROM sig GROUP BY 1",
    "enriched_neologisms": f"""{ANALYSIS}, w AS (SELECT signal_id, n_neologisms, list_concat(phrases, stems, tails) AS known, list_filter(regexp_extract_all(low, '\\b([a-z][a-z0-9_-]{{3,}})\\b', 1), lambda x: NOT list_contains({X.sql_list(X.ECHO_STOP)}, x)) AS l FROM ana),
        v AS (SELECT signal_id, n_neologisms, list_filter({_FIRST('l')}[1:5], lambda x: NOT list_contains(known, x)) AS new FROM w) SELECT signal_id, CAST(n_neologisms + len(new) AS INT) AS n, array_to_string(new, ',') AS added FROM v""",
    "typology_tags": f"{ANALYSIS}{_TAGS} SELECT signal_id, array_to_string(tags, ',') AS tags FROM tag",
    "propagation_vector": f"""{ANALYSIS}, p AS (SELECT signal_id, community, CASE family {' '.join(f'WHEN {S(f)} THEN {X.sql_list(ps)}' for f, ps in X.PLATFORMS.items())} ELSE ['x_twitter'] END AS l FROM ana)
        SELECT signal_id, array_to_string(CASE WHEN (contains(community, 'ai') OR contains(community, 'machine')) AND NOT list_contains(l, 'ai_tech') THEN list_append(l, 'ai_tech') ELSE l END, ',') AS platforms FROM p""",
    "signal_report": f"""{ANALYSIS}{_TAGS} SELECT signal_id, observed, 'PARTIAL' AS status, 'high' AS entropy_class, 'elevated' AS risk_band, 'ingest=mock;stage=' || stage AS provenance, CAST(len(tags) AS INT) AS n_tags,
        {_HINT[0]} || ' ' || {_HINT[1]} || CASE WHEN tier IN ('ELEVATED', 'CRITICAL') THEN ' ' || {_HINT[2]} ELSE '' END || CASE WHEN stage = 'ACTUALIZING' THEN ' ' || {_HINT[3]} ELSE '' END || CASE WHEN tier = 'LOW' THEN ' ' || {_HINT[4]} ELSE '' END AS hints FROM tag""",
    "primary_term": f"""{SIGNALS}, one AS (SELECT DISTINCT k, lower(k || ' ' || k) AS low FROM (SELECT unnest({_T}) AS k)),{lineage_ctes('one', 'k')}, m AS (SELECT signal_id, {_SPLIT} AS l FROM sig), u AS (SELECT signal_id, unnest({_FIRST('l')}) AS term, generate_subscripts({_FIRST('l')}, 1) AS i FROM m)
        SELECT signal_id, arg_max(term, (coalesce(confidence, -1), -i)) AS primary_term, count(*) AS n_terms FROM u LEFT JOIN best ON term = k GROUP BY 1""",
    "scan_queries": f"""{ANALYSIS}, q AS (SELECT signal_id, query, tier, ({X.sql_list(X.DEFAULT_QUERIES)})[1:CASE tier {' '.join(f'WHEN {S(t)} THEN {m}' for t, _, _, m, _ in X.TIERS)} END] AS head, {_SPLIT} AS l FROM ana),
        a AS (SELECT *, CASE WHEN len(l) > 0 THEN {_FIRST('l')} ELSE [trim(query)] END AS atoms FROM q) SELECT signal_id, tier, array_to_string(list_concat(list_filter(atoms, lambda x: NOT list_contains(head, lower(x))), head)[1:len(head)], ',') AS queries FROM a""",
    "scan_recommended": f"{ANALYSIS}, g AS (SELECT event_type, count(*) AS n, avg(CASE WHEN family IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE) AS c, count(DISTINCT family) AS families FROM ana GROUP BY 1) SELECT event_type, n, round(c, 3) AS coverage, families, CASE WHEN c >= 0.85 AND families >= 4 THEN 'ELEVATED' WHEN c >= 0.5 THEN 'MODERATE' ELSE 'LOW' END AS tier FROM g",
    "relay_envelopes": f"""{ANALYSIS}, e AS (SELECT signal_id, fingerprint_id, unnest({X.sql_list(list(X.RUNES)[:3])}) AS rune_id, unnest(['scan', 'signal', 'attractor']) AS role, unnest({_CLAIMS}) AS claims FROM ana)
        SELECT signal_id, rune_id, role, claims, substr(sha256(rune_id || '|' || fingerprint_id || '|' || claims), 1, 20) AS envelope_id FROM e""",
    "relay_series": f"{_series('signal_key')} SELECT signal_key, 'RUNE.HLX.CALIBRATION_SERIES' AS rune_id, 'calibration' AS role, 'operator' AS authority, 'series_brier:OBSERVED|n:OBSERVED' AS claims FROM g",
    "lineage_override": f"WITH docs AS (SELECT doc_id, lower(text) AS low FROM documents),{lineage_ctes('docs', 'doc_id', rows=_OVERRIDE).replace('confidence >= 0.42', 'confidence >= 0.45')} SELECT doc_id, family_id, n_hits, confidence, matched FROM best",
    "backfill_inventory": f"WITH {PACKS}, p AS (SELECT * FROM packs WHERE term <> '') {_INVENTORY}",
    "backfill_through": f"WITH {PACKS}, p AS (SELECT * FROM packs WHERE term <> '' AND month <= 5) {_INVENTORY}",
    "backfill_first_seen": f"WITH {PACKS} SELECT family_id, lower(term) AS term, arg_min(label, pos) AS first_seen_month FROM packs WHERE term <> '' GROUP BY 1, 2",
    "registry_delta": f"""WITH {PACKS}, f AS (SELECT DISTINCT family_id, lower(term) AS t, 1 AS old FROM {_FAMILY}), n AS (SELECT DISTINCT family_id, lower(term) AS t FROM packs WHERE term <> ''), j AS (SELECT family_id, t, old FROM f FULL JOIN n USING (family_id, t))
        SELECT family_id, count(old) AS n_before, count(*) AS n_after, CAST(count(*) - count(old) AS INT) AS n_added, string_agg(t, ',' ORDER BY t) FILTER (WHERE old IS NULL) AS added FROM j GROUP BY 1 HAVING count(*) > count(old)""",
    "family_terms": f"WITH {PACKS}, t AS (SELECT arg_min(term, pos) AS term, min(pos) AS pos FROM packs WHERE term <> '' AND family_id = 'gaming-meta' GROUP BY lower(term)) SELECT term, row_number() OVER (ORDER BY pos) AS rank FROM t",
    "phylogeny_nodes": f"""WITH {PACKS}, s AS (SELECT family_id, lower(term) AS t, arg_min(label, pos) AS first_seen_month FROM packs WHERE term <> '' GROUP BY 1, 2), f AS (SELECT *, term_pos < greatest(1, n_terms // 2) AS trunk FROM {_FAMILY})
        SELECT family_id, family_id || CASE WHEN trunk THEN '::term::' ELSE '::leaf::' END || term AS id, CASE WHEN trunk THEN 'trunk_term' ELSE 'leaf' END AS kind, first_seen_month FROM f LEFT JOIN s ON f.family_id = s.family_id AND lower(f.term) = s.t
        UNION ALL SELECT family_id, family_id || '::' || k, k, NULL FROM (SELECT DISTINCT family_id FROM f), (VALUES ('root'), ('trunk')) AS v(k)""".replace("SELECT family_id, family_id || CASE", "SELECT f.family_id, f.family_id || CASE"),
    "settlements": f"WITH {_DECISIONS} SELECT forecast_id, outcome, settlement_decision, CASE WHEN error IS NULL THEN substr(sha256(CAST(forecast_id AS VARCHAR) || '|' || CAST(outcome AS VARCHAR) || '|' || settlement_decision || '|2026-01-01T00:00:00+00:00'), 1, 16) END AS settlement_id, error FROM e",
    "settle_log": f"""{_LOG}, ev AS (SELECT signal_key, 'forecast' AS event FROM f WHERE forecast_id % 3 = 0 UNION ALL SELECT signal_key, 'forecast' FROM st WHERE forecast_id % 3 <> 0 UNION ALL SELECT signal_key, unnest(['settlement', 'score']) FROM st)
        SELECT signal_key AS chain, count(*) FILTER (WHERE event = 'forecast') AS n_forecast, count(*) FILTER (WHERE event = 'settlement') AS n_settlement, count(*) FILTER (WHERE event = 'score') AS n_score, true AS ok, CAST(NULL AS INT) AS broken_at FROM ev GROUP BY 1""",
    "log_series": f"{_LOG} SELECT signal_key, count(*) AS n, round(avg((probability - outcome) ** 2), 6) AS brier FROM st WHERE settlement_decision IN ('TRUE', 'FALSE') GROUP BY 1",
    "skill_score": f"""{PAIRS}, b AS (SELECT *, lag(outcome) OVER (PARTITION BY signal_key ORDER BY forecast_id) AS before FROM ok), g AS (SELECT signal_key, count(*) AS n, avg((probability - outcome) ** 2) AS bs, var_pop(outcome) AS ref, avg((before - outcome) ** 2) AS rb, avg((probability - outcome) ** 2) FILTER (WHERE before IS NOT NULL) AS ba FROM b GROUP BY 1)
        SELECT signal_key, n, round(CASE WHEN ref <> 0 THEN 1 - bs / ref WHEN bs = 0 THEN 0 END, 6) AS skill, CASE WHEN n >= 2 AND bs = 0 THEN 0.0 END AS skill_persistence, round(CASE WHEN rb <> 0 THEN 1 - ba / rb WHEN ba = 0 THEN 0 END, 6) AS skill_before FROM g""",
    "shifted_series": f"{PAIRS}, g AS (SELECT signal_key, avg(probability) - avg(outcome) AS shift FROM ok GROUP BY 1) SELECT signal_key, count(*) AS n, round(avg((greatest(0.0::DOUBLE, least(1.0::DOUBLE, probability - shift)) - outcome) ** 2), 6) AS brier FROM ok JOIN g USING (signal_key) GROUP BY 1",
    "forecasts_override": f"{ANALYSIS}, o AS (SELECT signal_id, fingerprint_id, CASE stage WHEN 'ACTUALIZING' THEN 0.9 ELSE 0.2 END::DOUBLE AS probability FROM ana) SELECT signal_id, substr(sha256(fingerprint_id || '|hyperstition.stage|' || printf('%.6f', probability) || '|v1'), 1, 16) AS forecast_id, probability FROM o",
    "ledger_entry": f"""{PAIRS}, h AS (SELECT forecast_id, sha256(CAST(forecast_id AS VARCHAR) || '|' || printf('%.6f', probability) || '|' || signal_key || '|v1') AS forecast_hash, sha256(CAST(forecast_id AS VARCHAR) || '|' || printf('%.6f', atomic) || '|' || printf('%.6f', probability) || '|' || printf('%.1f', outcome)) AS score_hash, sha256('lexwave.calibration.v1|' || signal_key || '|v1') AS c FROM ok)
        SELECT forecast_id, forecast_hash, score_hash, sha256(forecast_hash || '|' || score_hash || '|' || c || '|1') AS ledger_hash, substr(sha256(CAST(forecast_id AS VARCHAR) || '|1'), 1, 32) AS entry_id FROM h""",
    "receipt_emit": "SELECT user_id AS chain, count(*) AS n, count(*) AS n_valid, true AS ok, CAST(NULL AS INT) AS broken_at FROM events GROUP BY 1",
    "receipt_verify": "SELECT m = 'valid' AS ok, m AS message, count(*) AS n FROM (SELECT CASE WHEN event_id % 50 = 9 THEN 'missing integrity' WHEN event_id % 50 = 7 THEN 'integrity mismatch' ELSE 'valid' END AS m FROM events) GROUP BY 1, 2",
    "receipt_list": f"{ANALYSIS}{_RECEIPTS} SELECT signal_id, family, stage, 'receipt_' || CAST(signal_id AS VARCHAR) || '_' || integrity AS name FROM rec WHERE family = 'crypto-degen' ORDER BY signal_id DESC LIMIT 50",
    "receipt_index": f"{ANALYSIS}{_RECEIPTS} SELECT signal_id, canonical_hash, integrity FROM rec",
    "receipt_diff": f"""{ANALYSIS}{_RECEIPTS}{_other_registry()}, u AS (SELECT signal_id, unnest(['integrity', 'canonical_hash', 'family', 'lineage_confidence', 'typology', 'hybrid', 'predicted', 'stage', 'n_neologisms']) AS field,
        unnest([rec.integrity, rec.canonical_hash, rec.family, CAST(rec.lineage_confidence AS VARCHAR), rec.typology, CAST(rec.hybrid AS VARCHAR), CAST(rec.predicted AS VARCHAR), rec.stage, CAST(rec.n_neologisms AS VARCHAR)]) AS a,
        unnest([rec_b.integrity, rec_b.canonical_hash, rec_b.family, CAST(rec_b.lineage_confidence AS VARCHAR), rec_b.typology, CAST(rec_b.hybrid AS VARCHAR), CAST(rec_b.predicted AS VARCHAR), rec_b.stage, CAST(rec_b.n_neologisms AS VARCHAR)]) AS b FROM rec JOIN rec_b USING (signal_id))
        SELECT * FROM u WHERE a IS DISTINCT FROM b""",
    "receipt_violations": f"{ANALYSIS} SELECT signal_id, 'family' AS field, 'missing' AS problem FROM ana WHERE family IS NULL UNION ALL SELECT signal_id, 'stage', 'not allowed' FROM ana WHERE signal_id % 40 = 1",
    "inbox_priority": f"{ANALYSIS} SELECT signal_id, stage, 'high' AS priority FROM ana WHERE stage = 'ACTUALIZING' ORDER BY signal_id DESC LIMIT 50",
    "archive_summary": f"{ANALYSIS}{_RECEIPTS} SELECT signal_id, canonical_hash, family, typology, stage, hybrid, lineage_confidence, substr(observed, 1, 240) AS preview, CASE WHEN family IS NOT NULL THEN 'INFERRED' ELSE 'NOT_COMPUTABLE' END AS lineage_label FROM rec",
    "archive_catalog": f"{ANALYSIS}, g AS (SELECT strftime(ts, '%Y-%m-%d') AS snapshot_id, count(*) AS n_receipts, count(family) AS n_with_lineage, count(DISTINCT family) AS n_families, round(avg(lineage_confidence), 6) AS mean_confidence FROM ana GROUP BY 1) SELECT *, CAST(row_number() OVER (ORDER BY snapshot_id DESC) AS INT) AS rank FROM g",
    "vector_seed": f"""{ANALYSIS}{_RECEIPTS}, {PACKS}, i AS (SELECT DISTINCT 'term' AS kind, 'registry' AS source, 'term:' || family_id || ':' || lower(term) AS k FROM {_FAMILY} UNION SELECT 'term', 'backfill', 'term:backfill:' || family_id || ':' || lower(term) FROM packs WHERE term <> '' UNION SELECT 'receipt', 'receipt', 'receipt:' || integrity FROM rec)
        SELECT kind, source, count(*) AS n, min(kind || ':' || substr(sha256(k), 1, 24)) AS first_id FROM i GROUP BY 1, 2""",
    "vector_index": f"""{ANALYSIS}, t AS (SELECT family, unnest(list_concat(CASE WHEN matched IS NULL THEN [] ELSE string_split(matched, ',')[1:12] END, CASE WHEN len(string_split(query, ' ')) <= 4 THEN [query] ELSE [] END)) AS text FROM ana)
        SELECT DISTINCT 'term:' || substr(sha256('term:ingest:' || coalesce(family, '') || ':' || lower(text)), 1, 24) AS id, 'term' AS kind, text, family AS family_id FROM t""",
    "vector_export": "SELECT 'k' || CAST(label AS VARCHAR) AS kind, count(*) AS n, CAST(max(len(embedding)) AS INT) AS dim FROM embeddings WHERE label <> 3 GROUP BY 1",
    "neighbor_edges": """WITH s AS (SELECT x.label, x.vec_id AS a, y.vec_id AS b, list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS score FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id <> y.vec_id),
        t AS (SELECT * FROM s WHERE score >= 0.08 QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 3) SELECT label, least(a, b) AS a, greatest(a, b) AS b, round(max(score), 6) AS score FROM t GROUP BY 1, least(a, b), greatest(a, b)""",
    "stage_cells": f"{PAIRS}, c AS (SELECT signal_key, CASE WHEN d IS NULL THEN 'pending' WHEN d = 'VOID' THEN 'void' ELSE 'settled' END AS state FROM f LEFT JOIN s USING (forecast_id)) SELECT signal_key, state, count(*) AS n FROM c GROUP BY 1, 2",
    "pending_first": f"{PAIRS} SELECT signal_key, CAST(row_number() OVER (PARTITION BY signal_key ORDER BY forecast_id) AS INT) AS rank, forecast_id FROM f ANTI JOIN s USING (forecast_id) QUALIFY rank <= 20",
    "stream_settled": "SELECT a.event_id AS forecast_id, strftime(b.ts, '%Y-%m-%d %H:%M:%S') AS settled_at, round(b.value, 6) AS value FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.event_id % 2 = 0 AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 hour",
    "chain_built": "SELECT user_id, count(*) AS n, true AS ok, CAST(NULL AS INT) AS broken_at, CAST(NULL AS VARCHAR) AS reason FROM events GROUP BY 1",
    "transmission": f"WITH RECURSIVE runs AS (SELECT p_partkey AS run_id, 0.35::DOUBLE AS beta, 0.08::DOUBLE AS gamma, p_size / 50.0::DOUBLE AS hybrid FROM part), {_transmission('runs')} SELECT run_id, beta, gamma, hybrid, {_ROUND('final_mean', 'final_mean')}, {_ROUND('peak', 'peak')}, time_to_peak, {_ROUND('max_mean', 'max_mean')}, {_ROUND('reach', 'reach')}, stabilizing FROM sim",
    "transmission_grid": f"{_GRID} SELECT * FROM mae",
    "transmission_best": f"{_GRID} SELECT CAST(row_number() OVER (ORDER BY mae, cell) AS INT) AS rank, beta, gamma, mae FROM mae QUALIFY rank <= 5",
}
