"""The library's verbs by name: what a user calls, in one place."""

from __future__ import annotations

from collections.abc import Callable

from lexwave.functions import enrich, text
from lexwave.operators import backfill, calibration, inbox, ledger, lineage, receipts, simulate, vectors
from lexwave.plans import analysis
from lexwave.sources import catalog, signals
from lexwave.streaming import log

VERBS: dict[str, Callable] = {
    "sources": catalog.listed, "resolve": catalog.resolved, "ingest": signals.mock_text, "extracted-terms": signals.extracted_terms, "glossary": signals.glossary_terms, "analyze": analysis.analysed_queries,
    "terms-split": text.split_terms, "lineage": lineage.candidates, "lineage-hybrid": lineage.hybrid_best, "enrich": enrich.enriched, "risk": text.risk, "risk-schedule": text.policy, "scan-queries": text.planned_queries,
    "emit-receipt": receipts.emit, "verify-receipt": receipts.verify, "verify-foreign": receipts.verify_foreign, "list-receipts": receipts.listed, "ledger-diff": receipts.diff, "ledger-stats": ledger.stats,
    "verify-receipt-ledger": ledger.verify_chain, "validate": receipts.violations, "archive-export": receipts.write_archive, "archive-catalog": receipts.archive_catalog, "extract-forecasts": calibration.extract_forecasts,
    "settle": calibration.settle, "settle-log": calibration.settle_and_log, "pending": calibration.pending, "score-series": calibration.series, "murphy": calibration.murphy, "skill": calibration.skill,
    "recalibrate": calibration.mean_shifted, "lineage-backfill": backfill.delta, "backfill-inventory": backfill.inventory, "phylogeny": backfill.phylogeny_nodes, "simulate": simulate.transmission,
    "simulate-agents": simulate.scenarios, "simulate-calibrate": simulate.grid_search, "simulate-compare": simulate.ranked, "vector-seed": vectors.seeds, "vector-search": vectors.top_k_each, "vector-export": vectors.export,
    "vector-import": signals.read_vectors_json, "vector-sync": vectors.sync, "inbox-push": inbox.push, "inbox-list": inbox.listed, "inbox-clear": inbox.clear, "stream-latest": log.latest, "stream-windows": log.windows, "stream-settled": log.settled,
}
