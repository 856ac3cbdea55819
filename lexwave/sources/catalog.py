"""Sources by name, alias and route, resolved row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Canonical sources in order: name, kind, whether it needs the network.
SOURCES = [
    ("mock", "deterministic", False), ("glossary", "web", True), ("glossary_expanded", "web", True), ("reddit", "web", True), ("urban", "web", True), ("wikipedia", "web", True),
    ("x_search", "social", True), ("crawl4ai", "web", True), ("combined", "composed", True),
]
# Other names of sources.
ALIASES = {
    "mock": "mock", "offline": "mock", "local": "mock", "test": "mock", "fixture": "mock", "glossary": "glossary", "real": "glossary", "web": "glossary", "an": "glossary", "actionnetwork": "glossary",
    "glossary_expanded": "glossary_expanded", "glossaries": "glossary_expanded", "expanded": "glossary_expanded", "reddit": "reddit", "urban": "urban", "ud": "urban", "wikipedia": "wikipedia", "wiki": "wikipedia",
    "x_search": "x_search", "x": "x_search", "twitter": "x_search", "crawl4ai": "crawl4ai", "firecrawl": "crawl4ai", "crawl": "crawl4ai", "combined": "combined", "all": "combined", "multi": "combined", "live": "combined",
}
# Routes and the source each one picks.
ROUTES = {"offline": "mock", "mock": "mock", "default": "mock", "live": "combined", "glossary": "glossary", "social": "x_search"}


def _map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


def resolved(source: Column, route: Column, offline: bool = False) -> dict[str, Column]:
    """source, ok, network and kind that a requested source and route come to. A route wins over a source; an unknown name of
    either is the offline source and not ok; offline, whatever needs the network is the offline source."""
    way = F.nullif(F.lower(F.trim(route)), F.lit(""))
    name = F.lower(F.trim(F.coalesce(F.nullif(F.trim(source), F.lit("")), F.lit("mock"))))
    found = F.when(way.isNotNull(), _map(ROUTES.items())[way]).otherwise(_map(ALIASES.items())[name])
    needs = _map((n, net) for n, _, net in SOURCES)
    canonical = F.coalesce(F.when(needs[found], F.lit("mock")).otherwise(found) if offline else found, F.lit("mock"))
    return {"resolved": canonical, "ok": found.isNotNull(), "network": needs[canonical], "kind": _map((n, k) for n, k, _ in SOURCES)[canonical]}


def listed(spark: SparkSession) -> DataFrame:
    """The catalogue: name, kind, network, other names in order."""
    rows = [(i, n, k, net, sorted(a for a, c in ALIASES.items() if c == n and a != n)) for i, (n, k, net) in enumerate(SOURCES)]
    return spark.createDataFrame(rows, "pos int, name string, kind string, network boolean, aliases array<string>")
