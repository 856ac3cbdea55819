"""Candidates that a provider adds to found terms. A provider is a Column expression or a pandas UDF: text -> JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexwave.sources import lexicon as X

CANDIDATES = "struct<candidates: array<struct<term: string, formation: string, confidence: double>>>"


def echo(text: Column) -> Column:
    """The provider for tests: the first five words of four characters or more, as JSON."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?<![\p{L}\p{N}_])([a-z][a-z0-9_-]{3,})(?<=[a-z0-9_])(?![\p{L}\p{N}_])"), F.lit(1))
    kept = F.slice(F.array_distinct(F.array_except(words, F.array(*map(F.lit, X.ECHO_STOP)))), 1, 5)
    rows = F.transform(kept, lambda w: F.struct(w.alias("term"), F.lit("llm_echo").alias("formation"), F.lit(0.4).alias("confidence")))
    return F.to_json(F.struct(rows.alias("candidates")))


def parsed(raw: Column) -> Column:
    """A provider's answer as an array; JSON inside other text is found; else empty."""
    inside = F.regexp_extract(raw, r"(\{[\s\S]*\})", 1)
    first = F.from_json(raw, CANDIDATES)["candidates"]
    return F.coalesce(first, F.from_json(inside, CANDIDATES)["candidates"], F.array().cast("array<struct<term: string, formation: string, confidence: double>>"))


def enriched(found: Column, raw: Column) -> Column:
    """Terms found, and a provider's new ones with their confidence held in [0, 0.85]; each term once, found ones first."""
    known = F.transform(found, lambda t: F.lower(t["term"]))
    new = F.filter(parsed(raw), lambda t: t["term"].isNotNull() & (F.trim(t["term"]) != "") & ~F.array_contains(known, F.lower(F.trim(t["term"]))))
    bounded = F.transform(new, lambda t: F.struct(t["term"].alias("term"), F.coalesce(t["formation"], F.lit("llm")).alias("formation"), F.greatest(F.lit(0.0), F.least(F.lit(0.85), F.coalesce(t["confidence"], F.lit(0.4)))).alias("confidence")))
    return F.concat(F.transform(found, lambda t: F.struct(t["term"].alias("term"), t["formation"].alias("formation"), t["confidence"].cast("double").alias("confidence"))), bounded)


def first_text(payload: Column, keys: list[str]) -> Column:
    """The first of some fields of a JSON payload that isn't blank, in one line of 950 characters at most."""
    found = F.coalesce(*[F.nullif(F.trim(F.get_json_object(payload, f"$.{k}")), F.lit("")) for k in keys])
    return F.substring(F.trim(F.regexp_replace(found, r"\s+", " ")), 1, 950)
