"""Monthly packs of terms: inventory, first sight, and what they add to the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def named(packs: DataFrame) -> DataFrame:
    """Pack rows (pos, label, term, family_id, first_seen_month, prominence, provenance) with their defaults; blank terms go."""
    out = packs.withColumn("term", F.trim("term")).filter(F.col("term") != "")
    return out.withColumns({"family_id": F.coalesce("family_id", F.lit("unknown")), "first_seen_month": F.coalesce("first_seen_month", "label"), "prominence": F.coalesce("prominence", F.lit("medium")), "provenance": F.coalesce("provenance", F.lit("INFERRED")), "key": F.lower("term")})


def inventory(packs: DataFrame) -> DataFrame:
    """(kind, value, n): distinct terms by family; all entries by provenance and by prominence."""
    rows = named(packs)
    count = lambda kind, c, df: df.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "value", "n")
    out = count("family", "family_id", rows.select("key", "family_id").distinct())
    return out.unionByName(count("provenance", "provenance", rows)).unionByName(count("prominence", "prominence", rows))


def first_seen(packs: DataFrame) -> DataFrame:
    """(family_id, key, first_seen_month): of the first pack that has the term."""
    return named(packs).groupBy("family_id", "key").agg(F.min_by("first_seen_month", "pos").alias("first_seen_month"))


def terms_for_family(packs: DataFrame, family: str) -> DataFrame:
    """(term, rank): a family's terms in the packs, each once, as first written, in that order."""
    rows = named(packs).filter(F.col("family_id") == family).groupBy("key").agg(F.min_by("term", "pos").alias("term"), F.min("pos").alias("pos"))
    return rows.select("term", F.row_number().over(Window.orderBy("pos")).alias("rank"))


def delta(registry: DataFrame, packs: DataFrame) -> DataFrame:
    """(family_id, n_before, n_after, added): families that the packs add terms to, with those terms in order."""
    before = registry.select("family_id", F.lower("term").alias("key")).distinct().withColumn("old", F.lit(1))
    both = before.join(named(packs).select("family_id", "key").distinct().withColumn("new", F.lit(1)), ["family_id", "key"], "full")
    added = F.sort_array(F.collect_list(F.when(F.col("old").isNull(), F.col("key"))))
    out = both.groupBy("family_id").agg(F.count("old").alias("n_before"), F.count(F.lit(1)).alias("n_after"), added.alias("added"))
    return out.filter(F.size("added") > 0)


def phylogeny_nodes(registry: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(family_id, id, kind, first_seen_month): each family's root and trunk, its stable terms and its leaves."""
    trunk = F.col("term_pos") < F.greatest(F.lit(1), F.floor(F.col("n_terms") / 2))
    terms = registry.withColumn("kind", F.when(trunk, "trunk_term").otherwise("leaf")).withColumn("key", F.lower("term"))
    terms = terms.join(seen, ["family_id", "key"], "left") if seen is not None else terms.withColumn("first_seen_month", F.lit(None).cast("string"))
    terms = terms.select("family_id", F.concat("family_id", F.when(F.col("kind") == "leaf", "::leaf::").otherwise("::term::"), "term").alias("id"), "kind", "first_seen_month")
    tops = registry.select("family_id").distinct().select("family_id", F.explode(F.array(F.lit("root"), F.lit("trunk"))).alias("kind"))
    return tops.select("family_id", F.concat("family_id", F.lit("::"), "kind").alias("id"), "kind", F.lit(None).cast("string").alias("first_seen_month")).unionByName(terms)


DOMAIN = "domain_id string, roots array<struct<id:string,label:string>>, trunks array<struct<id:string,label:string,family_id:string>>, leaves array<struct<term:string,family_id:string>>, cross_edges array<struct<`from`:string,`to`:string,operator:string>>"


def domain_sizes(packs: DataFrame) -> DataFrame:
    """(domain_id, n_roots, n_trunks, n_leaves, n_cross) of domain packs (DOMAIN)."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    return packs.select("domain_id", *[F.greatest(n(c), F.lit(0)).alias(a) for c, a in (("roots", "n_roots"), ("trunks", "n_trunks"), ("leaves", "n_leaves"), ("cross_edges", "n_cross"))])


def domain_edges(packs: DataFrame) -> DataFrame:
    """(domain_id, source, target, operator): every leaf under its family's trunks, and the cross edges."""
    trunks = packs.select("domain_id", F.inline("trunks")).select("domain_id", F.col("id").alias("source"), "family_id")
    leaves = packs.select("domain_id", F.inline("leaves")).select("domain_id", F.col("term").alias("target"), "family_id")
    cross = packs.select("domain_id", F.inline("cross_edges")).select("domain_id", F.col("from").alias("source"), F.col("to").alias("target"), "operator")
    return trunks.join(leaves, ["domain_id", "family_id"]).select("domain_id", "source", "target", F.lit("branch").alias("operator")).unionByName(cross)
