"""Row-local scoring functions, all native Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexwave.sources import lexicon as X


def half_up(x: Column, places: int) -> Column:
    """Rounds halves up; for averages, whose last bits depend on the order of the rows: the nudge hides them."""
    return F.round(x + 1e-9, places)


def rounded(x: Column, places: int) -> Column:
    """Rounds the stored binary value, not its decimal print: 0.6395 is stored below that half and goes down; true halves go
    to the even side. n is the nearest half unit, rest the exact way from there to x (both products fit 53 bits)."""
    x, unit = x.cast("double"), 2.0 * 10**places
    high, n = x.cast("float").cast("double"), F.rint(x * unit)
    rest = (high * unit - n) + (x - high) * unit
    return F.rint(n / 2 + F.signum(rest) / 4) / 10.0**places + 0.0


def has_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def count_of(text: Column, words: list[str]) -> Column:
    return sum((text.contains(w).cast("int") for w in words), F.lit(0))


def clean(text: Column) -> Column:
    """The whole text without the filler words, blanks collapsed."""
    out = text
    for w in X.CLEANED:
        out = F.replace(out, F.lit(w), F.lit(""))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


#: What stands before and after a whole word, alike in Java's and RE2's regular expressions.
BEFORE, AFTER = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def word_test(term: str) -> str:
    return BEFORE + term + AFTER


def words(text: Column) -> Column:
    """Number of words between blanks."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def virality(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    velocity = F.least(F.lit(1.0), words(text) / F.lit(40.0))
    cues = count_of(low, X.SPREAD)
    acceleration = F.least(F.lit(1.0), F.when(has_any(low, ["velocity", "narrative"]), 0.6).otherwise(0.3) + 0.08 * cues)
    return {"velocity": rounded(velocity, 3), "acceleration": rounded(acceleration, 3), "spread_cues": cues, "hybrid": rounded(velocity * 0.3 + acceleration * 0.4 + F.lit(0.75) * 0.3, 3)}


def stage(text: Column) -> Column:
    return F.when(has_any(F.lower(text), ["revenge", "sharp"]), "ACTUALIZING").otherwise("EMERGENT")


def _split(text: Column) -> tuple[Column, Column]:
    """(parts, lexicon) of a query: at each word the longest lexicon phrase that ends at a blank, or else the word."""
    one = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    alternatives = "|".join(re.escape(t).replace(r"\ ", " ").replace(r"\-", "-") for t in sorted(X.terms(), key=lambda t: (-len(t), t)))
    return F.regexp_extract_all(one, F.lit(f"({alternatives}|[^ ]+)(?: |$)"), F.lit(1)), F.array(*map(F.lit, X.terms()))


def split_matched(text: Column) -> Column:
    """The lexicon terms of a query in order, repeats included."""
    parts, known = _split(text)
    return F.filter(parts, lambda p: F.array_contains(known, p))


def split_terms(text: Column, min_unknown: int = 3) -> tuple[Column, Column]:
    """(terms, other words of min_unknown characters or more) of a query, each once."""
    parts, known = _split(text)
    return F.array_distinct(split_matched(text)), F.array_distinct(F.filter(parts, lambda p: ~F.array_contains(known, p) & (F.length(p) >= min_unknown)))


def norm_key(form: Column) -> Column:
    """A surface form without case and doubled blanks."""
    return F.lower(F.trim(F.regexp_replace(form, r"\s+", " ")))


def typology_tags(primary: Column, scores: Column, family: Column, drivers: Column, stage_: Column) -> Column:
    """Primary typology, others of 0.45 or more (best first), lineage, drivers and stage; eight at most."""
    some = lambda c: F.filter(F.array(c), lambda x: x.isNotNull())
    others = F.transform(F.filter(scores, lambda t: t["s"] >= 0.45), lambda t: t["id"])
    tags = F.concat(some(F.when(primary != "one_off", primary)), others, some(F.when(family.isNotNull(), F.concat(F.lit("lineage:"), family))), drivers, some(F.when(stage_.isin("ACTUALIZING", "EMERGENT"), F.concat(F.lit("hyperstition_"), F.lower(stage_)))))
    tags = F.array_distinct(tags)
    return F.when(F.size(tags) == 0, F.array(F.lit("imitation_spread"))).otherwise(F.slice(tags, 1, 8))


def propagation(family: Column, community: Column, source: Column) -> Column:
    """Platforms of a family, a community and a source; six at most."""
    known = F.create_map(*[x for f, ps in X.PLATFORMS.items() for x in (F.lit(f), F.array(*map(F.lit, ps)))])
    rest = F.array(F.when(community.contains("ai") | community.contains("machine"), "ai_tech"), F.when(F.lower(source).isin("x_search", "social", "live"), "x_twitter"))
    return F.slice(F.array_distinct(F.concat(F.coalesce(known[family], F.array(F.lit("x_twitter"))), F.filter(rest, lambda x: x.isNotNull()))), 1, 6)


def integrity_header(source: Column, stage_: Column) -> dict[str, Column]:
    elevated = F.coalesce(stage_.isin("ACTUALIZING", "EMERGENT"), F.lit(False))
    return {
        "status": F.when(elevated, "PARTIAL").otherwise("PASS"), "entropy_class": F.when(elevated, "high").otherwise("medium"), "risk_band": F.when(elevated, "elevated").otherwise("baseline"),
        "provenance": F.concat(F.lit("ingest="), F.coalesce(source, F.lit("unknown")), F.lit(";stage="), F.coalesce(stage_, F.lit("none"))),
    }


def action_hints(tier: Column, stage_: Column) -> Column:
    always, busy, loop, quiet = X.HINTS[:2], *X.HINTS[2:]
    out = F.array(*map(F.lit, always), F.when(tier.isin("ELEVATED", "CRITICAL"), busy), F.when(stage_ == "ACTUALIZING", loop), F.when(tier == "LOW", quiet))
    return F.filter(out, lambda x: x.isNotNull())


def planned_queries(seed: Column, most: Column) -> Column:
    """A scan's queries: the seed's own terms (or itself) that the default list's head lacks, then that head; most in all."""
    terms = F.array_distinct(split_matched(seed))
    atoms = F.when(F.size(terms) > 0, terms).otherwise(F.filter(F.array(F.trim(seed)), lambda x: x != ""))
    head = F.slice(F.array(*map(F.lit, X.DEFAULT_QUERIES)), F.lit(1), most)
    return F.slice(F.concat(F.filter(atoms, lambda a: ~F.array_contains(head, F.lower(a))), head), F.lit(1), most)


def neologisms(text: Column) -> Column:
    """array<struct<term, formation, confidence>>: phrases, then stems, then suffixed words; each term once."""
    low = F.lower(text)
    bound = lambda body: rf"(?<![\p{{L}}\p{{N}}_])({body})(?![\p{{L}}\p{{N}}_])"
    phrases = F.array_distinct(F.regexp_extract_all(low, F.lit(bound("|".join(X.PHRASES))), F.lit(1)))
    stems = F.filter(F.array(*[F.when(low.rlike(word_test(s)), F.lit(s)) for s in X.STEMS]), lambda x: x.isNotNull())
    tail = F.array_distinct(F.regexp_extract_all(low, F.lit(bound(f"[a-z]{{3,}}(?:{'|'.join(X.SUFFIXES)})")), F.lit(1)))
    put = lambda name, formation, conf: lambda x: F.struct(x.alias("term"), formation(x).alias("formation"), conf(x).alias("confidence"))
    rest = F.array_except(F.array_except(tail, phrases), stems)
    return F.concat(
        F.transform(phrases, put("p", lambda x: F.lit("compound_phrase"), lambda x: F.lit(0.78))),
        F.transform(F.array_except(stems, phrases), put("s", lambda x: F.lit("platform_compression"), lambda x: F.lit(0.72))),
        F.transform(rest, put("t", lambda x: F.when(x.contains("block") | x.contains("nine"), "extra-grammatical").when(x.endswith("pilled") | x.endswith("rot"), "derivational").otherwise("grammatical"), lambda x: F.when(F.length(x) > 6, 0.7).otherwise(0.45))),
    )


def typology_counts(text: Column) -> Column:
    """Cues found of each rule, in the rules' order."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    return F.array(*[count_of(padded, cues) for _, _, cues in X.TYPOLOGY])


def typology_scores(counts: Column, family: Column) -> Column:
    """array<struct<s, p, id>>, best first; counts stand in a column of their own."""
    prior = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in X.PRIOR.items() for x in kv]), family), F.lit(""))
    rows = []
    for pos, (name, w, _) in enumerate(X.TYPOLOGY):
        m = counts[pos]
        base = F.when(m > 0, rounded(w * F.least(F.lit(1.0), 0.35 + 0.2 * m), 3))
        s = F.when(prior == name, rounded(F.coalesce(base, F.lit(0.0)) + 0.15, 3)).otherwise(base)
        # a key that only the prior makes comes last
        rows.append(F.when(s.isNotNull(), F.struct(s.alias("s"), F.when(base.isNull(), -100 - pos).otherwise(-pos).alias("p"), F.lit(name).alias("id"))))
    return F.sort_array(F.filter(F.array(*rows), lambda x: x.isNotNull()), asc=False)


def typology_of(scores: Column) -> dict[str, Column]:
    """typology, score and whether it is memetic, of scores that stand in a column of their own."""
    top = F.try_element_at(scores, F.lit(1))
    memetic = F.coalesce((top["s"] >= 0.45) | (F.size(scores) >= 2), F.lit(False))
    return {
        "typology": F.coalesce(top["id"], F.lit("one_off")), "is_memetic": memetic, "n_types": F.size(scores),
        "memetic_score": F.when(memetic, rounded(F.least(F.lit(0.95), 0.4 + top["s"] * 0.5), 2)).otherwise(0.31),
    }


def sense_place(text: Column) -> Column:
    """Which branch of the cascade a text falls in, from 1; none: one more than there are."""
    low, out = F.lower(text), F.lit(len(X.SENSES) + 1)
    for i, (keys, _, _, _) in reversed(list(enumerate(X.SENSES, 1))):
        out = F.when(has_any(low, keys), i).otherwise(out)
    return out


def sense(place: Column, family: Column, primary: Column) -> dict[str, Column]:
    pick = lambda *values: F.element_at(F.array(*values), place)
    soft = F.array(
        F.when(family.isNotNull(), "community_identity"), F.when(primary == "platform_agency", "platform_compression"),
        F.when(primary == "risk_identity", "risk_signaling"), F.when(primary.isin("status_radiation", "irony_inversion"), "status_competition"),
    )
    drivers = pick(*[F.array(*map(F.lit, d)) for _, _, _, d in X.SENSES], F.array(F.lit("communicative_need")))
    return {
        "sense": pick(*[F.lit(s) for _, s, _, _ in X.SENSES], F.lit("general")), "community": pick(*[F.lit(c) for _, _, c, _ in X.SENSES], F.lit("general")),
        "drivers": F.array_distinct(F.concat(drivers, F.filter(soft, lambda x: x.isNotNull()))),
    }


def predict(hybrid: Column, velocity: Column, acceleration: Column, lineage: Column, memetic: Column, stage_: Column, n: Column) -> dict[str, Column]:
    lc, act = F.coalesce(lineage, F.lit(0.0)), stage_ == "ACTUALIZING"
    raw = hybrid * 0.50 + velocity * 0.12 + acceleration * 0.18 + F.least(F.lit(1.0), lc) * 0.10 + F.least(F.lit(1.0), F.coalesce(memetic, F.lit(0.0))) * 0.05 + F.when(act, 0.12).when(stage_ == "EMERGENT", 0.04).otherwise(0.0) + F.least(F.lit(0.1), 0.03 * n)
    predicted = rounded(F.greatest(F.lit(0.0), F.least(F.lit(0.98), raw)), 3)
    conf = rounded(F.least(F.lit(0.75), 0.35 + F.when(lc >= X.THRESHOLD, 0.15).otherwise(0.0) + F.when(act, 0.1).otherwise(0.0) + 0.05 * F.least(F.lit(3), n)), 3)
    return {"predicted": predicted, "predicted_confidence": conf, "delta": rounded(predicted - hybrid, 3)}


def risk(stage_: Column, hybrid: Column, predicted: Column, lineage: Column, memetic: Column, peak: Column | None = None, reach: Column | None = None, rate: Column | None = None, cascade: Column | None = None) -> Column:
    """Weighted mean of the drivers that are present."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    vh = unit(F.coalesce(hybrid, F.lit(0.0)))
    rows = [
        (0.28, F.when(stage_ == "ACTUALIZING", 0.85).when(stage_ == "EMERGENT", 0.45).otherwise(0.15)), (0.14, vh), (0.12, unit(F.coalesce(predicted, vh))),
        (0.10, unit(F.coalesce(lineage, F.lit(0.0)))), (0.08, unit(F.coalesce(memetic, F.lit(0.0)))),
    ]
    rows += [(w, F.when(c.isNotNull(), unit(c))) for w, c in ((0.12, peak), (0.08, reach), (0.08, rate)) if c is not None]
    rows += [(0.10, F.when(cascade, 1.0).when(~cascade, 0.15))] if cascade is not None else []
    total = sum((F.when(v.isNotNull(), w).otherwise(0.0) for w, v in rows), F.lit(0.0))
    return rounded(F.least(F.lit(0.98), sum((F.coalesce(w * v, F.lit(0.0)) for w, v in rows), F.lit(0.0)) / total), 3)


def risk_tier(score: Column) -> Column:
    return F.when(score >= 0.75, "CRITICAL").when(score >= 0.55, "ELEVATED").when(score >= 0.35, "MODERATE").otherwise("LOW")


def policy(tier: Column) -> dict[str, Column]:
    """cron, hours, max_queries and source of a tier; a lookup, for a join on a computed column would copy it into filters."""
    pick = lambda at: F.create_map(*[F.lit(x) for row in X.TIERS for x in (row[0], row[at])])[tier]
    return {name: pick(at) for at, name in enumerate(("cron", "hours", "max_queries", "source"), 1)}


def level(x: Column) -> Column:
    return F.when(x >= 0.72, "High").when(x >= 0.42, "Medium").otherwise("Low")


def vowel_drop(seed: Column) -> Column:
    """The seed without its inner vowels, if that changes it."""
    inner = F.regexp_replace(F.substring(seed, F.lit(2), F.length(seed) - 2), "[aeiouAEIOU]", "")
    out = F.concat(F.substring(seed, 1, 1), inner, F.right(seed, F.lit(1)))
    return F.when((F.length(seed) >= 4) & ~seed.contains(" ") & (out != seed) & (F.length(out) >= 2), out)
