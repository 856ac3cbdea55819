"""The lexicon's families, typology cues, phrases, templates and policies, and SQL VALUES of them."""

from __future__ import annotations


# Families in order, each with its terms in order and its branch operator.
FAMILIES: list[tuple[str, str, list[str]]] = [
    ("betting-sharp", "sense_extension", ["sharp", "steam", "square", "wiseguy", "hammer", "holler", "revenge", "low block", "false nine"]),
    ("crypto-degen", "cross_family_borrowing", ["hodl", "diamond hands", "paper hands", "rekt", "ape", "degen", "moon", "bagholder", "fud", "fomo", "ngmi", "wagmi", "rug"]),
    ("ai-native", "platform_compression", ["hallucinate", "slop", "clanker", "agentic", "glazing", "skill issue", "token", "context window", "vibe coding"]),
    ("brainrot-aura", "irony_inversion", [
        "brainrot", "brain rot", "aura", "aura farming", "mid", "cooked", "let him cook", "rizz", "skibidi", "gyatt", "sigma", "delulu", "no cap",
        "locked in", "crash out", "mewing", "looksmaxxing", "mog", "mogging", "ate", "left no crumbs", "it's giving", "npc", "main character",
        "main character energy", "fanum tax", "ohio", "bussin", "slay", "six seven", "67", "edging", "gooning", "vibe check", "negative aura",
        "aura points", "yap", "yapping", "chat is this real",
    ]),
    ("kinship-address", "sense_extension", ["bro", "sis", "twin", "unc", "cuz", "family"]),
    ("political-status", "irony_inversion", ["based", "redpilled", "blackpilled", "cope", "seethe", "dilate"]),
    ("gaming-meta", "platform_compression", ["nerf", "buff", "meta", "sweaty", "noob", "gg", "ez", "ratio", "touch grass", "skill issue", "diff", "int", "feed", "smurf", "sus"]),
    ("workplace-corp", "sense_extension", [
        "quiet quitting", "quiet firing", "rto", "return to office", "layoffs", "pip", "synergy", "circle back", "bandwidth", "low-hanging fruit",
        "act your wage",
    ]),
]

# Typology rules in order: id, weight, cues (blanks at the ends count).
TYPOLOGY: list[tuple[str, float, list[str]]] = [
    ("tactical_edge", 1.0, ["sharp", "steam", "square", "wiseguy", "hammer", "clv", "juice", "vig", "line move", "revenge"]),
    ("risk_identity", 1.0, ["degen", "hodl", "rekt", "diamond hands", "paper hands", "ape", "moon", "rug", "ngmi", "wagmi"]),
    ("platform_agency", 1.0, ["agentic", "slop", "hallucin", "clanker", "context window", "skill issue", "token", "glazing", "nerf", "buff", "meta", "sweaty", "smurf", "diff"]),
    ("labor_identity", 0.95, ["quiet quitting", "quiet firing", "rto", "return to office", "layoffs", "bandwidth", "circle back", "act your wage", "synergy", "pip"]),
    ("status_radiation", 0.95, ["aura", "aura farming", "based", "mid", "cooked", "let him cook", "glazing"]),
    ("irony_inversion", 0.95, ["brainrot", "brain rot", "cope", "seethe", "dilate", "redpill", "blackpill"]),
    ("kinship_address", 0.9, [" bro ", " sis ", "twin", " unc ", " cuz ", "family"]),
    ("imitation_spread", 0.75, ["narrative", "holler", "spread", "everyone saying", "organic velocity", "coordinated"]),
]

# A family's preferred typology.
PRIOR = {
    "betting-sharp": "tactical_edge", "crypto-degen": "risk_identity", "ai-native": "platform_agency", "brainrot-aura": "status_radiation",
    "kinship-address": "kinship_address", "political-status": "irony_inversion", "gaming-meta": "platform_agency", "workplace-corp": "status_radiation",
}

# Branches of the offline source in order: any keyword in the query; the text after the query.
MOCK: list[tuple[list[str], str, str]] = [
    (["sharp", "steam", "revenge", "betting", "square", "wiseguy"], 'Mock memetic channel on "', '": organic velocity, coordinated push. sharp steam square revenge wiseguy hammer low block.'),
    (["hodl", "degen", "rekt", "moon", "crypto"], 'Mock memetic channel on "', '": organic velocity. hodl diamond hands rekt degen moon bagholder.'),
    (["brainrot", "aura", "mid", "cooked"], 'Mock memetic channel on "', '". brainrot aura farming mid cooked let him cook.'),
    (["agentic", "slop", "hallucin", "clanker", "token"], 'Mock memetic channel on "', '". agentic slop skill issue hallucinate clanker context window.'),
    (["based", "cope", "seethe", "redpill", "blackpill", "political"], 'Mock memetic channel on "', '". based redpilled cope seethe dilate blackpilled.'),
    (["bro", "sis", "twin", "unc", "cuz", "kinship"], 'Mock memetic channel on "', '". bro sis twin unc cuz family.'),
    (["nerf", "buff", "meta", "sweaty", "noob", "gg", "gaming", "smurf"], 'Mock memetic channel on "', '". nerf buff meta sweaty noob gg ez ratio touch grass skill issue diff smurf.'),
    (["quiet quitting", "rto", "layoff", "bandwidth", "workplace", "corp", "act your wage"], 'Mock memetic channel on "', '". quiet quitting quiet firing rto return to office layoffs pip synergy circle back bandwidth low-hanging fruit act your wage.'),
]
MOCK_REST = ('Mock channel note on "', '". Quiet discourse sample.')

# The sense cascade: keywords, sense, community, drivers.
SENSES: list[tuple[list[str], str, str, list[str]]] = [
    (["sharp", "steam", "betting", "line", "clv"], "tactical/quant", "sharp_money", ["communicative_need", "semantic_distinction"]),
    (["degen", "hodl", "rekt", "moon"], "risk/conviction", "crypto_degen", ["community_identity", "risk_signaling"]),
    (["agentic", "slop", "hallucin", "clanker", "token"], "machine-culture", "ai_native", ["platform_compression", "semantic_distinction"]),
    (["aura", "mid", "based", "brainrot"], "status/irony", "status_publics", ["status_competition", "community_identity"]),
    (["bro", "sis", "twin", "unc", "family"], "kinship-address", "fictive_kin", ["community_identity", "communicative_need"]),
]

# Neologism phrases, stems and suffixes.
PHRASES = [
    "sharp money", "diamond hands", "paper hands", "false nine", "low block", "aura farming", "skill issue", "context window",
    "organic velocity", "line movement", "locked in", "crash out", "left no crumbs", "main character energy", "fanum tax", "six seven",
    "vibe check", "vibe coding", "aura points", "negative aura", "chat is this real", "it's giving", "no cap", "looksmaxxing", "touch grass",
    "quiet quitting", "act your wage",
]
STEMS = ["rizz", "skibidi", "gyatt", "sigma", "delulu", "mewing", "mog", "mogging", "bussin", "gooning", "yap", "yapping", "npc", "slay", "ohio", "edging"]
SUFFIXES = ["block", "nine", "sharp", "holler", "revenge", "degen", "slop", "aura", "pilled", "rot"]
CLEANED = ["pivotal", "underscoring", "showcasing", "crucial", "landscape", "tapestry", "delve", "realm"]
SPREAD = ["spread", "steam", "coordinated", "organic", "everyone", "viral"]

# Mutation suffixes, general and by family.
GENERAL_SUFFIXES = ["ed", "ing", "er", "y"]
FAMILY_SUFFIXES = {
    "brainrot-aura": ["core", "maxxing", "posting", "points"], "political-status": ["pilled", "maxxing"], "gaming-meta": ["diff", "core"],
    "ai-native": ["slop", "core", "maxxing"], "crypto-degen": ["season", "core"], "workplace-corp": ["core"], "betting-sharp": ["core"], "kinship-address": [],
}

# Tier, cron, hours, queries at most, source.
TIERS = [("LOW", "0 */12 * * *", 12, 3, "mock"), ("MODERATE", "0 */6 * * *", 6, 5, "mock"), ("ELEVATED", "0 */2 * * *", 2, 8, "combined"), ("CRITICAL", "0 * * * *", 1, 12, "combined")]

# Agent roles: threshold, broadcast, default number.
ROLES = [("innovator", 0.15, 0.9, 2), ("early_adopter", 0.35, 0.7, 4), ("mainstream", 0.55, 0.4, 8), ("skeptic", 0.8, 0.2, 3), ("amplifier", 0.4, 1.0, 2)]

# Scenario presets: agents, steps, seeds, influence, decay, numbers by role (in the order of ROLES) or none.
PRESETS = [
    ("baseline", 20, 15, 2, 0.22, 0.05, None), ("viral_cascade", 24, 18, 3, 0.32, 0.03, [2, 4, 8, 2, 8]), ("skeptic_wall", 24, 18, 2, 0.18, 0.08, [1, 3, 6, 12, 2]),
    ("elite_innovators", 18, 16, 4, 0.28, 0.04, [6, 4, 4, 2, 2]), ("slow_burn", 20, 28, 1, 0.12, 0.02, None),
]

THRESHOLD = 0.42

# Tails of the terms that a structured read extracts.
EXTRACTED = ["block", "nine", "sharp", "holler", "revenge", "low", "false", "vig", "action", "chalk", "steam", "degen", "aura", "slop"]

# Offline texts of the glossaries in order, and of the social search; {} is the query.
GLOSSARIES = [
    "[OFFLINE_GLOSSARY:action_network] sharp money, steam, juice, clv for '{}'",
    "[OFFLINE_GLOSSARY:wikipedia_slang] internet slang context for '{}'",
    "[OFFLINE_GLOSSARY:urban] '{}'",
]
SOCIAL_STUB = "[X_SEARCH_STUB] Structured placeholder for '{}': velocity markers \u2014 sharp money, revenge narrative, memetic spread. Not live; do not treat as OBSERVED market chatter."
# What a glossary page without entries is read as.
GLOSSARY_REST = ["Action", "Chalk", "Dog", "Vig", "Juice", "Sharp", "Steam", "Revenge"]

# Where a family's terms travel.
PLATFORMS = {
    "betting-sharp": ["x_twitter", "niche"], "crypto-degen": ["x_twitter", "discord", "niche"], "ai-native": ["x_twitter", "ai_tech", "reddit"], "brainrot-aura": ["tiktok", "x_twitter", "niche"],
    "kinship-address": ["x_twitter", "discord"], "political-status": ["x_twitter", "reddit"], "gaming-meta": ["discord", "twitch", "x_twitter"], "workplace-corp": ["linkedin", "x_twitter"],
}

# Queries of a scan where none are given.
DEFAULT_QUERIES = ["sharp money", "steam", "revenge", "diamond hands", "rizz", "locked in", "crash out", "agentic slop", "skill issue", "vibe coding", "based", "quiet quitting", "act your wage", "touch grass"]

# Hints of a risk packet: always, for the two upper tiers, for an actualizing stage, for the lowest tier.
HINTS = [
    "Label claims OBSERVED/INFERRED/SPECULATIVE; this packet is SPECULATIVE.", "Do not invent Brier; settle forecasts only with operator authority.",
    "Increase scan frequency; archive receipts; prepare settlement criteria.", "Loop may already couple narrative to external confirmation \u2014 verify evidence.", "Monitor only; transmission may remain niche.",
]

# Runes and their roles; the claims of each envelope with their labels (lineage_match depends on the row).
RUNES = {"RUNE.HLX.LIVE_EMERGENCE_SCAN": "scan", "RUNE.HLX.COMMUNICATION_RELAY": "signal", "RUNE.HLX.ATTRACTOR_CANDIDATE": "attractor", "RUNE.HLX.CALIBRATION_FORECAST": "forecast", "RUNE.HLX.CALIBRATION_SERIES": "calibration"}
CLAIM_LABELS = ["OBSERVED", "INFERRED", "SPECULATIVE", "NOT_COMPUTABLE"]

# Words that the echo provider leaves out.
ECHO_STOP = ["that", "this", "with", "from", "have", "were", "been", "they", "them", "mock", "channel"]


def weight(term: str) -> float:
    return min(0.75, 0.22 + 0.14 * max(1, len(term.split())) + 0.025 * min(len(term), 24))


def family_rows() -> list[tuple[int, str, str, int, str, float, int]]:
    """(family position, family, operator, term position, term, weight, the family's terms)."""
    return [(i, f, op, j, t, weight(t), len(terms)) for i, (f, op, terms) in enumerate(FAMILIES) for j, t in enumerate(terms)]


def terms() -> list[str]:
    """Distinct terms in order."""
    return list(dict.fromkeys(t for _, _, ts in FAMILIES for t in ts))


def sql_str(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_values(rows, names: str) -> str:
    put = lambda v: sql_str(v) if isinstance(v, str) else "NULL" if v is None else repr(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(put, r)) + ')' for r in rows)}) AS v({names})"


def sql_list(items) -> str:
    return "[" + ", ".join(map(sql_str, items)) + "]"
