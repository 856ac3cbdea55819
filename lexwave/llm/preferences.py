"""Preference formatting, DataFrame functions only.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns (same turn number, role and text)
is rendered once as the prompt; what follows on either side is a completion, with a loss mask: spans of characters
that count (the assistant's turns). Turns are compared turn by turn in a join, and the first difference is a minimum
over partial aggregates, so a long conversation or a very common first turn gathers nowhere before it is rendered.

A turn number repeated within a conversation: equal rows count once, different ones stand in order of role and text. A
null role or text is rendered as empty. Rows with a null conv_id or turn are ignored. A pair without a common turn has
an empty prompt; a side that is missing or wholly common has an empty completion and mask. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TRAINED = "assistant"


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n"))


def _turns(side: DataFrame, name: str) -> DataFrame:
    """One row per (pair_id, turn): its rendered text and whether it is trained on."""
    rows = side.filter(F.col("pair_id").isNotNull() & F.col("turn").isNotNull()).select("pair_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = F.array_sort(F.collect_set(F.struct("role", "text")))
    spans = F.transform(parts, lambda x: F.struct(rendered(x["role"], x["text"]).alias("s"), (x["role"] == TRAINED).alias("m")))
    return rows.groupBy("pair_id", "turn").agg(spans.alias(name))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: x["s"]), "")


def _mask(spans: Column) -> Column:
    """Character spans [from, to) that are trained on."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<from:bigint,to:bigint>>").alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + F.length(x["s"])).alias("at"), F.when(x["m"], F.concat(acc["out"], F.array(F.struct(acc["at"].alias("from"), (acc["at"] + F.length(x["s"])).alias("to"))))).otherwise(acc["out"]).alias("out"))
    return F.aggregate(spans, start, step, lambda acc: acc["out"])


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """chosen, rejected: (pair_id, turn, role, text). One row a pair: prompt, n_prompt_turns, chosen, chosen_mask, rejected, rejected_mask."""
    both = _turns(chosen, "c").join(_turns(rejected, "r"), ["pair_id", "turn"], "full")
    first = both.groupBy("pair_id").agg(F.min(F.when(~F.col("c").eqNullSafe(F.col("r")), F.col("turn"))).alias("split"))
    tagged = both.join(first, "pair_id").withColumn("common", F.col("split").isNull() | (F.col("turn") < F.col("split")))
    put = lambda cond, col: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("turn", F.col(col).alias("x"))))), lambda t: t["x"]))
    rows = tagged.groupBy("pair_id").agg(
        F.count(F.when(F.col("common"), 1)).alias("n_prompt_turns"), put(F.col("common"), "c").alias("p"),
        put(~F.col("common") & F.col("c").isNotNull(), "c").alias("c"), put(~F.col("common") & F.col("r").isNotNull(), "r").alias("r"),
    )
    return rows.select("pair_id", "n_prompt_turns", _joined(F.col("p")).alias("prompt"), _joined(F.col("c")).alias("chosen"), _mask(F.col("c")).alias("chosen_mask"), _joined(F.col("r")).alias("rejected"), _mask(F.col("r")).alias("rejected_mask"))


def op7_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k and 2k+1 are a pair: the first is the chosen one."""
    rows = table(spark, sf_dir, "conversations").select(F.floor(F.col("conv_id") / 2).alias("pair_id"), F.pmod("conv_id", F.lit(2)).alias("side"), "turn", "role", "text")
    out = preference_pairs(rows.filter("side = 0"), rows.filter("side = 1"))
    mask = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["from"], F.lit("-"), s["to"])), ",")
    return out.withColumn("chosen_mask", mask("chosen_mask")).withColumn("rejected_mask", mask("rejected_mask"))
