"""Signals: the offline source's texts, and readers of logs and packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexwave.functions.text import has_any
from lexwave.sources import lexicon as X


def mock_text(query: Column) -> Column:
    """The offline source: the first branch whose keyword is in the query."""
    low, q = F.lower(F.trim(query)), F.trim(query)
    out = F.concat(F.lit(X.MOCK_REST[0]), q, F.lit(X.MOCK_REST[1]))
    for keys, a, b in reversed(X.MOCK):
        out = F.when(has_any(low, keys), F.concat(F.lit(a), q, F.lit(b))).otherwise(out)
    return out


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One signal an event: a lexicon term, for each third user two of them."""
    terms = F.array(*map(F.lit, X.terms()))
    n = len(X.terms())
    at = lambda x: F.element_at(terms, (F.pmod(x, F.lit(n)) + 1).cast("int"))
    one, two = at(F.col("event_id")), at(F.col("event_id") * 7 + F.col("user_id"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "ts")
    rows = rows.select(F.col("event_id").alias("signal_id"), "user_id", "event_type", "ts", F.when(F.pmod("user_id", F.lit(3)) == 0, F.concat_ws(" ", one, two)).otherwise(one).alias("query"))
    return rows.withColumn("raw", mock_text(F.col("query")))


def fingerprints(rows: DataFrame) -> DataFrame:
    """content_hash of the raw text and the source's fingerprint."""
    content = F.sha2(F.col("raw"), 256)
    key = F.concat_ws("|", F.lit("mock"), F.lower(F.trim("query")), content, F.lit(""), F.lit("ingest-v1.7"))
    return rows.select("signal_id", content.alias("content_hash"), F.substring(F.sha2(key, 256), 1, 24).alias("fingerprint_id"))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines log; blank and broken lines are skipped. The schema carries an explicit seq."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_vectors_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines export of vectors; a broken line fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


PACK = "year int, month int, label string, terms array<struct<term:string, family_id:string, first_seen_month:string, prominence:string, provenance:string, branch_operator:string>>"


def read_packs(spark: SparkSession, path: str, through: tuple[int, int] | None = None) -> DataFrame:
    """Backfill packs (one JSON file a month), a row a term; months after `through` are pruned."""
    rows = spark.read.schema(PACK).option("multiLine", True).json(path)
    if through:
        rows = rows.filter(F.struct("year", "month") <= F.struct(F.lit(through[0]).alias("year"), F.lit(through[1]).alias("month")))
    return rows.select("year", "month", "label", F.inline("terms"))


def read_receipts(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """JSON receipts, one a file, from files and folders; a file named twice is read once."""
    rows = spark.read.schema(schema).option("multiLine", True).json(paths).withColumn("path", F.col("_metadata.file_path"))
    return rows.dropDuplicates(["path"])


def extracted_terms(raw: Column, most: int = 8) -> Column:
    """Terms of a structured read: words with one of the known tails, each once, the first of them."""
    tails = "|".join(X.EXTRACTED)
    found = F.regexp_extract_all(F.lower(raw), F.lit(rf"(?<![\p{{L}}\p{{N}}_])([a-z]{{4,}}(?:{tails}))(?![\p{{L}}\p{{N}}_])"), F.lit(1))
    return F.slice(F.array_distinct(found), 1, most)


def filled(template: str, query: Column) -> Column:
    before, after = template.split("{}", 1)
    return F.concat(F.lit(before), query, F.lit(after))


def glossaries(query: Column) -> Column:
    """The offline glossaries as one signal, each cut to 280 characters."""
    return F.concat_ws(" || ", *[F.substring(filled(t, query), 1, 280) for t in X.GLOSSARIES])


def combined(parts: list[Column]) -> Column:
    """Several sources as one signal, in order, each cut to 220 characters; a source that gave nothing (null) is left out."""
    return F.concat_ws(" | ", *[F.substring(x, 1, 220) for x in parts])


def glossary_terms(html: Column, most: int = 12) -> Column:
    """The entries of a glossary page: a capitalised name, a dash and its meaning; a fixed list where there is none."""
    names = F.regexp_extract_all(html, F.lit(r"([A-Z][a-zA-Z\s]{2,30}?)\s*[\u2014\u2013-]\s*([A-Za-z][^<]{15,70})"), F.lit(1))
    found = F.slice(F.array_distinct(F.filter(F.transform(names, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: F.length(x) > 3)), 1, most)
    return F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, X.GLOSSARY_REST)))


def scan_queries(rows: DataFrame, query: str, pos: str) -> DataFrame:
    """A query list without repeats, in the order of first sight."""
    return rows.groupBy(F.trim(F.col(query)).alias(query)).agg(F.min(pos).alias(pos)).filter(F.col(query) != "")
