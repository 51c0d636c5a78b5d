"""Articles made from the driver's tables, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions.lexicon import SOURCE_WEIGHTS
from gazette.functions.text import literal_array, split_words
from gazette.functions.urls import host

AS_OF = "2024-01-31 00:00:00"
SUBJECTS = ("Startup Alpha", "OpenAI", "A new model", "Enterprise team", "Weekly roundup", "Chip maker", "The summit")
VERBS = ("launches", "raises Series A for", "signed a deal on", "explains how to tutorial", "benchmarks")
OBJECTS = ("multimodal agents", "enterprise adoption", "a podcast episode", "inference chips and accelerators", "a strategic partnership", "customer workflows", "seed funding", "an opinion guide", "API tools", "latency and throughput", "nothing")
CONTEXTS = ("", "Product launch with new feature and production deployment.", "Event recap.", "Funding round with investors and valuation", "Step by step", "Merger agreement, contract and acquisition")
SOURCES = (*SOURCE_WEIGHTS, "Unknown Source")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("_event"), F.col("ts").alias("published_at"))


def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, page_id, pos, url, html, title, source_name, published_at."""
    p = table(spark, sf_dir, "pages")
    p = p.select("page_id", F.col("page_id").alias("pos"), F.col("page_id").cast("string").alias("id"), "url", "html", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), host(F.col("url")).alias("source_name"))
    return p.join(times(spark, sf_dir), F.col("page_id") == F.col("_event"), "left").drop("_event")


PAGES_SQL = r"""t1 AS (
    SELECT p.page_id, p.url, p.html, regexp_extract(p.html, '<title>([^<]*)</title>', 1) AS title, lower(regexp_extract(p.url, '^https?://([^/:?#]+)', 1)) AS source_name, e.ts AS published_at
    FROM pages p LEFT JOIN events e ON e.event_id = p.page_id)"""


def document_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, title (the first twelve words), description, published_at."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.array_join(F.slice(split_words(F.col("text")), 1, 12), " ").alias("title"), F.col("text").alias("description"))
    return d.join(times(spark, sf_dir), F.col("doc_id") == F.col("_event"), "left").drop("_event")


DOCUMENTS_SQL = r"""t2 AS (
    SELECT d.doc_id, d.source, d.lang, array_to_string(list_filter(regexp_split_to_array(d.text, '\s+'), lambda x: x <> '')[1:12], ' ') AS title, d.text AS description, e.ts AS published_at
    FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id)"""


def _turn(values, key: str, by: int):
    return F.element_at(literal_array(values), (F.floor(F.col(key) / by) % len(values) + 1).cast("int"))


def _turn_sql(values, key: str, by: int) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][1 + (({key} // {by}) % {len(values)})::INT]"


_PARTS = (("subject", SUBJECTS, 1), ("verb", VERBS, 2), ("object", OBJECTS, 3), ("description", CONTEXTS, 5), ("source_name", SOURCES, 7))


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, title, description, source_name, published_at, duplicate_count of every document: its first twelve words behind a
    headline that the word lists know, and its whole text behind such a context; these are dealt by the ids."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 7 + 1).alias("duplicate_count"), *[_turn(v, "doc_id", by).alias(n) for n, v, by in _PARTS])
    title = F.concat_ws(" ", "subject", "verb", "object", F.array_join(F.slice(split_words(F.col("text")), 1, 12), " "))
    d = d.withColumns({"title": title, "description": F.concat_ws(" ", "description", "text")}).drop("subject", "verb", "object", "text")
    return d.join(times(spark, sf_dir), F.col("doc_id") == F.col("_event"), "left").drop("_event")


HEADLINES_SQL = rf"""dealt AS (
    SELECT doc_id, text, doc_id % 7 + 1 AS duplicate_count, {", ".join(f"{_turn_sql(v, 'doc_id', by)} AS {n}" for n, v, by in _PARTS)} FROM documents),
t3 AS (SELECT doc_id, duplicate_count, concat_ws(' ', subject, verb, object, coalesce(array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')[1:12], ' '), '')) AS title,
    concat_ws(' ', description, text) AS description, source_name, e.ts AS published_at
    FROM dealt LEFT JOIN events e ON e.event_id = doc_id)"""
