"""The corpus pipeline: documents without the toxic, exact copies and near-duplicates, mixed to target weights and encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm import exact_dedup, mixing, near_copies, sentencepiece, simhash, toxicity
from gazette.llm.common import free_names, parted, remainder, stored, table
from gazette.llm.queries import vocabulary

#: Documents that score this or more are toxic.
TOXIC = 0.3


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose score says they are toxic. The lexicon is learnt from docs that have a label."""
    may_learn = remainder(F.col("doc_id"), 4) != 2
    lexicon = toxicity.learn(toxicity.labelled_rows(docs, table(spark, sf_dir, "labels"), may_learn))
    (score,) = free_names(docs.columns, "_toxicity")
    return toxicity.with_toxicity(docs, lexicon, score_col=score).where(F.col(score) < TOXIC).drop(score)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of those whose texts are equal without white space."""
    return exact_dedup.kept_rows(docs, exact_dedup.exact_dedup(docs))


def _linked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows (doc_id, digest, group) of docs: groups that have texts of one SimHash component are one group."""
    marked = docs.select(near_copies.text_digest(F.col("text")).alias("digest"), "text")
    alike = simhash.near_duplicates(marked, "digest").select(F.col("doc_id").alias("digest"), F.col("component_id").alias("component"))
    met = stored(rows.select("digest", "group").join(alike.distinct(), "digest").select("component", "group").distinct(), "near-met")
    least = met.groupBy("component").agg(F.min("group").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    edges = stored(met.join(least, "component").where("group > b").select(F.col("group").alias("a"), "b").distinct(), "near-links")
    roots = simhash.components(edges).select(F.col("node").alias("group"), "root")
    return rows.join(roots, "group", "left").select("doc_id", "digest", F.coalesce("root", "group").alias("group"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: the smallest id (null last), then the least digest of the text.

    Near copies are texts whose SimHashes op8 links (three words, 2 bits at most, repeats counted), and texts with a five-word Jaccard
    similarity of 0.8 or more; groups are what both connect. Neither has the other's pairs: texts so similar may differ in more bits
    than any grid can reach at size, and a text that says the same again and again has few shingles. The second kind is found by a
    prefix filter that loses no pair, and verified on the texts.
    Rows are told apart by id and text, since ids may be null or repeated; those equal in both are one and the same document.
    """
    rows = stored(near_copies.groups(docs), "near-groups")
    rows = stored(_linked(rows, docs), "near-linked")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("digest").alias("of")))
    best = rows.groupBy("group").agg(first.alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").select("group", "best")
    own, mark, chosen = free_names(docs.columns, "_text", "_digest", "_best")
    texts = stored(rows.join(best, "group").groupBy(F.col("digest").alias(mark)).agg(F.first("best").alias(chosen)), "near-copies")
    some, others = parted(docs.withColumn(own, near_copies.text_digest(F.col("text"))), F.col(own), texts.select(mark))
    found = some.join(texts, F.col(own) == F.col(mark), "left")
    best_row = (F.col(own) == F.col(chosen)["of"]) & F.col("doc_id").eqNullSafe(F.col(chosen)["id"])
    if rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return found.where(F.col(mark).isNull() | best_row).select(*docs.columns).unionByName(others.select(*docs.columns))
    stay = found.where(F.col(mark).isNotNull() & best_row).dropDuplicates(["doc_id", own])
    return found.where(F.col(mark).isNull()).unionByName(stay).select(*docs.columns).unionByName(others.select(*docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as the mix of sources takes it."""
    return mixing.emit(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_pieces, decodes: the pieces of each text, and whether decoding them gives the text back."""
    out = sentencepiece.encode(docs.select("doc_id", "source", "text"), vocabulary("piece_bpe_32k.model"), decodes_col="decodes")
    return out.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_pieces"), "decodes")


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("simhash near-dedup", without_near_copies),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: The scores of the lexicon and the pieces of the texts can't be said in SQL; tests/llm/test_pipeline.py holds the stages and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's rows written to the shared folder before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
