"""Scores, cluster representatives and the top k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.functions import scoring
from gazette.functions.lexicon import DEFAULT, Lexicon
from gazette.functions.staging import free_names
from gazette.operators.clustering import story_clusters


def representatives(df: DataFrame, cluster: str = "leader_rk") -> DataFrame:
    """Of each cluster the row with the largest score, then the latest, then the first in scan order.

    An aggregate that merges: each task reduces its rows of a cluster to one before the only shuffle, so a cluster may be
    of any size. Rows without a cluster are one; a null score counts as 0.
    """
    rest = [c for c in df.columns if c != cluster]
    order = F.struct(F.coalesce("score", F.lit(0.0)), F.col("published_at").isNotNull(), F.col("published_at"), -F.col("rk"))
    (best,) = free_names(df.columns, "_best")
    found = df.groupBy(cluster).agg(F.max_by(F.struct(*[F.col(c) for c in rest]), order).alias(best))
    return found.select(*[F.col(best)[c].alias(c) if c != cluster else F.col(c) for c in df.columns])


def top_k(df: DataFrame, k: int, tie: str = "leader_rk") -> DataFrame:
    """The k rows with the largest scores, then the latest, then by tie; rank from 1. The window sees k rows."""
    keys = [F.coalesce("score", F.lit(0.0)).desc(), F.col("published_at").desc_nulls_last(), F.col(tie)]
    best = df.orderBy(*keys).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*keys)).cast("long"))


def clamp_limit(limit: int, most: int = 50) -> int:
    return max(1, min(limit, most))


def score_rows(df: DataFrame, as_of: Column, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """df with score. Columns: title, og_title, description, og_description, source_name, published_at, duplicate_count, cluster_size."""
    title = scoring.effective_title(F.col("og_title"), F.col("title"))
    context = scoring.effective_context(F.col("og_description"), F.col("description"))
    (rel,) = free_names(df.columns, "_relevance")
    score = scoring.final_score(F.col(rel), scoring.recency(F.col("published_at"), as_of), scoring.source_weight(F.col("source_name"), lexicon), F.col("duplicate_count"), F.col("cluster_size"), scoring.novelty(title))
    return scoring.with_relevance(df, title, context, rel, lexicon).withColumn("score", score).drop(rel)


def rank_articles(df: DataFrame, as_of: Column, limit: int, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Cluster by effective title, score, pick representatives, keep the top `limit`."""
    (own,) = free_names(df.columns, "_title")
    title = scoring.effective_title(F.col("og_title"), F.col("title"))
    clustered = story_clusters(df.withColumn(own, F.col("title")).withColumn("title", title)).withColumn("title", F.col(own)).drop(own)
    return top_k(representatives(score_rows(clustered, as_of, lexicon)), limit)
