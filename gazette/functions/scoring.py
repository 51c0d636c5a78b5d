"""Scores of an article as Columns: relevance, recency, source, novelty, signals and their weighted sum."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions.lexicon import DEFAULT, Lexicon
from gazette.functions.staging import free_names
from gazette.functions.text import literal_array, normalize_text, present, split_words, strip


def effective_title(og_title: Column, title: Column) -> Column:
    return F.coalesce(present(og_title), title)


def effective_context(og_description: Column, description: Column) -> Column:
    return F.coalesce(present(og_description), present(description), F.lit(""))


def hits(tokens: Column, lexicon_words) -> Column:
    return F.size(F.array_intersect(tokens, literal_array(lexicon_words))).cast("long")


def phrase_hits(text: Column, phrases) -> Column:
    """How many of the phrases occur anywhere in the text, within words too."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(p)).cast("long") for p in phrases])


def boost(n: Column, base: float, extra: float = 0.03, most_extra: int = 2) -> Column:
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.lit(base) + F.least(n - 1, F.lit(most_extra)) * F.lit(extra))


def content(title: Column, context: Column) -> Column:
    return normalize_text(F.concat(title, F.lit(" "), context))


def with_hits(df: DataFrame, title: Column, context: Column, lexicon: Lexicon = DEFAULT) -> tuple[DataFrame, dict[str, str]]:
    """df with columns of the normalised text, the words of it that the lexicon has, and the hits of each list; and what these
    columns are called: norm, found, low, high_phrases, low_phrases, and a name for each group of the lexicon.

    The text is read once for all lists: against one set of their words. Only the few that are found are told apart by list.
    """
    lists = {**{name: w for name, w, _ in lexicon.groups}, "low": lexicon.low}
    known = ["norm", "found", "high_phrases", "low_phrases", *lists]
    at = dict(zip(known, free_names(df.columns, *(f"_{k}" for k in known)), strict=True))
    col = lambda k: F.col(at[k])
    every = sorted({w for words_ in lists.values() for w in words_} - set(lexicon.stopwords))
    df = df.withColumn(at["norm"], content(title, context))
    df = df.withColumn(at["found"], F.array_intersect(F.split(col("norm"), " "), literal_array(every).cast("array<string>")))
    counts = {at[name]: hits(col("found"), words_) for name, words_ in lists.items()}
    counts |= {at["high_phrases"]: phrase_hits(col("norm"), lexicon.high_phrases), at["low_phrases"]: phrase_hits(col("norm"), lexicon.low_phrases)}
    return df.withColumns(counts), at


def with_relevance(df: DataFrame, title: Column, context: Column, out: str = "relevance", lexicon: Lexicon = DEFAULT) -> DataFrame:
    """df with a number between 0 and 1: boosts for lexicon hits and phrases, less a penalty for low-priority ones; 0.2 for
    no words. Words and hits are columns of their own on the way, so that each is computed once."""
    df, at = with_hits(df, title, context, lexicon)
    col = lambda k: F.col(at[k])
    score = reduce(lambda s, g: s + boost(col(g[0]), g[2]), lexicon.groups, F.lit(0.15))
    score = score + F.least(col("high_phrases"), F.lit(2)) * F.lit(0.07)
    low = col("low_phrases") + col("low")
    some = reduce(lambda a, b: a + b, [col(name) for name, _, _ in lexicon.groups]) > 0
    penalty = F.when(some, F.lit(0.08)).otherwise(F.lit(0.22)) + F.least(low, F.lit(3)) * F.lit(0.03)
    score = score - F.when(low > 0, penalty).otherwise(F.lit(0.0))
    return df.withColumn(out, F.when(col("norm") == "", F.lit(0.2)).otherwise(F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))))).drop(*at.values())


def recency(published: Column, as_of: Column) -> Column:
    """By age in hours, the bounds included; 0.3 where the time is not known."""
    age = F.greatest((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(published.cast("timestamp"))) / F.lit(3.6e9), F.lit(0.0))
    by_age = reduce(lambda w, x: w.when(age <= x[0], F.lit(x[1])), [(24, 0.8), (48, 0.6), (96, 0.4)], F.when(age <= 6, F.lit(1.0)))
    return F.when(published.isNull(), F.lit(0.3)).otherwise(by_age.otherwise(F.lit(0.2)))


def source_weight(name: Column, lexicon: Lexicon = DEFAULT) -> Column:
    table = F.create_map(*[F.lit(x) for pair in lexicon.source_weights.items() for x in pair])
    return F.coalesce(F.try_element_at(table, strip(F.lower(name))), F.lit(lexicon.default_weight))


def novelty(title: Column) -> Column:
    """Distinct words by white space, of 20 at most."""
    return F.least(F.size(F.array_distinct(split_words(F.lower(title)))) / F.lit(20.0), F.lit(1.0))


def signal(n: Column) -> Column:
    return F.least(n / F.lit(5.0), F.lit(1.0))


def final_score(rel: Column, rec: Column, weight: Column, duplicates: Column, cluster_size: Column, new: Column) -> Column:
    total = F.lit(0.38) * rel + F.lit(0.24) * rec + F.lit(0.14) * weight + F.lit(0.10) * signal(duplicates)
    return F.round(total + F.lit(0.09) * signal(F.greatest(cluster_size, F.lit(1))) + F.lit(0.05) * new, 5)
