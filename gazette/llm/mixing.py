"""Mixing sources to target weights: repetition rates from token totals, then whole copies and a hash-seeded one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.llm.common import WORD, free_names, stored


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def chance(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone: 48 bits of an MD5. A null key hashes as 'null'."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target of each source. sizes: source, size.

    The sources, by code point with null last, take the weights in turn, and share `share` of all sizes by them. No target
    exceeds `most` times its source's size; what is over goes to the others by weight, until none is above. That is found
    in one pass: by increasing cap/weight, a source is full exactly if its cap/weight is no more than what a unit of
    weight would get from what the sources before it leave.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int"))
    every, earlier = Window.partitionBy(), Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    t = totals.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    t = t.withColumn("ratio", F.col("cap") / F.col("weight"))
    t = t.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share))).withColumn("weight_sum", F.sum("weight").over(every))
    per_unit = (F.col("budget") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / (F.col("weight_sum") - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
    t = t.withColumn("full", F.col("ratio") <= per_unit)
    only = lambda x, yes: F.sum(F.when(F.col("full") == F.lit(yes), F.col(x)).otherwise(F.lit(0.0))).over(every)
    rest = (F.col("budget") - only("cap", True)) / only("weight", False)
    return t.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * rest)).select("source", "source_size", "target")


#: How many draws a source's fractional copies are chosen from.
DRAWS = 16


def shifted(chance_: Column, draw: Column) -> Column:
    """The draw's number of a document: its chance turned by a sixteenth of the circle for each draw."""
    x = chance_ + draw / F.lit(float(DRAWS))
    return x - F.floor(x)


def best_draws(rated: DataFrame) -> DataFrame:
    """of, draw: per source the draw whose words come nearest to the target, the first of equals. rated: source, source_size,
    target, rate, size, chance. The sums of all draws take one aggregate."""
    rest = F.col("rate") - F.floor("rate")
    sums = [F.sum(F.when(shifted(F.col("chance"), F.lit(d)) < rest, F.col("size")).otherwise(0)).alias(f"d{d}") for d in range(DRAWS)]
    summed = rated.groupBy(F.col("source").alias("of")).agg(F.max(F.floor("rate") * F.col("source_size")).alias("whole"), F.max("target").alias("target"), *sums)
    off = [F.struct(F.abs(F.col("whole") + F.col(f"d{d}") - F.col("target")).alias("off"), F.lit(d).alias("draw")) for d in range(DRAWS)]
    return summed.select("of", F.array_min(F.array(*off))["draw"].alias("draw"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, rate, draw, copies, taken.

    A document is emitted floor(rate) times, and once more with a probability of the fraction, drawn from a hash of its id:
    reruns agree, and rows that share an id share the draw. Of DRAWS such draws each source takes the one that comes nearest
    to its target. A null text has size 0; null is a source like any other; a source without words has target 0. An empty
    table gives no rows; other columns are not looked at. A row a source meets in one task: they may be many thousands.
    """
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), chance(F.col(id_col), seed).alias("chance"))
    sizes = stored(sizes, "mix-sizes")
    targets = stored(source_targets(sizes, weights, share, most).withColumnRenamed("source", "of"), "mix-targets")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    rated = sizes.join(targets, F.col("source").eqNullSafe(F.col("of")), "left").drop("of").withColumn("target", F.coalesce("target", F.lit(0.0))).withColumn("rate", rate)
    draws = stored(best_draws(rated), "mix-draws")
    out = rated.join(draws, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    whole = F.floor("rate")
    out = out.withColumn("copies", whole + F.when(shifted(F.col("chance"), F.col("draw")) < F.col("rate") - whole, 1).otherwise(0))
    return out.withColumn("taken", F.col("size") * F.col("copies")).drop("chance")


def emit(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Rate and draw of a source are looked up, so texts are not shuffled by id."""
    of, rate, draw, copies, copy = free_names(docs.columns, "_of", "_rate", "_draw", "_copies", "_copy")
    mixed = mix(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    rates = stored(mixed.groupBy(F.col("source").alias(of)).agg(F.max("rate").alias(rate), F.max("draw").alias(draw)), "mix-rates")
    whole = F.floor(rate)
    times = whole + F.when(shifted(chance(F.col(id_col), seed), F.col(draw)) < F.col(rate) - whole, 1).otherwise(0)
    out = docs.join(rates, F.col(source_col).eqNullSafe(F.col(of)), "left").withColumn(copies, F.coalesce(times, F.lit(0)).cast("int"))
    return out.where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
