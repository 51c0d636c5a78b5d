"""Story clusters: candidate pairs by shared title tokens, similarity, and leader clustering in parallel."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.functions.lexicon import DEFAULT, Lexicon
from gazette.functions.staging import free_names
from gazette.functions.text import normalize_text, tokenize
from gazette.operators import overlaps
from gazette.operators.components import components
from gazette.storage import stored

MAX_HOURS = 120


def scan_order(df: DataFrame, published: str = "published_at", pos: str = "pos") -> DataFrame:
    """df with rk from 1: latest first, null times last, then by position.

    A range-partitioned sort and the counts of the partitions before: no task sorts all rows.
    """
    spark = df.sparkSession
    part, at, shift = free_names([*df.columns, "rk"], "_part", "_at", "_shift")
    ordered = df.orderBy(F.col(published).desc_nulls_last(), F.col(pos)).withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id())
    ordered = stored(ordered, "scan-order")
    sizes = ordered.groupBy(F.col(part).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first")).orderBy("part").collect()
    before, rows = 0, []
    for r in sizes:
        rows.append((r.part, before - r["first"] + 1))
        before += r.n
    shifts = spark.createDataFrame(rows, f"{part} int, {shift} long")
    return ordered.join(F.broadcast(shifts), part).withColumn("rk", F.col(at) + F.col(shift)).drop(part, at, shift)


def with_tokens(df: DataFrame, title: str = "title", lexicon: Lexicon = DEFAULT) -> DataFrame:
    norm = normalize_text(F.col(title))
    return df.withColumn("norm", norm).withColumn("tokens", tokenize(F.col("norm"), lexicon.stopwords))


def candidate_pairs(asked: DataFrame, kinds: DataFrame, least: int = 2, rows: DataFrame | None = None, characters: bool = False, named: bool = False, block: int = 8192, chunk: int = 4096) -> DataFrame:
    """l, r, overlap, l_n, r_n: rows of `asked` (rk, norm, tokens, published_at) and titles of `kinds` (as titles() gives), before or
    behind them, that have another text and share `least` tokens or more, and the numbers of tokens of both.

    `rows`: those that have the titles; then also aligned and apart, how many of title r's rows are within MAX_HOURS of l and how
    many aren't. `characters`: then also both (the characters that both texts have), l_length and r_length. `named`: l_norm, r_norm.

    Frequent tokens count too, so the pairs of all rows would grow with the square of their number; a stated part of the rows
    asks all titles. Blocks of some `block` asked rows meet parts of the titles, each two in a cell of their own, where shared tokens
    are counted by posting lists: a task holds a block and a few titles at a time, and no pair is shuffled. Equal texts ask once in a
    block. A title's dates come `chunk` at a time.
    """
    told = F.size("tokens") >= least
    left, right = asked.where(told), kinds.where(told)
    if rows is not None:
        return _dated_pairs(left, right, rows, least, characters, named, block, chunk)
    return _search(left, right.withColumns({"dates": F.array().cast("array<long>"), "undated": F.lit(0).cast("long")}), least, characters, False, named, block)


def _dated_pairs(asked: DataFrame, kinds: DataFrame, rows: DataFrame, least: int, characters: bool, named: bool, block: int, chunk: int) -> DataFrame:
    """candidate_pairs with aligned and apart: a title of more than `chunk` rows is there once for each chunk of its dates."""
    at = F.unix_micros(F.col("published_at").cast("timestamp"))
    of = kinds.select("norm", F.col("rk").alias("title"), F.ceil(F.col("copies") / F.lit(chunk)).alias("chunks"))
    dealt = rows.select("norm", at.alias("at"), F.xxhash64("rk").alias("deal")).join(of, "norm").withColumn("chunk", F.pmod("deal", "chunks"))
    dates = dealt.groupBy("title", "chunk", "chunks").agg(F.sort_array(F.collect_list("at")).alias("dates"), F.count_if(F.col("at").isNull()).alias("undated"))
    full = stored(kinds.select("rk", "norm", "tokens").join(dates.withColumnRenamed("title", "rk"), "rk"), "title-dates")
    few = _search(asked, full.where("chunks = 1"), least, characters, True, named, block)
    many = full.where("chunks > 1")
    if many.isEmpty():
        return few
    parts = _search(asked, many, least, characters, True, named, block)
    sums = [F.sum(c).alias(c) for c in ("aligned", "apart")]
    return few.unionByName(parts.groupBy([c for c in parts.columns if c not in ("aligned", "apart")]).agg(*sums))


def _search(asked: DataFrame, kinds: DataFrame, least: int, characters: bool, dated: bool, named: bool, block: int) -> DataFrame:
    n, titles_ = asked.count(), kinds.count()
    blocks = max(1, -(-n // block))
    # As many parts as keep all tasks busy; beyond, a part grows, which a task reads a few titles at a time.
    parts = max(1, min(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-titles_ // 512)))
    deal = lambda by: F.pmod(F.xxhash64("rk"), F.lit(by))
    every = lambda by: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(by - 1).cast("long")))
    at = F.unix_micros(F.col("published_at").cast("timestamp")) if dated else F.lit(None).cast("long")
    left = asked.select(deal(blocks).alias("block"), every(parts).alias("part"), F.lit(0).alias("side"), "rk", "norm", "tokens", at.alias("at"), F.array().cast("array<long>").alias("dates"), F.lit(0).cast("long").alias("undated"))
    right = kinds.select(every(blocks).alias("block"), deal(parts).alias("part"), F.lit(1).alias("side"), "rk", "norm", "tokens", F.lit(None).cast("long").alias("at"), "dates", "undated")
    place = ((F.col("block") * parts + F.col("part")) * 2 + F.col("side")).alias("place")
    placed = left.unionByName(right).select(place, F.shiftright(place, 1).alias("cell"), "rk", F.col("norm").cast("string").alias("norm"), "tokens", "at", "dates", "undated")
    placed = placed.repartition(blocks * parts, "cell").sortWithinPartitions("place")
    kinds_of = {"l": "long", "r": "long", "overlap": "int", "l_n": "int", "r_n": "int"}
    kinds_of |= dict.fromkeys(("both", "l_length", "r_length"), "int") if characters else {}
    kinds_of |= dict.fromkeys(("aligned", "apart"), "int") if dated else {}
    kinds_of |= dict.fromkeys(("l_norm", "r_norm"), "string") if named else {}
    names, reach = list(kinds_of), MAX_HOURS * 3_600_000_000 if dated else None
    found = placed.mapInArrow(lambda batches: overlaps.search(batches, names, least, characters, reach, named), ", ".join(f"{k} {v}" for k, v in kinds_of.items()))
    return found.withColumns({c: F.col(c).cast("long") for c in names if c in ("overlap", "aligned", "apart")})


def with_sides(pairs: DataFrame, asked: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """Pairs with norm, number of tokens and published_at of both sides, jaccard and overlap ratio."""
    side = lambda df, p: df.select(F.col("rk").alias(p), F.col("norm").alias(f"{p}_norm"), F.size("tokens").alias(f"{p}_n"), F.col("published_at").alias(f"{p}_at"))
    return with_ratios(pairs.join(side(asked, "l"), "l").join(side(asked if kinds is None else kinds, "r"), "r"))


def with_ratios(pairs: DataFrame) -> DataFrame:
    """Pairs (overlap, l_n, r_n) with jaccard and overlap ratio."""
    out = pairs.withColumn("jaccard", F.col("overlap") / (F.col("l_n") + F.col("r_n") - F.col("overlap")))
    return out.withColumn("overlap_ratio", F.col("overlap") / F.greatest(F.least("l_n", "r_n"), F.lit(1)))


def time_aligned(left: str, right: str, hours: int = MAX_HOURS):
    apart = F.abs(F.unix_micros(F.col(left).cast("timestamp")) - F.unix_micros(F.col(right).cast("timestamp")))
    return F.coalesce(apart <= hours * 3_600_000_000, F.lit(True))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """The matching ratio of two strings; it depends on which comes first."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right, strict=True)], dtype="float64")


#: The characters of normalised titles.
_CHARACTERS = " 0123456789abcdefghijklmnopqrstuvwxyz"


def character_counts(norm: Column) -> Column:
    """How often each character of normalised text is in it."""
    return F.transform(F.split(F.lit(_CHARACTERS), ""), lambda c: F.length(norm) - F.length(F.replace(norm, c, F.lit(""))))


def quick_ratio(left: Column, right: Column, left_counts: Column, right_counts: Column) -> Column:
    """What the matching ratio of two normalised strings is at most: matched characters are in both, however they stand."""
    both = F.aggregate(F.zip_with(left_counts, right_counts, lambda a, b: F.least(a, b)), F.lit(0), lambda n, c: n + c)
    return shared_ratio(both, F.length(left) + F.length(right))


def shared_ratio(both: Column, length: Column) -> Column:
    """What the matching ratio of two texts of this length together is at most, which have so many characters both."""
    return F.when(length == 0, F.lit(1.0)).otherwise(2 * both / length)


def with_quick_ratio(sides: DataFrame) -> DataFrame:
    """sides (l, r, l_norm, r_norm) with quick. Characters are counted once a title, not once a pair."""
    counted = lambda p: sides.select(F.col(f"{p}_norm").alias("norm"))
    counts = counted("l").unionByName(counted("r")).distinct().withColumn("counts", character_counts(F.col("norm")))
    for p in "lr":
        sides = sides.join(counts.select(F.col("norm").alias(f"{p}_norm"), F.col("counts").alias(f"{p}_counts")), f"{p}_norm")
    quick = quick_ratio(F.col("l_norm"), F.col("r_norm"), F.col("l_counts"), F.col("r_counts"))
    return sides.withColumn("quick", quick).drop("l_counts", "r_counts")


def title_similarity(sides: DataFrame) -> DataFrame:
    """sides with sim = 0.65 jaccard + 0.35 ratio; the later row is the left one."""
    return sides.withColumn("sim", F.lit(0.65) * F.col("jaccard") + F.lit(0.35) * sequence_ratio("l_norm", "r_norm"))


def titles(df: DataFrame) -> DataFrame:
    """One row a distinct title (norm) of df: rk, published_at (of its first row in scan order), last (rk of its last), tokens, copies."""
    first = F.min(F.struct("rk", "published_at")).alias("first")
    kinds = df.groupBy("norm").agg(first, F.max("rk").alias("last"), F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("copies"))
    return kinds.select("first.rk", "first.published_at", "last", "norm", "tokens", "copies")


def similar_sets(df: DataFrame, least: float, least_shared: int = 1, cell: int = 4096) -> DataFrame:
    """l, r, overlap of the pairs of df (rk, tokens) with l > r whose token sets share `least_shared` tokens or more and have a
    Jaccard index of `least` or more. Nothing is lost (see set_candidates)."""
    return set_candidates(df, least, least_shared, cell)


def set_candidates(df: DataFrame, least: float, least_shared: int = 1, cell: int = 4096) -> DataFrame:
    """l, r, overlap of the pairs of df (rk, tokens) with l > r that meet by a token and are similar (see similar_sets).

    Rarest tokens first, two such sets share one of the tokens that are left when each gives up its last needed - 1, where it
    needs ceil(least * size) or least_shared shared ones; so a frequent token brings rows together only where a title has little
    else. Where sets meet, their tokens are with them and are counted there, by posting lists; a pair is given by the first token
    that both have, so once, and neither pairs nor their sets are shuffled.
    The token that a pair is given by also bounds how large either set may be for the other, by the tokens that are left from it on: sets
    that may meet none of their own size by it don't meet each other, only the others (see overlaps).
    A token that more than `cell` rows meet by is dealt in blocks; each two meet in a place of their own, where a pair may be in them.
    """
    terms = df.select("rk", F.explode("tokens").alias("t"))
    held = terms.groupBy("t").agg(F.count(F.lit(1)).alias("held"))
    # Numbers in the order of the sort: a partition's are above those of the partitions before it.
    order = stored(held.orderBy("held", "t").withColumn("o", F.monotonically_increasing_id()), "title-tokens")
    # A little is taken off so that rounding can only let one token more in.
    needed = lambda n: F.greatest(F.ceil(F.lit(least) * n - F.lit(1e-9)), F.lit(least_shared))
    owns = terms.join(order.select("t", "o"), "t").groupBy("rk").agg(F.array_sort(F.collect_list("o")).alias("own"))
    n = F.size("own")
    placed = owns.where(n >= least_shared).select("rk", "own", F.posexplode(F.slice("own", F.lit(1), (n - needed(n) + 1).cast("int"))).alias("pos", "first"))
    asked = F.floor((n - F.col("pos")) * F.lit(overlaps.reach(least))) - n >= n
    heads = stored(placed.select("rk", "own", asked.alias("asked"), "first"), "title-heads")
    counts = heads.groupBy("first").agg(F.count_if("asked").alias("n"), F.count(F.lit(1)).alias("rows")).where("rows > 1 and n > 0")
    blocks = lambda c: F.when(F.col("rows") <= cell, F.lit(0)).otherwise(F.ceil(c / F.lit(cell))).cast("long")
    counts = counts.select("first", F.greatest(blocks(F.col("n")), F.lit(1)).alias("blocks"), blocks(F.col("rows") - F.col("n")).alias("more"))
    deal = lambda by: F.pmod(F.xxhash64("rk"), F.col(by))
    block = F.when(F.col("asked") | (F.col("more") == 0), deal("blocks")).otherwise(F.col("blocks") + deal("more"))
    dealt = heads.join(counts, "first").withColumn("block", block)
    every = F.col("blocks") + F.when(F.col("block") < F.col("blocks"), F.col("more")).otherwise(0)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), every - 1)))
    dealt = dealt.select("first", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "rk", "block", "own")
    # So many tasks, whatever the bytes: the work is in the pairs.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(tasks, "first", "x", "y").sortWithinPartitions("first", "x", "y")
    names = ["l", "r", "overlap"]
    return dealt.mapInArrow(lambda batches: overlaps.meet(batches, names, least, least_shared), "l long, r long, overlap long")


def story_candidates(kinds: DataFrame) -> DataFrame:
    """The pairs of titles, both ways, that may tell one story by their tokens, with both sides (see with_sides); and a title with
    itself where it has copies. kinds: as titles() gives."""
    told = kinds.where(F.size("tokens") >= 2)
    pairs = similar_sets(told, 0.415, 2)
    own = told.where(F.col("copies") > 1).select(F.col("rk").alias("l"), F.col("rk").alias("r"), F.size("tokens").cast("long").alias("overlap"))
    both = pairs.unionByName(pairs.select(F.col("r").alias("l"), F.col("l").alias("r"), "overlap")).unionByName(own)
    ends = kinds.select(F.col("rk").alias("l"), "last")
    return with_sides(both.join(ends, "l").where("r < last"), kinds).where("jaccard >= 0.415 and overlap_ratio >= 0.5").drop("last")


def worth_matching(sides: DataFrame) -> DataFrame:
    """The sides, with quick, that a ratio no larger than the quick one can still lift over a threshold of same_story_pairs."""
    most = F.lit(0.65) * F.col("jaccard") + F.lit(0.35) * F.col("quick") + F.lit(1e-9)
    return with_quick_ratio(sides).where((most >= 0.78) | (most >= 0.62) & (F.col("overlap_ratio") >= 0.7))


def same_story_pairs(kinds: DataFrame) -> DataFrame:
    """l, r, sim, any_date: titles such that a row of title l joins a leader of title r before it, at any date or (any_date
    false) within MAX_HOURS. kinds: as titles() gives. Both directions, and a title with itself where it has copies, as far as
    rows stand in that order. Pairs that their ratio can't lift are dropped before the UDF: by a ratio of 1, then by the quick one."""
    told = title_similarity(worth_matching(story_candidates(kinds)))
    told = told.withColumn("any_date", (F.col("sim") >= 0.78) & (F.col("overlap_ratio") >= 0.5))
    near = (F.col("sim") >= 0.62) & (F.col("overlap_ratio") >= 0.7)
    return told.where(F.col("any_date") | near).select("l", "r", "sim", "any_date")


def _led(rows: DataFrame, edges: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """rows (rk, title, published_at) joined to the leaders found before them that they may join, as lead."""
    ahead = edges.join(found.select(F.col("title").alias("r"), F.col("rk").alias("lead"), F.col("published_at").alias("lead_at")), "r")
    return rows.join(ahead, (F.col("title") == F.col("l")) & (F.col("lead") < F.col("rk")) & (F.col("any_date") | time_aligned("published_at", "lead_at")), how)


def _in_rounds(every: DataFrame, e: DataFrame) -> DataFrame:
    """title, published_at, leader of rows of any number. Rows behind a leader that they may join are members; of the rest, a
    row leads if no undecided row of its title or a linked one stands before it. As many rounds as the longest chain of leaders
    that wait for each other; each is written out."""
    rest, found = every, every.limit(0)
    while not rest.isEmpty():
        first = rest.groupBy("title").agg(F.min("rk").alias("open"))
        linked = e.join(first.withColumnRenamed("title", "r"), "r").select(F.col("l").alias("title"), "open")
        before = linked.unionByName(first).groupBy("title").agg(F.min("open").alias("open"))
        new = stored(rest.join(before, "title").where(F.col("rk") <= F.col("open")).drop("open"), "story-leaders")
        found = found.unionByName(new.select(*found.columns))
        undecided = rest.join(new.select("rk"), "rk", "left_anti").select(*every.columns)
        rest = stored(_led(undecided, e, new, "left_anti"), "story-rest")
    joined = _led(every, e, stored(found, "story-all-leaders"), "left")
    return joined.groupBy("title", "published_at", "rk").agg(F.min("lead").alias("lead")).select("title", "published_at", F.coalesce("lead", "rk").alias("leader"))


def scan(rows: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """title, at (microseconds), leader of rows (title, rk, at), one after the other: each joins the first leader that it has an
    edge (l, r, any_date) to, else it leads."""
    ahead: dict[int, list[tuple[int, bool]]] = {}
    for left, right, any_date in zip(edges["l"].tolist(), edges["r"].tolist(), edges["any_date"].tolist(), strict=True):
        ahead.setdefault(left, []).append((right, any_date))
    leading: dict[int, list[tuple[int, int | None]]] = {}
    out = []
    for title, rk, at in sorted(zip(rows["title"].tolist(), rows["rk"].tolist(), (None if pd.isna(x) else int(x) for x in rows["at"]), strict=True), key=lambda r: r[1]):
        found = [lead for r, any_date in ahead.get(title, ()) for lead, b in leading.get(r, ()) if any_date or at is None or b is None or abs(at - b) <= MAX_HOURS * 3_600_000_000]
        if not found:
            leading.setdefault(title, []).append((rk, at))
        out.append((title, at, min(found, default=rk)))
    return pd.DataFrame(out, columns=["title", "at", "leader"]).astype({"at": "Int64"})


def leaders(rows: DataFrame, edges: DataFrame, whole: int = 4096, bucket: int = 16384) -> DataFrame:
    """title, published_at, leader: whom the rows (rk, title, published_at) of titles with edges (l, r, any_date) join; a leader
    joins itself.

    Scanning in order, a row joins the first leader it has an edge to, else it leads. Rows of different components of the graph
    of titles never meet, so components of at most `whole` rows and edges are scanned as they are, many in one task, in buckets
    of some `bucket` rows and edges. Larger ones are decided in rounds. Rows of one title and date join the same leader and
    are one.
    """
    e = stored(edges.select("l", "r", "any_date"), "story-edges")
    named = e.select(F.col("l").alias("title")).unionByName(e.select(F.col("r").alias("title"))).distinct()
    every = rows.join(named, "title").groupBy("title", "published_at").agg(F.min("rk").alias("rk"))
    root = components(e.select(F.col("l").alias("a"), F.col("r").alias("b"))).withColumnRenamed("node", "title")
    every = stored(every.join(root, "title", "left").withColumn("root", F.coalesce("root", "title")), "story-kinds")
    linked = e.join(root.withColumnRenamed("title", "l"), "l", "left").withColumn("root", F.coalesce("root", "l"))
    counted = every.groupBy("root").agg(F.count(F.lit(1)).alias("n")).unionByName(linked.groupBy("root").agg(F.count(F.lit(1)).alias("n")))
    sizes = stored(counted.groupBy("root").agg(F.sum("n").alias("n")), "story-sizes")
    large = sizes.where(F.col("n") > whole).select("root")
    total, most = sizes.agg(F.sum(F.when(F.col("n") <= whole, F.col("n"))), F.max("n")).first()
    none = (most or 0) <= whole
    part = lambda df, how: df if none and how == "left_anti" else df.join(large, "root", how)
    deal = F.pmod(F.xxhash64("root"), F.lit(max(1, -(-(total or 0) // bucket)))).alias("bucket")
    left = part(every, "left_anti").select(deal, "title", "rk", F.unix_micros(F.col("published_at").cast("timestamp")).alias("at"))
    right = part(linked, "left_anti").select(deal, "l", "r", "any_date")
    told = left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInPandas(scan, "title long, at long, leader long")
    kind = every.schema["published_at"].dataType
    out = told.select("title", F.timestamp_micros("at").cast(kind).alias("published_at"), "leader")
    if none:
        return out
    return out.unionByName(_in_rounds(stored(part(every, "left_semi").drop("root"), "story-large"), stored(part(linked, "left_semi").drop("root"), "story-large-edges")))


def story_clusters(df: DataFrame) -> DataFrame:
    """df (id, title, published_at, pos) with rk, leader_rk, cluster_id (the leader's id) and cluster_size, which replace columns
    of these names; other columns stay as they are, whatever they are called."""
    base = stored(scan_order(df.drop("rk", "leader_rk", "cluster_id", "cluster_size")), "story-rows")
    slim = stored(with_tokens(base.select("rk", "title", "published_at")).select("rk", "norm", "tokens", "published_at"), "story-words")
    kinds = stored(titles(slim), "story-distinct")
    rows = slim.join(kinds.select("norm", F.col("rk").alias("title")), "norm").select("rk", "title", "published_at")
    joined = leaders(rows, same_story_pairs(kinds)).withColumnsRenamed({"title": "of", "published_at": "at"})
    same = (F.col("title") == F.col("of")) & F.col("published_at").eqNullSafe(F.col("at"))
    led = stored(rows.join(joined, same, "left").select("rk", F.coalesce("leader", "rk").alias("leader_rk")), "story-led")
    sizes = led.groupBy("leader_rk").agg(F.count(F.lit(1)).alias("cluster_size"))
    names = base.select(F.col("rk").alias("leader_rk"), F.col("id").alias("cluster_id"))
    return base.join(led.join(sizes.join(names, "leader_rk"), "leader_rk"), "rk")
