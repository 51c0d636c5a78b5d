"""SimHash near-duplicates: segment popcounts place fingerprints on a grid, and pairs that share a cell are verified."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import fresh, remove, stored, unsent


#: How many tasks the rows of one fingerprint, and the fingerprints of one component, are dealt over.
SALTS = 16


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """The SimHash of a text as an unsigned number: shingles of `width` words, A-Z in lower case, repeats counted."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    ends, digest = ends[k - 1 :].tolist(), xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 16):
        h = [digest(joined[s:e], seed) for s, e in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)]
        ones += np.unpackbits(np.array(h, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    schema = rows.select("doc_id", F.lit(0).cast("long").alias("fp")).schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py(), width) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return rows.mapInArrow(each, schema)


def cells(fp: Column, segments: int) -> tuple[Column, Column]:
    """The fingerprint's own grid cell, and all cells within Manhattan distance 1 of it, its own first.

    A cell is the vector of the bit counts of `segments` equal segments, each count plus one in a digit of a long.
    Flipping one bit changes one count by one, so the Manhattan distance of two vectors is at most the Hamming distance.
    """
    if segments not in (4, 8, 16):
        raise ValueError("segments must be 4, 8 or 16")
    wide = step = 64 // segments
    counts = [F.bit_count(F.shiftrightunsigned(fp, wide * i).bitwiseAND(F.lit((1 << wide) - 1).cast("long"))) for i in range(segments)]
    own = reduce(lambda x, y: x.bitwiseXOR(y), [F.shiftleft((c + 1).cast("long"), step * i) for i, c in enumerate(counts)])
    up = [F.when(c < wide, own + F.shiftleft(F.lit(1).cast("long"), step * i)) for i, c in enumerate(counts)]
    down = [F.when(c > 0, own - F.shiftleft(F.lit(1).cast("long"), step * i)) for i, c in enumerate(counts)]
    return own, F.filter(F.array(own, *up, *down), lambda x: x.isNotNull())


def links(nodes: DataFrame, segments: int = 16, dense: int = 64) -> DataFrame:
    """Links between different fingerprints (column fp, distinct) that differ in at most 2 bits: a, b with b < a.

    Two vectors within Manhattan distance 2 have a cell within 1 of both, so pairs of fingerprints that share one of their
    cells are all candidates there are; each is verified on its bits. A cell of more than `dense` fingerprints is not paired:
    each of its fingerprints takes the 65 codes within one bit of it, and all that share a code are linked to the
    smallest. Sharers differ in 2 bits at most, and any two fingerprints that do share a code, so components are the same.
    """
    own, near = cells(F.col("fp"), segments)
    # A table of fingerprints is small beside what it explodes to: all tasks take part.
    spread = nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    placed = spread.select("fp", F.explode(near).alias("cell"))
    counts = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(unsent(placed).join(counts, "cell").withColumn("own", own), "simhash-cells")
    sparse = shared.where(F.col("n") <= dense)
    a, b = sparse.alias("a"), sparse.alias("b")
    differ = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp")))
    # Vectors that are equal share all their cells: their own is enough.
    once = (F.col("a.own") != F.col("b.own")) | (F.col("a.own") == F.col("a.cell"))
    pairs = unsent(a).join(b, (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") > F.col("b.fp")) & (differ <= 2) & once)
    pairs = pairs.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    crowd = shared.where(F.col("n") > dense).select("fp").distinct()
    codes = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), i)) for i in range(64)])
    coded = crowd.select("fp", F.explode(codes).alias("code"))
    least = coded.groupBy("code").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("code", "b")
    stars = unsent(coded).join(least, "code").where("fp > b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for every node of the edges (a, b). Alternates large and small stars.

    Each round is written to the shared folder and the one before deleted; nothing but a count and a sum reaches the driver.
    """
    spark = edges.sparkSession

    def large(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()

    def small(e: DataFrame) -> DataFrame:
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        to = e.join(least, "a")
        return to.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()

    at, before = "", None
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    while True:
        path = fresh(spark, "components")
        small(large(now)).write.parquet(path)
        if at:
            remove(spark, at)
        at, now = path, spark.read.schema(edges.schema).parquet(path)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = seen


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, segments: int = 16, dense: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable).

    A null or wordless text has fingerprint zero and links like any other; null ids are never the smallest. Rows of one
    fingerprint are collapsed before any pairing, so copies make no pairs. An empty table gives no rows; other columns
    are not looked at.
    """
    prints = stored(fingerprints(docs, id_col, text_col, width), "simhash-prints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")), "simhash-nodes")
    edges = stored(links(nodes.select("fp"), segments, dense), "simhash-links")
    roots = components(edges).withColumnRenamed("node", "fp")
    roots = stored(roots.unionByName(roots.select(F.col("root").alias("fp"), "root").distinct()), "simhash-roots")
    smallest = unsent(roots).join(nodes, "fp").groupBy("root").agg(F.min("least_id").alias("of_all"))
    salt, every = lambda key: F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    linked = unsent(roots.withColumn("salt", salt("fp"))).join(smallest.select("root", "of_all", every), ["root", "salt"]).select("fp", "of_all")
    # Only fingerprints that have a link or a copy are looked up, those of many rows in SALTS tasks.
    named = unsent(nodes).join(linked, "fp", "left").where("n > 1 or of_all is not null")
    named = named.select("fp", F.coalesce("of_all", "least_id").alias("component"), every)
    salted = prints.withColumn("salt", salt("doc_id"))
    component = F.coalesce("component", "doc_id").alias("component_id")
    return unsent(salted).join(named, ["fp", "salt"], "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component)
