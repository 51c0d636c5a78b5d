"""Near copies: texts whose sets of word shingles have a Jaccard similarity of 4/5 or more, with all that such pairs connect.

A prefix filter that loses no pair gives the candidates, and each is verified on the texts. SimHashes have no part in it: texts so
similar differ in some ten bits of them, more than a grid can reach. The pipeline links by SimHashes beside it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm import simhash
from gazette.llm.common import parted, stored, within

#: 64-bit words of the shortest parity print.
PARITY = 8
#: A shingle that many texts are known to have is dealt over so many tasks.
SALTS = 64


def shingles(text: bytes | None, width: int = 5) -> np.ndarray:
    """The sorted set of a text's shingles as 64-bit hashes: `width` words, A-Z in lower case; a shorter text is one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, k, digest = b" ".join(words), min(width, len(words)), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    ends = ends[k - 1 :].tolist()
    return np.unique(np.fromiter((digest(joined[s:e], 5) for s, e in zip(starts, ends, strict=True)), np.uint64, len(starts)))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of 4/5 or more; two empty sets have."""
    both = np.concatenate((a, b))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 5 * shared >= 4 * (len(both) - shared)


def prefix(own: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, int]:
    """So many of a set's first shingles that two similar sets share one: by hash, those of `common` after all others. And
    how many of these are in `common`.

    Similar sets share 4/5 of the larger one at least, so neither can have all it shares behind its first n - 4n/5 + 1. That
    holds in any order that is the same for all sets: which shingles are in `common` changes the work, never the pairs.
    """
    if not len(own):
        return own, 0
    at = np.minimum(np.searchsorted(common, own), max(0, len(common) - 1))
    late = common[at] == own if len(common) else np.zeros(len(own), bool)
    size = len(own) - -(-4 * len(own) // 5) + 1
    return np.concatenate((own[~late], own[late]))[:size], max(0, size - int((~late).sum()))


def parity(own: np.ndarray) -> np.ndarray:
    """Bits that are each flipped by the shingles that fall on them: two prints of one length differ in no more bits than the
    sets in shingles. A print has 64 PARITY bits or more, a power of two that is twice the number of shingles at least."""
    bits = 64 * PARITY
    while bits < 2 * len(own):
        bits *= 2
    at = (own % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def folded(mark: np.ndarray, words: int) -> np.ndarray:
    """The print that a set has in fewer words."""
    return np.bitwise_xor.reduce(mark.reshape(-1, words), axis=0)


def may_be_similar(a: bytes, b: bytes, shingles_of_both: int) -> bool:
    """Similar sets differ in a ninth of their sizes' sum at most, and their prints in no more bits."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    words = min(len(x), len(y))
    return 9 * int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()) <= shingles_of_both


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*rows, np.empty(0, np.uint64)]).view(np.int64)))


def _in_parts(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(i, size) for i in range(0, batch.num_rows, size))


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows, sorted by key, in tables that have each key's rows together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_numpy()
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        if held and (cut or held[-1].column(key)[-1].as_py() != keys[-1]):
            first = int(np.searchsorted(keys, held[-1].column(key)[-1].as_py(), "right"))
            yield pa.Table.from_batches([*held, batch.slice(0, first)])
            held, batch, cut = [], batch.slice(first), cut - first
        if cut > 0:
            yield pa.Table.from_batches([batch.slice(0, cut)])
            batch = batch.slice(cut)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def text_digest(text: Column) -> Column:
    """16 bytes that stand for a text; null has its own."""
    return F.unhex(F.substring(F.sha2(F.coalesce(F.concat(F.lit("="), text), F.lit("")), 256), 1, 32))


def common_shingles(docs: DataFrame, text_col: str, width: int, at_most_rows: int = 8000, least: int = 3, at_most: int = 200_000) -> np.ndarray:
    """Shingles that a bounded sample has in `least` texts or more, sorted. They only order the shingles (see prefix)."""
    key = F.xxhash64(F.col(text_col), F.lit("common"))
    rows = docs.where(within(key, at_most_rows / max(1, docs.count()))).select(F.col(text_col).cast("binary").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*(shingles(x.as_py(), width) for x in batch.column(0)), np.empty(0, np.uint64)]).view(np.int64))], names=["h"])

    seen = rows.mapInArrow(each, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    found = seen.orderBy(F.col("n").desc(), "h").limit(at_most).select("h").toPandas()
    return np.sort(found["h"].to_numpy(np.int64).view(np.uint64))


def prints(docs: DataFrame, id_col: str, text_col: str, width: int, common: np.ndarray) -> DataFrame:
    """Per row: doc_id, digest of the text, of its set: the set's digest, n, prefix, how many of it are common, print."""
    shared = docs.sparkSession.sparkContext.broadcast(common)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("digest"), F.col(text_col).cast("binary").alias("text"))
    none, longs = F.lit(b"").cast("binary"), F.array().cast("array<long>")
    columns = {"set": none, "n": F.lit(0).cast("long"), "prefix": longs, "n_common": F.lit(0), "mark": none}
    schema = rows.select("doc_id", "digest", *[v.alias(k) for k, v in columns.items()]).schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = shared.value
        for batch in _in_parts(batches):
            texts = [x.as_py() for x in batch.column(2)]
            own = [shingles(x, width) for x in texts]
            heads, bits = [prefix(x, late) for x in own], [parity(x) for x in own]
            marks = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in own], pa.binary())
            columns = [marks, pa.array([len(x) for x in own], pa.int64()), _lists([x for x, _ in heads]), pa.array([k for _, k in heads], pa.int32())]
            columns += [pa.array([x.tobytes() for x in bits], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=schema.names)

    return rows.mapInArrow(each, schema)


def sharing(nodes: DataFrame) -> DataFrame:
    """at, salt, id, n, first, first_n, more: each set with each shingle of its prefix that another set's has too, the first set
    that has it, and whether more than two have it (where that can't be seen, it is true). Common shingles are dealt over SALTS
    tasks, with a first set in each; others have salt -1."""
    placed = nodes.select("id", "n", (F.size("prefix") - F.col("n_common")).alias("rare"), F.posexplode("prefix").alias("pos", "at"))
    salt = F.when(F.col("pos") >= F.col("rare"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(-1).cast("int")
    placed = placed.select("at", salt.alias("salt"), "id", "n").repartition("at", "salt").sortWithinPartitions("at", "salt", "id")
    names = ["at", "salt", "id", "n", "first", "first_n", "more"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of the run of rows that ends a batch: its key, its first row, and whether that is still untold.
        key, begun, untold = None, (0, 0), False
        for batch in batches:
            at, salt, own, n = (c.to_numpy() for c in batch.columns)
            if not len(at):
                continue
            new = np.concatenate(([key != (at[0], salt[0])], (at[1:] != at[:-1]) | (salt[1:] != salt[:-1])))
            start = np.maximum.accumulate(np.where(new, np.arange(len(at)), -1))
            first, first_n = np.where(start < 0, begun[0], own[start]), np.where(start < 0, begun[1], n[start])
            if untold and not new[0]:
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (at[0], salt[0], *begun, *begun, True)], names=names)
            tell = ~new | np.append(~new[1:], False) | (salt >= 0)
            run = np.cumsum(new)
            more = (np.bincount(run)[run] > 2) | (run == 0) | (run == run[-1])
            untold = not tell[-1]
            key, begun = (at[-1], salt[-1]), (first[-1], first_n[-1])
            yield pa.RecordBatch.from_arrays([pa.array(x[tell]) for x in (at, salt, own, n, first, first_n, more)], names=names)

    return placed.mapInArrow(each, "at long, salt int, id long, n long, first long, first_n long, more boolean")


def _least_heads(shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """at, first of each task of a common shingle; at, least: the least of them."""
    heads = shared.where("salt >= 0 and id = first").select("at", "first")
    return heads, heads.groupBy("at").agg(F.min("first").alias("least"))


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def star_pairs(shared: DataFrame) -> DataFrame:
    """Candidates a < b, in number no more than the rows of `shared`: each set with the first that shares a shingle, and the first
    ones of a common shingle's tasks with the least of them."""
    sized = shared.where("4 * greatest(n, first_n) <= 5 * least(n, first_n)")
    heads, least = _least_heads(shared)
    return _pairs(sized, "id", "first").unionByName(_pairs(heads.join(least, "at"), "first", "least")).distinct()


def rest_pairs(shared: DataFrame, roots: DataFrame, nodes: DataFrame, block: int) -> DataFrame | None:
    """None where all sets that share a shingle are connected; else candidates a < b that share a shingle of their prefixes and are not connected by `roots` yet, whose sizes and prints
    allow a similarity of 4/5.

    Sets that share a shingle share its first set, so they are gathered by first sets: a set is there once, however many
    shingles it shares with the first, and is compared with the others once. What the first round has seen is left out:
    pairs with the first set of a shingle, but for common ones. More than `block` sets are dealt into blocks, and each two
    blocks meet in a task.
    """
    near = shared.where("salt < 0 and more and id <> first").select(F.col("first").alias("lead"), "id")
    common = shared.where("salt >= 0").select("at", "id").join(_least_heads(shared)[1], "at").select(F.col("least").alias("lead"), "id")
    members = stored(near.unionByName(common).distinct(), "copies-members").join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
    members = members.select("lead", "id", F.coalesce("root", "id").alias("root"))
    apart = members.groupBy("lead").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("blocks")).where("x <> y").select("lead", "blocks")
    apart = stored(apart, "copies-apart")
    if apart.isEmpty():
        return None
    dealt = members.join(apart, "lead").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cell = F.xxhash64("lead", F.least("block", "other"), F.greatest("block", "other"))
    dealt = dealt.select(cell.alias("cell"), "id", "root", "block", (F.col("block") == F.col("other")).alias("within"))
    sized = nodes.select("id", "n", "mark").join(stored(dealt.select("id").distinct(), "copies-dealt"), "id", "left_semi")
    placed = dealt.join(sized, "id").select("cell", "id", "n", "root", "block", "within", "mark").repartition("cell").sortWithinPartitions("cell", "n")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, "cell"):
            cell, own, n, root, block, within_ = (rows[c].to_numpy() for c in ("cell", "id", "n", "root", "block", "within"))
            marks = rows["mark"].to_pylist()
            short = np.stack([folded(np.frombuffer(x, np.uint64), PARITY) for x in marks])
            for step in range(1, len(cell)):
                near = (cell[step:] == cell[:-step]) & (4 * n[step:] <= 5 * n[:-step])
                if not near.any():
                    break
                k = np.nonzero(near & (root[step:] != root[:-step]) & (within_[step:] | (block[step:] != block[:-step])))[0]
                k = k[9 * np.bitwise_count(short[k] ^ short[k + step]).sum(axis=1, dtype=np.int64) <= n[k] + n[k + step]]
                k = np.array([i for i in k.tolist() if may_be_similar(marks[i], marks[i + step], int(n[i] + n[i + step]))], np.int64)
                if len(k):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(own[k], own[k + step])), pa.array(np.maximum(own[k], own[k + step]))], names=["a", "b"])

    return placed.mapInArrow(each, "a long, b long").distinct()


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, width: int, repeated: bool) -> DataFrame:
    """The pairs a, b that are similar. Prints rule out most of the others; texts, which compress well, go to the rest."""
    ids = lambda df: df.select(F.col("a").alias("id")).unionByName(df.select(F.col("b").alias("id"))).distinct()
    pairs = stored(pairs, "copies-pairs")
    if pairs.isEmpty():
        return pairs
    marks = stored(nodes.select("id", "n", "mark").join(stored(ids(pairs), "copies-paired"), "id", "left_semi"), "copies-marks")
    side = lambda x: marks.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("mark").alias(f"m{x}"))
    marked = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ma", "mb", (F.col("na") + F.col("nb")).alias("n"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [may_be_similar(x.as_py(), y.as_py(), n) for x, y, n in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    likely = stored(marked.mapInArrow(compare, "a long, b long"), "copies-likely")
    if likely.isEmpty():
        return likely
    wanted = stored(nodes.select("id", "digest").join(ids(likely), "id", "left_semi"), "copies-needed")
    some, _ = parted(docs.select(text_digest(F.col(text_col)).alias("digest"), F.col(text_col).cast("binary").alias("text")), F.col("digest"), wanted.select("digest"))
    found = some.join(wanted, "digest").select("id", "text")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([zlib.compress(x.as_py() or b"", 6) for x in batch.column(1)], pa.binary())], names=["id", "text"])

    # A text travels with each of its pairs: it is packed once, much tighter than a shuffle does.
    small = found.mapInArrow(packed, "id long, text binary")
    texts = stored(small.dropDuplicates(["id"]) if repeated else small, "copies-texts")
    both = likely.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.empty(0, np.uint64)
        for batch in _in_parts(batches, 64):
            keep = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != at:  # pairs of one text follow each other
                    at, own = a, shingles(zlib.decompress(x.as_py()), width)
                keep.append(similar(own, shingles(zlib.decompress(y.as_py()), width)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, block: int = 4096) -> DataFrame:
    """One row per row of docs: doc_id, digest (text_digest of its text), group (a long, the same for all rows of a group).

    Two texts are near copies when their sets of `width` words have a Jaccard similarity of 4/5 or more; groups are what near
    copies connect. Texts without words are copies of each other. No pair is lost, and no group of copies is paired in full:
    a first round verifies each set against few others, which connects most of what there is to connect; the second looks at
    the pairs of one shingle that are still apart. An empty table gives no rows; other columns are not looked at.
    """
    made = prints(docs, id_col, text_col, width, common_shingles(docs, text_col, width)).withColumn("id", F.monotonically_increasing_id())
    rows = stored(made, "copies-prints")
    alike = stored(rows.groupBy("set").agg(F.min("id").alias("of"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("set", "of"), "copies-alike")
    repeated = not alike.isEmpty()
    nodes = rows
    if repeated:
        some, others = parted(rows, F.col("set"), alike.select("set"))
        nodes = others.unionByName(some.join(alike, "set", "left").where("of is null or of = id").drop("of"))

    shared = stored(sharing(nodes), "copies-sharing")
    first = stored(verified(star_pairs(shared), nodes, docs, text_col, width, repeated), "copies-first")
    roots = stored(simhash.components(first), "copies-roots")
    pairs = rest_pairs(shared, roots, nodes, block)
    if pairs is not None:
        rest = stored(verified(pairs, nodes, docs, text_col, width, repeated), "copies-rest")
        if not rest.isEmpty():
            roots = simhash.components(first.unionByName(rest))
    named = rows.select("doc_id", "digest", "set", "id").join(alike, "set", "left").select("doc_id", "digest", F.coalesce("of", "id").alias("node"))
    return named.join(roots, "node", "left").select("doc_id", "digest", F.coalesce("root", "node").alias("group"))
