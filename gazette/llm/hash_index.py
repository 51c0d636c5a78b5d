"""Approximate nearest neighbours by multi-index hashing of learned, rotated binary codes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.llm.common import stored, within

#: A code has WORDS rotations of 64 bits each; its PARTS substrings of 16 bits each have an index of their own. Its last bit
#: is always 0, so that a distance fits a byte.
WORDS, PARTS = 4, 16
#: Buckets are probed for up to so many flipped bits of a substring; beyond, comparing all codes of a shard costs less.
FLIPS = 2
_VALUES = np.arange(1 << 16, dtype=np.uint16)
_MASKS = [_VALUES[np.bitwise_count(_VALUES) <= q] for q in range(FLIPS + 1)]


@dataclass
class Codes:
    """What makes a code of a vector."""

    longest: float  # the largest norm
    mean: np.ndarray
    rotation: np.ndarray  # (dimensions + 1) x 64 WORDS

    def of(self, x: np.ndarray, query: bool = False, step: int = 8192) -> np.ndarray:
        """Codes (n x WORDS). Vectors get one more component with which all rows have one norm, so the largest inner product
        is the smallest angle. No bound is at 0, where sums of exact numbers like to lie: equal vectors get equal codes."""
        out = np.empty((len(x), WORDS), np.uint64)
        for at in range(0, len(x), step):
            bits = (_lifted(x[at : at + step], None if query else self.longest) - self.mean) @ self.rotation > 1e-9
            bits[:, -1] = False
            out[at : at + step] = np.packbits(bits, axis=1, bitorder="little").view("<u8")
        return out


def _lifted(x: np.ndarray, longest: float | None) -> np.ndarray:
    if longest is None:
        return np.column_stack((x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))))
    x = x / longest
    return np.column_stack((x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))))


def learn(sample: np.ndarray, longest: float, rounds: int = 8, seed: int = 11) -> Codes:
    """Fit the rotations on a sample by iterative quantisation, each from a random start of its own."""
    rng = np.random.default_rng(seed)
    up = _lifted(sample, longest)
    mean = up.mean(axis=0)
    z = up - mean
    vectors = np.linalg.eigh(z.T @ z)[1][:, ::-1]
    if vectors.shape[1] < 64:  # short vectors: more than one bit for a direction
        vectors = np.column_stack((vectors, rng.normal(size=(len(mean), 64 - vectors.shape[1]))))
    z = z @ (vectors := vectors[:, :64])
    turns = []
    for _ in range(WORDS):
        turn = np.linalg.qr(rng.normal(size=(64, 64)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(z @ turn > 0, 1.0, -1.0).T @ z)
            turn = (u @ v).T
        turns.append(vectors @ turn)
    return Codes(longest, mean, np.column_stack(turns))


class Index:
    """Of a shard's codes: for each substring, the rows by its value."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.words = np.ascontiguousarray(codes.T)
        parts = np.ascontiguousarray(codes).view("<u2").T
        self.rows = np.concatenate([np.argsort(p, kind="stable") for p in parts])
        self.first = np.concatenate([np.concatenate(([0], np.cumsum(np.bincount(p, minlength=1 << 16)))) + i * n for i, p in enumerate(parts)])
        self.begin = np.arange(PARTS)[:, None] * ((1 << 16) + 1)
        self.probed = self.enough = 0

    def distances(self, code: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        out = np.bitwise_count(self.words[0, rows] ^ code[0])
        for words, own in zip(self.words[1:], code[1:], strict=True):
            out += np.bitwise_count(words[rows] ^ own)
        return out

    def within(self, code: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All rows whose code is within the radius, and their distances. With radius = PARTS q + a, one of the first a + 1
        substrings differs in at most q bits or one of the others in at most q - 1: those buckets are probed, and each row
        found is checked. A radius that needs more than FLIPS flips is looked for in all codes."""
        q, a = divmod(radius, PARTS)
        if q > FLIPS:
            d = self.distances(code)
            rows = np.nonzero(d <= radius)[0]
            return rows, d[rows]
        own = np.ascontiguousarray(code).view("<u2")[:, None]
        near = (self.begin[: a + 1] + (own[: a + 1] ^ _MASKS[q])).ravel()
        if q and a + 1 < PARTS:
            near = np.concatenate((near, (self.begin[a + 1 :] + (own[a + 1 :] ^ _MASKS[q - 1])).ravel()))
        begin = self.first[near]
        size = self.first[near + 1] - begin
        begin, size = begin[size > 0], size[size > 0]
        rows = np.unique(self.rows[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())])
        d = self.distances(code, rows)
        return rows[d <= radius], d[d <= radius]

    def nearest(self, code: np.ndarray, count: int) -> np.ndarray:
        """All rows within the least radius that holds `count` rows (all, if there are fewer).

        The radius grows by a flip a substring, until the rows found confirm it. Where few of a shard's codes have others so
        near, its other queries go to all codes at once, which gives the same rows.
        """
        rows = d = None
        if self.probed < 64 or 4 * self.enough > self.probed:
            self.probed += 1
            for q in range(FLIPS + 1):
                some, near = self.within(code, PARTS * q + PARTS - 1)
                if len(some) >= count:
                    rows, d = some, near
                    self.enough += 1
                    break
        if d is None:
            rows, d = np.arange(self.words.shape[1]), self.distances(code)
        if len(rows) <= count:
            return rows
        return rows[d <= np.searchsorted(np.cumsum(np.bincount(d)), count)]


def able_to_be_near(ids: np.ndarray, x: np.ndarray, codes: np.ndarray, k: int) -> np.ndarray:
    """Rows without those that cannot be among k nearest: of equal vectors, the k + 1 smallest ids have all the places, and of
    rows that share an id, k. So a vector that a third of all rows hold is compared k + 1 times, not in all its copies."""
    key = (codes * np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)).sum(axis=1, dtype=np.uint64)
    _, of, n = np.unique(key, return_inverse=True, return_counts=True)
    crowded = np.nonzero(n[of] > k + 1)[0]
    if not len(crowded):
        return np.arange(len(ids))
    _, group = np.unique(np.ascontiguousarray(x[crowded]).view(f"V{x.shape[1] * x.itemsize}").ravel(), return_inverse=True)
    order = np.lexsort((ids[crowded], group))
    g, i = group[order], ids[crowded][order]
    new_group = np.concatenate(([True], g[1:] != g[:-1]))
    new_id = new_group | np.concatenate(([True], i[1:] != i[:-1]))
    at = np.arange(len(g))
    nth_id = np.cumsum(new_id) - np.cumsum(new_id)[np.maximum.accumulate(np.where(new_group, at, 0))]
    nth_row = at - np.maximum.accumulate(np.where(new_id, at, 0))
    keep = np.ones(len(ids), bool)
    keep[crowded[order[(nth_id > k) | (nth_row >= k)]]] = False
    return np.nonzero(keep)[0]


def products(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each added up from the first component to the last: equal rows get equal ones."""
    return np.cumsum(x * v, axis=1)[:, -1]


def largest(ids: np.ndarray, x: np.ndarray, v: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Places and inner products of the k rows with the largest, ties to the smaller id. Sums in any order say which rows can
    be among them: those less than `slack`, far more than rounding does, below the k-th."""
    near = x @ v
    some = np.nonzero(near >= np.partition(near, len(near) - k)[len(near) - k] - slack)[0] if len(near) > k else np.arange(len(near))
    exact = products(x[some], v)
    top = np.lexsort((ids[some], -exact))[:k]
    return some[top], exact[top]


def search(codes: Codes, ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query id, id, inner product of the k nearest found of each query: the `count` nearest codes, and all as near as
    those, are compared as floats."""
    every = codes.of(x)
    some = able_to_be_near(ids, x, every, k)
    ids, x, index = ids[some], x[some], Index(every[some])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q, v, code in zip(query_ids.tolist(), queries, codes.of(queries, query=True), strict=True):
        rows = index.nearest(code, count + 1)
        others = rows[ids[rows] != q]
        if len(others) < k and len(rows) < len(ids):  # its id is in many rows
            rows = index.nearest(code, count + int((ids == q).sum()))
            others = rows[ids[rows] != q]
        top, near = largest(ids[others], x[others], v, k, 1e-11 * codes.longest * float(np.linalg.norm(v)))
        out.append((np.full(len(top), q), ids[others[top]], near))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v (array of float or double) of the rows with an id and a vector of the commonest length (the shorter of
    equals), without null or non-finite components and not zero."""
    single = vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType())
    v = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    odd = lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))
    rows = rows.where(~F.exists("v", odd) & F.exists("v", lambda y: y != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (size.n if size else -1))


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([c.flatten().to_numpy() for c in parts]).astype(np.float64).reshape(rows, -1)


def enough(rows: DataFrame, asks: DataFrame, codes, k: int, recall: float, sample_queries: int) -> int:
    """So many of the nearest codes of all rows hold `recall` of the k nearest neighbours, as measured at this table's size.

    A bounded sample of queries (the least hashes of ids) is searched by brute force in all rows; per query, tasks give their best k
    with the distances of their codes, and how many codes are at each distance. Both add up over the tasks.
    """
    spark = rows.sparkSession
    key = F.xxhash64("id", F.lit("recall"))
    drawn = asks.orderBy(key, "id").limit(sample_queries).toPandas()
    ids, x = drawn.id.to_numpy(np.int64), np.stack(drawn.v.to_numpy()).astype(float)
    shared = spark.sparkContext.broadcast((ids, x, codes.value.of(x, query=True)))

    def each(batches):
        own, v, code = shared.value
        counts = np.zeros((len(own), 64 * WORDS + 1), np.int64)
        best = [(np.empty(0), np.empty(0, np.int64)) for _ in own]
        for batch in batches:
            if not batch.num_rows:
                continue
            here, there = batch.column("id").to_numpy(), _matrix(batch.column("v"), batch.num_rows)
            marks = codes.value.of(there)
            score = there @ v.T
            for q, of in enumerate(own.tolist()):
                others = here != of
                d = np.bitwise_count(marks[others] ^ code[q]).sum(axis=1, dtype=np.int64)
                counts[q] += np.bincount(d, minlength=counts.shape[1])
                s, d = np.concatenate((best[q][0], score[others, q])), np.concatenate((best[q][1], d))
                top = np.argsort(-s, kind="stable")[:k]
                best[q] = (s[top], d[top])
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(counts.tolist()), pa.array([s.tolist() for s, _ in best]), pa.array([d.tolist() for _, d in best])], names=["query", "counts", "score", "distance"])

    told = rows.select("id", "v").mapInArrow(each, "query long, counts array<long>, score array<double>, distance array<long>")
    at = told.select("query", F.posexplode("counts").alias("distance", "n")).groupBy("query", "distance").agg(F.sum("n").alias("n"))
    near = told.select("query", F.explode(F.arrays_zip("score", "distance")).alias("x")).select("query", "x.score", "x.distance")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "distance"))).where(F.col("rank") <= k)
    # A sample's counts and neighbours: bounded by the sample.
    below = {int(q): np.concatenate(([0], np.cumsum(g.sort_values("distance").n.to_numpy()))) for q, g in at.toPandas().groupby("query")}
    needed = sorted(int(below[r.query][r.distance]) + 1 for r in near.collect())
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] if needed else 1


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", keep: int = 768, recall: float = 0.98, sample_rows: int = 8192, sample_queries: int = 64, shard_mb: int = 32) -> DataFrame:
    """For each row that is_query holds for: query_id, rank, vec_id, score of the k nearest found among all other rows.

    Nearness is the inner product in double precision, summed in the order of the components; ties go to the smaller id. Rows
    with the query's id are its own; a repeated id asks once but may be found as often as it is there. Null, zero, odd-length
    or non-finite vectors take no part; an empty table gives no rows; other columns are not looked at.

    The rotations are fitted on a bounded sample (the sample_rows least hashes of ids). Every row is indexed: rows are dealt
    by hash into shards of at most about shard_mb as doubles, queries into blocks of that size, and each shard and block meet
    in one task. There a query takes the nearest codes, so many that they are the `keep` nearest of all rows, and some more
    for chance; those alone are compared as floats. `keep` is raised to what `recall` needs, as measured on all rows of the table
    by sample_queries of its queries (see enough), so that it holds at any size. A `keep` of all rows is the exact way.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors, id_col, vector_col), "ann-rows")
    asks = rows.where(is_query(F.col("id"))).dropDuplicates(["id"])
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, y: s + y.cast("double") * y.cast("double")))
    n, longest, size = rows.agg(F.count(F.lit(1)), F.max(norm), F.max(F.size("v"))).first()
    n_asks = asks.count()
    schema = "query_id long, vec_id long, score double"
    if not n or not n_asks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    key = F.xxhash64("id", F.lit("sample"))
    drawn = rows.where(within(key, 1.5 * sample_rows / n)).orderBy(key, "id").limit(sample_rows).toPandas()
    codes = spark.sparkContext.broadcast(learn(np.stack(drawn.v.to_numpy()).astype(float), longest))
    keep = max(keep, enough(rows, asks, codes, k, recall, sample_queries)) if keep < n else n
    tasks, most = int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, (shard_mb << 20) // (8 * size))
    shards, blocks = max(-(-n // most), min(tasks, -(-n // 4096))), -(-n_asks // most)
    parts = max(tasks, shards * blocks)
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    shard, block = F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    left = rows.select("id", "v", shard.alias("shard"), each(blocks).alias("block")).repartition(parts, "shard", "block")
    right = asks.select("id", "v", each(shards).alias("shard"), block.alias("block")).repartition(parts, "shard", "block")

    def meet(here: pa.Table, asked: pa.Table) -> pa.Table:
        if not here.num_rows or not asked.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query_id", "vec_id", "score"])
        matrix = lambda t: _matrix(t.column("v"), t.num_rows)
        mine = keep * here.num_rows / n
        found = search(codes.value, here.column("id").to_numpy(), matrix(here), asked.column("id").to_numpy(), matrix(asked), k, int(mine + 3 * mine**0.5) + 8)
        return pa.table([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])

    met = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(meet, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
