"""Hard negatives: exact integer scores of anchors and candidates by Strassen's multiplication, mined by heaps that merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.llm.common import stored

#: Matrices with a side of so many or fewer are multiplied as they are.
LEAF = 16
#: An id that sorts behind all others: null.
NO_ID = np.iinfo(np.int64).max
_NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of int64 matrices: seven products of half the sides in place of eight, odd sides padded with zeros.

    Sums and differences wrap around, so each entry is exact modulo 2**64: those that fit 64 bits are exact, whatever the sums on
    the way are.
    """
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a, b = np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, h = a.shape[0] // 2, b.shape[1] // 2, a.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :h], a[:i, h:], a[i:, :h], a[i:, h:]
    b11, b12, b21, b22 = b[:h, :j], b[:h, j:], b[h:, :j], b[h:, j:]
    out = np.empty((2 * i, 2 * j), np.int64)
    c11, c12, c21, c22 = out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:]
    # Winograd's order of the same seven products, which needs fifteen additions.
    s1 = a21 + a22
    s2 = s1 - a11
    t1 = b12 - b11
    t2 = b22 - t1
    p1 = strassen(a11, b11, leaf)
    np.add(p1, strassen(a12, b21, leaf), out=c11)
    u2 = p1 + strassen(s2, t2, leaf)
    u3 = u2 + strassen(a11 - a21, b22 - b12, leaf)
    p5 = strassen(s1, t1, leaf)
    np.add(u3, p5, out=c22)
    np.subtract(u3, strassen(a22, t2 - b21, leaf), out=c21)
    u2 += p5
    np.add(u2, strassen(a12 - s2, b22, leaf), out=c12)
    return out[:m, :n]


class Heaps:
    """The `size` best entries of each of n keys: the largest scores, ties to the smaller id. Two heaps merge into one."""

    def __init__(self, n: int, size: int):
        self.score = np.full((n, size), _NONE, np.int64)
        self.id = np.full((n, size), NO_ID, np.int64)
        self.held = np.zeros(n, np.int64)

    def merge(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Take in entries in any order. Those worse than all of a full heap are left out before anything is sorted."""
        n, size = self.score.shape
        may = (self.held[key] < size) | (score > self.score[key, -1]) | ((score == self.score[key, -1]) & (ids < self.id[key, -1]))
        key, score, ids = key[may], score[may], ids[may]
        if not len(key):
            return
        touched = np.unique(key)
        slot = np.arange(size)[None, :] < self.held[touched][:, None]
        key = np.concatenate((np.repeat(touched, self.held[touched]), key))
        score, ids = np.concatenate((self.score[touched][slot], score)), np.concatenate((self.id[touched][slot], ids))
        order = np.lexsort((ids, ~score, key))  # ~score falls as score grows, without overflow
        key, score, ids = key[order], score[order], ids[order]
        begin = np.concatenate(([True], key[1:] != key[:-1]))
        nth = np.arange(len(key)) - np.maximum.accumulate(np.where(begin, np.arange(len(key)), 0))
        top = nth < size
        self.score[key[top], nth[top]], self.id[key[top], nth[top]] = score[top], ids[top]
        self.held[touched] = np.minimum(np.bincount(key, minlength=n)[touched], size)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """key, score, id of all that is held."""
        key, at = np.nonzero(np.arange(self.score.shape[1])[None, :] < self.held[:, None])
        return key, self.score[key, at], self.id[key, at]


class Anchors:
    """A block of anchors, by label: of each its row, label and vector."""

    def __init__(self, rid: np.ndarray, label: np.ndarray, x: np.ndarray):
        order = np.argsort(label, kind="stable")
        self.rid, self.label, self.x = rid[order], label[order], x[order]

    def of(self, label: int) -> slice:
        return slice(*np.searchsorted(self.label, [label, label + 1]).tolist())


def _tiles(batch: pa.RecordBatch, width: int, rows: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """rid, id, label and vectors (padded with zeros to `width`; what is longer meets nothing there) of a batch, by label."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        rid, ids, label, v = part.columns
        size, flat = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy()
        x = np.zeros((part.num_rows, max(width, int(size.max(initial=0)))), np.int64)
        x[np.arange(x.shape[1])[None, :] < size[:, None]] = flat
        order = np.argsort(label.to_numpy(), kind="stable")
        yield rid.to_numpy()[order], ids.to_numpy()[order], label.to_numpy()[order], x[order, :width]


def mine_positives(anchors: Anchors, batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """rid, id, score of the best `size` of the candidates seen, for each anchor: other rows of its label. Each label's
    candidates are multiplied with its own anchors only."""
    heaps = Heaps(len(anchors.rid), size)
    for batch in batches:
        for rid, ids, label, x in _tiles(batch, anchors.x.shape[1]):
            for own in np.unique(label).tolist():
                mine, here = anchors.of(own), slice(*np.searchsorted(label, [own, own + 1]).tolist())
                if mine.start == mine.stop:
                    continue
                score = strassen(anchors.x[mine], x[here].T)
                a, c = np.nonzero(anchors.rid[mine][:, None] != rid[here][None, :])
                heaps.merge(a + mine.start, score[a, c], ids[here][c])
    key, score, ids = heaps.entries()
    yield pa.RecordBatch.from_arrays([pa.array(anchors.rid[key]), pa.array(ids), pa.array(score)], names=["rid", "id", "score"])


def mine_window(anchors: Anchors, key: np.ndarray, positive: np.ndarray, batches: Iterator[pa.RecordBatch], size: int, low: int, step: int = 512) -> Iterator[pa.RecordBatch]:
    """key, id, score of the best `size` candidates seen in each window: of another label than the anchor's, with
    low * positive <= 100 * score <= 100 * positive. Window key[i] belongs to anchor i // (windows an anchor)."""
    heaps, per = Heaps(len(key), size), len(key) // max(1, len(anchors.rid))
    top = positive.reshape(-1, per)
    # The least whole score in a window. What is below all windows of an anchor, or above, is seen by one comparison.
    least = -((-low * top) // 100)
    empty = (top < 0) | (key.reshape(-1, per) < 0)
    top, least = np.where(empty, _NONE, top), np.where(empty, NO_ID, least)
    most, fewest = top.max(axis=1, initial=_NONE), least.min(axis=1, initial=NO_ID)
    for batch in batches:
        for _, ids, label, x in _tiles(batch, anchors.x.shape[1]):
            for at in range(0, len(anchors.rid), step):
                part = slice(at, at + step)
                score = strassen(anchors.x[part], x.T)
                a, c = np.nonzero((score <= most[part, None]) & (score >= fewest[part, None]) & (anchors.label[part, None] != label[None, :]))
                s, a = score[a, c], a + at
                for nth in range(per):
                    fits = (s <= top[a, nth]) & (s >= least[a, nth])
                    heaps.merge(a[fits] * per + nth, s[fits], ids[c[fits]])
    at, score, ids = heaps.entries()
    yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(ids), pa.array(score)], names=["key", "id", "score"])


def scaled(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, label: Column | None, scale: int) -> DataFrame:
    """id (null: behind all), label, v (whole numbers) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("id"), (F.col(label_col) if label is None else label).cast("long").alias("label"), v.alias("v"))
    rows = rows.where(F.col("label").isNotNull() & F.col("v").isNotNull())
    # Of what is larger, a hundred times a sum of products need not fit 64 bits.
    most = F.lit(float(2**55)) / F.greatest(F.size("v"), F.lit(1))
    rows = rows.where(~F.exists("v", lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))))
    rows = rows.where(~F.exists("v", lambda y: (F.floor(y * scale) * F.lit(1.0)) * (F.floor(y * scale) * F.lit(1.0)) >= most))
    return rows.select("id", "label", F.transform("v", lambda y: F.floor(y * scale)).alias("v"))


def hard_negatives(vectors: DataFrame, is_anchor, positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 256, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block_mb: int = 16) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score: for each row that is_anchor holds
    for and each of its `positives` best other rows of the same label (all, if fewer), the best `negatives` rows of another
    label whose score is from `low` to 100 per cent of the positive's.

    A score is the inner product of the two rows' whole numbers floor(scale * component), exactly; ties go to the smaller id.
    Rows with a null label or vector or a null or non-finite component take no part, nor do those with components so large that
    their scores might not fit a long. Of two vectors the shorter counts as padded with zeros. A null id is no anchor, and comes
    last among ties. Rows that repeat an id are rows of their own. An empty table gives no rows; other columns are not looked at.

    Anchors go out in blocks of at most about block_mb, each broadcast to all tasks, and each task multiplies the block with its
    candidates tile by tile. A task keeps heaps only: per anchor its best positives, then, in a second pass, per positive the best
    of its window. Heaps of all tasks merge by a ranking that Spark limits before its shuffle.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows = stored(scaled(vectors, id_col, vector_col, label_col, label, scale).withColumn("rid", F.monotonically_increasing_id()), "hard-rows").select("rid", "id", "label", "v")
    asks = rows.where((F.col("id") != F.lit(int(NO_ID))) & is_anchor(F.col("id")))
    n, width = asks.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return empty
    blocks = -(-n * 8 * max(1, width) // (block_mb << 20))
    in_block = F.pmod(F.xxhash64("rid"), F.lit(blocks))
    found = [_block(spark, rows, asks.where(in_block == b), width, positives, negatives, low) for b in range(blocks)]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def _block(spark, rows: DataFrame, asks: DataFrame, width: int, positives: int, negatives: int, low: int) -> DataFrame:
    own = asks.toPandas()  # a block is bounded
    x = np.zeros((len(own), width), np.int64)
    for i, v in enumerate(own.v):
        x[i, : len(v)] = v
    ids = dict(zip(own.rid.tolist(), own.id.tolist(), strict=True))
    anchors = Anchors(own.rid.to_numpy(np.int64), own.label.to_numpy(np.int64), x)
    shared = spark.sparkContext.broadcast(anchors)

    def best(df: DataFrame, key: str, size: int) -> DataFrame:
        order = Window.partitionBy(key).orderBy(F.desc("score"), "id")
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)

    met = rows.mapInArrow(lambda batches: mine_positives(shared.value, batches, positives), "rid long, id long, score long")
    top = stored(best(met, "rid", positives), "hard-positives")
    # Windows: a row for each anchor and place among its positives, -1 where there is none.
    at = {rid: i for i, rid in enumerate(anchors.rid.tolist())}
    key, score = np.full(len(at) * positives, -1, np.int64), np.zeros(len(at) * positives, np.int64)
    for r in top.select("rid", "rank", "score").collect():  # of one block
        i = at[r.rid] * positives + r["rank"] - 1
        key[i], score[i] = i, r.score
    windows = spark.sparkContext.broadcast((key, score))
    met = rows.mapInArrow(lambda batches: mine_window(shared.value, *windows.value, batches, negatives, low), "key long, id long, score long")
    near = stored(best(met, "key", negatives), "hard-negatives")
    named = spark.createDataFrame([(i, rid, ids[rid]) for rid, i in at.items()], "anchor int, rid long, anchor_id long")
    pos = named.join(top, "rid").select("anchor_id", (F.col("anchor") * positives + F.col("rank") - 1).cast("long").alias("key"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    neg = near.select("key", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    known = lambda c: F.when(F.col(c) != F.lit(int(NO_ID)), F.col(c)).alias(c)
    return pos.join(neg, "key").select("anchor_id", known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score")
