"""Hard negatives against plain scores of all pairs."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gazette.llm import hard_negatives as H


def plain(rows, is_anchor, positives=5, negatives=5, low=80, scale=256):
    """rows: (id, label, vector); the result's rows, sorted."""
    used = [(i, k, [math.floor(scale * float(x)) for x in v]) for i, k, v in rows if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for a, (i, label, v) in enumerate(used):
        if i is None or not is_anchor(i):
            continue
        scores = [(sum(x * y for x, y in zip(v, w, strict=False)), j, k) for b, (j, k, w) in enumerate(used) if b != a]
        for p, pid, _ in sorted((s for s in scores if s[2] == label), key=order)[:positives]:
            fits = sorted((s for s in scores if s[2] != label and low * p <= 100 * s[0] <= 100 * p), key=order)[:negatives]
            out += [(i, pid, r, nid, p, s) for r, (s, nid, _) in enumerate(fits, 1)]
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 0, 2), (17, 17, 17), (33, 18, 51), (128, 64, 70)])
def test_strassen_is_exact_and_wraps_around(shape):
    rng = np.random.default_rng(sum(shape))
    a, b = (rng.integers(-(2**62), 2**62, s) for s in (shape[:2], shape[1:]))
    for leaf in (1, 2, 5, 16):
        assert (H.strassen(a, b, leaf) == a @ b).all()


def test_tiles_of_a_sliced_batch():
    rng = np.random.default_rng(1)
    rows = [rng.integers(-9, 9, rng.integers(0, 6)).tolist() for _ in range(5000)]
    columns = [pa.array(range(5000)), pa.array(range(5000)), pa.array(rng.integers(0, 4, 5000)), pa.array(rows, pa.list_(pa.int64()))]
    batch = pa.RecordBatch.from_arrays(columns, names=["rid", "id", "label", "v"]).slice(7)
    found = {r: v for rid, _, _, x in H._tiles(batch, 4, 700) for r, v in zip(rid.tolist(), x.tolist(), strict=True)}
    assert found == {r: (rows[r] + [0] * 4)[:4] for r in range(7, 5000)}


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(2)
    key, score, ids = rng.integers(0, 7, 3000), rng.integers(-40, 40, 3000), rng.permutation(3000)
    score[:5] = [-(2**63) + 1, 2**62, -(2**62), 0, 0]
    heaps = H.Heaps(8, 5)
    for part in np.array_split(rng.permutation(3000), 11):
        heaps.merge(key[part], score[part], ids[part])
    found = sorted(zip(*(x.tolist() for x in heaps.entries()), strict=True))
    want = [(k, s, i) for k in range(8) for s, i in sorted(((s, i) for kk, s, i in zip(key.tolist(), score.tolist(), ids.tolist(), strict=True) if kk == k), key=lambda x: (-x[0], x[1]))[:5]]
    assert found == sorted(want)


@pytest.mark.parametrize("kind", ["array<float>", "array<double>"])
def test_ties_copies_hot_labels_and_odd_rows(spark, kind):
    rng = np.random.default_rng(len(kind))
    x = rng.integers(-3, 9, (420, 9)) / 8
    rows = [(int(i), int(rng.integers(0, 4)) if i % 3 else 0, v.tolist()) for i, v in enumerate(x)]
    rows += [(500 + i, int(i % 3), x[7].tolist()) for i in range(60)]  # copies with one score
    rows += [(10, 1, [0.5] * 9), (10, 2, [0.5] * 9), (None, 1, [0.9] * 9), (None, None, [0.9] * 9), (30, 2, [1.0]), (31, 0, [0.5] * 14), (32, 0, [])]
    rows += [(40, 0, None), (50, 1, [None] * 9), (60, 1, [float("nan")] * 9), (70, 1, [float("inf")] * 9), (80, 2, [-float("inf")] * 9), (90, 3, [0.0] * 9), (600, 77, [1.0] * 9)]
    df = spark.createDataFrame([(*r, 1, "b") for r in rows], f"vec_id long, label int, embedding {kind}, rid int, rank string").repartition(6)
    result = got(H.hard_negatives(df, lambda i: i % 10 == 0, block_mb=16))
    assert result == plain(rows, lambda i: i % 10 == 0) and len(result) > 300


def test_blocks_of_anchors_and_vectors_that_have_no_scores(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 3)), (rng.normal(size=2048) / 40).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert got(H.hard_negatives(df, lambda i: i % 2 == 0, block_mb=1)) == plain(rows, lambda i: i % 2 == 0)  # three blocks
    large = [(i, i % 2, [1e30, 1.0]) for i in range(10)]
    assert got(H.hard_negatives(spark.createDataFrame(large, "vec_id long, label int, embedding array<double>"), lambda i: i >= 0)) == []
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<double>")
    assert got(H.hard_negatives(empty, lambda i: i >= 0)) == []
    alone = spark.createDataFrame([(0, 1, [1.0]), (1, 2, [1.0])], "vec_id long, label int, embedding array<double>")
    assert got(H.hard_negatives(alone, lambda i: i >= 0)) == []  # no positives


def test_changed_labels(spark):
    import __spark_entry__

    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    rows = [(i, (k + 1) % 10 if k is not None and i % 7 == 0 else k, v) for i, k, v in rows]
    result = got(__spark_entry__.queries()["op12_hard_negatives"](spark, folder))
    assert result == plain(rows, lambda i: i % 100 == 0) and result
    assert H.hard_negatives(spark.read.parquet(f"{folder}/embeddings.parquet"), lambda i: i == 100, label=F.lit(1)).isEmpty()
