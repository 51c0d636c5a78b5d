"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from gazette.llm import hash_index as H


def plain(ids, x, q, k):
    """Ids and inner products of the k nearest other rows, each product added up in the order of the components."""
    scores = []
    for i, row in enumerate(x):
        total = 0.0
        for a, b in zip(row.tolist(), x[q].tolist(), strict=True):
            total += a * b
        scores.append(total)
    return sorted(((-scores[i], int(ids[i])) for i in range(len(x)) if ids[i] != ids[q]))[:k]


@pytest.mark.parametrize("copies", [3, 5, 9, 23, 50])
@pytest.mark.parametrize("kind", ["array<float>", "array<double>"])
def test_equal_vectors(spark, copies, kind):
    rng = np.random.default_rng(copies)
    x = rng.normal(size=(240, 24)).astype(np.float32 if "float" in kind else float).astype(float)
    ids = rng.permutation(400)[:240]
    ids[:4] = [400, 420, 440, 460]
    for group in np.array_split(rng.permutation(240)[: 3 * copies], 3):
        x[group] = x[group[0]]
    table = spark.createDataFrame([(int(i), v.tolist(), "x", 1.0) for i, v in zip(ids, x, strict=True)], f"vec_id long, embedding {kind}, shard string, score double")
    got = {}
    for r in H.nearest(table, lambda key: key % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    asked = [i for i in range(240) if ids[i] % 20 == 0]
    assert set(got) == {int(ids[i]) for i in asked}
    for q in asked:
        assert got[int(ids[q])] == plain(ids, x, q, 20)


def test_few_are_compared_and_most_are_found(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 24)) * rng.uniform(0.2, 3, size=(3000, 1))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(7000, None, 0), (7020, [0.0] * 24, 0), (7040, [float("nan")] * 24, 0), (7060, [1.0], 0), (None, [1.0] * 24, 0), (7080, [None] * 24, 0)]
    table = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>, label int")
    got = {}
    for r in H.nearest(table, lambda k: k % 20 == 0, k=10, keep=300, shard_mb=1).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert set(got) == set(range(0, 3000, 20))
    hit = 0
    for q, found in got.items():
        near = x @ x[q]
        near[q] = -np.inf
        hit += len({i for _, i in found} & set(sorted(range(3000), key=lambda i: (-near[i], i))[:10]))
        assert len(found) == 10 and found == sorted(found)
    assert hit >= 0.9 * 1500
    few = H.nearest(table.where("vec_id < 5"), lambda k: k == 0, k=20).collect()
    assert len(few) == 4 and H.nearest(table.limit(0), lambda k: k == 0).count() == 0


def test_as_many_codes_are_kept_as_the_recall_needs(spark):
    rng = np.random.default_rng(9)
    for n, least in ((400, 20), (24000, 400)):
        x = rng.normal(size=(n, 48))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
        rows = H.usable(table, "vec_id", "embedding").cache()
        codes = spark.sparkContext.broadcast(H.learn(x[:4000], 1.0))
        keep = H.enough(rows, rows.where("id % 100 = 0"), codes, 20, 0.98, 32)
        assert least < keep <= n
        got = {}
        for r in H.nearest(table, lambda key: key % 200 == 0, k=20).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        near = x[::200] @ x.T
        near[np.arange(len(near)), np.arange(0, n, 200)] = -np.inf
        want = np.argsort(-near, axis=1)[:, :20]
        assert sum(len(got[200 * i] & set(w.tolist())) for i, w in enumerate(want)) >= 0.95 * want.size


def test_repeated_ids(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), *[(1, [2.0, 1.0])] * 3, (2, [0.5, 0.5]), (20, [1.0, 1.0])]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in H.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda k: k % 20 == 0, k=4).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 4.0), (0, 2, 1, 4.0), (0, 3, 1, 4.0), (0, 4, 20, 3.0), (20, 1, 0, 3.0), (20, 2, 0, 3.0), (20, 3, 1, 3.0), (20, 4, 1, 3.0)]


def test_rows_that_cannot_be_near():
    rng = np.random.default_rng(7)
    x = rng.integers(0, 2, size=(400, 3)).astype(float)
    ids, codes = rng.integers(0, 120, 400), np.repeat(x.astype(np.uint64)[:, :1], H.WORDS, axis=1)
    kept = set(H.able_to_be_near(ids, x, codes, 5).tolist())
    for q in range(0, 400, 7):
        order = sorted((i for i in range(400) if ids[i] != ids[q]), key=lambda i: (-(x[i] @ x[q]), ids[i]))
        best = [(x[i] @ x[q], ids[i]) for i in order[:5]]
        assert best == [(x[i] @ x[q], ids[i]) for i in order if i in kept][:5]
    assert len(kept) < 400


@pytest.mark.parametrize("near", [True, False])
def test_index_finds_all_within_the_radius(near):
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 1 << 63, (3000, H.WORDS), dtype=np.uint64)
    if near:  # codes a few bits from one another
        codes[1000:] = codes[0]
        for i in range(1000, 3000):
            for b in rng.integers(0, 63, rng.integers(0, 40)):
                codes[i, rng.integers(0, H.WORDS)] ^= np.uint64(1 << int(b))
    index = H.Index(codes)
    apart = np.array([sum(int(v).bit_count() for v in c ^ codes[0]) for c in codes])
    for radius in (0, 3, 15, 16, 20, 31, 40, 47, 48, 120, 250):
        rows, d = index.within(codes[0], radius)
        assert rows.tolist() == np.nonzero(apart <= radius)[0].tolist() and d.tolist() == apart[rows].tolist()
    for count in (1, 2, 50, 400, 2500, 3000, 4000):
        for _ in range(80):
            rows = index.nearest(codes[0], count)
        radius = np.sort(apart)[min(count, 3000) - 1]
        assert rows.tolist() == np.nonzero(apart <= radius)[0].tolist()
