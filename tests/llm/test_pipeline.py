"""The stages of corpus_pipeline against brute force, on small tables."""

import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from gazette.llm import common, lattice, near_copies, sentencepiece, simhash
from gazette.llm.common import stored
from gazette.llm.queries import vocabulary


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def plain_groups(texts):
    sets, root = [plain_shingles(t) for t in texts], list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if root[i] != root[j] and near(sets[i], sets[j]):
            root = [root[i] if r == root[j] else r for r in root]
    return root


def edited_texts():
    """Texts with edits that leave Jaccard similarities from about 0.5 to 1, a line that all share, and odd ones."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    line, texts = " ".join(word() for _ in range(8)), [None, "", " \n", "a", "A", "a b", "x " * 500]
    for _ in range(6):
        base = [word() for _ in range(rng.choice([12, 60, 150]))] + line.split()
        texts.append(" ".join(base))
        for _ in range(14):
            own = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 30))):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("block", [3, 4096])
def test_near_copies_are_all_found(spark, block):
    texts = edited_texts()
    root = plain_groups(texts)
    assert 10 < len(set(root)) < len(texts) - 20
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.group for r in near_copies.groups(table, block=block).collect()}
    assert len(got) == len(texts)
    for i, j in itertools.combinations(range(len(texts)), 2):
        assert (got[i] == got[j]) == (root[i] == root[j])
    assert near_copies.groups(table.limit(0)).count() == 0


def test_first_candidates_share_a_shingle(spark):
    """Nothing is computed for candidates that the prefix filter has anyway: no SimHash is made, and all candidates share a shingle."""
    texts = edited_texts()
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = near_copies.prints(table, "doc_id", "text", 5, near_copies.common_shingles(table, "text", 5)).withColumn("id", F.col("doc_id"))
    assert "fp" not in nodes.columns
    pairs = near_copies.star_pairs(near_copies.sharing(nodes)).collect()
    assert len(pairs) > 20 and all(plain_shingles(texts[r.a]) & plain_shingles(texts[r.b]) for r in pairs)


def test_near_copy_stage_keeps_one_of_each_group(spark):
    texts = edited_texts()
    root = plain_groups(texts)
    table = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    left = pipeline.without_near_copies(spark, table, "")
    assert left.columns == table.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted({r: i for i, r in reversed([*enumerate(root)])}.values())


def test_near_copy_stage_tells_rows_apart(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a), (2, f"{a} tail"), (2, b), (3, c), (3, f"{c} tail"), (None, d), (None, f"{d} tail"), (None, f"{a} end"), (4, "x"), (4, "x"), (None, "alone")]
    left = pipeline.without_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    got = [(r.doc_id, r.text) for r in left.collect()]
    assert (1, a) in got and (2, b) in got and (None, "alone") in got and got.count((4, "x")) == 1
    assert len([r for r in got if r[0] == 3]) == 1 and len([r for r in got if r[0] is None and r[1].startswith("d")]) == 1 and len(got) == 6


def test_near_copy_stage_links_by_simhash(spark):
    """Texts that say one line again and again differ in few bits, though most of their shingles are their own."""
    line = " ".join(f"l{i}" for i in range(9))
    said = lambda x: f"{line} " * 150 + " ".join(f"{x}{i}" for i in range(30))
    texts = {4: said("a"), 2: said("b"), None: said("c"), 7: said("d") + " tail", 8: " ".join(f"o{i}" for i in range(60)), 9: f"{line} else"}
    codes = {i: simhash.fingerprint(t.encode()) for i, t in texts.items()}
    assert all((codes[i] ^ codes[2]).bit_count() <= 2 for i in (4, None, 7)) and min((codes[8] ^ codes[2]).bit_count(), (codes[9] ^ codes[2]).bit_count()) > 2
    assert len(set(plain_groups([*texts.values()]))) == 6
    # Near by Jaccard only to one of those that SimHashes link.
    texts[1] = f"{line} {line} " + " ".join(f"a{i}" for i in range(30))
    assert near(plain_shingles(texts[1]), plain_shingles(texts[4]))
    assert min((simhash.fingerprint(texts[1].encode()) ^ c).bit_count() for c in codes.values()) > 2
    left = pipeline.without_near_copies(spark, spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(3), "")
    assert Counter(r.doc_id for r in left.collect()) == Counter([1, 8, 9])


def corpus():
    """Rows (doc_id, text, source): clean and toxic texts, exact copies, near copies, null and empty texts, null and repeated ids."""
    rng = random.Random(12)
    words = ["".join(rng.choices("bcdfgklmnpaeiou", k=5)) for _ in range(300)]
    rows = []
    for i in range(360):
        said = rng.choices(words, k=60)
        if i % 6 == 0:
            said[rng.randrange(50)] = rng.choice(["idiot", "idi0t", "IDIOT"])
        rows.append((i, " ".join(said), "abc"[i % 3]))
    for k, i in enumerate(range(1, 120, 7)):
        rows += [(400 + k, rows[i][1].replace(" ", "  ", k % 3), "a"), (500 + k, f"{rows[i][1]} {words[k]}", "b"), (None, f"{words[k]} {rows[i][1]}", "c")]
    rows += [(600, None, "a"), (601, "", "b"), (None, " ", "c"), rows[5], (7, rows[8][1] + " tail", "a"), (2, "only this of id two", "b")]
    return rows


def plain_toxic(rows):
    return [r for r in rows if not any(w in (r[1] or "").lower() for w in ("idiot", "idi0t"))]


def plain_exact(rows):
    groups = {}
    for r in rows:
        groups.setdefault("".join((r[1] or "").split()), []).append(r)
    return [min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for g in groups.values()]


def plain_near(rows):
    groups = {}
    for r, g in zip(rows, plain_groups([r[1] for r in rows]), strict=True):
        groups.setdefault(g, []).append(r)
    mark = lambda t: hashlib.sha256(b"" if t is None else f"={t}".encode()).hexdigest()[:32]
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0, mark(r[1]))) for g in groups.values()]


def plain_mixed(rows):
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    weight, left, free, target = dict(zip(sorted(size), (3, 1, 2), strict=True)), 1.5 * sum(size.values()), set(size), {}
    while over := {s for s in free if left * weight[s] / sum(weight[x] for x in free) >= 2 * size[s]}:
        target |= {s: 2.0 * size[s] for s in over}
        left, free = left - sum(2 * size[s] for s in over), free - over
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    out, drawn, marked = [], {}, []
    for r in rows:
        rate = target[r[2]] / size[r[2]]
        draws = drawn.setdefault(r[2], [0] * 16)
        u = int(hashlib.md5(f"mix:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:12], 16) / 2**48
        taken = [math.floor(rate) + ((u + d / 16) - math.floor(u + d / 16) < rate - math.floor(rate)) for d in range(16)]
        for d in range(16):
            draws[d] += taken[d] * len((r[1] or "").split())
        marked.append((r, taken))
    for r, taken in marked:
        out += [r] * taken[min(range(16), key=lambda d: (abs(drawn[r[2]][d] - target[r[2]]), d))]
    return out


PLAIN = {"toxicity": plain_toxic, "exact dedup": plain_exact, "simhash near-dedup": plain_near, "mixing": plain_mixed}


def test_stages_and_run(spark, tmp_path):
    rows, schema = corpus(), "doc_id long, text string, source string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(360)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    codec = sentencepiece.Codec(lattice.load_pieces(vocabulary("piece_bpe_32k.model")))
    same = lambda r: (r[0], r[1] or "", r[2])
    docs, last = spark.read.parquet(f"{tmp_path}/documents.parquet"), Counter()
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name == "sentencepiece":
            got = out.collect()
            assert all(r.n_pieces == len(r.ids) for r in got)
            last = Counter((r.doc_id, codec.decode(np.array(r.ids, "int32")), r.source) for r in got)
            assert last == Counter(map(same, rows))
        else:
            before, rows = len(rows), PLAIN[name](rows)
            assert len(rows) != before and out.columns == docs.columns
            assert Counter(map(same, out.collect())) == Counter(map(same, rows)), name
            docs = spark.createDataFrame(rows, schema).repartition(3)
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, codec.decode(np.array(r.ids, "int32")), r.source) for r in got) == last


def test_clashing_columns(spark, tmp_path):
    names = ["_toxicity", "_text", "_digest", "_best", "_of", "_copies", "_rate", "_draw", "_gone", "_unclear", "_k0", "group", "digest", "fp", "id", "row", "size"]
    rows = [(*r, *names) for r in corpus()]
    spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names)).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(360)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [tuple(r) for r in out.select(*names).distinct().collect()] == [tuple(names)]
        docs = stored(out, "test")
    assert pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_last_stage_decodes_what_it_encodes(spark):
    table = spark.createDataFrame([(1, "a \t b\u2581\n", "s"), (2, None, "s"), (3, "", "s"), (None, "Zw\u00f6lf \U0001f600", "s")], "doc_id long, text string, source string")
    got = pipeline.encoded(spark, table, "").collect()
    assert len(got) == 4 and all(r.decodes for r in got)
    model = vocabulary("piece_bpe_32k.model")
    coded = sentencepiece.encode(table, model, decodes_col="decodes")
    assert coded.columns == [*table.columns, "ids", "decodes"]
    with pytest.raises(ValueError):
        sentencepiece.encode(table, model, decodes_col="text")


def test_rows_parted_by_keys(spark):
    rows = spark.range(3000).select(F.when(F.col("id") > 0, F.sha2(F.col("id").cast("string"), 256)).alias("k"), F.col("id").alias("_row"), F.lit("mine").alias("_bitmap"))
    keys = rows.where("_row % 10 = 0").select(F.col("k").alias("of"))
    for bits in (16, 1 << 16, 1 << 25):  # full, with some hits by chance, with none to speak of
        may, others = common.parted(rows, F.col("k"), keys, bits)
        assert may.columns == others.columns == rows.columns
        there, away = {r["_row"] for r in may.collect()}, [r["_row"] for r in others.collect()]
        assert set(range(0, 3000, 10)) <= there and not there & set(away) and len(there) + len(away) == 3000
        assert {16: len(there) == 3000, 1 << 16: 300 < len(there) < 400, 1 << 25: len(there) < 305}[bits], bits
    assert common.parted(rows, F.col("k"), keys.limit(0))[0].count() == 0 and common.parted(rows.limit(0), F.col("k"), keys)[1].count() == 0
