"""The training-data operators against brute force, on small tables with nulls, ties, copies and clashing columns."""

import gzip
import hashlib
import itertools
import math
import random

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from gazette.llm import exact_dedup, language_id, lattice, lattice_lm, mixing, sentencepiece, simhash, token_counts, toxicity, warc
from gazette.llm.queries import PATTERN, vocabulary

MODEL, RANKS = vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.tiktoken")
ODD = [None, "", " \n\t", "a", "Zwölf Boxkämpfer 😀 中文\x00▁ end\n\nline", "one two three four five " * 4000, "x" * 5000, "don't  stop   spaces ", "  é"]
SCHEMA = "doc_id long, text string, lang string, source string, row long, digest string, best string, ids_ string, _of string, _copies string, _rate string, _gone string, _unclear string, _k0 string, _toxicity string, salt string, delivery string, score double"


def docs(spark, texts, sources=None):
    rows = [(None if i == 3 else i, t, "en", sources[i] if sources else "s", 0, "d", "b", "i", *"ocrgukts", "d", 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def norm(t):
    return "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")


@pytest.mark.parametrize("digest_hex", [64, 1])
def test_exact_dedup(spark, digest_hex):
    texts = [*ODD, *ODD, "a b", "ab", "a  b", " ab", "c", "c"]
    table = docs(spark, texts)
    decided = exact_dedup.exact_dedup(table, digest_hex=digest_hex)
    got = decided.collect()
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(norm(t), []).append((-len(t or ""), i == 3, i))
    for r in got:
        i = 3 if r.doc_id is None else r.doc_id
        best = min(groups[norm(texts[i])])
        assert r.keep_id == (None if best[1] else best[2]) and r.group_size == len(groups[norm(texts[i])]) and r.kept == (best[2] == i)
        assert r.digest == hashlib.sha256(norm(texts[i]).encode()).hexdigest()
    assert len(got) == len(texts) and sum(r.kept for r in got) == len(groups)
    left = exact_dedup.kept_rows(table, decided)
    assert left.columns == table.columns and left.count() == len(groups)
    assert {(r["_gone"], r["_unclear"], r["_k0"]) for r in left.collect()} == {("g", "u", "k")}
    again = table.unionByName(table.where("doc_id = 4"))
    assert exact_dedup.kept_rows(again, exact_dedup.exact_dedup(again)).count() == len(groups)
    assert exact_dedup.exact_dedup(table.limit(0)).count() == 0


def test_exact_dedup_in_many_batches(spark):
    table = docs(spark, [*ODD, *ODD, "a b", "ab"])
    plain = lambda df: sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in df.collect())
    assert plain(exact_dedup.exact_dedup(table, bytes_per_trigger=1)) == plain(exact_dedup.exact_dedup(table))


def test_exact_dedup_goes_on_with_a_second_delivery(spark, tmp_path):
    for k, rows in enumerate(([(1, "a b"), (2, "c"), (3, "c"), (4, "d")], [(5, "ab"), (6, "c "), (7, "e"), (8, "e"), (0, "d")])):
        spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/docs{k}")
    deliveries = [spark.read.parquet(f"{tmp_path}/docs{k}") for k in (0, 1)]
    home = f"file://{tmp_path}/home"
    first = exact_dedup.exact_dedup(deliveries[0], home=home, delivery="one")
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in first.collect()} == {(1, 1, 1, True), (2, 2, 2, True), (3, 2, 2, False), (4, 4, 1, True)}
    second = exact_dedup.exact_dedup(deliveries[1], home=home, delivery="two").collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in second} == {(5, 1, 2, False), (6, 6, 3, True), (7, 7, 2, True), (8, 7, 2, False), (0, 0, 2, True)}
    at = next(r.locator for r in second if r.doc_id == 5)
    found = spark.read.parquet(at.file).where(F.col("_metadata.row_index") == at.row).first()
    assert found.doc_id == 1
    with pytest.raises(ValueError, match="differ between deliveries"):
        other = f"file://{tmp_path}/other"
        exact_dedup.exact_dedup(deliveries[0], digest_hex=1, home=other, delivery="one")
        many = spark.createDataFrame([(k, f"text {k}") for k in range(100)], "doc_id long, text string")
        exact_dedup.exact_dedup(many, digest_hex=1, home=other, delivery="two")


@pytest.mark.parametrize("fails", ["write", "before", "within", "after", "finish"])
def test_a_delivery_that_fails_is_given_again(spark, tmp_path, monkeypatch, fails):
    one = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c"), (4, "d")], "doc_id long, text string").repartition(2)
    two = spark.createDataFrame([(5, "ab c"), (6, "d  "), (7, "a  b")], "doc_id long, text string").repartition(2)
    told = lambda df: {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()}
    home = lambda k: f"file://{tmp_path}/{k}"
    clean = [told(exact_dedup.exact_dedup(df, home=home("clean"), delivery=name)) for name, df in (("one", one), ("two", two))]
    assert clean[0] == {(1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True), (4, 4, 1, True)}

    class Stopped(Exception):
        pass

    def stop(*_, **__):
        raise Stopped

    real = exact_dedup.digest_state

    def within(spark_, path, *rest):
        # The state has taken the digests in, but what the batch changed is lost with the driver.
        real(spark_, path, *rest)
        last = exact_dedup.names(spark_, f"{path}/checkpoint/commits")[-1]
        exact_dedup.remove(spark_, f"{path}/checkpoint/commits/{last}")
        exact_dedup.remove(spark_, f"{path}/changed")
        raise Stopped

    for k, (name, df) in enumerate((("one", one), ("two", two))):
        with monkeypatch.context() as patch:
            if fails == "write":
                patch.setattr(exact_dedup.Home, "write", stop)
            elif fails == "before":
                patch.setattr(exact_dedup, "digest_state", stop)
            elif fails == "within" and k == 0:
                patch.setattr(exact_dedup, "digest_state", within)
            elif fails == "after":
                patch.setattr(exact_dedup, "stored", stop)
            else:
                patch.setattr(exact_dedup.Home, "finish", stop)
            with pytest.raises(Stopped):
                exact_dedup.exact_dedup(df, home=home("home"), delivery=name)
        with pytest.raises(RuntimeError, match="has not been finished"):
            exact_dedup.exact_dedup(two, home=home("home"), delivery="other")
        again = df.repartition(3)  # rows may come in another order
        assert told(exact_dedup.exact_dedup(again, home=home("home"), delivery=name)) == clean[k]
        assert told(exact_dedup.exact_dedup(again, home=home("home"), delivery=name)) == clean[k]
    with pytest.raises(ValueError, match="needs a name"):
        exact_dedup.exact_dedup(one, home=home("home"))


def test_batches_of_deliveries_become_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup.digest_state, "__defaults__", (1 << 30, 4_000_000, 3))
    home = f"file://{tmp_path}/home"
    for k in range(9):
        df = spark.createDataFrame([(10 * k, "same"), (10 * k + 1, f"own {k}"), (10 * k + 2, f"own {k // 2}")], "doc_id long, text string")
        got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(df, home=home, delivery=f"d{k}").collect()}
        assert got[10 * k] == (0, k + 1)
    assert got[82] == (41, 2) and got[81] == (81, 1)
    assert len(exact_dedup.names(spark, f"{home}/changed")) <= 4 and len(exact_dedup.names(spark, f"{home}/hits")) == 1


def test_mixing(spark):
    rng = random.Random(1)
    sources = [rng.choice(["b", "a", None, "c", "big", "big", "big"]) for _ in range(600)]
    texts = [" ".join(["w"] * rng.randint(0, 30)) if i else None for i in range(600)]
    table = docs(spark, texts, sources)
    got = mixing.mix(table).collect()
    size = {}
    for s, t in zip(sources, texts, strict=True):
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, free, left, target = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, set(order), 1.5 * sum(size.values()), {}
    while True:  # share, fix those above their cap, share the rest anew
        over = {s for s in free if left * weight[s] / sum(weight[x] for x in free) >= 2 * size[s]}
        if not over:
            break
        target |= {s: 2.0 * size[s] for s in over}
        left, free = left - sum(2 * size[s] for s in over), free - over
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    for r in got:
        assert math.isclose(r.target, target[r.source]) and r.source_size == size[r.source] and r.taken <= 2 * r["size"]
    for s in order:
        assert abs(sum(r.taken for r in got if r.source == s) - target[s]) <= 0.03 * target[s] + 15
    again = {(r.doc_id, r.source, r["size"]): r.copies for r in mixing.mix(table).collect()}
    assert all(again[r.doc_id, r.source, r["size"]] == r.copies for r in got)
    emitted = mixing.emit(table)
    assert emitted.count() == sum(r.copies for r in got) and emitted.columns == table.columns
    assert {(r["_of"], r["_copies"], r["_rate"]) for r in emitted.select("_of", "_copies", "_rate").collect()} == {("o", "c", "r")}
    assert mixing.mix(table.limit(0)).count() == 0 and {r.taken for r in mixing.mix(docs(spark, [None, ""])).collect()} == {0}


def plain_simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(codes):
    parent = list(range(len(codes)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(codes)), 2):
        if (codes[i] ^ codes[j]).bit_count() <= 2:
            parent[find(i)] = find(j)
    return [find(i) for i in range(len(codes))]


def test_simhash(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(40)) for _ in range(20)]
    texts = [*ODD, *base, *base, *(b + " tail" for b in base), *(b.upper() for b in base)]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    codes = [plain_simhash(t) for t in texts]
    root = components(codes)
    for i in range(len(texts)):
        r = got[None if i == 3 else i]
        assert r.fingerprint == f"{codes[i]:016x}"
        assert r.component_id == min((k for k in range(len(texts)) if root[k] == root[i] and k != 3), default=None)
    assert simhash.near_duplicates(docs(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("dense", [2, 64])
def test_links_in_crowds(spark, dense):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(4)]
    codes = sorted({s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for s in seeds for _ in range(60)})
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    edges = simhash.links(spark.createDataFrame([(c,) for c in signed], "fp long"), dense=dense)
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in edges.collect())
    label = {r.node: r.root for r in simhash.components(edges).collect()}
    root = components(codes)
    for i, c in enumerate(signed):
        assert label.get(c, c) == min(signed[k] for k in range(len(codes)) if root[k] == root[i])


def test_simhash_broadcasts_no_table(spark, monkeypatch):
    """Cells are many for each fingerprint and codes for each of a crowd; Spark would size them as the fingerprints are."""
    plans, kept = [], simhash.stored

    def watched(df, name):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name)

    monkeypatch.setattr(simhash, "stored", watched)
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(40)]
    out = simhash.near_duplicates(docs(spark, [*texts, *texts, *(f"{t} tail" for t in texts)]), dense=2)
    watched(out, "out")
    assert len(plans) == 6 and any("Generate" in p for p in plans) and not [p for p in plans if "Broadcast" in p]


def brute(pieces, word):
    """Log scores of all segmentations of a word."""
    byte_ids = set(pieces.byte_id.tolist())
    ids = {p: i for i, p in enumerate(pieces.surface) if i not in byte_ids and np.isfinite(pieces.score[i])}

    def go(s):
        if s == len(word):
            yield 0.0
            return
        n = len(word[s:].decode()[0].encode())
        for t in range(s + 1, len(word) + 1):
            if word[s:t] in ids:
                yield from (pieces.score[ids[word[s:t]]] + x for x in go(t))
        if word[s : s + n] not in ids:
            yield from (sum(pieces.score[pieces.byte_id[b]] for b in word[s : s + n]) + x for x in go(s + n))

    return list(go(0))


def test_lattice_against_all_segmentations():
    pieces = lattice.load_pieces(MODEL)
    words = [w.encode() for w in ("▁the", "▁therein", "▁naïve", "▁x😀y", "▁▁▁", "▁͸q", "▁training", "z", "▁中文")]
    top, total = lattice.best(pieces, words), lattice.marginal(pieces, words)
    for w, ids, m in zip(words, top, total, strict=True):
        every = brute(pieces, w)
        assert b"".join(pieces.surface[i] for i in ids) == w
        assert math.isclose(max(every), pieces.score[ids].sum(), abs_tol=1e-9) and math.isclose(np.logaddexp.reduce(every), m, abs_tol=1e-9)


def test_expected_counts_against_all_segmentations():
    pieces, words, n = lattice.load_pieces(MODEL), ["▁the", "▁therein", "▁x😀y", "z"], np.array([2.0, 1.0, 3.0, 1.0])
    want, ids = np.zeros(len(pieces.score)), {p: i for i, p in enumerate(pieces.surface) if np.isfinite(pieces.score[i]) and i not in set(pieces.byte_id.tolist())}

    def go(text):
        if not text:
            yield []
        for t in range(1, len(text) + 1):
            if text[:t].encode() in ids:
                yield from ([ids[text[:t].encode()], *x] for x in go(text[t:]))
        if text and text[0].encode() not in ids:
            yield from ([*(int(pieces.byte_id[b]) for b in text[0].encode()), *x] for x in go(text[1:]))

    for w, k in zip(words, n, strict=True):
        every = list(go(w))
        p = np.exp([pieces.score[x].sum() for x in every])
        for x, share in zip(every, p / p.sum(), strict=True):
            np.add.at(want, x, share * k)
    assert np.allclose(lattice.expected(pieces, [w.encode() for w in words], n), want)


def test_double_array():
    keys = {bytes(k): i for i, k in enumerate({tuple(random.Random(i).choices(range(256), k=i % 5 + 1)) for i in range(500)})}
    base, check, value = lattice.double_array(keys)
    for key, i in keys.items():
        s = 0
        for b in key:
            to = base[s] + b
            assert check[to] == s
            s = to
        assert value[s] == i


def test_sentencepiece_round_trip(spark):
    table = docs(spark, ODD)
    assert all(r.decodes for r in sentencepiece.round_trip(table, MODEL).collect())
    coded = sentencepiece.encode(table, MODEL)
    assert coded.columns == [*table.columns, "ids"]
    for r in sentencepiece.decode(coded, MODEL).collect():
        assert r.decoded == (r.text or "")
    assert sentencepiece.encode(table.limit(0), MODEL).count() == 0
    small = sentencepiece.Codec(lattice.load_pieces(MODEL), keep=3)
    assert [small.decode(x) for x in small.encode(ODD)] == [t or "" for t in ODD]
    ids = {r.doc_id: list(r.ids) for r in coded.collect()}
    assert all(list(r.ids) == ids[r.doc_id] and r.n_pieces == len(r.ids) for r in sentencepiece.round_trip(table, MODEL).collect())


def plain_viterbi(pieces, data):
    """The best segmentation of a whole text without white space in it: bytes where a character is no piece."""
    byte_ids = set(pieces.byte_id.tolist())
    ids = {p: i for i, p in enumerate(pieces.surface) if i not in byte_ids and np.isfinite(pieces.score[i])}
    longest, top = max(map(len, ids)), [(0.0, [])] + [(-math.inf, [])] * len(data)
    for s in range(len(data)):
        if top[s][0] == -math.inf or data[s] & 0xC0 == 0x80 and not top[s][1]:
            continue
        size = next((k for k in (1, 2, 3, 4) if s + k == len(data) or data[s + k] & 0xC0 != 0x80), 1)
        arcs = [(s + k, [ids[data[s : s + k]]]) for k in range(1, min(longest, len(data) - s) + 1) if data[s : s + k] in ids]
        if data[s : s + size] not in ids:
            arcs.append((s + size, [int(pieces.byte_id[b]) for b in data[s : s + size]]))
        for t, more in arcs:
            new = top[s][0] + sum(pieces.score[i] for i in more)
            if new > top[t][0] + 1e-12:
                top[t] = (new, top[s][1] + more)
    return top[-1]


def test_segments_make_up_the_best_of_the_whole_text():
    pieces = lattice.load_pieces(MODEL)
    codec = sentencepiece.Codec(pieces)
    for text in ("the training of  models,   unbelievably͸ naïve 😀 中文 ", " leading and doubled  spaces", "x" * 60, "don't stop"):
        score, _ = plain_viterbi(pieces, (" " + text).replace(" ", "▁").encode())
        (ids,) = codec.encode([text])
        assert math.isclose(pieces.score[ids].sum(), score, abs_tol=1e-6)


def test_lattice_lm(spark):
    texts = [*ODD, "the cat sat", "The cat", "a dog sat unseen͸"]
    got = {r.doc_id: r for r in lattice_lm.lattice_scores(docs(spark, texts), MODEL, F.col("doc_id") < 10, block_mb=1).collect()}
    words = [[*(t or "").encode().lower().split(), b" "] for t in texts]
    train = [w for i, w in enumerate(words) if i < 10 and i != 3]
    count = {}
    for w in itertools.chain(*train):
        count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for i, w in enumerate(words):
        r = got[None if i == 3 else i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(x in count for x in w), n, not (i < 10 and i != 3))
        assert math.isclose(r.base_score, sum(math.log10((count.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    # The same by all segmentations of each word, with pieces learnt from the rare training words.
    rare = spark.createDataFrame([(w, c) for w, c in count.items()], "word binary, n long")
    pieces, end = lattice_lm.learn(rare, MODEL)
    for i in (len(texts) - 3, len(texts) - 2, len(texts) - 1):
        want = 0.0
        for w in words[i]:
            p = math.exp(end if w == b" " else np.logaddexp.reduce(brute(pieces, lattice.MARK + w)))
            want += math.log10((count.get(w, 0) + v * p) / (n + v))
        assert math.isclose(got[i].score, want, rel_tol=1e-9)
    assert lattice_lm.lattice_scores(docs(spark, texts).limit(0), MODEL, F.lit(True)).count() == 0
    none = lattice_lm.lattice_scores(docs(spark, texts), MODEL, F.lit(False)).collect()
    assert all(math.isfinite(r.score) and r.train_tokens == 0 for r in none)


def test_frequent_words_are_broadcast_and_scores_stay(spark):
    rng = np.random.default_rng(12)
    words = np.array(["the", "Of", "and", "x" * 70, "naïve", *(f"w{i}" for i in range(4000))])
    texts = [" ".join(words[np.minimum(rng.zipf(1.2, 6000) - 1, len(words) - 1)]) for _ in range(90)]
    table = docs(spark, [*ODD, *texts])
    got = []
    for hot_words in (0, 3, 1 << 16):
        scored = lattice_lm.lattice_scores(table, MODEL, F.col("doc_id") % 5 != 1, block_mb=1, hot_words=hot_words)
        got.append(sorted((tuple(r) for r in scored.collect()), key=lambda r: (r[0] is None, r[0])))
    assert got[0] == got[1] == got[2] and len(got[0]) == len(ODD) + 90
    held = spark.createDataFrame([(b"a", 3, 2), (b"b", 1, 3), (b"c", 9, 1), (b"d" * 65, 9, 3), (b" ", 5, 2)], "word binary, n long, blocks long")
    assert {bytes(r.word) for r in lattice_lm.frequent(held, 2).collect()} == {b"b", b" "}


def test_language_id(spark):
    rng = random.Random(4)
    parts = {"en": "the and ing tion of th er", "de": "der und ung schl ich ein keit"}
    rows = [(i, " ".join("".join(rng.choices(parts[lang].split(), k=3)) for _ in range(30)), lang) for i, lang in ((i, rng.choice(["en", "de"])) for i in range(240))]
    table = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 3!", "de"), (902, "\x00", None)], "doc_id long, text string, lang string")
    model = language_id.train(language_id.training_windows(table, F.col("doc_id") < 160))
    got = {r.doc_id: r for r in language_id.predict(table, model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows[160:]]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and {got[i].lang_pred for i in (900, 901, 902)} == {"und"}
    spans = language_id.position_spans(model, rows[0][1])
    assert spans[0][0] == 0 and spans[-1][1] == len(rows[0][1]) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert {r.lang_pred for r in language_id.predict(table, language_id.train([])).collect()} == {"und"}


def test_document_probabilities_against_plain_recurrence():
    rng = np.random.default_rng(3)
    model = language_id.Model(["a", "b", "c"], [rng.normal(size=(4, 257)) for _ in "fb"], [rng.normal(size=(4, 2)) for _ in "fb"], rng.normal(size=(3, 4)), rng.normal(size=3))
    for t in model.table:
        language_id._pads(t)

    def states(way, data):
        h, out = np.zeros(2), []
        for b in data:
            a = model.table[way][:, b] + model.recurrent[way] @ h
            z, c = 1 / (1 + np.exp(-a[:2])), np.tanh(a[2:])
            h = z * h + (1 - z) * c
            out.append(h)
        return out

    texts = [b"", b"x", bytes(rng.integers(0, 256, 300).tolist()), b"ab" * 64]
    got = language_id.document_probabilities(model, texts)
    for text, p in zip(texts, got, strict=True):
        want = []
        for at in range(0, len(text), language_id.WINDOW):
            part = text[at : at + language_id.WINDOW]
            for f, b in zip(states(0, part), states(1, part[::-1])[::-1], strict=True):
                e = np.exp(model.out @ np.concatenate((f, b)) + model.bias)
                want.append(e / e.sum())
        assert np.allclose(p, np.mean(want, axis=0) if want else 0, atol=1e-9)


def test_windows_cover_the_texts():
    texts = [b"", b"ab", bytes(range(255)) * 3, b"", b"x" * language_id.WINDOW, b"y"]
    for at_once in (1, 3, 8192):
        back = [b""] * len(texts)
        for x, of, held in language_id._windows(texts, at_once=at_once):
            assert x.shape[1] <= at_once and (x[-1, held < language_id.WINDOW] == language_id.PAD).all()
            for i, (k, n) in enumerate(zip(of, held, strict=True)):
                back[k] += bytes(x[:n, i].tolist())
        assert back == texts


def test_backpropagation_is_the_gradient():
    rng = np.random.default_rng(0)
    x, table, rec = rng.integers(0, 256, (6, 3)), rng.normal(size=(4, 257)), rng.normal(size=(4, 2))
    weight = rng.normal(size=(6, 2, 3))
    loss = lambda t, r: (language_id._states(t, r, x) * weight).sum()
    kept, d_table, d_rec = [], np.zeros_like(table), np.zeros_like(rec)
    language_id._states(table, rec, x, kept)
    language_id._back(rec, x, kept, weight, d_table, d_rec)
    for i, j in itertools.product(range(4), range(2)):
        step = np.zeros_like(rec)
        step[i, j] = 1e-6
        assert math.isclose((loss(table, rec + step) - loss(table, rec - step)) / 2e-6, d_rec[i, j], rel_tol=1e-4, abs_tol=1e-6)
    step = np.zeros_like(table)
    step[1, x[2, 0]] = 1e-6
    assert math.isclose((loss(table + step, rec) - loss(table - step, rec)) / 2e-6, d_table[1, x[2, 0]], rel_tol=1e-4, abs_tol=1e-6)


def test_token_counts(spark):
    enc, size = token_counts.encoding(RANKS, PATTERN)
    got = {}
    for r in token_counts.section_tokens(docs(spark, ODD), RANKS, PATTERN).collect():
        got.setdefault(3 if r.doc_id is None else r.doc_id, []).append(r)
    for i, t in enumerate(ODD):
        rows = sorted(got[i], key=lambda r: r.section)
        assert "".join((t or "")[r.char_start : r.char_end] for r in rows) == (t or "")
        assert sum(r.n_tokens for r in rows) == len(enc.encode_ordinary(t or "")) == rows[0].doc_tokens
    texts = ["one\n\n two\n", "a\n\n\n\n b", "é\r\n\r\n  x\n😀\n", *[t or "" for t in ODD[:5]]]
    for rule in token_counts.RULES:
        made = {}
        for r in token_counts.section_tokens(docs(spark, texts), RANKS, PATTERN, rule).collect():
            made.setdefault(3 if r.doc_id is None else r.doc_id, []).append((r.section, r.n_tokens, r.n_crossing))
        for i, t in enumerate(texts):
            line_of = [k for k, line in enumerate(t.encode().splitlines(keepends=True) if b"\r" not in t.encode() else t.encode().replace(b"\r", b"_").splitlines(keepends=True)) for _ in line]
            owner, at = [], 0
            for token in enc.encode_ordinary(t):
                held = line_of[at : at + size[token]]
                at += size[token]
                owner.append((held[0] if rule == "start" else held[-1] if rule == "end" else max(sorted(set(held)), key=held.count), len(set(held)) > 1))
            want = [(k, sum(o == k for o, _ in owner), sum(o == k and c for o, c in owner)) for k in range(max([0, *line_of]) + 1)]
            assert sorted(made[i]) == want
    ends, starts = np.array([2, 5, 9, 10]), np.array([0, 3, 4, 8])
    assert [token_counts.attribute(ends, starts, 10, r)[0].tolist() for r in token_counts.RULES] == [[2, 0, 1, 1], [1, 0, 1, 2], [2, 0, 1, 1]]
    assert token_counts.section_tokens(docs(spark, ODD).limit(0), RANKS, PATTERN).count() == 0
    for t in ODD[1:]:
        words = [i for w in regex.finditer(PATTERN, t) for i in enc._encode_single_piece(w.group())]
        assert token_counts.tokens(enc, PATTERN, t).tolist() == words
    blank = " " * 1_500_000 + "a"
    assert size[token_counts.tokens(enc, PATTERN, blank)].sum() == len(blank)


def test_warc(spark, tmp_path):
    html = ["<p>a</p>", "<p>a</p>", None, "", "é\r\n\r\nWARC/1.1", "x" * 300_000, "<p>a</p>"]
    rows = [(None if i == 1 else i, None if i == 2 else f"https://e.com/{i}\n", h, "x") for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    got = warc.archive_round_trip(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, h in enumerate(html):
        r = by[None if i == 1 else i]
        assert r.payload_bytes == len((h or "").encode()) and r.payload_digest == warc.digest((h or "").encode())
    assert (by[0].record_type, by[0].refers_to, by[6].record_type, by[None].record_type) == ("revisit", 6, "response", "response")
    assert (by[2].record_type, by[2].refers_to) == ("revisit", 3)
    assert {r.record_type for r in warc.archive_round_trip(pages, least=1).where("payload_bytes = 0").collect()} == {"response"}
    assert warc.archive_round_trip(pages.limit(0)).count() == 0
    made = warc.normalise(warc.write_archives(pages, f"{tmp_path}/raw"), f"{tmp_path}/members").first()
    data = open(made.path, "rb").read()
    lines = [__import__("json").loads(x) for x in open(made["index"])]
    assert sum(x["length"] for x in lines) == len(data) and made.n_records == len(lines)
    assert all(gzip.decompress(data[x["offset"] : x["offset"] + x["length"]]).startswith(b"WARC/1.1") for x in lines)


def test_toxicity(spark):
    rng = random.Random(9)
    words = [f"wo{a}{b}rd" for a in "bcdfgklmnp" for b in "aeiou"]
    rows = []
    for i in range(400):
        bad = i % 8 == 0
        said = rng.choices(words, k=40) + ([rng.choice(["idi0t", "IDIOT", "idіot", "idiot"]), "clown"] if bad else [])
        rng.shuffle(said)
        rows.append((i, " ".join(said), int(bad)))
    table = spark.createDataFrame([*rows, (900, None, None), (901, "", 0)], "doc_id long, text string, toxic int")
    lexicon = toxicity.learn(table.where("doc_id < 300"))
    got = {r.doc_id: r.score for r in toxicity.toxicity(table, lexicon).collect()}
    assert all((got[i] >= 0.3) == bool(bad) for i, _, bad in rows[300:]) and got[900] == got[901] < 0.3
    found = toxicity.Lexicon(lexicon.weight, ("clown-fish",), (0, 0, 0)).automaton()
    assert toxicity.features(found, toxicity.fold("a clown fish")) == (0.0, 0.0) < toxicity.features(found, toxicity.fold("a clown"))
    with pytest.raises(ValueError):
        toxicity.with_toxicity(table, lexicon, score_col="TOXIC")
    own = toxicity.Lexicon({" b": 1.0, " d ": 2.0}, ("a b c d e", "b c", "d a"), (0, 0, 0)).automaton()
    for text, total in (("a b c d e", 0), ("b c d", 2), ("a b c d", 2), ("d d a b", 3), ("b c " * 3 + "b", 1)):
        assert toxicity.features(own, text.split())[1] == 10 * total / (len(text.split()) + 10)
    assert toxicity.fold("1D1​OT іdіot") == ["idiot", "idiot"]
    assert toxicity.toxicity(table, toxicity.learn(table.limit(0))).count() == 402


def test_exceptions_are_learnt_from_clean_texts(spark):
    rng = random.Random(10)
    words = [f"wo{a}{b}rd" for a in "bcdfgklmnp" for b in "aeiou"]
    rows = []
    for i in range(800):
        said = rng.choices(words, k=20)
        said[7:7] = ["zilch"] if i % 5 == 0 else ["zilch", "garden"] if i % 40 == 1 else []
        rows.append((i, " ".join(said), int(i % 5 == 0)))
    lexicon = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert "zilch garden" in lexicon.exceptions and any(" zilch ".startswith(t) for t in lexicon.weight)
    found = lexicon.automaton()
    assert toxicity.features(found, ["the", "zilch", "garden"]) == (0.0, 0.0) < toxicity.features(found, ["the", "zilch", "woe"])


def test_matching_against_a_plain_search():
    rng = random.Random(14)
    for _ in range(300):
        letters = lambda n: "".join(rng.choices("ab", k=n))
        weight = {t: rng.choice([0.5, 1.0, 2.0]) for t in ({f" {letters(rng.randint(1, 3))}" + rng.choice(["", " "]) for _ in range(6)})}
        spared = tuple({f"{letters(rng.randint(1, 2))} {letters(rng.randint(1, 2))}" for _ in range(3)})
        words = [letters(rng.randint(1, 4)) for _ in range(rng.randint(0, 12))]
        text, total = f" {' '.join(words)} ", 0.0
        inside = [(i, i + len(e) + 1) for e in spared for i in range(len(text)) if text.startswith(f" {e} ", i)]
        for i in range(len(text)):
            here = [w for t, w in weight.items() if text.startswith(t, i)]
            if here and not any(a <= i < b for a, b in inside):
                total += max(here)
        got = toxicity.features(toxicity.Lexicon(weight, spared, (0, 0, 0)).automaton(), words)
        assert math.isclose(got[1], 10 * total / (len(words) + 10)) if words else got == (0.0, 0.0)
