"""Spelling variants against a comparison of all words with all."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gazette.llm import spelling as S


def plain_words(rows, every=31, least_points=7, least_n=2):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_points:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n >= least_n}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_near(words):
    near = {w: [] for w in words}
    by = {}
    for w in words:
        by.setdefault(len(w), []).append(w)
    for w in words:
        for v in [*by.get(len(w), []), *by.get(len(w) + 1, [])]:
            if v != w and one_edit(w, v):
                near[w].append(v)
                if len(v) > len(w):
                    near[v].append(w)
    return near


def plain_variants(words, times=10):
    near, form = plain_near(words), {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    rows = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return rows


def rows_of(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("cell_words, leaf, block, sample_words", [(8192, 48, 1 << 14, 1 << 16), (20, 3, 1 << 14, 1 << 16), (20, 4, 7, 60)])
def test_all_words_that_are_an_edit_apart(spark, cell_words, leaf, block, sample_words):
    rng = np.random.default_rng(cell_words + block)
    words = set()
    while len(words) < 900:
        w = "".join(rng.choice(list("aabcdeéÿ×"), rng.integers(7, 11)))
        words |= {w, w[::-1], w[1:] + w[0], w[:3] + w[4:], w[:2] + "aa" + w[2:], "b" + w[1:]}
    words = {w: int(rng.integers(2, 400)) for w in words if len(w) >= 7}
    words |= {"a" * 300: 5, "a" * 301: 60, "a" * 299 + "b": 5, "a" * 2500: 3, "a" * 2501: 3}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    got = {r.word: (r.n_near, r.best_n, r.best) for r in S.near_words(df, cell_words, leaf, sample_words, block).collect()}
    want = {w: (len(v), *min((-words[x], x) for x in v)) for w, v in plain_near(words).items() if v}
    assert got == {w: (k, -n, best) for w, (k, n, best) in want.items()}


def test_forms_and_roots(spark):
    rows = [(1, "quickly " * 3000), (2, "quicklyy " * 250 + "QUICKLLY " * 9), (3, "quicklyyy " * 20), (4, "quicklyyyy quicklyyyy"), (5, None), (6, ""), (7, "Ünquickly ünquickly ÜNQUICKLY ünquickly"), (8, "lonely_words lonely1words"), (None, "nobodys nobodys"), (9, "x" * 5000 + " " + "x" * 5000)]
    rows += [(10, "quickly quickly")] * 3
    df = spark.createDataFrame([(*r, "mine", 1, "y") for r in rows], "doc_id long, text string, word string, n int, root string").repartition(4)
    got = rows_of(S.spelling_variants(df))
    assert len(got) == len(set(got)) and set(got) == plain_variants(plain_words(rows))
    by = {r[0]: r for r in got}
    assert by["quicklyyyy"][1:3] == ("quicklyyy", "quickly")  # three steps


def test_given_documents_are_grouped_as_by_hand(spark):
    import __spark_entry__

    folder = "/root/testdata/sf0.001"
    got = rows_of(__spark_entry__.queries()["op11_spelling"](spark, folder))
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert len(got) == len(set(got)) > 100 and set(got) == plain_variants(plain_words(rows))


def test_no_words(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert rows_of(S.spelling_variants(df)) == []
    assert rows_of(S.spelling_variants(spark.createDataFrame([(1, "short words")], "doc_id long, text string"))) == []
