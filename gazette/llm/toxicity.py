"""Toxicity by a weighted lexicon: Aho-Corasick over folded text, normalised by length, with exception phrases."""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import free_names, stored, within

# Letters that look like Latin ones, and digits and signs written for letters.
HOMOGLYPHS = dict(zip("аеорсухкмтвнієѕјԁɡαβεηικνορτυχ", "aeopcyxkmtbhiesjdgabenikvoptux", strict=True))
SUBSTITUTES = dict(zip("0134578@$!|€", "oieastbasile", strict=True))
HIDDEN = "­​‌‍⁠﻿"

#: Rules for terms: least log odds, standard errors taken off them, and in how many toxic texts a term must be. learn() tries
#: each on a part of the labelled rows that may teach.
RULES = ((1.5, 1.0, 3), (2.0, 1.0, 4), (2.5, 1.0, 4), (1.0, 2.0, 4), (2.0, 2.0, 4), (3.0, 1.0, 3))

_FOLD = str.maketrans({**HOMOGLYPHS, **SUBSTITUTES, **dict.fromkeys(HIDDEN)})
_WORDS = re.compile(r"[^\W\d_]+")
PREFIXES = range(3, 9)


def fold(text: str | None) -> list[str]:
    """The words of a text in lower case, look-alikes and substituted digits and signs replaced by letters."""
    low = (text or "").lower()
    if not low.isascii():
        low = unicodedata.normalize("NFKC", low)
    return _WORDS.findall(low.translate(_FOLD))


def terms(words: set[str]) -> Iterator[str]:
    """What a lexicon may hold of a word: the word between spaces, and its beginnings after a space."""
    for w in words:
        yield f" {w} "
        for n in PREFIXES:
            if n > len(w):
                break
            yield f" {w[:n]}"


@dataclass
class Lexicon:
    weight: dict[str, float]  # terms, with a space where a word must begin or end
    exceptions: tuple[str, ...]
    logistic: tuple[float, float, float]  # bias, of the weight per root of the words, of the weight per word

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term, weight in self.weight.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            whole = f" {' '.join(fold(phrase))} "
            found.add_word(whole, (len(whole), None))
        found.make_automaton()
        return found


def features(found: ahocorasick.Automaton, words: list[str]) -> tuple[float, float]:
    """The matched weight, by the root of the number of words and by the number. A place counts its largest weight once;
    places inside an exception phrase count nothing."""
    if not words or found.kind != ahocorasick.AHOCORASICK:
        return 0.0, 0.0
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, weight) in found.iter(f" {' '.join(words)} "):
        start = end - size + 1
        if weight is None:
            spared.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    spared.sort()
    starts, reach = [a for a, _ in spared], [0, *accumulate((b for _, b in spared), max)]
    total = sum(w for s, w in best.items() if s >= reach[bisect_right(starts, s)])
    return total / math.sqrt(len(words) + 10), 10 * total / (len(words) + 10)


def score(found: ahocorasick.Automaton, logistic: tuple[float, float, float], text: str | None) -> float:
    x = features(found, fold(text))
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, logistic[0] + logistic[1] * x[0] + logistic[2] * x[1]))))


def odds(a: int, b: int, toxic: int, clean: int) -> tuple[float, float]:
    """Log odds of a term that `a` of the toxic and `b` of the clean texts have, and their standard error."""
    return math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1)), math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))


def choose(counts: list[tuple[str, int, int]], toxic: int, clean: int, at_most: int, rule: tuple[float, float, int]) -> dict[str, float]:
    """Terms and weights (log odds) from (term, toxic texts, clean texts): those that the rule takes. A beginning gives way to
    one a letter shorter that says as much."""
    least_odds, errors, least = rule
    weight, seen = {}, {}
    for term, a, b in counts:
        w, error = odds(a, b, toxic, clean)
        if a >= least and w - errors * error > least_odds:
            weight[term], seen[term] = w, (a, b)
    kept = {t: w for t, w in weight.items() if seen.get(t.rstrip()[:-1] if not t.endswith(" ") else t[:-1]) != seen[t]}
    top = sorted(kept, key=lambda t: (-seen[t][0] * kept[t], t))[:at_most]
    return {t: kept[t] for t in sorted(top)}


def phrases(weight: dict[str, float], words: list[str]) -> set[str]:
    """The pairs of neighbouring words one of which a term of the lexicon matches: what an exception may be."""
    marked = {w for w in set(words) if any(t in weight for t in terms({w}))}
    return {f"{x} {y}" for x, y in zip(words, words[1:], strict=False) if x in marked or y in marked}


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton's method with a small ridge."""
    x, w = np.column_stack((np.ones(len(x)), x)), np.zeros(3)
    ridge = np.diag([1e-3, 0.1, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _log_loss(x: np.ndarray, y: np.ndarray, w: tuple[float, float, float]) -> float:
    p = 1 / (1 + np.exp(-np.clip(w[0] + x @ np.array(w[1:]), -50, 50)))
    return float(-(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)).mean())


def learn(labelled: DataFrame, at_most_rows: int = 16_000, at_most_terms: int = 4000, at_most_exceptions: int = 1000, exceptions: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """A lexicon from labelled rows (label 0 or 1; other labels and null are left out).

    A bounded sample teaches: those whose ids' hashes are the least, at_most_rows of them on average. A quarter of it, by
    another hash, chooses the rule of RULES: the one whose lexicon, learnt from the other three, has the least log loss there.
    Then the whole sample teaches by that rule. Pairs of words around a term that speak for clean texts, their log odds and
    a standard error together below 0, become exceptions, besides those given.

    Terms and pairs are counted by Spark; the driver gets counts of those that a rule takes, and some numbers of each sampled
    row to calibrate on. Of more than at_most_terms terms, those with the largest product of toxic texts and log odds stay; of
    more than at_most_exceptions, those with the most clean texts.
    """
    spark = labelled.sparkSession
    key = F.xxhash64(F.col(id_col).cast("string"), F.lit("lexicon"))
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(key.alias("key"), F.col(text_col).alias("text"), (F.col(label_col) == 1).alias("toxic"))
    rows = rows.where(within(F.col("key"), at_most_rows / max(1, rows.count()))).withColumn("tries", F.pmod(F.xxhash64("key", F.lit("inner")), F.lit(4)) == 0)
    rows = rows.select("text", "toxic", "tries").repartition(max(8, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(fold(x.as_py())) for x in batch.column(0)], pa.string()), *batch.columns[1:]], names=["said", "toxic", "tries"])

    sample = stored(rows.mapInArrow(folded, "said string, toxic boolean, tries boolean"), "toxicity-sample")
    totals = {(r.toxic, r.tries): r["count"] for r in sample.groupBy("toxic", "tries").count().collect()}
    inner = [totals.get((y, False), 0) for y in (True, False)]
    whole = [n + totals.get((y, True), 0) for n, y in zip(inner, (True, False), strict=True)]

    def counted(found, passes) -> list:
        """item, a, b, c, d that pass: in how many toxic and clean texts of the teaching part each is, and of all."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict = {k: Counter() for k in itertools.product((True, False), repeat=2)}
            for batch in batches:
                for said, toxic, tries in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    seen[toxic, tries].update(found(said.split()))
            every = list(set().union(*seen.values()))
            column = lambda *keys: pa.array([sum(seen[k][t] for k in keys) for t in every], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *(column(*k) for k in ([(True, False)], [(False, False)], [(True, False), (True, True)], [(False, False), (False, True)]))], names=["item", "a", "b", "c", "d"])

        summed = sample.mapInArrow(count, "item string, a long, b long, c long, d long").groupBy("item").agg(*[F.sum(k).alias(k) for k in "abcd"])
        return summed.where(passes).collect()

    def says(a: str, b: str, n: list[int]) -> tuple[Column, Column]:
        x, y = F.col(a) + 0.5, F.col(b) + 0.5
        return F.log(x / (n[0] + 1)) - F.log(y / (n[1] + 1)), F.sqrt(1 / x + 1 / y)

    # The rules of choose(), which decides: the driver gets no term that is clearly below all of them.
    taken = [(F.col(a) >= least) & (w - errors * error > odds_ - 1e-6) for a, b, n in (("a", "b", inner), ("c", "d", whole)) for w, error in [says(a, b, n)] for odds_, errors, least in RULES]
    counts = counted(lambda words: terms(set(words)), reduce(lambda x, y: x | y, taken))

    def measured(lexicons: list[Lexicon]):
        """toxic, tries and the features by each lexicon (rows x lexicons x 2) of the sampled rows."""
        shared = spark.sparkContext.broadcast(lexicons)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automata = [x.automaton() for x in shared.value]
            for batch in batches:
                x = [[v for found in automata for v in features(found, said.split())] for said in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), *batch.columns[1:]], names=["x", "toxic", "tries"])

        got = sample.mapInArrow(each, "x array<double>, toxic boolean, tries boolean").toPandas()
        return got.toxic.to_numpy(float), got.tries.to_numpy(bool), np.array(got.x.tolist(), float).reshape(len(got), len(lexicons), 2)

    none = (-3.0, 1.0, 0.0)
    rule = RULES[0]
    if min(inner) and len(totals) == 4:
        tried = [choose([(r["item"], r.a, r.b) for r in counts], *inner, at_most_terms, r) for r in RULES]
        y, tries, x = measured([Lexicon(w, exceptions, none) for w in tried])
        losses = [_log_loss(x[tries, i], y[tries], _fit(x[~tries, i], y[~tries])) for i in range(len(RULES))]
        rule = RULES[int(np.argmin(losses))]
    weight = choose([(r["item"], r.c, r.d) for r in counts], *whole, at_most_terms, rule)
    shared_weight = spark.sparkContext.broadcast(weight)
    w, error = says("c", "d", whole)
    clean = counted(lambda words: phrases(shared_weight.value, words), (F.col("d") >= 4) & (w + error < 0)) if weight else []
    learnt = tuple(sorted(r["item"] for r in sorted(clean, key=lambda r: (-r.d, r["item"]))[:at_most_exceptions]))
    lexicon = Lexicon(weight, (*exceptions, *learnt), none)
    y, _, x = measured([lexicon])
    return replace(lexicon, logistic=_fit(x[:, 0], y)) if len(y) else lexicon


def toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row, from its whole text. A null or empty text scores as one without any match; repeated
    rows are each scored; an empty table gives no rows; other columns are not looked at."""
    return with_toxicity(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), lexicon, score_col="score").select("doc_id", "score")


def with_toxicity(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """docs with one more column, the score, which docs must not have; texts are not shuffled for it."""
    if score_col.lower() in map(str.lower, docs.columns):
        raise ValueError(f"the table already has a column {score_col}")
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    at, schema = docs.columns.index(text_col), docs.withColumn(score_col, F.lit(0.0)).schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Lexicon = shared.value
        found = known.automaton()
        for batch in batches:
            scores = [score(found, known.logistic, x.as_py()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=schema.names)

    return docs.mapInArrow(each, schema)


def labelled_rows(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Id, text and label of the rows that may_learn holds for and that have a label; of several labels the largest."""
    (of,) = free_names([id_col, text_col, label_col], "_of")
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias(of)).agg(F.max(label_col).alias(label_col))
    return docs.where(may_learn).select(id_col, text_col).join(marks, F.col(id_col) == F.col(of)).drop(of)
