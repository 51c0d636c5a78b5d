"""Spelling variants: words one edit apart, found by k-d trees over letter counts and verified by the order of their letters.

An edit changes the counts of a word's letters by one up (an insertion), one down (a deletion) or both (a replacement): their L1
distance is two at most, and the lengths say which of these it is. So the tree of the words of one length is searched by the
words of that length and by those one shorter, with at most one step up and one down left to spend on the bounds of its boxes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import stored, within

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A letter is one byte here, a-z or U+00C0 to U+00FF, and has a number; the byte 0 fills shorter words up and has the last one.
LETTERS = 26 + 64
_NUMBER = np.full(256, LETTERS, np.int64)
_NUMBER[97:123], _NUMBER[0xC0:] = np.arange(26), np.arange(26, LETTERS)


def counts_of(words: np.ndarray) -> np.ndarray:
    """A row of letter counts for each of an array of words as bytes."""
    width = max(1, words.dtype.itemsize)
    codes = np.ascontiguousarray(words).view(np.uint8).reshape(len(words), width)
    out = np.zeros((len(words), LETTERS), np.int32)
    wide = LETTERS + 1
    step = max(1, (1 << 22) // width)
    for at in range(0, len(words), step):
        part = codes[at : at + step]
        flat = np.repeat(np.arange(len(part)), width) * wide + _NUMBER[part.ravel()]
        out[at : at + step] = np.bincount(flat, minlength=len(part) * wide).reshape(-1, wide)[:, :LETTERS]
    return out


class KdTree:
    """Splits points at whole numbers, the letter that parts them most evenly first, down to leaves of `leaf` points."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.nodes: list[tuple[int, int, int, int]] = []  # letter, bound (counts up to it go left), left, right; or -1, leaf
        self.leaves: list[np.ndarray] = []
        self._grow(points, np.arange(len(points)), leaf)

    def _grow(self, points: np.ndarray, own: np.ndarray, leaf: int) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, len(self.leaves), 0, 0))
        split = self._split(points[own]) if len(own) > leaf else None
        if split is None:
            self.leaves.append(own)
            return at
        letter, bound = split
        left = points[own, letter] <= bound
        self.nodes[at] = (letter, bound, self._grow(points, own[left], leaf), self._grow(points, own[~left], leaf))
        return at

    @staticmethod
    def _split(points: np.ndarray) -> tuple[int, int] | None:
        best = (0, -1, 0)
        for letter in np.argsort(-points.var(axis=0), kind="stable")[:6].tolist():
            values, n = np.unique(points[:, letter], return_counts=True)
            if len(values) > 1:
                below = np.cumsum(n)[:-1]
                k = int(np.abs(2 * below - len(points)).argmin())
                even = min(int(below[k]), len(points) - int(below[k]))
                best = max(best, (even, letter, int(values[k])), key=lambda x: x[0])
        return None if best[1] < 0 else best[1:]

    def reach(self, asked: np.ndarray, up: np.ndarray, down: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """The leaves whose boxes hold points that asked vectors can come to by `up` more letters and `down` fewer (0 or 1), each
        with these vectors' places and what they have left to spend."""
        todo = [(0, np.arange(len(asked)), up, down)]
        while todo:
            at, own, more, less = todo.pop()
            letter, bound, left, right = self.nodes[at]
            if not len(own):
                continue
            if letter < 0:
                yield bound, own, more, less
                continue
            c = asked[own, letter].astype(np.int64)
            goes = c - bound <= less
            todo.append((left, own[goes], more[goes], (less - np.maximum(c - bound, 0))[goes]))
            goes = bound + 1 - c <= more
            todo.append((right, own[goes], (more - np.maximum(bound + 1 - c, 0))[goes], less[goes]))


def _letters_apart(a: np.ndarray, b: np.ndarray, square: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of rows with a squared distance: of whole numbers that add up to 0 (or 1), squares that add up to 2
    (or 1) are one up and one down (or one up). The products are whole numbers that the type holds exactly."""
    return np.nonzero((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T) == square)


class Words:
    """Words of one length as bytes, sorted, grouped in classes of equal letter counts; the places of letters by class."""

    def __init__(self, words: np.ndarray, n: np.ndarray, length: int):
        order = np.argsort(words)
        self.words, self.n, self.length, self.order = words[order], n[order], length, order
        self.codes = np.ascontiguousarray(self.words.astype(f"S{max(1, length)}")).view(np.uint8).reshape(len(words), -1)
        classes, self.of = np.unique(np.sort(self.codes, axis=1).view(f"S{self.codes.shape[1]}").ravel(), return_inverse=True)
        self.counts = counts_of(classes)
        self.exact = self.counts.astype(np.float32 if length < 2000 else np.float64)
        self.powers = np.cumprod(np.full(self.codes.shape[1], 0x9E3779B97F4A7C15, np.uint64))
        self._at: dict[str, tuple] = {}

    def hashes(self) -> np.ndarray:
        return (self.codes * self.powers).sum(axis=1, dtype=np.uint64)

    def keyed(self, how: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """slot (class and letter, sorted), word, key: of each word and each of its letters the hash of the word with a hole in
        its place ("hole") or without it ("gone"; of a run of one letter only the first); or of each word its hash ("whole",
        at letter 0)."""
        if how not in self._at:
            c = self.codes.astype(np.uint64)
            if how == "whole":
                word, letter, key = np.arange(len(c)), np.zeros(len(c), np.int64), self.hashes()
            else:
                part = c * self.powers
                if how == "hole":
                    key = part.sum(axis=1, dtype=np.uint64)[:, None] - part
                    use = np.ones(c.shape, bool)
                else:
                    shifted = np.zeros_like(c)
                    shifted[:, 1:] = c[:, 1:] * self.powers[:-1]
                    behind = shifted.sum(axis=1, dtype=np.uint64)[:, None] - np.cumsum(shifted, axis=1, dtype=np.uint64)
                    key = np.cumsum(part, axis=1, dtype=np.uint64) - part + behind
                    use = np.concatenate((np.ones((len(c), 1), bool), self.codes[:, 1:] != self.codes[:, :-1]), axis=1)
                word, place = np.nonzero(use)
                letter, key = _NUMBER[self.codes[word, place]], key[word, place]
            slot = self.of[word].astype(np.int64) * LETTERS + letter
            order = np.argsort(slot, kind="stable")
            self._at[how] = slot[order], word[order], key[order]
        return self._at[how]

    def listed(self, how: str, classes: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all given pairs of class and letter: the pair's number, word, key."""
        slot, word, key = self.keyed(how)
        want = classes.astype(np.int64) * LETTERS + letters
        begin, end = np.searchsorted(slot, want), np.searchsorted(slot, want, "right")
        size = end - begin
        at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.repeat(np.arange(len(want)), size), word[at], key[at]


def verified(asked: Words, points: Words, q: np.ndarray, p: np.ndarray, step: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of classes, the pairs of words whose letters stand in the same order but for the edit. Words of two classes meet
    by a hash of what the edit leaves, so the work is the classes' sum, not their product; the letters decide."""
    found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    same = asked.length == points.length
    for at in range(0, len(q), step):
        qs, ps = q[at : at + step], p[at : at + step]
        apart = points.counts[ps] - asked.counts[qs]
        came = apart.argmax(axis=1)
        left = asked.listed("hole", qs, apart.argmin(axis=1)) if same else asked.listed("whole", qs, np.zeros(len(qs), np.int64))
        right = points.listed("hole" if same else "gone", ps, came)
        mix = np.uint64(0xD6E8FEB86659FD93)
        left_key, right_key = left[2] ^ (left[0].astype(np.uint64) * mix), right[2] ^ (right[0].astype(np.uint64) * mix)
        order = np.argsort(right_key, kind="stable")
        ranked = right_key[order]
        begin, end = np.searchsorted(ranked, left_key), np.searchsorted(ranked, left_key, "right")
        size = end - begin
        of = np.repeat(np.arange(len(left_key)), size)
        to = order[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())]
        one = left[0][of] == right[0][to]
        a, b = left[1][of[one]], right[1][to[one]]
        differ = asked.codes[a] != points.codes[b, : asked.codes.shape[1]]
        if same:
            ok = differ.sum(axis=1) == 1
        else:
            # Behind the first place that differs, one is the other moved by a letter.
            first = np.where(differ.any(axis=1), differ.argmax(axis=1), asked.length)
            moved = asked.codes[a] == points.codes[b, 1:]
            ok = (moved | (np.arange(asked.codes.shape[1])[None, :] < first[:, None])).all(axis=1)
        found_a.append(a[ok])
        found_b.append(b[ok])
    return np.concatenate(found_a), np.concatenate(found_b)


def _told(words: np.ndarray, of: np.ndarray, near: np.ndarray, near_n: np.ndarray) -> pa.RecordBatch | None:
    """word, n_near, best_n, best: how many words are near each, and the one of largest n (ties: the smallest)."""
    if not len(of):
        return None
    order = np.lexsort((near, -near_n, of))
    of, near, near_n = of[order], near[order], near_n[order]
    begin = np.nonzero(np.concatenate(([True], of[1:] != of[:-1])))[0]
    text = lambda x: pa.array([w.decode("latin-1") for w in x.tolist()], pa.string())
    return pa.RecordBatch.from_arrays([text(words[of[begin]]), pa.array(np.diff(np.append(begin, len(of)))), pa.array(near_n[begin]), text(near[begin])], names=["word", "n_near", "best_n", "best"])


class Cell:
    """The words of one box, with a tree of their classes."""

    def __init__(self, words: list[bytes], n: np.ndarray, leaf: int):
        self.points = Words(np.array(words), n, len(words[0]))
        self.tree = KdTree(self.points.counts, leaf)

    def near(self, words: list[bytes], n: np.ndarray, up: np.ndarray, down: np.ndarray) -> Iterator[pa.RecordBatch]:
        """What the words of one length, which have so much to spend yet, find here; and of those one longer, what found them."""
        asked = Words(np.array(words), n, len(words[0]))
        first = np.full(len(asked.counts), -1)
        first[asked.of] = np.arange(len(words))  # words of one class came the same way
        spend = asked.order[first]
        same = asked.length == self.points.length
        kind = self.points.exact.dtype
        q, p = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for leaf, own, _, _ in self.tree.reach(asked.counts, up[spend].astype(np.int64), down[spend].astype(np.int64)):
            there = self.tree.leaves[leaf]
            i, j = _letters_apart(asked.exact[own].astype(kind), self.points.exact[there], 2 if same else 1)
            q.append(own[i])
            p.append(there[j])
        a, b = verified(asked, self.points, np.concatenate(q), np.concatenate(p))
        told = [_told(asked.words, a, self.points.words[b], self.points.n[b])]
        if not same:
            told.append(_told(self.points.words, b, asked.words[a], asked.n[a]))
        yield from (x for x in told if x is not None)


@dataclass
class Boxes:
    """For each length the tree that deals its words to cells, numbered over all lengths."""

    trees: dict[int, tuple[int, KdTree]]
    cells: int

    @classmethod
    def fit(cls, sample: list[bytes], share: float, at_most: int) -> Boxes:
        """Boxes of some `at_most` words, by a sample that has `share` of all words. A length that it lacks has one cell."""
        trees, cells, by = {}, 0, {}
        for w in sample:
            by.setdefault(len(w), []).append(w)
        for length, words in sorted(by.items()):
            tree = KdTree(counts_of(np.array(sorted(words))), max(1, int(at_most * share)))
            trees[length] = (cells, tree)
            cells += len(tree.leaves)
        return cls(trees, cells)

    def dealt(self, words: np.ndarray, length: int, asked: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """cell, place among the words, up, down: the cell of each word of a length; or (asked) the cells of that length, or
        of the next, that its near words may be in."""
        counts = counts_of(words)
        one, none = np.ones(len(words), np.int64), np.zeros(len(words), np.int64)
        for into, up, down in ((length, one, one), (length + 1, one, none)) if asked else ((length, none, none),):
            first, tree = self.trees.get(into, (-1 - into, None))
            if tree is None:
                yield np.full(len(words), first), np.arange(len(words)), up, down
                continue
            for leaf, own, more, less in tree.reach(counts, up, down):
                yield np.full(len(own), first + leaf), own, more, less


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 31, least_points: int = 7, least_n: int = 2) -> DataFrame:
    """word, n: the distinct runs of letters of whole texts, A-Z in lower case, with so many code points and occurrences.

    Where `every` divides h, the unsigned crc32 of the run's id, a colon and the run, the run's code point h % length is deleted
    first: misspellings that the corpus would have. Null texts have no words; a null id counts as empty. Counted in part before the shuffle.
    """
    runs = F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit("[a-zÀ-ÿ]+"), F.lit(0))
    each = docs.select(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":")).alias("of"), F.explode(runs).alias("run"))
    # A run that can't be long enough any more need not be hashed.
    each = each.where(F.char_length("run") >= least_points).select("run", F.crc32(F.concat("of", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = each.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= least_points)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def near_words(words: DataFrame, cell_words: int = 8192, leaf: int = 48, sample_words: int = 1 << 16, block: int = 1 << 14) -> DataFrame:
    """word, n_near, best_n, best of the words (word, n) that have near ones: one inserted, deleted or replaced code point away.

    Each length's words are dealt to the boxes of a k-d tree, which is fitted on a bounded sample (sample_words; it changes
    who meets where, never the pairs), and each word asks the boxes of its length and of the next that its edits can reach. In a
    box, a tree of its own finds the classes of letter counts that are an edit away, and the order of letters decides. Words
    of equal counts are never near. A box of more than `block` words is dealt in blocks, which all that ask it meet one by one.
    """
    spark = words.sparkSession
    n = words.count()
    share = min(1.0, sample_words / max(1, n))
    sample = words.where(within(F.xxhash64("word", F.lit("boxes")), share)).select("word").toPandas()["word"]
    boxes = spark.sparkContext.broadcast(Boxes.fit([w.encode("latin-1") for w in sample], share, cell_words))

    def place(asked: bool):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, seen = [w.encode("latin-1") for w in batch.column(0).to_pylist()], batch.column(1).to_numpy()
                size = np.fromiter(map(len, own), np.int64, len(own))
                for length in np.unique(size).tolist():
                    of = np.nonzero(size == length)[0]
                    for cell, at, up, down in boxes.value.dealt(np.array([own[i] for i in of.tolist()]), length, asked):
                        take = of[at]
                        kinds = [pa.array(cell, pa.int32()), pa.array(up, pa.int8()), pa.array(down, pa.int8()), batch.column(0).take(pa.array(take)), pa.array(seen[take])]
                        yield pa.RecordBatch.from_arrays(kinds, names=["cell", "up", "down", "word", "n"])

        return words.select("word", "n").mapInArrow(each, "cell int, up tinyint, down tinyint, word string, n long")

    points = place(False)
    # As many rows as there are cells, which are few for their words.
    dealt = {r.cell: -(-r.n // block) for r in points.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).collect()}
    blocks = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in dealt.items() for x in kv]), F.col("cell")), F.lit(1)) if dealt else F.lit(1)
    here = points.select("cell", F.pmod(F.xxhash64("word"), blocks).cast("int").alias("block"), F.lit(False).alias("asks"), F.lit(0).alias("length"), "up", "down", "word", "n")
    asks = place(True).select("cell", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))).alias("block"), F.lit(True).alias("asks"), F.char_length("word").alias("length"), "up", "down", "word", "n")
    # The words of a block come first, then those that ask it, by length, so that a task holds a block and a batch.
    met = here.unionByName(asks).repartition("cell", "block").sortWithinPartitions("cell", "block", "asks", "length")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cell, held, held_n = None, None, [], []
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            cuts = np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1 if len(keys) else np.empty(0, np.int64)
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if lo == hi:
                    continue
                own = [w.encode("latin-1") for w in batch.column(6).slice(lo, hi - lo).to_pylist()]
                seen = batch.column(7).slice(lo, hi - lo).to_numpy()
                if at != (key := tuple(keys[lo, :2].tolist())):
                    at, cell, held, held_n = key, None, [], []
                if not keys[lo, 2]:
                    held += own
                    held_n.append(seen)
                elif held:
                    if cell is None:
                        cell = Cell(held, np.concatenate(held_n), leaf)
                    up, down = (batch.column(i).slice(lo, hi - lo).to_numpy() for i in (4, 5))
                    # Words of equal counts have the same left to spend, so they stay together.
                    yield from cell.near(own, seen, up, down)

    told = met.mapInArrow(find, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("first")
    return told.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("first.less")).alias("best_n"), F.col("first.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where each word (word, form) ends if forms are followed to the last. Each round doubles the steps; since a
    form is so many times as frequent as its word, no chain is longer than the digits of a count."""
    at = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = at.select(F.col("word").alias("_of"), F.col("root").alias("_to"))
        moved = at.join(further, F.col("root") == F.col("_of"), "left").select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("moved"))
        moved = stored(moved, "spelling-roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = 10, every: int = 31, least_points: int = 7, least_n: int = 2, **how) -> DataFrame:
    """word, form, root, n, n_near, form_n: the words of docs (see word_counts) with the number of their near words, and the form
    that each is a variant of: its near word of largest n (ties: the smallest), if that is `times` its own n; else null. root is
    where forms end, the word itself without one.

    A null text has no words, an empty table gives no rows, repeated rows count again; other columns are not looked at.
    """
    words = stored(word_counts(docs, id_col, text_col, every, least_points, least_n), "spelling-words")
    near = stored(near_words(words, **how), "spelling-near")
    all_ = words.join(near, "word", "left").withColumn("is_variant", F.coalesce(F.col("best_n") >= times * F.col("n"), F.lit(False)))
    all_ = all_.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("is_variant"), F.col("best")).alias("form"), F.when(F.col("is_variant"), F.col("best_n")).alias("form_n"))
    all_ = stored(all_, "spelling-forms")
    ends = roots(all_.where("form is not null"))
    return all_.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
