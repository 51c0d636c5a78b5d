"""A language model whose score of a text sums over all segmentations of its words into an existing vocabulary's pieces."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm.common import stored
from gazette.llm.lattice import MARK, Pieces, expected, load_pieces, marginal

#: Stands for the end of a text among its words: no word has a space in it.
END = b" "
#: Weight of the vocabulary's own scores, in pieces, beside the expected counts of the pieces in rare training words.
PRIOR = 1000.0
#: How often a training word may be seen to teach the pieces, and how many rounds of expectations there are.
RARE, ROUNDS = 2, 2


def block_words(rows: DataFrame) -> DataFrame:
    """block, word, n (in training texts) for each block's distinct words and the end. rows: block, text (binary), train; a
    partition holds whole blocks, and a task has the words of one batch in memory at a time, so a block may give a word twice."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, train = batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
            blocks = batch.column(0).to_numpy()
            for block in np.unique(blocks):
                learnt: Counter = Counter()
                seen: set = set()
                for i in np.nonzero(blocks == block)[0]:
                    words = (texts[i].as_py() or b"").lower().split()
                    words.append(END)
                    if train[i]:
                        learnt.update(words)
                    else:
                        seen.update(words)
                words = [*learnt, *seen.difference(learnt)]
                n = np.zeros(len(words), np.int64)
                n[: len(learnt)] = list(learnt.values())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), block)), pa.array(words, pa.binary()), pa.array(n)], names=["block", "word", "n"])

    return rows.mapInArrow(each, "block long, word binary, n long")


def piece_expectations(words: DataFrame, shared) -> DataFrame:
    """piece, n: how often the segmentations of the distinct words hold each piece on average, each word counting once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: Pieces = shared.value
        total = np.zeros(len(pieces.score))
        for batch in batches:
            for part in (batch.slice(i, 20_000) for i in range(0, batch.num_rows, 20_000)):
                word = [MARK + w for w in part.column(0).to_pylist() if w != END]
                total += expected(pieces, word, np.ones(len(word)))
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["piece", "n"])

    return words.select("word").mapInArrow(each, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n"))


def learn(words: DataFrame, model: bytes, prior: float = PRIOR, rare: int = RARE, rounds: int = ROUNDS) -> tuple[Pieces, float]:
    """The pieces with scores learnt from the training words (word, n), and the natural log probability of the end.

    The lattice serves words that the training texts lack or hardly have, so the rare ones of them teach, those seen `rare`
    times at most, each distinct word once. Starting from the vocabulary's own scores, each round sums the expected counts of
    the pieces over all segmentations; these and the own scores, with a weight of `prior` pieces, share the probability. No
    more than a number for each piece of the vocabulary comes to the driver.
    """
    pieces = load_pieces(model)
    own = np.exp(pieces.score)
    own /= own.sum()
    some = words.where((F.col("n") > 0) & (F.col("n") <= rare))
    for _ in range(rounds):
        weight = prior * own
        for r in piece_expectations(some, words.sparkSession.sparkContext.broadcast(pieces)).collect():
            weight[r.piece] += r.n
        total = weight.sum() + 1
        with np.errstate(divide="ignore"):
            pieces = replace(pieces, score=np.log(weight / total))
    return pieces, -math.log(weight.sum() + 1) if rounds else -math.log(prior + 1)


def scored_words(words: DataFrame, pieces, end: float, total: int, distinct: int) -> DataFrame:
    """word, n, logp: the log10 probability of each distinct word, over all paths of its lattice.

    Beside the paths of pieces, a word that the training texts have has one arc for the whole of it. The arcs of whole words
    weigh what they count, `total` in all, and the paths of pieces `distinct` tokens in all, as in Witten and Bell's estimate.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 20_000) for i in range(0, batch.num_rows, 20_000)):
                word = part.column(0).to_pylist()
                p = marginal(pieces.value, [b"" if w == END else MARK + w for w in word])
                p[[w == END for w in word]] = end
                if total:
                    with np.errstate(divide="ignore"):
                        p = np.logaddexp(np.log(part.column(1).to_numpy()), math.log(distinct) + p) - math.log(total + distinct)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(p / math.log(10))], names=["word", "n", "logp"])

    return words.mapInArrow(each, "word binary, n long, logp double")


def frequent(words: DataFrame, at_most: int, longest: int = 64) -> DataFrame:
    """The words of the most blocks, where that is more than one: `at_most` words of `longest` bytes at most, so they may be
    broadcast whatever the size of the corpus."""
    some = words.where((F.col("blocks") > 1) & (F.octet_length("word") <= longest)).orderBy(F.desc("blocks"), "word").limit(at_most)
    return some.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def lattice_scores(docs: DataFrame, model: bytes, train: Column, id_col: str = "doc_id", text_col: str = "text", block_mb: int = 8, hot_words: int = 1 << 16) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. train: a boolean Column.

    Tokens are the text's words, A-Z in lower case, then one end; runs of white space count as one, as in SentencePiece.
    score is the log10 probability that the model gives the words and the end, summed over all segmentations: a piece with a
    whitespace marker can only begin a word, so it is the product over the words. See scored_words for a word's lattice.
    base_score adds up log10((c + 0.5)/(N + 0.5(V + 1))) over the tokens.

    A null text is empty and scores as an end alone; a null `train` is false; repeated rows each count. An empty table gives
    no rows. Other columns are not looked at.

    The texts are dealt by hash into blocks of about block_mb MB. A block's distinct words are looked up in the corpus'
    words by a join, and come back to the block's texts by a cogroup: no task and not the driver holds all words. The hot_words
    words of the most blocks, which would have a row for each block in one key of that join, are broadcast instead.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = 1 + n_bytes // (block_mb << 20)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)))
    parts = min(n_blocks, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_blocks // 16))
    held = stored(block_words(rows.select("block", "text", "train").repartition(parts, "block")), "lm-block-words")
    words = stored(held.groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks")), "lm-words")
    n, v = words.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    pieces, end = learn(words.where("n > 0"), model)
    scores = lambda some: scored_words(some.select("word", "n"), spark.sparkContext.broadcast(pieces), end, n, v)
    hot = stored(scores(frequent(words, hot_words)), "lm-hot-words")
    stats = hot.toPandas()  # bounded, see frequent
    shared = spark.sparkContext.broadcast(({bytes(w): i for i, w in enumerate(stats.word)}, stats.n.to_numpy(np.int64), stats.logp.to_numpy(float)))
    others = lambda df: df.join(F.broadcast(hot.select("word")), "word", "left_anti")
    looked_up = others(held).select("block", "word").join(scores(others(words)), "word").select("block", "word", "n", "logp")
    floor = math.log10(n + 0.5 * (v + 1))

    schema = rows.select("doc_id").schema.add("held_out", "boolean").add("n_tokens", "long").add("n_known", "long").add("train_tokens", "long").add("base_score", "double").add("score", "double")

    def score(texts: pa.Table, stats: pa.Table) -> pa.Table:
        hot_at, hot_c, hot_logp = shared.value
        at = hot_at | {w: i for i, w in enumerate(stats.column("word").to_pylist(), len(hot_at))}
        c, logp = np.concatenate((hot_c, stats.column("n").to_numpy())), np.concatenate((hot_logp, stats.column("logp").to_numpy()))
        base, get = np.log10(c + 0.5) - floor, at.__getitem__
        n_tokens, n_known, sums = [], [], []
        for x in texts.column("text"):
            tokens = (x.as_py() or b"").lower().split()
            tokens.append(END)
            ids = np.fromiter(map(get, tokens), np.int64, len(tokens))
            n_tokens.append(len(ids))
            n_known.append(int((c[ids] > 0).sum()))
            sums.append((base[ids].sum(), logp[ids].sum()))
        many = len(n_tokens)
        return pa.table(
            [texts.column("doc_id"), pa.array([not x for x in texts.column("train").to_pylist()], pa.bool_()), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array([n] * many, pa.int64()), pa.array([a for a, _ in sums], pa.float64()), pa.array([b for _, b in sums], pa.float64())],
            names=schema.names,
        )

    return rows.groupBy("block").cogroup(looked_up.groupBy("block")).applyInArrow(score, schema)
