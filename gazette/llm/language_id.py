"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.llm.common import within

#: Positions in a window; every byte of a text is in exactly one, and a state starts anew with it.
WINDOW = 128
#: Stands for a position behind the text's end: its gate keeps the state as it is.
PAD = 256


@dataclass
class Model:
    """Of each direction, forward first: table (2H x 257) of what a byte adds to gate and candidate, and recurrent (2H x H)."""

    langs: list[str]
    table: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: np.ndarray  # languages x 2H
    bias: np.ndarray


def _pads(table: np.ndarray) -> None:
    h = len(table) // 2
    table[:h, PAD], table[h:, PAD] = 30, 0


def _states(table: np.ndarray, recurrent: np.ndarray, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (L x H x B) after each of the bytes x (L x B). z is the gate, c the candidate: h = z h + (1 - z) c."""
    n, b = x.shape
    h2 = len(table)
    h = h2 // 2
    half = table.copy()
    half[:h] *= 0.5
    rec = recurrent.copy()
    rec[:h] *= 0.5  # a sigmoid is half a tanh of the half
    out = np.empty((n, h, b), table.dtype)
    a, m, state = np.empty((h2, b), table.dtype), np.empty((h2, b), table.dtype), np.zeros((h, b), table.dtype)
    for t in range(n):
        np.take(half, x[t], axis=1, out=a, mode="clip")
        np.matmul(rec, state, out=m)
        a += m
        np.tanh(a, out=a)
        z, c = a[:h], a[h:]
        z *= 0.5
        z += 0.5
        if keep is not None:
            keep.append((z.copy(), c.copy(), state.copy()))
        np.subtract(state, c, out=state)
        state *= z
        state += c
        out[t] = state
    return out


def _back(recurrent: np.ndarray, x: np.ndarray, kept: list, d_out: np.ndarray, d_table: np.ndarray, d_rec: np.ndarray) -> None:
    """Backpropagation through time: adds to d_table and d_rec, given the loss' gradient by the states."""
    h = len(recurrent) // 2
    d_next = np.zeros_like(d_out[0])
    for t in range(len(x) - 1, -1, -1):
        z, c, before = kept[t]
        d = d_out[t] + d_next
        da = np.concatenate((d * (before - c) * z * (1 - z), d * (1 - z) * (1 - c * c)))
        d_rec += da @ before.T
        np.add.at(d_table.T, x[t], da.T)
        d_next = d * z + recurrent.T @ da
    assert d_next.shape[0] == h


def _windows(texts: list[bytes], wide: int = WINDOW, at_once: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes (L x B, padded) of the texts' windows, and of each its text and how many bytes it has: at_once windows at a time,
    so that however long a text is, no more of them is laid out."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    count = -(-size // wide)
    begins = np.cumsum(count) - count
    first = np.cumsum(size) - size
    data = np.frombuffer(b"".join(texts) + bytes(wide), np.uint8)
    total = int(count.sum())
    for at in range(0, total, at_once):
        window = np.arange(at, min(at + at_once, total))
        of = np.searchsorted(begins + count, window, "right")
        done = (window - begins[of]) * wide
        start, held = first[of] + done, np.minimum(wide, size[of] - done)
        x = data[start[None, :] + np.arange(wide)[:, None]].astype(np.int64)
        x[np.arange(wide)[:, None] >= held[None, :]] = PAD
        yield x, of, held


def _position_probabilities(model: Model, x: np.ndarray, keep: tuple[list, list] | None = None):
    """Probability of each language (C x L x B) at each position, and the states of both directions."""
    f = _states(model.table[0], model.recurrent[0], x, keep and keep[0])
    b = _states(model.table[1], model.recurrent[1], x[::-1], keep and keep[1])[::-1]
    h = f.shape[1]
    logit = np.empty((len(model.langs), *x.shape), f.dtype)
    for t in range(len(x)):
        np.matmul(model.out[:, :h], f[t], out=logit[:, t])
        logit[:, t] += model.out[:, h:] @ b[t]
    np.clip(logit, -40, 40, out=logit)  # states are within (-1, 1): logits are small as they are
    np.exp(logit, out=logit)
    logit *= np.exp(model.bias)[:, None, None]
    logit /= logit.sum(axis=0)
    return logit, f, b


def train(samples: list[tuple[bytes, str]], hidden: int = 4, epochs: int = 8, batch: int = 64, rate: float = 0.02, seed: int = 7) -> Model:
    """Fit the network by Adam on the cross-entropy of every position's label, its text's language.

    samples: stretches of text, cut to one window each. Without samples there are no languages.
    """
    langs = sorted({lang for _, lang in samples})
    rng = np.random.default_rng(seed)
    normal = lambda *s: (rng.normal(size=s) * 0.3).astype(np.float64)
    p = {f"{k}{i}": normal(*s) for i in range(2) for k, s in (("table", (2 * hidden, 257)), ("rec", (2 * hidden, hidden)))}
    p |= {"out": normal(len(langs), 2 * hidden), "bias": np.zeros(len(langs))}
    if langs:
        parts = [*_windows([s[:WINDOW] or b" " for s, _ in samples])]
        x, held = np.concatenate([p[0] for p in parts], axis=1), np.concatenate([p[2] for p in parts])
        y = np.array([langs.index(lang) for _, lang in samples])
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    model = lambda kind: Model(langs, [p["table0"].astype(kind), p["table1"].astype(kind)], [p["rec0"].astype(kind), p["rec1"].astype(kind)], p["out"].astype(kind), p["bias"].astype(kind))
    for epoch in range(epochs if len(langs) > 1 else 0):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            xs, real = x[:, pick], np.arange(WINDOW)[:, None] < held[pick][None, :]
            _pads(p["table0"]), _pads(p["table1"])
            kept: tuple[list, list] = ([], [])
            prob, f, b = _position_probabilities(model(np.float64), xs, kept)
            prob[y[pick], :, np.arange(len(pick))] -= 1
            d = prob * (real / real.sum())
            g = {k: np.zeros_like(v) for k, v in p.items()}
            both = np.concatenate((f, b), axis=1)
            g["out"], g["bias"] = np.einsum("clb,lhb->ch", d, both), d.sum(axis=(1, 2))
            d_states = np.einsum("ch,clb->lhb", p["out"], d)
            _back(p["rec0"], xs, kept[0], d_states[:, :hidden], g["table0"], g["rec0"])
            _back(p["rec1"], xs[::-1], kept[1], d_states[::-1, hidden:], g["table1"], g["rec1"])
            step += 1
            for k in p:
                m1[k], m2[k] = 0.9 * m1[k] + 0.1 * g[k], 0.99 * m2[k] + 0.01 * g[k] ** 2
                p[k] -= rate / (1 + epoch / 3) * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    _pads(p["table0"]), _pads(p["table1"])
    return model(np.float32)


def document_probabilities(model: Model, texts: list[bytes]) -> np.ndarray:
    """Mean over a text's positions of each language's probability there (texts x languages); zeros for an empty text."""
    pooled = np.zeros((len(texts), len(model.langs)))
    for x, of, held in _windows(texts):
        prob, _, _ = _position_probabilities(model, x)
        prob *= np.arange(WINDOW)[:, None] < held[None, :]
        np.add.at(pooled, of, prob.sum(axis=1).T)
    return pooled / np.maximum(1, np.fromiter(map(len, texts), np.int64, len(texts)))[:, None]


def position_spans(model: Model, text: str) -> list[tuple[int, int, str]]:
    """Runs (start, end, language) of byte positions that have the same likeliest language."""
    found: list[np.ndarray] = [np.empty(0, int)]
    for x, _, held in _windows([text.encode("utf-8", "replace")]):
        best = _position_probabilities(model, x)[0].argmax(axis=0)
        found += [best[:n, i] for i, n in enumerate(held)]
    label = np.concatenate(found)
    cuts = [0, *(np.nonzero(np.diff(label))[0] + 1).tolist(), len(label)] if len(label) else []
    return [(a, b, model.langs[label[a]]) for a, b in zip(cuts, cuts[1:], strict=False)]


def training_windows(docs: DataFrame, may_learn: Column, at_most: int = 4000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[bytes, str]]:
    """A bounded sample to learn from: of at most `at_most` rows, one window at a hashed place of the text. Only text and
    language of rows that may_learn holds for, with neither null, are used.

    The languages share the sample evenly, as far as they have rows, so that one of few rows is learnt as well as the commonest;
    of each, the rows with the least hashes of their ids count. There may be more rows than `at_most` where there are more
    languages: each gives one.
    """
    rows = docs.where(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = rows.select(F.xxhash64(F.col(id_col).cast("string"), F.lit("window")).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a language
    left, quotas = at_most, []
    for i, r in enumerate(sorted(counts, key=lambda r: (r.n, r.lang))):
        quota = min(r.n, max(1, left // (len(counts) - i)))
        left -= quota
        quotas.append((r.lang, quota, min(1.0, (1.5 * quota + 20) / r.n)))
    if not quotas:
        return []
    wanted = docs.sparkSession.createDataFrame(quotas, "lang string, quota int, share double")
    wanted = F.broadcast(wanted) if len(quotas) <= 100_000 else wanted
    place = F.pmod(F.xxhash64(F.lit("place"), F.col("key")), F.greatest(F.char_length("text") - WINDOW // 2, F.lit(1))).cast("int") + 1
    likely = rows.join(wanted, "lang").where(within(F.col("key"), F.col("share")))  # no task sorts many more than are taken
    drawn = likely.select("lang", "key", "quota", F.substring(F.col("text"), place, F.lit(WINDOW)).alias("part"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("key", "part"))
    taken = drawn.withColumn("nth", nth).where("nth <= quota").orderBy("key", "lang", "part")
    return [(r.part.encode(), r.lang) for r in taken.select("key", "lang", "part").collect()]


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", batch: int = 2000) -> DataFrame:
    """doc_id, lang_pred, score of every row, over its whole text: the likeliest language and its pooled probability.

    `und` with score 0 if the text is null or has no letter, or if there was nothing to learn from. A tie goes to the
    language first by code point. Repeated rows are each predicted; other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = rows.select("doc_id", F.lit("").cast("string").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Model = shared.value
        for whole in batches:
            for part in (whole.slice(i, batch) for i in range(0, whole.num_rows, batch)):
                texts = part.column(1).to_pylist()
                said = [bool(net.langs) and any(map(str.isalpha, x or "")) for x in texts]
                prob = document_probabilities(net, [x.encode("utf-8", "replace") if s else b"" for x, s in zip(texts, said, strict=True)])
                top = prob.argmax(axis=1) if net.langs else np.zeros(len(texts), int)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([net.langs[k] if s else "und" for k, s in zip(top, said, strict=True)], pa.string()),
                        pa.array([min(1.0, float(prob[i, k])) if s else 0.0 for i, (k, s) in enumerate(zip(top, said, strict=True))], pa.float64()),
                    ],
                    names=schema.names,
                )

    return rows.mapInArrow(each, schema)
