"""Token counts of a document's sections: whole texts are encoded once, and token spans joined to section spans."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("start", "end", "majority")

_encodings: dict[tuple[int, str], tuple[tiktoken.Encoding, np.ndarray]] = {}


def encoding(ranks: bytes, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The byte-level encoding of a ranks file, and how many bytes each token has; made once in a worker."""
    key = (hash(ranks), pattern)
    if key not in _encodings:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        size = np.zeros(max(table.values()) + 1, np.int64)
        for token, rank in table.items():
            size[rank] = len(token)
        _encodings[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}), size
    return _encodings[key]


def tokens(enc: tiktoken.Encoding, pattern: str, text: str) -> np.ndarray:
    """The ids of a text. The encoder's own matcher gives up on white space of a million characters in a row; then the same
    pattern cuts the text here, and only the words go to the encoder."""
    try:
        return enc.encode_to_numpy(text, disallowed_special=())
    except ValueError:
        ids = [i for word in regex.finditer(pattern, text) for i in enc._encode_single_piece(word.group())]
        return np.array(ids, np.uint32)


def lines(data: bytes) -> np.ndarray:
    """Byte offsets at which the lines begin; a line end belongs to the line before it. There is one line at least."""
    ends = np.nonzero(np.frombuffer(data, np.uint8) == 10)[0] + 1
    return np.concatenate(([0], ends[ends < len(data)]))


def attribute(ends: np.ndarray, starts: np.ndarray, total: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens each section gets, and how many of them cross its bounds.

    Tokens and sections both cover the text without gaps: token i reaches from the end of the one before it to ends[i],
    section j from starts[j] to the next start. A token in one section is its. One that crosses a bound goes, whole, to the
    section of its first byte ('start'), of its last ('end'), or to the one that holds most of it, the earlier of
    equals ('majority'). So the sections' counts always add up to the text's.
    """
    begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    first = np.searchsorted(starts, begins, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    owner = last.copy() if rule == "end" else first.copy()
    crossing = np.nonzero(first != last)[0]
    if rule == "majority":
        bounds = np.append(starts, total)
        for i in crossing.tolist():
            j = np.arange(first[i], last[i] + 1)
            held = np.minimum(bounds[j + 1], ends[i]) - np.maximum(bounds[j], begins[i])
            owner[i] = j[held.argmax()]
    n = len(starts)
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def section_tokens(docs: DataFrame, ranks: bytes, pattern: str, rule: str = "majority", id_col: str = "doc_id", text_col: str = "text", batch: int = 256) -> DataFrame:
    """A row for each line of each text: doc_id, section (from 0), char_start, char_end, n_tokens, n_crossing, doc_tokens.

    Offsets are in code points of the whole text, the end not included. A null or empty text has one section (0, 0) without
    tokens. Repeated rows each give their sections; an empty table gives none; other columns are not looked at. The
    vocabulary is broadcast: its size is that of the ranks file.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    schema = rows.select("doc_id").schema
    for name in ("section", "char_start", "char_end", "n_tokens", "n_crossing", "doc_tokens"):
        schema = schema.add(name, "long")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, size = encoding(shared.value, pattern)
        for whole in batches:
            for part in (whole.slice(i, batch) for i in range(0, whole.num_rows, batch)):
                cols: list[list[np.ndarray]] = [[] for _ in range(6)]
                of = []
                for i, text in enumerate(part.column(1).to_pylist()):
                    text = text or ""
                    data = text.encode("utf-8", "replace")
                    ends = np.cumsum(size[tokens(enc, pattern, text)]) if data else np.empty(0, np.int64)
                    starts = lines(data)
                    own, crossing = attribute(ends, starts, len(data), rule)
                    bounds = np.append(starts, len(data))
                    if not text.isascii():
                        lead = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
                        bounds = np.concatenate(([0], np.cumsum(lead)))[bounds]
                    n = len(starts)
                    of.append(np.full(n, i))
                    for col, x in zip(cols, (np.arange(n), bounds[:-1], bounds[1:], own, crossing, np.full(n, len(ends))), strict=True):
                        col.append(x)
                ids = part.column(0).take(pa.array(np.concatenate(of)))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.concatenate(c).astype(np.int64)) for c in cols)], names=schema.names)

    return rows.mapInArrow(each, schema)
