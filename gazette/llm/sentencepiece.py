"""SentencePiece encoding by unigram Viterbi over a double-array trie, and decoding of whitespace markers and byte pieces."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm.lattice import MARK, Pieces, best, load_pieces

#: No piece has a line end, a tab or a literal marker in it, so they bound segments; a segment is a run of spaces and what follows.
SEGMENT = re.compile("[\t\n▁]| *[^ \t\n▁]+| +")
FORCED = frozenset("\t\n▁")


class Codec:
    """Encodes and decodes texts. Segmentations never cross a segment's bounds, so those of segments, kept, make up that of
    the text. At most `keep` segments are kept; then the memory starts anew."""

    def __init__(self, pieces: Pieces, keep: int = 150_000):
        self.pieces, self.keep, self.known = pieces, keep, {}
        byte_ids = set(pieces.byte_id.tolist())
        self.surface = [x if i in byte_ids else x.replace(MARK, b" ") for i, x in enumerate(pieces.surface)]
        held = b"".join(p for i, p in enumerate(pieces.surface) if i not in byte_ids and np.isfinite(pieces.score[i]))
        if any(x in held for x in (b"\t", b"\n")):
            raise ValueError("a piece has a tab or line end in it")

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text. A space leads the text, as SentencePiece has it; an empty or null text has no ids."""
        cut = [SEGMENT.findall(" " + x) if x else [] for x in texts]
        new = list(set().union(*cut).difference(self.known))
        if len(self.known) + len(new) > self.keep:
            self.known = {}
            new = list(set().union(*cut))
        plain = [x for x in new if x not in FORCED]
        for x, ids in zip(plain, best(self.pieces, [x.replace(" ", "▁").encode("utf-8", "surrogatepass") for x in plain]), strict=True):
            self.known[x] = ids.tobytes()
        for x in FORCED.intersection(new):
            self.known[x] = self.pieces.byte_id[list(x.encode())].astype(np.int32).tobytes()
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, x)), np.int32) for x in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: markers become spaces, byte pieces bytes, and the leading space goes."""
        return b"".join(map(self.surface.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace")


_codecs: dict[int, Codec] = {}


def _codec(model: int, broadcast) -> Codec:
    """The worker's codec of a broadcast vocabulary; what it has kept serves the worker's later tasks too."""
    if model not in _codecs:
        _codecs.clear()
        _codecs[model] = Codec(broadcast.value)
    return _codecs[model]


def _share(spark: SparkSession, model: bytes):
    return zlib.crc32(model), spark.sparkContext.broadcast(load_pieces(model))


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.empty(0, np.int32)])))


def encode(docs: DataFrame, model: bytes, text_col: str = "text", ids_col: str = "ids", batch: int = 512, decodes_col: str | None = None) -> DataFrame:
    """docs with the ids of each text (array of int) in ids_col; a null text has an empty array. Rows and columns stay as they are.

    With decodes_col, the ids are decoded in the same pass, and that column says whether they give the text back (null counts as empty).
    docs must not have a column ids_col or decodes_col. The vocabulary is broadcast: its size is the model file's. An empty table gives none.
    """
    for name in (ids_col, decodes_col):
        if name in docs.columns:
            raise ValueError(f"the table already has a column {name}")
    (key, shared), at = _share(docs.sparkSession, model), docs.columns.index(text_col)
    schema = docs.withColumn(ids_col, F.array().cast("array<int>"))
    schema = (schema.withColumn(decodes_col, F.lit(True)) if decodes_col else schema).schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, shared)
        for whole in batches:
            for part in (whole.slice(i, batch) for i in range(0, whole.num_rows, batch)):
                texts = part.column(at).to_pylist()
                ids = codec.encode(texts)
                back = [pa.array([codec.decode(x) == (t or "") for x, t in zip(ids, texts, strict=True)], pa.bool_())] if decodes_col else []
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(ids), *back], names=schema.names)

    return docs.mapInArrow(each, schema)


def decode(rows: DataFrame, model: bytes, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """rows with the text of each row's ids in text_col; null ids decode to the empty text."""
    (key, shared), at = _share(rows.sparkSession, model), rows.columns.index(ids_col)
    schema = rows.withColumn(text_col, F.lit("").cast("string")).schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, shared)
        for part in batches:
            texts = [codec.decode(x.values.to_numpy()) if x.is_valid else "" for x in part.column(at)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(each, schema)


def round_trip(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", batch: int = 512) -> DataFrame:
    """Per row: doc_id, ids, n_pieces, n_byte_pieces, decodes (decoding gives the text back); encoded and decoded in one pass.

    A null text counts as the empty one, which has no ids. An empty table gives no rows; other columns are not looked at.
    """
    key, shared = _share(docs.sparkSession, model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = rows.select("doc_id", F.array().cast("array<int>").alias("ids"), F.lit(0).cast("long").alias("n_pieces"), F.lit(0).cast("long").alias("n_byte_pieces"), F.lit(True).alias("decodes")).schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, shared)
        is_byte = np.isin(np.arange(len(codec.surface)), codec.pieces.byte_id)
        for whole in batches:
            for part in (whole.slice(i, batch) for i in range(0, whole.num_rows, batch)):
                texts = part.column(1).to_pylist()
                ids = codec.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        _lists(ids),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([int(is_byte[x].sum()) for x in ids], pa.int64()),
                        pa.array([codec.decode(x) == (t or "") for x, t in zip(ids, texts, strict=True)], pa.bool_()),
                    ],
                    names=schema.names,
                )

    return rows.mapInArrow(each, schema)
