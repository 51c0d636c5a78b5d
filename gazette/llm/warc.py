"""WARC archives: written as one gzip stream a file, normalised to a gzip member a record with an offset index, read back."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import fresh, remove, stored

DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = 31


def digest(payload: bytes) -> str:
    """The SHA-1 in upper-case base32, without a prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record's bytes; line ends in header values become spaces."""
    lines = [f"WARC-Type: {kind}", *(f"{k}: {' '.join(v.split())}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response with the payload, or a revisit that has the HTTP header only and names the response it refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE)]
    headers += [("WARC-Target-URI", url)] if url else []
    headers += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if refers_to is None:
        return record("response", headers, http + payload)
    return record("revisit", [*headers, ("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:page:{refers_to}>")], http)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(headers["content-length"])
    if len(rest) < size:
        raise ValueError("a record is cut short")
    return headers, rest[:size]


def records(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a plain WARC stream; no more than a record and a block is held."""
    held = bytearray()
    size = None
    for block in blocks:
        held += block
        while True:
            if size is None:
                at = held.find(b"\r\n\r\n")
                if at < 0:
                    break
                head = bytes(held[:at]).lower()
                size = at + 4 + int(head.split(b"\r\ncontent-length:")[1].split(b"\r\n")[0]) + 4
            if len(held) < size:
                break
            yield bytes(held[:size])
            del held[:size]
            size = None
    if held:
        raise ValueError("the stream ends within a record")


def inflated(file, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The plain bytes of a gzip file, of one member or many, `chunk` of them at a time however well they were compressed."""
    z = zlib.decompressobj(GZIP)
    while data := file.read(chunk):
        while data:
            yield z.decompress(data, chunk)
            data = z.unconsumed_tail or z.unused_data
            if z.eof and data:
                z = zlib.decompressobj(GZIP)
    while not z.eof and (more := z.decompress(b"", chunk)):
        yield more
    if not z.eof:
        raise ValueError("the gzip stream is cut short")


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI that tasks can reach, and the path in it; a plain path is a shared mount."""
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri("file:///" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri)


def _put(folder: str, name: str, chunks: Iterator[bytes] | list[bytes]) -> str:
    """Write a file under a name that no other attempt has; the manifest that Spark commits says which attempt counts."""
    where, root = _open(folder)
    where.create_dir(root, recursive=True)
    with where.open_output_stream(f"{root}/{name}", compression=None) as out:
        for x in chunks:
            out.write(x)
    return f"{folder}/{name}"


def decide(rows: DataFrame, least: int) -> DataFrame:
    """rows (page_id, payload) with refers_to: of equal payloads of `least` bytes or more, the one with the largest id is the
    response and the others refer to it. Rows that repeat that id, or have none, are responses."""
    sha = F.sha2("payload", 256)
    groups = rows.where(F.length("payload") >= least).groupBy(sha.alias("of")).agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n"))
    joined = rows.join(stored(groups.where("n > 1").select("of", "top"), "warc-groups"), (sha == F.col("of")) & (F.length("payload") >= least), "left")
    return joined.withColumn("refers_to", F.when(F.col("page_id") < F.col("top"), F.col("top"))).drop("of", "top")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, archive_mb: int = 32, level: int = 1) -> DataFrame:
    """Write a record for each row, in archives that are each one gzip stream. The manifest: path, n_records.

    A null html is the empty payload, a null url has no target header, a null id an empty one. Ids must be integers.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit("").cast("binary")).alias("payload"))
    rows = decide(rows, least).select("page_id", "url", "payload", "refers_to")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple[str, int]] = []
        state: dict = {"chunks": None}

        def begin() -> None:
            state.update(z=zlib.compressobj(level, zlib.DEFLATED, GZIP), chunks=[], n=0, size=0)
            info = record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"software: gazette\r\nformat: WARC File Format 1.1\r\n")
            state["chunks"].append(state["z"].compress(info))

        def end() -> None:
            if state["chunks"] is not None:
                made.append((_put(folder, f"{uuid.uuid4().hex}.warc.gz", [*state["chunks"], state["z"].flush()]), state["n"]))
                state["chunks"] = None

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() if i != 2 else c for i, c in enumerate(batch.columns)), strict=True):
                if state["chunks"] is None:
                    begin()
                data = page_record(page_id, url, payload.as_py(), refers_to)
                state["chunks"].append(state["z"].compress(data))
                state["n"], state["size"] = state["n"] + 1, state["size"] + len(data)
                if state["size"] >= archive_mb << 20:
                    end()
        end()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in made], pa.string()), pa.array([n for _, n in made], pa.int64())], names=["path", "n_records"])

    return stored(rows.mapInArrow(each, "path string, n_records long"), "warc-manifest")


def normalise(archives: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Rewrite each archive (path) with a gzip member a record, and a sidecar index of them. The manifest: path, index, n_records.

    An archive is inflated once, as a stream: a task holds one record. The sidecar has a JSON line a record: offset and
    length of its member, type and id.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str, int]] = []
            for path in batch.column(0).to_pylist():
                name = uuid.uuid4().hex
                index: list[bytes] = []

                def members(path: str = path, index: list[bytes] = index) -> Iterator[bytes]:
                    where, at = _open(path)
                    offset = 0
                    with where.open_input_stream(at, compression=None) as file:
                        for data in records(inflated(file)):
                            z = zlib.compressobj(level, zlib.DEFLATED, GZIP)
                            member = z.compress(data) + z.flush()
                            headers, _ = parse(data)
                            index.append(json.dumps({"offset": offset, "length": len(member), "type": headers["warc-type"], "id": headers["warc-record-id"]}).encode() + b"\n")
                            offset += len(member)
                            yield member

                written = _put(folder, f"{name}.warc.gz", members())
                out.append((written, _put(folder, f"{name}.index.jsonl", index), len(index)))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["path", "index", "n_records"])

    spread = archives.select("path").repartition(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return stored(spread.mapInArrow(each, "path string, index string, n_records long"), "warc-normalised")


def read_archives(normalised: DataFrame) -> DataFrame:
    """The page records of normalised archives, each read on its own by its offset: page_id, payload_bytes, payload_digest,
    record_type, refers_to. A response's digest is that of the payload read, and must be the one its header names."""

    def number(urn: str | None) -> int | None:
        text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                where, at = _open(index)
                with where.open_input_stream(at, compression=None) as file:
                    entries = [json.loads(x) for x in file.read().splitlines()]
                where, at = _open(path)
                rows: list[tuple] = []
                with where.open_input_file(at) as file:
                    for e in entries:
                        if e["type"] not in ("response", "revisit"):
                            continue
                        file.seek(e["offset"])
                        headers, block = parse(zlib.decompress(file.read(e["length"]), GZIP))
                        http, _, payload = block.partition(b"\r\n\r\n")
                        named = headers["warc-payload-digest"].removeprefix("sha1:")
                        size = int(http.lower().split(b"\r\ncontent-length: ")[1].split(b"\r\n")[0])
                        if e["type"] == "response" and (len(payload) != size or digest(payload) != named):
                            raise ValueError(f"{path}: the payload of {headers['warc-record-id']} isn't what its header says")
                        rows.append((number(headers["warc-record-id"]), size, named, e["type"], number(headers.get("warc-refers-to"))))
                cols = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    spread = normalised.select("path", "index").repartition(int(normalised.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return spread.mapInArrow(each, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame, least: int = 0, **how) -> DataFrame:
    """Write, normalise and read back: the rows of read_archives, one for each row of pages. An empty table gives none."""
    spark = pages.sparkSession
    raw = fresh(spark, "warc")
    done = normalise(write_archives(pages, raw, least=least, **how), fresh(spark, "warc-members"))
    if not done.isEmpty():
        remove(spark, raw)
    return read_archives(done)
