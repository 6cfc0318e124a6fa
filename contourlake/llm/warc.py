"""WARC archives with one Zstandard frame per record and the dictionary in a leading skippable frame.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds a dictionary trained on records of this very
archive; every record is one frame compressed with it, so any record can be read alone.  Equal payloads are stored once:
the record of the largest page id is the response, the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_table
from .common import pieces, stored

MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
DICTIONARY_BYTES = 32 << 10
SAMPLE_BYTES = 1 << 20
ARCHIVE_BYTES = 256 << 20
_BLOCK = 1 << 20


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """The bytes of one record, headers and block, before compression."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    name = "null" if page_id is None else str(page_id)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{name}')}>",
        f"WARC-Date: {date}",
    ]
    if url is not None:
        safe = "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
        lines.append(f"WARC-Target-URI: {safe}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest32(payload)}")
    if revisit:
        lines.append(f"WARC-Profile: {PROFILE}")
        lines.append(f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>")
        lines.append(f"X-Refers-To-Page: {refers_to}")
    lines += [f"X-Page: {name}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from records; where they are too few or too alike to train one, their own last bytes serve as one."""
    total = sum(map(len, samples))
    if not total:
        return None
    if len(samples) >= 8 and total >= 8 * 1024:
        try:
            return zstandard.train_dictionary(min(size, max(1024, total // 8)), samples, k=256, d=8)
        except zstandard.ZstdError:
            pass
    return zstandard.ZstdCompressionDict(b"".join(samples)[-min(size, max(64, total // 2)) :], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    """Buffers records up to ``sample_bytes`` to train the dictionary, then writes frame by frame."""

    def __init__(self, filesystem: pafs.FileSystem, path: str, sample_bytes: int = SAMPLE_BYTES):
        self.filesystem, self.path, self.sample_bytes = filesystem, path, sample_bytes
        self.waiting: list[bytes] = []
        self.held = self.raw = self.records = 0
        self.stream = self.compressor = None

    def add(self, record: bytes) -> None:
        self.records += 1
        self.raw += len(record)
        if self.compressor is not None:
            self.stream.write(self.compressor.compress(record))
            return
        self.waiting.append(record)
        self.held += len(record)
        if self.held >= self.sample_bytes:
            self._start()

    def _start(self) -> None:
        dictionary = train_dictionary([r[: 1 << 16] for r in self.waiting])
        body = dictionary.as_bytes() if dictionary else b""
        self.stream = self.filesystem.open_output_stream(self.path, compression=None)
        self.stream.write(struct.pack("<II", MAGIC, len(body)) + body)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
        for record in self.waiting:
            self.stream.write(self.compressor.compress(record))
        self.waiting = []

    def close(self) -> None:
        if self.compressor is None:
            self._start()
        self.stream.close()


def read_archive(filesystem: pafs.FileSystem, path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record, one frame in memory at a time."""
    with filesystem.open_input_stream(path, compression=None) as stream:
        magic, size = struct.unpack("<II", stream.read(8))
        if magic != MAGIC:
            raise ValueError(f"{path}: no leading dictionary frame")
        body = stream.read(size)
        decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body) if body else None)
        rest = b""
        while True:
            rest = rest or stream.read(_BLOCK)
            if not rest:
                return
            frame, parts = decompressor.decompressobj(), []
            while not frame.eof:
                if not rest and not (rest := stream.read(_BLOCK)):
                    raise ValueError(f"{path}: the last record is cut off")
                parts.append(frame.decompress(rest))
                rest = frame.unused_data if frame.eof else b""
            head, _, block = b"".join(parts).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            headers = dict(line.split(": ", 1) for line in lines[1:])
            yield headers, block[: int(headers["Content-Length"])]


def decide(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Distinct (page_id, digest, size) with ``main``: the largest page id that has the payload.

    Only digests are shuffled; counts are combined before the shuffle, and the join's hot side can be split.
    """
    keys = pages.groupBy("page_id", "digest", "size").agg(F.count(F.lit(1)).alias("copies")).drop("copies")
    best = keys.groupBy("digest", "size").agg(F.max("page_id").alias("main"))
    revisit = (F.col("size") >= min_bytes) & F.col("main").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("main"))
    return keys.join(best, ["digest", "size"]).select(
        "page_id", "digest", "size", F.when(revisit, F.col("main")).alias("refers_to")
    )


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 0,
    date: str = DATE,
    archive_bytes: int = ARCHIVE_BYTES,
    sample_bytes: int = SAMPLE_BYTES,
) -> DataFrame:
    """Write one record per row to archives under ``folder`` (a shared path); returns (uri, records, raw_bytes).

    Every task writes archives of its own names; the returned table is the list of complete ones, so what a lost
    attempt leaves behind is never read.  The table must be stored before it is used twice.
    """
    body = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
        F.sha1(body).alias("digest"),
        F.octet_length(body).cast("long").alias("size"),
    )
    plan = decide(rows.select("page_id", "digest", "size"), min_bytes)
    other = plan.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("size").alias("s"), "refers_to")
    on = F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s"))
    joined = rows.join(other, on).select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = pafs.FileSystem.from_uri(folder)
        filesystem.create_dir(root, recursive=True)
        writer, done = None, []

        def finish(w: ArchiveWriter) -> None:
            w.close()
            done.append((w.path, w.records, w.raw))

        for part in pieces(batches, "html", 8 << 20):
            columns = [part.column(n).to_pylist() for n in ("page_id", "url", "html", "refers_to")]
            for page_id, url, html, refers_to in zip(*columns):
                if writer is None:
                    writer = ArchiveWriter(filesystem, f"{root}/{uuid.uuid4().hex}.warc.zst", sample_bytes)
                writer.add(_record(page_id, url, html.encode(), refers_to, refers_to is not None, date))
                if writer.raw >= archive_bytes:
                    finish(writer)
                    writer = None
        if writer is not None:
            finish(writer)
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())],
                names=["path", "records", "raw_bytes"],
            )

    return joined.mapInArrow(run, "path string, records bigint, raw_bytes bigint")


_READ = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def read_archives(manifest: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """The records of the archives that ``manifest`` (path) lists.

    A response's size and digest are computed from its payload and must equal its header; a revisit's come from its
    headers (its payload is the one it refers to).  ``payload`` adds the response's payload (null for a revisit).
    """
    fields = [f for f in _READ if payload or f.name != "payload"]
    schema = pa.schema(fields)
    ddl = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"

    def rows(filesystem, path: str) -> Iterator[tuple]:
        for headers, block in read_archive(filesystem, path):
            head, _, body = block.partition(b"\r\n\r\n")
            page = headers["X-Page"]
            digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
            size = int(head.rpartition(b"Content-Length: ")[2])
            revisit = headers["WARC-Type"] == "revisit"
            if not revisit and (len(body) != size or digest32(body) != digest):
                raise ValueError(f"{path}: record of page {page} is damaged")
            refers = int(headers["X-Refers-To-Page"]) if revisit else None
            out = (None if page == "null" else int(page), headers.get("WARC-Target-URI"), size, digest, headers["WARC-Type"], refers)
            yield (*out, None if revisit else body) if payload else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                block, size = [], 0
                for row in rows(filesystem, path):
                    block.append(row)
                    size += row[2] if payload else 0
                    if len(block) == 2000 or size > _BLOCK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block), fields)], schema=schema)
                        block, size = [], 0
                if block:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block), fields)], schema=schema)

    return manifest.select("path").mapInArrow(run, ddl + (", payload binary" if payload else ""))


def archived(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back.

    Per row: page_id, url, payload_bytes, payload_digest (base32 SHA-1), record_type, refers_to.  A null html is an
    empty payload; a null url gives a record without target.  Rows that repeat the response's page id with the same
    payload are responses too; rows with a null id revisit a known id, and are responses if no id is known.  Other
    columns are ignored; an empty table gives no archive and no rows.
    """
    folder = scratch_table(pages.sparkSession, "warc")
    manifest = stored(write_archives(pages, folder, **options), "warc-manifest")
    return read_archives(manifest, folder)
