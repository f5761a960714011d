"""WARC archives in Zstandard: a dictionary in the leading skippable frame, and one frame for each record.

Writing: every page becomes a record of its own. Of pages with equal payloads the one with the largest page_id is the
response, and the others are revisits that name it, without a payload of their own. A task frames its pages as
responses, so that only compressed records are shuffled to find each digest's response; each task then writes whole
archives into a folder that all machines share, under a temporary name first, so that a repeated task leaves one.
The dictionary is trained on a bounded sample of pages (``SAMPLE_PAGES`` of at most ``SAMPLE_BYTES`` each).

Reading: Spark hands each archive's path to a task, which loads the dictionary from the skippable frame, decodes frame
after frame from bounded pieces of the file, and checks each: magic numbers, the version line, the named headers,
Content-Length against the bytes that follow, the record's end, and a response's payload length and digest. The
records of all archives are then joined by digest, so that every revisit is held against the response that it names.
A broken archive, or a revisit without its response, is an error that says where.

Defined results: null html is an empty payload; equal rows are records of their own, of which one (the first row
among those with the largest page_id) is the response; null page_ids come before all others; an empty table writes
no archive and reads back no record; a long payload is one record, the only thing that a task holds whole; columns
other than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import encoded, materialise, slices

#: The sample that a dictionary is trained on, and the dictionary's size.
SAMPLE_PAGES = 200
SAMPLE_BYTES = 16 << 10
DICTIONARY_BYTES = 32 << 10
#: Payload bytes with which an archive is full, and bytes that a reader takes from it at a time.
ARCHIVE_BYTES = 64 << 20
PIECE_BYTES = 32 << 10

# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# -------------------------------------------------------------------- records


def record_bytes(page_id: int | None, url: str | None, payload: bytes, length: int, digest: str, refers_to: int | None | bool) -> bytes:
    """A WARC record. ``refers_to`` is False for a response, else the page_id (or null) that a revisit refers to."""
    name = lambda i: "none" if i is None else str(i)
    head = [
        ("WARC-Type", "response" if refers_to is False else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{name(page_id)}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", quote(url or "", safe=":/?#[]@!$&'()*+,;=%-._~")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Payload-Length", str(length)),
    ]
    if refers_to is not False:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{name(refers_to)}>")]
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    return b"".join([VERSION, b"\r\n", *(f"{k}: {v}\r\n".encode() for k, v in head), b"\r\n", payload, b"\r\n\r\n"])


def parse_record(data: bytes, where: str) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one whole record."""

    def must(ok: bool, what: str) -> None:
        if not ok:
            raise ValueError(f"{where}: {what}")

    end = data.find(b"\r\n\r\n")
    must(end >= 0, "the headers have no end")
    first, *lines = data[:end].split(b"\r\n")
    must(first == VERSION, f"the version line is {first[:20]!r}")
    headers: dict[str, str] = {}
    for line in lines:
        k, colon, v = line.decode().partition(":")
        must(bool(colon) and k == k.strip() and k.lower() not in headers, f"a header is malformed or there twice: {line[:60]!r}")
        headers[k.lower()] = v.strip()
    for k in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        must(k in headers, f"{k} is missing")
    must(headers["content-length"].isdigit(), "Content-Length is no number")
    size = int(headers["content-length"])
    block = data[end + 4 : end + 4 + size]
    must(len(block) == size and data[end + 4 + size :] == b"\r\n\r\n", f"Content-Length is {size}, and {len(data) - end - 8} bytes are there")
    if headers["warc-type"] == "response":
        must(headers.get("warc-payload-length") == str(size), "the payload's length differs")
        must(headers.get("warc-payload-digest") == f"sha1:{payload_digest(block)}", "the payload's digest differs")
    else:
        must(headers["warc-type"] == "revisit" and "warc-refers-to" in headers and size == 0, "neither a response nor a revisit")
        must(headers.get("warc-payload-length", "").isdigit() and headers.get("warc-payload-digest", "").startswith("sha1:"), "a revisit without its payload's length or digest")
    return headers, block


# -------------------------------------------------------------------- archives


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample by hash of page_id; a fixed text where there is too little to learn from."""
    few = min(1.0, 8.0 * SAMPLE_PAGES / max(1, pages.count()))  # so that no task sends many
    drawn = F.shiftrightunsigned(F.xxhash64(pages["page_id"], F.lit(7)), 11) / F.lit(float(1 << 53)) <= few
    sample = pages.where(drawn).select(F.substring(pages["html"], 1, SAMPLE_BYTES).alias("html"), F.xxhash64(pages["page_id"]).alias("h")).where("html is not null")
    rows = [r.html.encode() for r in sample.orderBy("h", "html").limit(SAMPLE_PAGES).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, rows).as_bytes()
    except zstandard.ZstdError:
        return b"<!DOCTYPE html><html><head><title></title></head><body></body></html>"


def archive_head(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE_MAGIC, len(dictionary)) + dictionary


class Feed:
    """A file in bounded pieces; what a frame leaves of a piece is handed back."""

    def __init__(self, file):
        self.file, self.held, self.at = file, b"", 0

    def some(self) -> bytes:
        data = self.held or self.file.read(PIECE_BYTES)
        self.held = b""
        self.at += len(data)
        return data

    def back(self, data: bytes) -> None:
        self.at -= len(data)
        self.held = data

    def exactly(self, n: int) -> bytes:
        """n bytes, or what is left of the file."""
        parts, size = [], 0
        while size < n and (data := self.some()):
            parts.append(data)
            size += len(data)
        data = b"".join(parts)
        self.back(data[n:])
        return data[:n]


def read_archive(archive, where: str = "archive") -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a whole archive (bytes, or an open file), each from a frame of its own, in time that grows with its size."""
    feed = Feed(io.BytesIO(archive) if isinstance(archive, bytes) else archive)
    head = feed.exactly(8)
    if len(head) < 8 or struct.unpack_from("<I", head)[0] != SKIPPABLE_MAGIC:
        raise ValueError(f"{where}: it does not begin with a dictionary's skippable frame")
    size = struct.unpack_from("<I", head, 4)[0]
    dictionary = feed.exactly(size)
    if len(dictionary) < size:
        raise ValueError(f"{where}: the dictionary is cut short")
    if dictionary[:4] == FRAME_MAGIC:  # it may itself be compressed
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    while True:
        place = f"{where}, byte {feed.at}"
        magic = feed.exactly(4)
        if not magic:
            return
        if magic != FRAME_MAGIC:
            raise ValueError(f"{place}: no frame begins here")
        frame, parts = decoder.decompressobj(), []
        data = magic
        while data:
            try:
                parts.append(frame.decompress(data))
            except zstandard.ZstdError as e:
                raise ValueError(f"{place}: {e}") from e
            if frame.eof:
                break
            data = feed.some()
        if not frame.eof:
            raise ValueError(f"{place}: the frame is cut short")
        feed.back(frame.unused_data)
        yield parse_record(b"".join(parts), place)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives below ``folder``; gives (path, records), written."""
    spark = pages.sparkSession
    dictionary = spark.sparkContext.broadcast(train_dictionary(pages))
    rows = pages.select(pages["page_id"], pages["url"], pages["html"])

    def frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary.value))
        part, number = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "html"):
            ids, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            payloads = [p or b"" for p in encoded(batch.column(2))]
            digests = [payload_digest(p) for p in payloads]
            frames = [squeeze.compress(record_bytes(i, u, p, len(p), d, False)) for i, u, p, d in zip(ids, urls, payloads, digests, strict=True)]
            place = (part << 33) + number + np.arange(len(ids))
            number += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(place), batch.column(0), batch.column(1), pa.array([len(p) for p in payloads], pa.int64()), pa.array(digests), pa.array(frames, pa.binary())], ["place", "page_id", "url", "size", "digest", "frame"])

    framed = materialise(rows.mapInArrow(frame, "place long, page_id long, url string, size long, digest string, frame binary"), "frames")
    best = framed.groupBy("digest").agg(F.max(F.struct(F.col("page_id").isNotNull(), "page_id", -F.col("place"))).alias("b"))
    first = best.select("digest", F.col("b.page_id").alias("of"), (-F.col("b.col3")).alias("at"))
    chosen = framed.join(first, "digest").withColumn("own", F.col("place") == F.col("at"))
    chosen = chosen.select("place", "page_id", "url", "size", "digest", F.when(F.col("own"), F.col("frame")).alias("frame"), "of")
    chosen = chosen.sortWithinPartitions("place")  # a task that runs again writes the same archives

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary.value))
        part, number, held, size, records = TaskContext.get().partitionId(), 0, [], 0, 0

        def close() -> pa.RecordBatch:
            path = f"{folder}/part-{part:05d}-{number:05d}.warc.zst"
            _put(path, b"".join([archive_head(dictionary.value), *held]))
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64())], ["path", "records"])

        for batch in batches:
            for r in batch.to_pylist():
                data = r["frame"] if r["frame"] is not None else squeeze.compress(record_bytes(r["page_id"], r["url"], b"", r["size"], r["digest"], r["of"]))
                held.append(data)
                size, records = size + len(data), records + 1
                if size >= ARCHIVE_BYTES:
                    yield close()
                    number, held, size, records = number + 1, [], 0, 0
        if held:
            yield close()

    return materialise(chosen.mapInArrow(write, "path string, records long"), "archives")


def _placed(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system that a path names, and the path on it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _put(path: str, data: bytes) -> None:
    """A file appears whole or not at all, whichever try of a task writes it."""
    system, name = _placed(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    draft = f"{name}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(draft, compression=None) as out:
        out.write(data)
    system.move(draft, name)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the archives in ``folder``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path")  # names only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda urn: None if urn == "<urn:page:none>" else int(urn.removeprefix("<urn:page:").removesuffix(">"))
        for path in (p for batch in batches for p in batch.column(0).to_pylist()):
            rows = []
            system, name = _placed(path)
            with system.open_input_stream(name, compression=None) as file:
                for h, _ in read_archive(file, path):
                    refers = number(h["warc-refers-to"]) if h["warc-type"] == "revisit" else None
                    rows.append((number(h["warc-record-id"]), int(h["warc-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], refers))
                    if len(rows) == 10_000:
                        yield _records(rows)
                        rows = []
            yield _records(rows)

    records = materialise(files.mapInArrow(run, _RECORD), "records")  # without payloads
    held = records.where("record_type = 'response'").groupBy("payload_digest").agg(F.max(F.struct("page_id", "payload_bytes")).alias("_r"), F.count("*").alias("_n"))
    met = records.join(held, "payload_digest", "left")
    right = (F.col("_n") == 1) & F.col("refers_to").eqNullSafe(F.col("_r.page_id")) & (F.col("payload_bytes") == F.col("_r.payload_bytes"))
    wrong = (F.col("record_type") == "revisit") & ~F.coalesce(right, F.lit(False))
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("no response of this digest, length and name for the revisit of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("none"))))).otherwise(F.col("record_type"))
    return met.select("page_id", "payload_bytes", "payload_digest", checked.cast("string").alias("record_type"), "refers_to")


def _records(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()], strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
