"""WARC records in seekable Zstandard bundles: independent frames, a footer seek table, an index."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.storage import open_seekable, publish
from starloom.plans.session import fresh_path, stage_table
from starloom.plans.sizing import lookup_join

FRAME_BYTES = 1 << 20
READ_BYTES = 16 << 20
BUNDLE_BYTES = 256 << 20
# Fixed values of the seekable format.
_SKIPPABLE = 0x184D2A5E
_SEEKABLE = 0x8F92EAB1
_DATE = "2020-01-01T00:00:00Z"
_INDEX = "page_id long, bundle string, frame int, offset long, length long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """A WARC/1.1 response record, or a revisit record without the payload that names the record it repeats."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    uri = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id} {uri}')}>", f"WARC-Date: {_DATE}",
             f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record; the block must have the stated length."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    size = int(fields["Content-Length"])
    if version != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    return fields, rest[:size]


class BundleWriter:
    """Collects records into frames and frames into a bundle."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.limit, self.packer = frame_bytes, zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.frames, self.sizes, self.pending, self.fill, self.size = [], [], [], 0, 0

    def add(self, data: bytes) -> tuple[int, int]:
        """The record's frame and its place inside that frame."""
        place = len(self.sizes), self.fill
        self.pending.append(data)
        self.fill += len(data)
        if self.fill >= self.limit:
            self._close_frame()
        return place

    def _close_frame(self) -> None:
        if self.pending:
            self.frames.append(self.packer.compress(b"".join(self.pending)))
            self.sizes.append((len(self.frames[-1]), self.fill))
            self.size += len(self.frames[-1])
            self.pending, self.fill = [], 0

    def write(self, stream: BinaryIO) -> None:
        """All frames, then the seek table in a skippable frame."""
        self._close_frame()
        for frame in self.frames:
            stream.write(frame)
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, _SEEKABLE)
        stream.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)


class BundleReader:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, stream: BinaryIO):
        self.stream = stream
        end = stream.seek(0, 2)
        stream.seek(end - 9)
        count, flags, magic = struct.unpack("<IBI", stream.read(9))
        if magic != _SEEKABLE or flags & 0x7F:
            raise ValueError("not a seekable bundle")
        step = 12 if flags & 0x80 else 8
        stream.seek(end - 9 - count * step)
        table = stream.read(count * step)
        self.places, at = [], 0
        for k in range(count):
            packed, size = struct.unpack_from("<II", table, k * step)
            self.places.append((at, packed, size))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, size = self.places[number]
        self.stream.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.stream.read(packed), max_output_size=size)


def _write_bundles(folder: str, frame_bytes: int, bundle_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, rows = BundleWriter(frame_bytes), []

        def close() -> pa.RecordBatch:
            path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
            publish(path, writer.write)
            ids, frames, offsets, lengths = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([path] * len(rows)), pa.array(frames, pa.int32()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                                              names=["page_id", "bundle", "frame", "offset", "length"])

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                data = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to)
                rows.append((page_id, *writer.add(data), len(data)))
                if writer.size >= bundle_bytes:
                    yield close()
                    writer, rows = BundleWriter(frame_bytes), []
        if rows:
            yield close()

    return run


def write_archives(pages: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, min_revisit_bytes: int = 0) -> DataFrame:
    """Write a record for every page into bundles below ``folder``; the index (page_id, bundle, frame, offset, length).

    Of pages with equal payloads of at least ``min_revisit_bytes`` bytes that with the largest
    page_id becomes a response and the others revisits of it; rows that repeat that page_id are all
    responses, as is every row with a null page_id. Payloads are compared by SHA-1 and length. Only
    digests that occur twice are looked up, so pages cross no shuffle where these fit a broadcast.

    A bundle has a new name in every attempt of a task; bundles that the index does not name belong
    to lost attempts and are never read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.when(F.col("page_id").isNotNull(), F.sha1(F.encode("html", "UTF-8"))), "size": F.octet_length("html")})
    twice = (rows.where((F.col("size") >= min_revisit_bytes) & F.col("digest").isNotNull()).groupBy("digest", "size")
             .agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", "size", "last"))
    placed = lookup_join(rows, twice, ["digest", "size"], "left").select("page_id", "url", "html", F.when(F.col("last") != F.col("page_id"), F.col("last")).alias("refers_to"))
    return stage_table(placed.mapInArrow(_write_bundles(folder, frame_bytes, bundle_bytes), _INDEX), "warc-index")


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _read_records(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = stream = reader = number = frame = None
        for batch in batches:
            out = []
            for path, at, offset, length in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "offset", "length"))):
                if path != bundle:
                    if stream is not None:
                        stream.close()
                    stream = open_seekable(path)
                    bundle, reader, number = path, BundleReader(stream), None
                if at != number:
                    number, frame = at, reader.frame(at)
                fields, block = parse(frame[offset:offset + length])
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if fields["WARC-Type"] == "response" and (base32_sha1(block) != digest or len(block) != int(fields["X-Payload-Length"])):
                    raise ValueError("a payload differs from its digest")
                out.append((int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None, fields["WARC-Target-URI"], int(fields["X-Payload-Length"]), digest, fields["WARC-Type"],
                            int(fields["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in fields else None, block if with_payload else None))
            columns = list(zip(*out)) or [()] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in _READ.split(", ")])

    return run


def read_archives(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that ``index`` names, each frame decompressed on its own; payloads are checked against their digests.

    Frames are dealt out by bundle and frame and read in order, so a frame is opened once. The number
    of tasks follows the bytes of the records, not those of the index.
    """
    tasks = -(-(index.agg(F.sum("length")).first()[0] or 1) // READ_BYTES)
    dealt = index.repartition(tasks, "bundle", F.floor(F.col("frame") / 16)).sortWithinPartitions("bundle", "frame", "offset")
    return dealt.mapInArrow(_read_records(with_payload), _READ)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write all pages and read the archives back; one row per page.

    A null html is an empty payload, a null url an empty target; non-ASCII characters of a url are
    percent-encoded. Repeated rows give a record each. An empty table writes nothing and gives no rows.
    """
    index = write_archives(pages, fresh_path(pages.sparkSession, "warc"), **options)
    return read_archives(index, with_payload=False).drop("payload")
