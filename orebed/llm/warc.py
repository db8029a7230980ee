"""WARC archives in seekable Zstandard bundles: independent frames, a seek table at the end, and an index of records."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, ship, stored, text_of

#: Fixed values of the Zstandard seekable format and of WARC 1.1.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:orebed:page:"

INDEX = "page_id bigint, bundle string, frame int, offset bigint, length bigint"


class BadArchive(ValueError):
    """A bundle or record that is cut or altered."""


class BundleWriter:
    """Collects records into frames of about frame_bytes and closes them with a seek table."""

    def __init__(self, sink, frame_bytes: int, level: int = 3):
        self.sink, self.frame_bytes = sink, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.open, self.size, self.total, self.frames = [], 0, 0, []

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset in the frame) of the record."""
        if self.size and self.size + len(record) > self.frame_bytes:
            self._flush()
        at = len(self.frames), self.size
        self.open.append(record)
        self.size += len(record)
        self.total += len(record)
        return at

    def _flush(self) -> None:
        plain = b"".join(self.open)
        packed = self.compressor.compress(plain)
        self.sink.write(packed)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.open, self.size = [], 0

    def close(self) -> None:
        if self.size:
            self._flush()
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE))
        self.sink.close()


class BundleReader:
    """Frames of a bundle by number, found through its seek table; only the frames asked for are read."""

    def __init__(self, source):
        self.source, size = source, source.size()
        if size < 17:
            raise BadArchive("too short for a seek table")
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE or flags & 0x7C:
            raise BadArchive("no seek table")
        width = 12 if flags & 0x80 else 8
        at = size - 9 - n * width
        if at < 8:
            raise BadArchive("seek table longer than the bundle")
        source.seek(at - 8)
        head = source.read(8 + n * width)
        if struct.unpack_from("<II", head) != (SKIPPABLE, n * width + 9):
            raise BadArchive("seek table has no frame of its own")
        self.frames, start = [], 0
        for i in range(n):
            packed, plain = struct.unpack_from("<II", head, 8 + i * width)
            check = struct.unpack_from("<I", head, 16 + i * width)[0] if width == 12 else None
            self.frames.append((start, packed, plain, check))
            start += packed
        if start != at - 8:
            raise BadArchive("frames and seek table disagree")

    def frame(self, i: int) -> bytes:
        start, packed, plain, check = self.frames[i]
        self.source.seek(start)
        try:
            data = zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=plain)
        except zstandard.ZstdError as e:
            raise BadArchive(str(e)) from e
        if len(data) != plain or check is not None and xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise BadArchive(f"frame {i} differs from its entry")
        return data


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str | None) -> str:
    """A header value without control characters."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text or "")


def _urn(page_id: int | None) -> str:
    return f"<{URN}{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, n_bytes: int, digest: str, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response, or without payload a revisit of the record `refers_to`; its HTTP header still tells the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + payload if payload is not None else http
    kind = "response" if payload is not None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if payload is None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """What one record says; digests are computed from the bytes read and must be those of the header."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise BadArchive("no WARC record here")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n" or f"sha1:{base32_sha1(block)}" != fields["warc-block-digest"]:
        raise BadArchive(f"record {fields.get('warc-record-id')} is cut or altered")
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda urn: int(v) if (v := urn.strip("<>").removeprefix(URN)) else None
    out = {"page_id": number(fields["warc-record-id"]), "url": fields["warc-target-uri"], "record_type": fields["warc-type"], "refers_to": None, "payload": None}
    if fields["warc-type"] == "revisit":
        length = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
        return out | {"payload_bytes": int(length[1]), "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"), "refers_to": number(fields["warc-refers-to"])}
    digest = base32_sha1(payload)
    if f"sha1:{digest}" != fields["warc-payload-digest"]:
        raise BadArchive(f"payload of {fields['warc-record-id']} differs from its digest")
    return out | {"payload_bytes": len(payload), "payload_digest": digest, "payload": payload}


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, frame_bytes: int = 256 << 10, bundle_bytes: int = 64 << 20, most_broadcast: int = 500_000) -> DataFrame:
    """Writes bundles of WARC records under `path` and returns their index: page_id, bundle, frame, offset, length.

    Of rows with equal payloads of at least min_bytes, those with the smallest
    id are responses (several only where rows repeat that id) and the others
    revisit it; null ids come last. A null html is an empty payload. An empty
    table writes no bundle.

    A task writes bundles of about bundle_bytes under names of its own, and
    the index names those of the tasks that ended well: what a lost or
    repeated task left behind is never read (drop_strays deletes it).

    Payload hashes are counted first. The repeated ones with their smallest
    ids are broadcast where there are at most most_broadcast of them, so that
    no payload travels: each task writes what it has read. A larger table is
    joined by a shuffle, whose hot hashes Spark splits, since the other side
    has one row a hash.
    """
    ship(pages.sparkSession)
    payload = F.encode(text_of(html_col), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("sha", F.sha2("payload", 256))
    firsts = stored(rows.groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "warc-copies")
    rows = rows.join(F.broadcast(firsts) if firsts.count() <= most_broadcast else firsts, "sha", "left")
    again = F.col("copies").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")) & (F.octet_length("payload") >= min_bytes)
    rows = rows.select("id", "url", "payload", F.when(again, F.col("first")).alias("first"), again.alias("again"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        writer, name, index = None, "", []

        def rows_of_index() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index, strict=True), kinds, strict=True)], ["page_id", "bundle", "frame", "offset", "length"])

        for batch in batches:
            for page_id, url, data, first, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    store.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(store.open_output_stream(f"{root}/{name}", compression=None), frame_bytes)
                made = record(page_id, url, None if revisit else data, len(data), base32_sha1(data), first)
                index.append((page_id, name, *writer.add(made), len(made)))
                if writer.total >= bundle_bytes:
                    writer.close()
                    yield rows_of_index()
                    writer, index = None, []
        if writer is not None:
            writer.close()
            yield rows_of_index()

    return stored(rows.mapInArrow(write, INDEX), "warc-index")


def read_archives(index: DataFrame, path: str, payloads: bool = False) -> DataFrame:
    """The records that the index rows point to: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload).

    Rows of a bundle meet in one task in the order of their frames, and there
    are as many tasks as bundles; only frames with a wanted record are read,
    and each of them once. A record, frame or seek table that does not fit its
    checksums fails the job.
    """
    ship(index.sparkSession)
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), *([("payload", pa.binary())] if payloads else [])]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        at, bundle, frame, data = None, None, None, b""
        for batch in batches:
            found = []
            for name, number, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != at:
                    at, bundle, frame = name, BundleReader(store.open_input_file(f"{root}/{name}")), None
                if number != frame:
                    frame, data = number, bundle.frame(number)
                found.append(parse(data[offset : offset + length]))
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], k) for n, k in kinds], [n for n, _ in kinds])

    bundles = max(1, index.select("bundle").distinct().count())
    # A number given with the key keeps Spark from merging the small index into few tasks.
    wanted = index.select("bundle", "frame", "offset", "length").repartition(bundles, "bundle").sortWithinPartitions("bundle", "frame", "offset")
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payloads
    return wanted.mapInArrow(read, schema)


def drop_strays(index: DataFrame, path: str) -> int:
    """Deletes the bundles under `path` that the index does not name, when no task writes there any more; returns their number."""
    spark = index.sparkSession
    store, root = fs.FileSystem.from_uri(path)
    names = [(f.base_name,) for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.endswith(".warc.zst")]
    there = spark.createDataFrame(names, "bundle string")
    strays = [r.bundle for r in there.join(index.select("bundle").distinct(), "bundle", "left_anti").collect()]
    for name in strays:
        store.delete_file(f"{root}/{name}")
    return len(strays)


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes all pages to archives in the shared folder and reads every record back."""
    path = scratch(pages.sparkSession, "warc")
    path = path if "://" in path or path.startswith("file:") else f"file://{path}"
    return read_archives(write_archives(pages, path, min_bytes=min_bytes), path)
