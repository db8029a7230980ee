"""Bytes as PNG images in binary columns, read back with every checksum tested, and a low-frequency cosine hash."""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices, stored, text_of

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH, CHANNELS = 64, 3
ROW = WIDTH * CHANNELS
CHUNK = 1 << 16


class BadImage(ValueError):
    """A PNG that is cut, altered or of a kind that is not read here."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _filtered(rows: np.ndarray, kind: int) -> np.ndarray:
    """The rows (height x ROW) under PNG filter 0, 1 or 2 (none, left, above), with the filter's byte in front."""
    out = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    out[:, 0], body = kind, out[:, 1:]
    body[:] = rows
    if kind == 1:
        body[:, CHANNELS:] -= rows[:, :-CHANNELS]
    elif kind == 2:
        body[1:] -= rows[:-1]
    return out


def write_png(samples: bytes, level: int = 3) -> bytes:
    """An 8-bit RGB image of WIDTH columns; samples are a positive multiple of ROW bytes.

    The filter is the one under which the whole image deflates best, and the
    data stands in chunks of at most CHUNK bytes.
    """
    rows = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    data = min((zlib.compress(_filtered(rows, k).tobytes(), level) for k in (0, 1, 2)), key=len)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    parts = [_chunk(b"IDAT", data[i : i + CHUNK]) for i in range(0, len(data), CHUNK)]
    return SIGNATURE + _chunk(b"IHDR", head) + b"".join(parts) + _chunk(b"IEND", b"")


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(type, data) of each chunk; fails where a length or checksum is wrong."""
    if png[:8] != SIGNATURE:
        raise BadImage("no PNG signature")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise BadImage("cut chunk")
        n, kind = struct.unpack_from(">I4s", png, at)
        data = png[at + 8 : at + 8 + n]
        if len(data) != n or at + 12 + n > len(png):
            raise BadImage("cut chunk")
        if zlib.crc32(data, zlib.crc32(kind)) != struct.unpack_from(">I", png, at + 8 + n)[0]:
            raise BadImage(f"checksum of {kind!r}")
        yield kind, data
        at += 12 + n
        if kind == b"IEND":
            return
    raise BadImage("no IEND")


def unfilter(raw: bytes, height: int, width: int, bpp: int) -> np.ndarray:
    """Samples of a filtered image, height x width bytes, for all five filters."""
    data = np.frombuffer(raw, np.uint8)
    if data.size != height * (width + 1):
        raise BadImage("wrong number of samples")
    data = data.reshape(height, width + 1)
    kinds, body = data[:, 0], data[:, 1:]
    if kinds.max() > 4:
        raise BadImage("unknown filter")
    out = np.zeros((height + 1, width), np.uint8)
    # Runs of rows with one filter: none and left need no row above, above adds up down the rows.
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for lo, hi in zip(np.r_[0, edges], np.r_[edges, height], strict=True):
        kind, part = kinds[lo], body[lo:hi]
        if kind == 0:
            out[lo + 1 : hi + 1] = part
        elif kind == 1:
            out[lo + 1 : hi + 1] = np.cumsum(part.reshape(hi - lo, -1, bpp), axis=1, dtype=np.uint8).reshape(hi - lo, width)
        elif kind == 2:
            out[lo + 1 : hi + 1] = np.cumsum(np.vstack([out[lo : lo + 1], part]), axis=0, dtype=np.uint8)[1:]
        else:
            for y in range(lo, hi):
                up = out[y].astype(np.int32)
                row = body[y].astype(np.int32)
                left, corner = np.zeros(bpp, np.int32), np.zeros(bpp, np.int32)
                for x in range(0, width, bpp):
                    above = up[x : x + bpp]
                    if kind == 3:
                        guess = (left + above) // 2
                    else:
                        p = left + above - corner
                        a, b, c = abs(p - left), abs(p - above), abs(p - corner)
                        guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
                    left, corner = (row[x : x + bpp] + guess) & 255, above
                    row[x : x + bpp] = left
                out[y + 1] = row
    return out[1:]


def read_png(png: bytes) -> np.ndarray:
    """Samples of an 8-bit grey, RGB or RGBA image without interlace: height x (columns x channels)."""
    head, parts = None, []
    for kind, data in chunks(png):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            parts.append(data)
    if head is None or not parts:
        raise BadImage("no header or no data")
    width, height, depth, colour, method, filters, interlace = head
    bpp = {0: 1, 2: 3, 6: 4}.get(colour)
    if depth != 8 or bpp is None or method or filters or interlace or not width or not height:
        raise BadImage("only 8-bit grey, RGB and RGBA without interlace")
    try:
        raw = zlib.decompress(b"".join(parts))
    except zlib.error as e:
        raise BadImage(str(e)) from e
    return unfilter(raw, height, width * bpp, bpp)


@functools.cache
def _cosines(n: int = 32, low: int = 8) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


def cosine_hash(samples: np.ndarray, bpp: int = CHANNELS) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies of the 32 x 32 brightness are above their median."""
    grey = samples.reshape(len(samples), -1, bpp).mean(axis=2)
    for axis in (0, 1):
        n = grey.shape[axis]
        if n >= 32:
            edges = np.arange(33) * n // 32
            grey = np.add.reduceat(grey, edges[:-1], axis=axis) / np.diff(edges).reshape((-1, 1) if axis == 0 else (1, -1))
        else:
            grey = np.take(grey, np.arange(32) * n // 32, axis=axis)
    low = _cosines() @ grey @ _cosines().T
    low = np.round(low.ravel(), 6)
    return np.packbits(low > np.median(low[1:])).tobytes()


def payload_of(text: str) -> tuple[int, bytes]:
    """Bytes of the UTF-8 text, and these padded with spaces to a positive multiple of ROW."""
    data = text.encode("utf-8", "surrogatepass")
    return len(data), data + b" " * (max(ROW, -(-len(data) // ROW) * ROW) - len(data))


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text as a PNG in a binary column, one image a row. A null text counts as empty."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [payload_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([write_png(p) for _, p in made], pa.binary())], ["id", "n_bytes", "media"])

    return rows.mapInArrow(images, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes bigint, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """What the stored images hold: payload size and checksums, the image's own size and hash, and its cosine hash.

    An image that cannot be read (a wrong checksum, cut or no image) fails the
    job with BadImage: a damaged archive is not passed over. A null image is
    read as one without payload and has null results.
    """
    ship(media.sparkSession)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[] for _ in range(6)]
            for png in batch.column(2).to_pylist():
                if png is None:
                    row = [None] * 6
                else:
                    samples = read_png(png)
                    payload = samples.tobytes()
                    row = [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(samples)]
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "phash"])

    kind = media.schema["id"].dataType.simpleString()
    return media.mapInArrow(features, f"id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, phash binary")


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts through images and back: images are written to the shared folder, read again and measured.

    One row per input row: id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature (hexadecimal cosine hash).
    Equal texts have equal values; a null text counts as empty; an empty table
    gives no rows. Each text is worked on alone, in batches of bounded number.
    """
    media = stored(store_media(docs, id_col, text_col), "media")
    seen = read_media(media)
    return seen.select(F.col("id").alias(id_col), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.lower(F.hex("phash")).alias("feature"))
