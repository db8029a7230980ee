import base64
import hashlib
import io
import zlib
from pathlib import Path

import numpy as np
import pytest
import zstandard

from orebed.llm import media, warc
from orebed.llm.common import scratch

PAGES = "page_id long, url string, html string, bundle string, sha string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "b", "s") for r in rows], PAGES)


ROWS = [(1, "http://a/\r\nx", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 300_000), (5, "u", "x" * 300_000), (6, "u", "x" * 300_000), (None, "u", "z")]


@pytest.mark.parametrize("least", [0, 5])
def test_archives_round_trip(spark, least):
    path = scratch(spark, "test-warc")
    index = warc.write_archives(frame(spark, ROWS), path, min_bytes=least, frame_bytes=1000)
    got = warc.read_archives(index, path, payloads=True).collect()
    assert len(got) == len(ROWS)
    groups = {}
    for i, _, h in ROWS:
        groups.setdefault(h or "", []).append(i)
    want = []
    for i, _, h in ROWS:
        data = (h or "").encode()
        first = min((x for x in groups[h or ""] if x is not None), default=None)
        again = i != first and len(data) >= least
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None, None if again else data))
    assert sorted(map(str, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got))) == sorted(map(str, want))
    files = list(Path(path.removeprefix("file://")).glob("*.warc.zst"))
    # Any Zstandard reader reads a bundle: frames, and a skippable frame at the end.
    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.read_bytes()), read_across_frames=True).read() for f in files)
    assert whole.count(b"WARC/1.1\r\n") == len(ROWS)


def test_one_record_is_read_from_its_frame(spark):
    path = scratch(spark, "test-warc")
    index = warc.write_archives(frame(spark, ROWS), path, frame_bytes=1000)
    one = warc.read_archives(index.where("page_id = 1"), path, payloads=True).collect()
    assert [bytes(r.payload).decode() for r in one] == ["<p>é</p>"]


def test_many_copies_take_the_shuffled_join(spark):
    path, other = scratch(spark, "test-warc"), scratch(spark, "test-warc")
    few, many = (warc.read_archives(warc.write_archives(frame(spark, ROWS), p, most_broadcast=n), p).collect() for p, n in ((path, 100), (other, 0)))
    assert sorted(map(str, few)) == sorted(map(str, many))


def test_bundles_are_read_by_as_many_tasks(spark):
    path = scratch(spark, "test-warc")
    index = warc.write_archives(frame(spark, [(i, "u", f"{i} " * 400) for i in range(400)]).coalesce(2), path, bundle_bytes=40_000)
    bundles = index.select("bundle").distinct().count()
    read = warc.read_archives(index, path)
    assert bundles > 8 and read.rdd.getNumPartitions() == bundles and read.count() == 400
    stray = Path(path.removeprefix("file://")) / "left.warc.zst"
    stray.write_bytes(b"x")
    assert warc.drop_strays(index, path) == 1 and not stray.exists() and read.count() == 400


def test_damage_is_noticed():
    sink = io.BytesIO()
    sink.close = lambda: None
    w = warc.BundleWriter(sink, 100)
    for i in range(10):
        w.add(warc.record(i, "u", b"x" * 50, 50, warc.base32_sha1(b"x" * 50), None))
    w.close()
    data = sink.getvalue()

    class Source(io.BytesIO):
        def size(self):
            return len(self.getbuffer())

    reader = warc.BundleReader(Source(data))
    assert len(reader.frames) == 10 and warc.parse(reader.frame(3))["page_id"] == 3
    for bad in (data[:-1], data[:-20] + data[-9:], data[5:]):
        with pytest.raises(warc.BadArchive):
            warc.BundleReader(Source(bad))
    broken = bytearray(data)
    broken[reader.frames[2][0] + 30] ^= 1
    with pytest.raises(warc.BadArchive):
        warc.BundleReader(Source(bytes(broken))).frame(2)
    with pytest.raises(warc.BadArchive):
        warc.parse(reader.frame(3).replace(b"xxx", b"xyx"))


def test_no_pages(spark):
    assert warc.archive_pages(frame(spark, [])).count() == 0


def plain_filter(rows, kind, bpp):
    """PNG's definition of a filter, byte by byte."""
    out = bytearray()
    for y, row in enumerate(rows):
        out.append(kind)
        for x in range(len(row)):
            a = int(row[x - bpp]) if x >= bpp else 0
            b = int(rows[y - 1][x]) if y else 0
            c = int(rows[y - 1][x - bpp]) if y and x >= bpp else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((int(row[x]) - [0, a, b, (a + b) // 2, near][kind]) & 255)
    return bytes(out)


@pytest.mark.parametrize("bpp", [1, 3, 4])
def test_all_filters_are_undone(bpp):
    rows = np.random.default_rng(1).integers(0, 256, (7, 6 * bpp), dtype=np.uint8)
    for kind in range(5):
        assert (media.unfilter(plain_filter(rows, kind, bpp), 7, 6 * bpp, bpp) == rows).all()
    mixed = b"".join(plain_filter(rows, k, bpp)[y * (6 * bpp + 1) : (y + 1) * (6 * bpp + 1)] for y, k in enumerate([2, 4, 4, 1, 0, 3, 2]))
    assert (media.unfilter(mixed, 7, 6 * bpp, bpp) == rows).all()


def test_png_and_its_checksums():
    for samples in (bytes(range(192)), b"text " * 960, bytes(i * j % 251 for i in range(40) for j in range(192))):
        png = media.write_png(samples)
        assert media.read_png(png).tobytes() == samples
        for i in (0, 20, len(png) // 2, len(png) - 5):
            bad = bytearray(png)
            bad[i] ^= 4
            with pytest.raises(media.BadImage):
                media.read_png(bytes(bad))
        with pytest.raises(media.BadImage):
            media.read_png(png[:-12])


def test_cosine_hash_is_steady():
    a = np.random.default_rng(3).integers(32, 123, (64, 192)).astype(np.uint8)
    b = a.copy()
    b[3, 5] ^= 8
    bits = lambda h: np.unpackbits(np.frombuffer(h, np.uint8))
    assert (bits(media.cosine_hash(a)) != bits(media.cosine_hash(b))).sum() <= 4 and len(media.cosine_hash(a)) == 8


def plain_cosine_hash(samples):
    """The definition, without matrices: averages of 32 x 32 cells, sums of cosines, bits above the median."""
    grey = samples.reshape(len(samples), -1, 3).mean(axis=2)

    def cell(n, i):
        return range(i * n // 32, (i + 1) * n // 32) if n >= 32 else [i * n // 32]

    small = [[np.mean([[grey[y, x] for x in cell(grey.shape[1], j)] for y in cell(grey.shape[0], i)]) for j in range(32)] for i in range(32)]
    low = []
    for u in range(8):
        for v in range(8):
            low.append(round(sum(small[y][x] * np.cos(np.pi * u * (2 * y + 1) / 64) * np.cos(np.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)), 6))
    middle = sorted(low[1:])[31]
    bits = "".join("1" if c > middle else "0" for c in low)
    return int(bits, 2).to_bytes(8, "big")


@pytest.mark.parametrize("height", [1, 7, 32, 75])
def test_cosine_hash_is_the_plain_one(height):
    rng = np.random.default_rng(height)
    a = rng.integers(0, 255, (height, 192)).astype(np.uint8)
    assert media.cosine_hash(a) == plain_cosine_hash(a)


def test_long_images_have_several_chunks():
    samples = np.random.default_rng(1).integers(0, 255, (2000, 192)).astype(np.uint8)
    png = media.write_png(samples.tobytes())
    kinds = [k for k, _ in media.chunks(png)]
    assert kinds.count(b"IDAT") > 3 and all(len(d) <= media.CHUNK for _, d in media.chunks(png)) and (media.read_png(png) == samples).all()


def test_media_features(spark):
    texts = [None, "", "ab", "ab", "é" * 50_000, "x" * 192]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    got = sorted(media.media_features(df).collect())
    for r, t in zip(got, texts, strict=True):
        data = (t or "").encode()
        padded = data.ljust(max(192, -(-len(data) // 192) * 192), b" ")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert r.media_sha256 == hashlib.sha256(media.write_png(padded)).hexdigest() and len(r.feature) == 16
    assert got[2][1:] == got[3][1:] and media.media_features(df.where("false")).count() == 0
