"""Removal of repeated passages wherever they begin and end, found by winnowed word grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices, stored, text_of, without
from .shingles import mixed

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Odd bases of the rolling hashes. Fixed values.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MEMO_WORDS = 200_000
_memo: dict[str, int] = {}
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash for each word, as it is written."""
    if len(_memo) > _MEMO_WORDS:
        _memo.clear()
    for w in words:
        if w not in _memo:
            _memo[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))


def _powers_to(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of the bases and of their inverses modulo 2^64, n of each at least."""
    if not _powers or len(_powers[0][0]) < n:
        _powers.clear()
        for base in _BASES:
            both = []
            for b in (base, pow(base, -1, 2**64)):
                p = np.full(2 * n, b, np.uint64)
                p[0] = 1
                both.append(np.cumprod(p, dtype=np.uint64))
            _powers.append((both[0], both[1]))
    return _powers


class Rolling:
    """Hashes of any runs of the words of a text, from prefix sums."""

    def __init__(self, text: str):
        h = _hashes(WORD.findall(text))
        self.n = len(h)
        self.inverse, self.sums = [], []
        for up, down in _powers_to(self.n + 1):
            self.sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[: self.n], dtype=np.uint64))))
            self.inverse.append(down)
            h = mixed(h)

    def of(self, first: np.ndarray, length: np.ndarray | int, which: int) -> np.ndarray:
        return mixed((self.sums[which][first + length] - self.sums[which][first]) * self.inverse[which][first])


def segments(text: str, min_words: int) -> tuple[np.ndarray, ...]:
    """(fingerprint, key 1, key 2, first window, windows after it) of the runs of windows with one winnowed gram.

    A window is min_words words long; its fingerprint, the least gram of half
    that length in it (of equal ones the last), hangs on its words only. A
    key stands for all words of its segment.
    """
    roll, k = Rolling(text), (min_words + 1) // 2
    n = roll.n - min_words + 1
    if n < 1:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    wide = min_words - k + 1
    grams = roll.of(np.arange(roll.n - k + 1), k, 0)
    anchor = np.arange(n) + wide - 1 - np.lib.stride_tricks.sliding_window_view(grams, wide)[:, ::-1].argmin(axis=1)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    more = np.diff(np.append(first, n)) - 1
    keys = [roll.of(first, more + min_words, i) + more.astype(np.uint64) for i in (0, 1)]
    return grams[anchor[first]].view(np.int64), keys[0].view(np.int64), keys[1].view(np.int64), first, more


def cut(text: str, ranges: list[tuple[int, int]]) -> tuple[str, int, int]:
    """(rest, removed words, removed runs) of a text without the ranges (first, last + 1) of its words.

    Where a run goes, one gap stays of the two around it: the one with a line
    end, else the one before it.
    """
    runs: list[list[int]] = []
    for a, b in sorted(ranges):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    spans = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for a, b in runs:
        left = spans[a - 1][1] if a else 0
        right = spans[b][0] if b < len(spans) else len(text)
        before, after = text[left : spans[a][0]], text[spans[b - 1][1] : right]
        out += [text[at:left], after if b == len(spans) or a and "\n" in after and "\n" not in before else before]
        at = right
    return "".join([*out, text[at:]]), sum(b - a for a, b in runs), len(runs)


def repeated_passages(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(_id, _t, _ranges): the word ranges of each document that stand earlier, in the order (id, text hash, word).

    Segments of equal keys are equal in all words, so the later ones go
    whole. Only the first of each key is laid out window by window, and only
    where another key has its fingerprint: elsewhere no window of it can
    stand a second time.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_of(text_col)).alias("_t"), text_of(text_col).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [segments(t, min_words) for t in batch.column(2).to_pylist()]
            of = pa.array(np.repeat(np.arange(len(got)), [len(g[0]) for g in got]))
            fp, k1, k2, first, more = (np.concatenate(x) for x in zip(*got, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(first, pa.int32()), pa.array(more, pa.int32()), pa.array(fp), pa.array(k1), pa.array(k2)], ["_id", "_t", "_pos", "_more", "_fp", "_k1", "_k2"])

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            of, places, w1, w2 = [], [], [], []
            for i, (text, ranges) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                roll = Rolling(text)
                at = np.concatenate([np.arange(r["_pos"], r["_pos"] + r["_more"] + 1) for r in ranges])
                of.append(np.full(len(at), i))
                places.append(at)
                w1.append(roll.of(at, min_words, 0).view(np.int64))
                w2.append(roll.of(at, min_words, 1).view(np.int64))
            if of:
                take = pa.array(np.concatenate(of))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate(places), pa.int32()), pa.array(np.concatenate(w1)), pa.array(np.concatenate(w2))], ["_id", "_t", "_pos", "_k1", "_k2"])

    ship(docs.sparkSession)
    place = F.struct("_id", "_t", "_pos")
    keys = ["_k1", "_k2"]
    found = stored(rows.mapInArrow(cut_up, f"_id {id_type}, _t bigint, _pos int, _more int, _fp bigint, _k1 bigint, _k2 bigint"), "segments")
    # A fingerprint that one segment has holds no repetition, and most are of this kind.
    often = found.groupBy("_fp").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_fp")
    found = stored(found.join(often, "_fp", "left_semi").select(found.columns), "repeated-segments")
    firsts = stored(found.groupBy(*keys).agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n"), F.min("_fp").alias("_fp"), F.min("_more").alias("_more")), "segment-firsts")
    whole = found.join(firsts.where("_n > 1").select(*keys, "_first"), keys).where(place > F.col("_first")).select("_id", "_t", "_pos", "_more")

    shared = firsts.groupBy("_fp").agg(F.count(F.lit(1)).alias("_keys")).where("_keys > 1").select("_fp")
    parts = firsts.join(shared, "_fp", "left_semi").select("_first.*", "_more")
    parts = parts.groupBy("_id", "_t").agg(F.collect_list(F.struct("_pos", "_more")).alias("_ranges")).withColumnsRenamed({"_id": "_i", "_t": "_h"})
    texts = rows.join(parts, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_t") == F.col("_h"))).select("_id", "_t", "_text", "_ranges")
    windows = stored(texts.mapInArrow(lay_out, f"_id {id_type}, _t bigint, _pos int, _k1 bigint, _k2 bigint"), "windows")
    window_firsts = windows.groupBy(*keys).agg(F.min(place).alias("_first"), F.max(place).alias("_last")).where("_first < _last").select(*keys, "_first")
    single = windows.join(window_firsts, keys).where(place > F.col("_first")).select("_id", "_t", "_pos", F.lit(0).alias("_more"))
    gone = whole.unionAll(single).select("_id", "_t", F.struct(F.col("_pos").alias("a"), (F.col("_pos") + F.col("_more") + min_words).alias("b")).alias("_range"))
    return gone.groupBy("_id", "_t").agg(F.collect_set("_range").alias("_ranges"))


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """docs with later repeated passages deleted word by word, plus removed_words and removed_passages.

    A word goes when it is part of min_words words that stand together
    earlier, in the order (id, hash of the text, word); lines do not matter,
    and words are compared as they are written. A text that repeats itself
    keeps its first period. A null text stays null; a text whose words all go
    stays as a row. Rows that repeat id and text are one document and come
    out alike. Columns of the input named like a result column are replaced.
    """
    docs = without(docs, "removed_words", "removed_passages", "_t", "_id", "_ranges", "_cut")
    ranges = repeated_passages(docs, id_col, text_col, min_words)
    joined = docs.withColumn("_t", F.xxhash64(text_of(text_col))).join(ranges.withColumnRenamed("_t", "_h"), F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_h")), "left")

    def rest(text: str | None, spans: list | None) -> tuple[str, int, int] | None:
        return cut(text, [(r["a"], r["b"]) for r in spans]) if spans else None

    # Rows without cuts send no text to Python.
    cut_udf = F.udf(rest, "text string, words bigint, runs bigint", useArrow=False)
    joined = joined.withColumn("_cut", cut_udf(F.when(F.col("_ranges").isNotNull(), F.col(text_col)), F.col("_ranges")))
    return joined.select(
        *[F.when(F.col("_ranges").isNull(), F.col(f"`{c}`")).otherwise(F.col("_cut.text")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
        F.coalesce("_cut.words", F.lit(0)).cast("long").alias("removed_words"),
        F.coalesce("_cut.runs", F.lit(0)).cast("long").alias("removed_passages"),
    )
