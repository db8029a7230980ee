"""Chunks of texts within a budget: at structure, sentences and blanks."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, slices

TOKEN = re.compile(r"\w+|[^\w\s]")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: Lines that begin a section: markdown headings, clauses with a word before the number, and numbers of two levels or more.
SECTION = re.compile(r"^(?:#{1,6}\s+|(?:Пункт|Раздел|Статья|п\.|§)\s*\d+(?:\.\d+)+|\d+(?:\.\d+)+(?:\s+|\.|$))", re.IGNORECASE)


def budget_parts(text: str, budget: int) -> list[str]:
    """A text cut into parts of at most `budget` tokens (words and marks), each as long as it can be, at the last blank of its last fifth.

    Tokens are found once; the ends of the tokens before a place are its
    prefix sums, so that the longest prefix within the budget is looked up.
    """
    clean = text.strip()
    starts = [m.start() for m in TOKEN.finditer(clean)]
    parts, at = [], 0
    while at < len(clean):
        first = bisect_right(starts, at - 1)
        if len(starts) - first <= budget:
            parts.append(clean[at:].strip())
            break
        best = starts[first + budget] - at  # the token that would be one too many begins here
        floor = max(1, int(best * 0.8))
        blank = max(clean.rfind("\n", at + floor, at + best), clean.rfind(" ", at + floor, at + best)) - at
        cut = at + (blank if blank >= floor else best)
        parts.append(clean[at:cut].strip())
        at = cut
        while at < len(clean) and clean[at].isspace():
            at += 1
    return [p for p in parts if p]


def _overlap(before: str, most: int) -> str:
    """The last whole sentences of a chunk within `most` characters; where the last one is longer, its end."""
    taken, used = [], 0
    for s in reversed([s.strip() for s in SENTENCE.split(before) if s.strip()] if most > 0 else []):
        if used + len(s) + 1 > most:
            return " ".join(reversed(taken)) if taken else s[-most:]
        taken.append(s)
        used += len(s) + 1
    return " ".join(reversed(taken))


def _filled(pieces: list[str], size: int, overlap: int, glue: str) -> list[str]:
    """Pieces of at most `size` characters put together to chunks; each begins with the end of the one before where that fits beside its piece."""
    chunks, held = [], ""
    for p in pieces:
        if held and len(held) + len(glue) + len(p) > size:
            chunks.append(held)
            lead = _overlap(held, min(overlap, size - len(p) - len(glue)))
            held = lead + glue + p if lead else p
        else:
            held = held + glue + p if held else p
    return [*chunks, held] if held else chunks


def structured_chunks(text: str, size: int, overlap: int) -> list[str]:
    """A text in chunks of at most `size` characters: sections stay whole where they fit, longer ones are cut at sentences, longer sentences anywhere."""
    blocks: list[list[str]] = []
    for line in text.split("\n"):
        if not blocks or SECTION.match(line.strip()):
            blocks.append([])
        blocks[-1].append(line)
    chunks, run = [], []
    for block in filter(None, ("\n".join(b).strip() for b in blocks)):
        if len(block) <= size:
            run.append(block)
            continue
        chunks += _filled(run, size, overlap, "\n\n")
        run, sentences = [], []
        for s in filter(None, (s.strip() for s in SENTENCE.split(block))):
            step = size - min(overlap, size // 4)
            sentences += [s] if len(s) <= size else [s[i : i + size] for i in range(0, max(len(s) - (size - step), 1), step)]
        chunks += _filled(sentences, size, overlap, " ")
    return chunks + _filled(run, size, overlap, "\n\n")


def _split(docs: DataFrame, id_col: str, text: str, cut) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A few texts at a time, so that a worker holds neither a batch's texts nor its chunks as objects.
        for batch in slices(batches, 64):
            parts = [cut(t) for t in batch.column(1).to_pylist()]
            sizes = [len(p) for p in parts]
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            at = [n for size in sizes for n in range(size)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(at, pa.int64()), pa.array([c for p in parts for c in p], pa.string())], [id_col, "part", "chunk"])

    ship(docs.sparkSession)
    return docs.select(id_col, F.coalesce(F.col(text), F.lit("")).alias("_t")).mapInArrow(run, f"{id_col} {kind}, part long, chunk string")


def split_to_budget(docs: DataFrame, id_col: str, text: str, budget: int) -> DataFrame:
    """(id, part, chunk): texts cut to a budget of tokens; null and blank texts have no rows. Ids are not null."""
    return _split(docs, id_col, text, lambda t: budget_parts(t, budget))


def split_by_structure(docs: DataFrame, id_col: str, text: str, size: int, overlap: int) -> DataFrame:
    """(id, part, chunk): texts cut at sections and sentences, with an overlap of whole sentences; null and blank texts have no rows. Ids are not null."""
    return _split(docs, id_col, text, lambda t: structured_chunks(t, size, overlap))
