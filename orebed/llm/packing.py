"""Packing of documents into token sequences: all tokens are concatenated and cut at fixed places."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, slices, stored, text_of

DEFAULT_TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
#: Runs of characters, and words of other texts, that a worker remembers; when there are more, it begins anew.
REMEMBERED_RUNS, REMEMBERED_WORDS = 800_000, 200_000

#: Of lower-case texts: runs of Latin letters, and what stands between them.
RUNS = re.compile("[a-zß-öø-ÿ]+|[^a-zß-öø-ÿ]+")
#: Texts that may be parted so: no apostrophe, nothing that composes, no special token.
PARTED = re.compile("(?!.*<[|])[\n -&(-~À-ÖØ-öø-ÿ]*", re.DOTALL)


class Runs(dict):
    """The ids of a run of characters, as bytes: letters go to the vocabulary's merges, everything else through the whole tokenizer."""

    def __init__(self, words: WordTokens):
        super().__init__()
        self.words = words

    def __missing__(self, run: str) -> bytes:
        ids = self[run] = self.words.merged(run) if run.isalpha() else self.words.whole(run)
        return ids


class WordTokens(dict):
    """The ids of a word of a text, as bytes, found by the tokenizer when the word is met first.

    The vocabulary has word ends and drops white space, so a text's ids are
    those of what stands between its spaces and line ends. Texts of Latin
    letters and ASCII marks are parted into runs of letters and of the rest,
    where the tokenizer parts them too.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.runs = Runs(self)
        self.splits = all(self.whole(a) + self.whole(b) == self.whole(f"{a} {b}") == self.whole(f"{a}\n{b}") for a, b in (("a", "a"), ("Ab", ",b."), ("1x", "Üé")))
        letters = "".join(map(chr, (*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100))))
        shown = {c: self.tokenizer.pre_tokenizer.pre_tokenize_str(c) for c in letters} if self.splits else {}
        self.shown = {ord(c): x[0][0] for c, x in shown.items() if len(x) == 1}
        self.simple = bool(shown) and all(self.merged(w) == self.whole(w) for w in (letters, "the", "straße", "été"))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def merged(self, letters: str) -> bytes:
        return np.array([t.id for t in self.tokenizer.model.tokenize(letters.translate(self.shown))], self.dtype).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.whole(word)
        if len(word) <= 64:
            self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        if self.simple and PARTED.fullmatch(text):
            if len(self.runs) >= REMEMBERED_RUNS:
                self.runs.clear()
            return b"".join(map(self.runs.__getitem__, RUNS.findall(text.lower())))
        if not self.splits:
            return self.whole(text)
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_words: dict[str, WordTokens] = {}


def _tokenised(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _words:
            _words[path] = WordTokens(path)
        words, part, at = _words[path], TaskContext.get().partitionId(), 0
        width, last = int(words.dtype[2]), np.array([end], words.dtype).tobytes()
        for batch in slices(batches):
            ids = [words.of(t) + last for t in batch.column(1).to_pylist()]
            n = np.array([len(x) // width for x in ids], np.int64)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part)), pa.array(starts), pa.array(n), pa.array(np.full(len(n), width)), pa.array(ids, pa.binary())], ["doc_id", "part", "at", "doc_tokens", "width", "ids"])

    return run


def tokenised(docs: DataFrame, id_col: str, text: str, path: str, end: int) -> DataFrame:
    """(doc_id, part, at, doc_tokens, width, ids): each document's ids and the end id, in `width` bytes each, after the `at` ids of its part that stand before."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(f"`{text}`").alias("text")).mapInArrow(_tokenised(path, end), f"doc_id {kind}, part long, at long, doc_tokens long, width long, ids binary")


def _tail_ends(total: int, size: int) -> list[int]:
    """Where the sequences after the last whole one end: powers of two, the largest first."""
    at, ends = total - total % size, []
    for bit in reversed(range(size.bit_length())):
        if total % size >> bit & 1:
            at += 1 << bit
            ends.append(at)
    return ends


def _pieces(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        for batch in slices(batches):
            rows, taken = [], []
            total = batch.column(5)[0].as_py()
            body, tail = total // size * size, _tail_ends(total, size)
            for row, (base, n, width, ids) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True)):
                ids, at = np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes(), base
                while at < base + n:
                    if at < body:
                        sequence, first = divmod(at, size)[0], at // size * size
                        stop = first + size
                    else:
                        nth = next(i for i, e in enumerate(tail) if e > at)
                        sequence, first, stop = body // size + nth, tail[nth - 1] if nth else body, tail[nth]
                    stop = min(stop, base + n)
                    rows.append((at - base, stop - at, ids[4 * (at - base) : 4 * (stop - base)], n, sequence, at - first))
                    taken.append(row)
                    at = stop
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(taken)), *columns], names)

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 4096, path: str = DEFAULT_TOKENIZER, end: int = 2) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset: the pieces into which documents are cut to fill sequences of `size` tokens.

    A document's tokens are its ids and the id `end`, so a null or empty text
    has one. ids are little-endian 32-bit numbers. Rows follow each other in
    the order in which they are read: the first pass tokenises, writes the ids
    and numbers them within each partition; prefix sums over the partitions'
    totals, one row each, give global places; the second pass cuts at
    multiples of `size`. A document over a window's end has a piece on either
    side. What is left after the last whole sequence is cut at powers of two,
    so that nothing is padded. Neither pass moves a document. Repeated rows and
    ids are documents of their own, null ids stay null, other columns are left
    out, and an empty table has no pieces.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    kept = stored(tokenised(docs, id_col, text, path, end), "packing_ids")
    totals = kept.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition of the first pass
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy()).alias("total"))
    placed = kept.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("at")).alias("base"), "doc_tokens", "width", "ids", "total")
    kind = kept.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(_pieces(size), f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, length, ids, doc_ids: whole sequences from their pieces, of which a sequence has at most its size."""
    rows = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x["ids"]))
    return rows.select("sequence_id", "length", joined.alias("ids"), F.col("p.doc_id").alias("doc_ids"))
