"""Encoding and decoding with a SentencePiece vocabulary: Aho-Corasick matches relaxed in one Viterbi pass."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices, text_of, without

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"


class Vocabulary:
    """Pieces, scores, the ids of the 256 bytes and the unknown id of a model; small enough to send to every worker."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], unknown: int, special: set[int], merges: bool = False):
        self.pieces, self.scores, self.byte_ids, self.unknown, self.special, self.merges = pieces, scores, byte_ids, unknown, special, merges

    @classmethod
    def load(cls, path: str | Path) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=str(path))
        n = model.get_piece_size()
        byte_ids = [-1] * 256
        for i in range(n):
            if model.is_byte(i):
                byte_ids[int(model.id_to_piece(i)[3:5], 16)] = i
        special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
        scores = [model.get_score(i) for i in range(n)]
        # Merge ranks are whole numbers that fall from piece to piece; log probabilities are not.
        ranks = [s for i, s in enumerate(scores) if i not in special and s > -1e9]
        merges = all(s == int(s) for s in ranks) and all(a > b for a, b in zip(ranks, ranks[1:], strict=False))
        probe = "  \u00e9 e\u0301 \ufb01\u2460  A\t "
        if "".join(model.encode_as_pieces(probe)).replace(SPACE, " ") and model.decode(model.encode(probe)) != probe:
            raise ValueError("models that normalise their text are not read here")
        return cls([model.id_to_piece(i) for i in range(n)], scores, byte_ids, model.unk_id(), special, merges)


class Codec:
    """encode and decode for one vocabulary.

    A text gets one space in front and spaces become U+2581; one pass over the
    automaton's matches then relaxes the best path to each position.

    Where scores are log probabilities, the best path has the highest total
    score, and the longer last piece at equal scores; a character that is no
    piece costs the least score less 10. Where they are merge ranks, their sum
    says nothing: a path is the one that the merges give exactly if each two
    neighbours on it are what the merges make of the two together. One piece
    that ends at a position fits the path to its start in this way, and the
    pass takes it.

    A character that is no piece becomes its UTF-8 bytes where the vocabulary
    has all bytes, else the unknown id. Since no piece has U+2581 or a line
    break after another character, and none joins a letter with a character
    that is none, words and what stands between them are encoded one by one
    and remembered. Where pieces of a vocabulary do so, it is not cut there.
    """

    def __init__(self, vocabulary: Vocabulary, most_words: int = 200_000):
        v = self.v = vocabulary
        self.automaton = ahocorasick.Automaton()
        self.single = set()
        for i, (piece, score) in enumerate(zip(v.pieces, v.scores, strict=True)):
            if i not in v.special and piece:
                self.automaton.add_word(piece, (len(piece), i, score, {}))
                if len(piece) == 1:
                    self.single.add(piece)
        self.automaton.make_automaton()
        ordinary = [p for i, p in enumerate(v.pieces) if i not in v.special]
        self.unknown_score = min((s for i, s in enumerate(v.scores) if i not in v.special), default=0.0) - 10
        spaces = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in ordinary)
        lines = any("\n" in p and p.strip("\n") for p in ordinary)
        letter, other = self._classes(ordinary)
        words = f"{SPACE}*[{letter}]+|{SPACE}*(?:(?![{SPACE}{{}}])[{other}])+|{SPACE}+"
        self.chunk = re.compile("(?s).+" if spaces else words.format("") if lines else words.format("\n") + "|\n+")
        self.bytes_of = all(b >= 0 for b in v.byte_ids)
        self.byte_at = {i: b for b, i in enumerate(v.byte_ids) if i >= 0}
        self.is_byte = np.isin(np.arange(len(v.pieces)), list(self.byte_at))
        self.text_of = ["" if i in v.special else p for i, p in enumerate(v.pieces)]
        self.most_words, self.memo, self.older = most_words, {}, {}
        self.rank = {p: (v.scores[i], i) for i, p in enumerate(v.pieces) if i not in v.special and p}
        self.pairs = 0

    @staticmethod
    def _classes(pieces: list[str]) -> tuple[str, str]:
        """Letters and the other characters, as insides of a class, such that no piece joins the two, but for U+2581 before a letter."""
        joined = {x for p in pieces for x in zip(p, p[1:], strict=False) if x[0] != SPACE}
        letters = {c for x in joined for c in x if re.match(r"[^\W\d_]", c)}
        odd: set[str] = set()
        while more := {c for x in joined if len(inside := letters.intersection(x) - odd) < len(set(x)) for c in inside}:
            odd |= more
        apart = "".join(map(re.escape, sorted(odd)))
        return rf"^\W\d_{apart}", rf"\W\d_{apart}"

    def merged(self, text: str) -> list[int]:
        """What merging the best pair of neighbours again and again makes of a text of known characters, the leftmost of equal ones first."""
        parts, rank = list(text), self.rank
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = rank.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found[0] > best):
                    best, at = found[0], i
            if at < 0:
                return [rank[p][1] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, before: int, piece: int) -> bool:
        """Whether merging leaves the two pieces as they are; before is -1 at the start and after an unknown character."""
        pieces = self.v.pieces
        if before < 0:
            return self.merged(pieces[piece]) == [piece]
        return self.merged(pieces[before] + pieces[piece]) == [before, piece]

    def merge_path(self, chunk: str) -> list[int]:
        """The merges' result: at each position the one matching piece that fits the path to its start."""
        n, known = len(chunk), self.single.issuperset(chunk)
        if self.pairs > 2_000_000:
            self.pairs = 0
            for *_, fitting in self.automaton.values():
                fitting.clear()
        via, step = [-1] * (n + 1), [0] * (n + 1)
        for end, (length, piece, _, fitting) in self.automaton.iter(chunk):
            end += 1
            if step[end]:
                continue
            start = end - length
            if not known and start and not step[start] and chunk[start - 1] in self.single:
                continue
            before = via[start]
            good = fitting.get(before)
            if good is None:
                good = fitting[before] = self.fits(before, piece)
                self.pairs += 1
            if good:
                via[end], step[end] = piece, length
        out: list[int] = []
        while n:
            if step[n]:
                out.append(via[n])
                n -= step[n]
            else:
                out.extend(self._unknown(chunk[n - 1]))
                n -= 1
        return out[::-1]

    def _unknown(self, char: str) -> list[int]:
        """The ids of a character that is no piece, last byte first."""
        return [self.v.byte_ids[b] for b in reversed(char.encode("utf-8", "surrogatepass"))] if self.bytes_of else [self.v.unknown]

    def viterbi(self, chunk: str) -> list[int]:
        if self.v.merges:
            return self.merge_path(chunk)
        n = len(chunk)
        low = float("-inf")
        best, step, via = [0.0] + [low] * n, [0] * (n + 1), [-1] * (n + 1)
        if all(c in self.single for c in chunk):
            for end, (length, piece, score, _) in self.automaton.iter(chunk):
                score += best[end + 1 - length]
                if score > best[end + 1]:
                    best[end + 1], step[end + 1], via[end + 1] = score, length, piece
        else:
            found = self.automaton.iter(chunk)
            ahead = next(found, None)
            for end in range(n):
                while ahead is not None and ahead[0] == end:
                    length, piece, score, _ = ahead[1]
                    score += best[end + 1 - length]
                    if score > best[end + 1]:
                        best[end + 1], step[end + 1], via[end + 1] = score, length, piece
                    ahead = next(found, None)
                if chunk[end] not in self.single and best[end] + self.unknown_score > best[end + 1]:
                    best[end + 1], step[end + 1], via[end + 1] = best[end] + self.unknown_score, 1, -1
        out: list[int] = []
        while n:
            out.extend([via[n]] if via[n] >= 0 else self._unknown(chunk[n - 1]))
            n -= step[n]
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        chunks = self.chunk.findall(SPACE + text.replace(" ", SPACE)) if text else []
        if len(self.memo) > self.most_words:  # words that come again are taken over from the older ones
            self.memo, self.older = {}, self.memo
        memo, long = self.memo, []
        for c in set(chunks).difference(memo):
            found = self.older.get(c)
            memo[c] = array("i", self.viterbi(c)).tobytes() if found is None else found
            if len(c) > 48:
                long.append(c)
        ids = np.frombuffer(b"".join(map(memo.__getitem__, chunks)), np.int32)
        for c in long:
            del memo[c]
        return ids

    def decode(self, ids: np.ndarray) -> str:
        has_bytes = self.is_byte[ids].any()
        ids = ids.tolist()
        if not has_bytes:
            text = "".join(map(self.text_of.__getitem__, ids))
        else:
            at, texts = self.byte_at, self.text_of
            text = b"".join(bytes((at[i],)) if i in at else texts[i].encode() for i in ids).decode("utf-8", "surrogatepass")
        text = text.replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


def encode_documents(docs: DataFrame, text_col: str = "text", model: str | Vocabulary = DEFAULT_MODEL, carry: list[str] | None = None) -> DataFrame:
    """The columns of `carry` (all but the text by default) plus n_tokens, token_ids and round_trip.

    round_trip tells whether decoding the ids gives the text back; it is false
    only for texts that hold U+2581 themselves, or for characters unknown to a
    vocabulary without bytes. A null text counts as empty and has no tokens.
    Every row is worked on alone: repeated rows come out alike, and an empty
    table gives no rows. Columns named like a result column are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    vocabulary = spark.sparkContext.broadcast(model if isinstance(model, Vocabulary) else Vocabulary.load(model))
    docs = without(docs, "n_tokens", "token_ids", "round_trip")
    carry = [c for c in docs.columns if c != text_col] if carry is None else carry
    rows = docs.select(*[F.col(f"`{c}`") for c in carry], text_of(text_col).alias("_text"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary)
        for batch in slices(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            ids = [codec.encode(t) for t in texts]
            same = [codec.decode(i) == t for i, t in zip(ids, texts, strict=True)]
            count = np.array([len(i) for i in ids], np.int32)
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(count, pa.int32()), lists, pa.array(same, pa.bool_())], [*batch.schema.names[:-1], "n_tokens", "token_ids", "round_trip"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "n_tokens int", "token_ids array<int>", "round_trip boolean"])
    return rows.mapInArrow(tokens, schema)


_codecs: dict[int, Codec] = {}


def _codec(vocabulary) -> Codec:
    """One codec for each vocabulary in a worker, with the words that it remembers."""
    v = vocabulary.value
    if id(v) not in _codecs:
        _codecs.clear()
        _codecs[id(v)] = Codec(v)
    return _codecs[id(v)]
