"""Packing: ids against the tokenizer's own, pieces against one long list cut by hand."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from orebed.llm.packing import DEFAULT_TOKENIZER, WordTokens, _tail_ends, pack_documents, sequences


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(DEFAULT_TOKENIZER)


@pytest.fixture(scope="module")
def words():
    return WordTokens(DEFAULT_TOKENIZER)


def own(words, text):
    return np.frombuffer(words.of(text), words.dtype).tolist()


def test_ids_are_the_tokenizers_own(spark, sf, words, tokenizer):
    assert words.splits and words.simple
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect():
        assert own(words, r.text or "") == tokenizer.encode(r.text or "", add_special_tokens=False).ids


def test_ids_of_odd_texts(words, tokenizer):
    r = random.Random(4)
    some = ["the", "Straße", "l'été", "I'm", "'s'S", "it's", "A1b22", "...", "<|endoftext|>", "a<|startoftext|>b", "<|", "|>", "é", "é", "́", "ΑΣ", "ſ", "İ", "ª", "µ", "中文", "😀👍", " ", "\x1c", "\t", "\r\n", "\n", " ", "  ", "　", "ŉ", "Ǆ", "x" * 200, "_-_", "½", "٣", "\x00", "ÿ×÷Ø"]
    for _ in range(1500):
        text = "".join(r.choice(some) for _ in range(r.randint(1, 9)))
        assert own(words, text) == tokenizer.encode(text, add_special_tokens=False).ids, text
    for _ in range(500):
        text = "".join(chr(r.choice([r.randint(1, 0x250), r.randint(32, 126), r.randint(0x300, 0x600), r.randint(0x1F00, 0x2100)])) for _ in range(30))
        assert own(words, text) == tokenizer.encode(text, add_special_tokens=False).ids, text


def held(pieces, docs, tokenizer, size):
    """Each id in one piece, sequences gapless, crc of the pieces, and as little padding as there can be."""
    want = {}
    for i, text in docs:
        want.setdefault(i, []).append(tokenizer.encode(text or "", add_special_tokens=False).ids + [2])
    by_seq, by_doc = {}, {}
    for p in pieces:
        ids = np.frombuffer(bytes(p.ids), "<u4").tolist()
        assert len(ids) == p.length > 0
        by_seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
        by_doc.setdefault(p.doc_id, []).append((p.start, ids, p.doc_tokens))
    for i, l in want.items():
        if len(l) == 1:
            rows = sorted(by_doc[i])
            assert sum((r[1] for r in rows), []) == l[0]
            assert [r[0] for r in rows] == np.cumsum([0, *[len(r[1]) for r in rows]])[:-1].tolist()
            assert {r[2] for r in rows} == {len(l[0])}
    assert by_doc.keys() == want.keys()
    total = sum(len(x) for l in want.values() for x in l)
    assert sum(p.length for p in pieces) == total
    lengths = []
    for s in range(len(by_seq)):
        at = 0
        for offset, n in sorted(by_seq[s]):
            assert offset == at
            at += n
        lengths.append(at)
    assert all(n <= size and n & (n - 1) == 0 for n in lengths)
    assert lengths == sorted(lengths, reverse=True) and lengths.count(size) == total // size


def test_pieces_of_the_given_table(spark, sf, tokenizer):
    df = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    held(pack_documents(df).collect(), [(r.doc_id, r.text) for r in df.collect()], tokenizer, 4096)


def test_odd_rows(spark, tokenizer):
    rows = [(1, "a b"), (None, "null id"), (3, None), (4, ""), (5, "word " * 30_000), (6, "twice"), (6, "twice"), (7, " \n ")]
    df = spark.createDataFrame([(*r, "x", 5, 1) for r in rows], "doc_id int, text string, ids string, `a.b` int, part int").repartition(3)
    pieces = pack_documents(df, size=64)
    assert pieces.schema["doc_id"].dataType.simpleString() == "int"
    held(pieces.collect(), rows, tokenizer, 64)
    assert pack_documents(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        pack_documents(df, size=100)


def test_sequences_are_whole(spark, tokenizer):
    df = spark.createDataFrame([(i, f"some words of document {i} " * (i % 7)) for i in range(60)], "doc_id long, text string").repartition(4)
    pieces = pack_documents(df, size=32)
    rows = {r.sequence_id: r for r in sequences(pieces).collect()}
    for p in pieces.collect():
        s = bytes(rows[p.sequence_id].ids)
        assert s[4 * p.offset : 4 * (p.offset + p.length)] == bytes(p.ids) and p.doc_id in rows[p.sequence_id].doc_ids
    assert all(len(r.ids) == 4 * r.length for r in rows.values())


def test_the_query_hashes_pieces(spark, sf):
    from orebed.llm.queries import op12_packing

    docs = pack_documents(spark.read.parquet(f"{sf}/documents.parquet"))
    want = sorted((p.doc_id, p.start, p.length, zlib.crc32(bytes(p.ids)), p.doc_tokens, p.sequence_id, p.offset) for p in docs.collect())
    df = op12_packing(spark, sf)
    assert df.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert sorted(map(tuple, df.collect())) == want


def test_tails():
    assert _tail_ends(0, 8) == [] and _tail_ends(8, 8) == [] and _tail_ends(13, 8) == [12, 13] and _tail_ends(7, 8) == [4, 6, 7]
