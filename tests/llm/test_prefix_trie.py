"""The prefix trie against dictionaries of tuples."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from orebed.llm.prefix_trie import SlotTable, conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = {}
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", digest(role or "", text or ""), text or ""))
    turns = {c: [(x[2], x[4]) for x in sorted(l)] for c, l in own.items()}
    built = {}
    for c, l in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        built[c] = turns.get(base, [])[:h] + l[h:]
    members = {}
    for c, l in built.items():
        for d in range(len(l) + 1):
            members.setdefault(tuple(l[:d]), []).append(c)
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        below = children.get(k, [])
        leaves[k] = sum(leaves[x] for x in below) if below else 1
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1]) if k else 0) + sum(saved[x] for x in below)
    out = []
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children.get(k, [])), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def random_rows(n, seed):
    r = random.Random(seed)
    rows = []
    for c in [*range(n), -7, -100, -193, 2**40, 2**40 + 1]:
        if r.random() < 0.1:
            continue
        for turn in range(r.choice([0, 1, 2, 3, 4, 7])):
            rows.append((c, r.choice([turn, turn, None, 0]), r.choice(["user", "bot", None, ""]), r.choice(["a", "ü𝄞", "", None, "bb"])))
    rows += [(None, 1, "user", "x"), *rows[:5]]
    rows += [(300 + i, t, "user", "the same") for i in range(60) for t in range(9)]
    rows += [(5000, t, "user", str(t % 3)) for t in range(700)]
    return rows


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("fan", [3, 16, 4096])
def test_against_dictionaries(spark, fan):
    rows = random_rows(250, fan)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(conversation_trie(df, fan)) == plain(rows)


def test_given_table(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    assert got(conversation_trie(df, 8)) == plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_odd_tables(spark):
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert conversation_trie(spark.createDataFrame([(None, None, None, None)], SCHEMA)).collect() == []
    rows = [(1, None, None, None), (1, None, None, None), (2, 1, "user", "x" * 300_000)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA + ", `a.b` int, depth string")
    assert got(conversation_trie(df)) == plain(rows)


def test_slots_are_minimal_and_verified():
    r = np.random.default_rng(1)
    a, b = r.integers(-(2**62), 2**62, (2, 5000))
    t = SlotTable(a, b)
    assert sorted(t.find(a, b)) == list(range(5000))
    assert (t.find(a, b + 1) == -1).all() and (t.find(b, a) == -1).all()
    assert len(SlotTable(a[:0], b[:0]).find(a, b)) == 5000 and (SlotTable(a[:0], b[:0]).find(a, b) == -1).all()
    with pytest.raises(ValueError):
        SlotTable(np.array([1, 1]), np.array([2, 2]))
