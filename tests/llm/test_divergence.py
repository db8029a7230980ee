"""Source divergence against whole numbers added up term by term."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from orebed.llm import divergence
from orebed.llm.divergence import UNIT, priced_pairs, source_divergence

SCHEMA = "doc_id long, lang string, source string, text string"
TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least=3, top=200):
    counts, docs, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        terms = TERMS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
        langs[lang].add(source)
    out = set()
    for lang, sources in langs.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        every = sum((counts[lang, s] for s in sources), Counter())

        def shares(c):
            over = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + UNIT * (c[t] + 1) // over for t in kept}

        q, p = shares(every), {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            cost = lambda a, b: (a - b) ** 2 // b
            pairs = [(o, sum(cost(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            telling = [(t, cost(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, l, most in (("pair", pairs, len(pairs)), ("term", telling, top)):
                for rank, (item, v) in enumerate(sorted(l, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.add((lang, s, part, item, v, rank))
    return out


def got(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def random_rows(n, seed):
    r = random.Random(seed)
    words = ["The", "the", "ÉTÉ", "été", "a-b", "x1y", "中文", "😀", "#", "ﬀ", "z" * 500, *[f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]]
    out = []
    for i in range(n):
        lang, source = r.choice(["en", "en", "en", "de", None, ""]), r.choice(["hot", "hot", "a", "b", "Ä", None, ""])
        out.append((i, lang, source, " ".join(r.choice(words[: r.choice([5, 40, 130])]) for _ in range(r.choice([0, 1, 9, 60])))))
    return out + [(n, "xx", "one", "rare words"), (n + 1, "xx", "two", None), (n + 2, "alone", "one", "same same"), (n + 2, "alone", "one", "same same"), (n + 2, "alone", "one", "same")]


@pytest.mark.parametrize("block", [16, 4096])
def test_against_plain_sums(spark, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", block)
    rows = random_rows(400, block)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", `a.b` string, term int").repartition(5)
    assert got(source_divergence(df)) == plain(rows)


def test_only_the_first_terms_are_ranked(spark):
    rows = [(i, "en", f"s{i % 2}", " ".join(f"t{'abcdefghij'[i % 2 * 5 + k % 5]}{chr(97 + k // 5)}" for k in range(100))) for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(source_divergence(df, top=7)) == plain(rows, top=7)


def test_given_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(source_divergence(df)) == plain([(r.doc_id, r.lang, r.source, r.text) for r in df.collect()])


def test_empty_table(spark):
    assert source_divergence(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("tile", [4, 2048])
def test_products_give_every_joint_table(monkeypatch, tile):
    monkeypatch.setattr(divergence, "TILE", tile)
    r = np.random.default_rng(tile)
    counts = r.zipf(1.4, (300, 7)).clip(max=10**12) - 1
    totals = [int(n) + 300 for n in counts.sum(axis=0)]
    p = [[1 + UNIT * (int(c) + 1) // totals[g] for g, c in enumerate(row)] for row in counts]
    want = [[sum((row[a] - row[b]) ** 2 // row[b] for row in p) for b in range(7)] for a in range(7)]
    assert priced_pairs(counts, totals).tolist() == want
