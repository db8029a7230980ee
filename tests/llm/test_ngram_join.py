import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from orebed.llm import ngram_join as nj
from orebed.llm.components import connected_components
from orebed.llm.shingles import MinHash, bands_for, shingle_hashes, shingle_set

DOCS = "doc_id long, text string, _id string, node string, class_id long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "e", "n", 0) for i, t in rows], DOCS)


def brute(rows, n=5, threshold=0.8):
    texts = defaultdict(list)
    for i, t in rows:
        texts[t or ""].append(i)
    keys = list(texts)
    sets = [set(shingle_set(t, n).tolist()) for t in keys]
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(keys)
    for a in range(len(keys)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k, t in enumerate(keys):
        ids = [i for i in texts[t] if i is not None]
        if ids:
            least[find(k)] = min(least.get(find(k), ids[0]), *ids)
    return {t: (least.get(find(k)), links[k], len(texts[t])) for k, t in enumerate(keys)}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def cases(rng, families=25, hot=0):
    rows = []
    for f in range(families):
        base = [f"w{rng.randrange(2000)}" for _ in range(rng.choice([4, 8, 60, 200]))]
        for _ in range(rng.randrange(1, 6)):
            rows.append(edited(rng, base, rng.choice([0, 0, 1, 2, 5])))
    base = [f"h{rng.randrange(2000)}" for _ in range(150)]
    rows += [edited(rng, base, rng.choice([0, 1, 2, 4, 6])) for _ in range(hot)]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)] + [(900, None), (901, ""), (902, "..."), (903, "One two"), (904, "one TWO!"), (None, rows[0]), (3, rows[3]), (905, "long " * 20000)]


def same(spark, rows, **options):
    want = brute(rows)
    text_of = defaultdict(set)
    for i, t in rows:
        text_of[i].add(t or "")
    got = nj.ngram_jaccard_join(frame(spark, rows), **options).collect()
    assert len(got) == len(rows)
    by_hash = {hashlib.md5(t.encode()).hexdigest(): v for t, v in want.items()}
    wrong = [(r, by_hash[r.text_md5]) for r in got if (r.class_id, r.n_links, r.n_copies) != by_hash[r.text_md5]]
    assert not wrong, wrong[:3]


def test_against_all_pairs(spark):
    same(spark, cases(random.Random(1)))


def test_components_of_many_blocks(spark, monkeypatch):
    """Blocks of four texts: leaders, far and close texts and pairs of blocks all take part."""
    monkeypatch.setattr(nj, "BLOCK_TEXTS", 4)
    same(spark, cases(random.Random(2), families=8, hot=60))


def test_long_forms_around_own_contents_are_not_compared(spark, monkeypatch):
    """Three quarters in common bring texts together in bands; sharing no rare shingle they fall apart again."""
    monkeypatch.setattr(nj, "BLOCK_TEXTS", 40)
    form = [f"form{i}" for i in range(120)]
    rows = [(i, " ".join([*form, *(f"own{i}x{j}" for j in range(25))])) for i in range(300)]
    rows += [(1000, rows[7][1] + " more"), (1001, rows[7][1] + " still more")]
    texts = spark.createDataFrame([("c", hashlib.md5(t.encode()).hexdigest(), t) for _, t in rows], "component string, node string, text string")
    parts = nj.narrowed(texts, texts.where("false").select("node"), 5, 0.8).collect()
    assert len(parts) == 3 and len({r.sub for r in parts}) == 1
    got = nj.ngram_jaccard_join(frame(spark, rows)).where("n_links > 0").collect()
    assert sorted(r.doc_id for r in got) == [7, 1000, 1001] and {r.n_links for r in got} == {2}


def test_ids_that_repeat_do_not_join_classes(spark):
    rows = [(1, "one text of its own with some words"), (1, "quite another text that has other words"), (2, "one text of its own with some words")]
    assert nj.one_of_each_class(frame(spark, rows)).count() == 2


def test_one_of_each_class(spark):
    rows = cases(random.Random(4), families=10)
    want = brute(rows)
    got = nj.one_of_each_class(frame(spark, rows))
    assert got.columns == frame(spark, rows).columns
    kept = got.collect()
    classes = {v[0] for v in want.values()}
    assert len(kept) == len(classes) and {r.doc_id for r in kept} == classes


def test_empty_table(spark):
    assert nj.ngram_jaccard_join(frame(spark, [])).count() == 0


def test_bands_reach_the_recall():
    bands, rows = bands_for(0.8, 0.9995, 160)
    assert bands * rows <= 160 and 1 - (1 - 0.8**rows) ** bands >= 0.9995
    rng = random.Random(7)
    minhash, found, total = MinHash(bands, rows), 0, 0
    for _ in range(300):
        base = [f"w{rng.randrange(5000)}" for _ in range(120)]
        a, b = shingle_hashes(" ".join(base), 5), shingle_hashes(edited(rng, base, 2), 5)
        s = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        if s >= 0.8:
            total += 1
            found += bool((minhash.band_hashes(a) == minhash.band_hashes(b)).any())
    assert total > 200 and found >= 0.99 * total


def test_intersections_in_narrow_steps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 20).astype(np.uint64)) for _ in range(9)]
    got = nj.intersections(sets[:4], sets[4:], width=7)
    assert [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]] == got.astype(int).tolist()


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (5, 4)], [(i, i + 1) for i in range(40)], [(7, 7)], [(9, i) for i in range(20)]])
def test_components(spark, edges):
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if any({a, b} != {k} and k in (a, b) for a, b in edges)}
