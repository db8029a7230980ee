import random

import numpy as np
import pytest

from orebed.llm.licenses import MATCH, TEMPLATES, TemplateIndex, align, find_licenses, fingerprint_of, grams, read_templates, scan_licenses, telling_words, winnow
from orebed.llm.shingles import WORD, word_hashes

INDEX = TemplateIndex(TEMPLATES)


def test_winnowing_guarantee():
    rng = np.random.default_rng(2)
    for _ in range(50):
        shared = rng.integers(0, 99, 5).astype(np.uint64)
        a = np.concatenate([rng.integers(100, 10**6, rng.integers(0, 20)).astype(np.uint64), shared, rng.integers(100, 10**6, 9).astype(np.uint64)])
        b = np.concatenate([rng.integers(10**6, 10**7, rng.integers(0, 20)).astype(np.uint64), shared])
        ga, gb = grams(a, 4), grams(b, 4)
        assert set(ga[winnow(ga, 2)].tolist()) & set(gb[winnow(gb, 2)].tolist())


def test_winnowing_by_definition():
    rng = np.random.default_rng(4)
    for _ in range(60):
        h = rng.integers(0, 6, rng.integers(0, 30)).astype(np.uint64)
        for w in (1, 2, 3, 5):
            spans = [range(i, i + w) for i in range(len(h) - w + 1)] or ([range(len(h))] if len(h) else [])
            assert winnow(h, w).tolist() == sorted({max(i for i in s if h[i] == h[list(s)].min()) for s in spans})


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    return row[-1]


def test_alignment_bridges_edits():
    t = word_hashes(" ".join(f"t{i}" for i in range(40)))
    words = [f"t{i}" for i in range(40)]
    words[5] = "other"
    words[12:12] = ["in", "serted"]
    del words[30:32]
    w = word_hashes("before it " + " ".join(words) + " after it")
    codes = {h: i for i, h in enumerate(t.tolist())}
    _, matched, first, last, places, same = align(np.arange(40), np.array([codes.get(h, -1) for h in w.tolist()]), 2, 16)
    assert matched == lcs(t.tolist(), w.tolist()) == 37 and (first, last) == (2, 2 + len(words))
    assert places.tolist() == [*range(2, 14), *range(16, 32), -1, -1, *range(32, 42)] and same.sum() == 37 and not same[5]


def test_every_template_is_found_in_a_text():
    index = TemplateIndex(TEMPLATES)
    for name, texts in TEMPLATES.items():
        for t in texts:
            doc = f"Some words before.\n{t}\nand after it, ÄÖ."
            hits = find_licenses(doc, index, 0.8, 16)
            assert any(h[0] == name and h[1] == 1.0 for h in hits), (name, hits)
            best = next(h for h in hits if h[0] == name)
            assert doc[best[3] : best[4]] in t


def test_scan_licenses(spark):
    rows = [(1, None), (2, ""), (3, "word " * 50_000 + "Released under the MIT License."), (4, "released under  THE mit license"), (4, "released under  THE mit license"), (5, "the license of this work"), (6, "This work is licensed under the GNU General Public License, version 3. Licensed under CC BY-NC 4.0.")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license string")
    got = sorted((r.doc_id, r.license, r.coverage) for r in scan_licenses(df).collect())
    assert got == [(3, "MIT", 1.0), (4, "MIT", 1.0), (4, "MIT", 1.0), (6, "CC-BY-NC-4.0", 1.0), (6, "GPL-3.0", 1.0)]
    assert scan_licenses(df.where("false")).count() == 0


@pytest.mark.parametrize("gap", [0, 1, 2, 5, 8, 9, 10, 11, 14, 40])
def test_mentions_at_any_distance(gap):
    notice = "Released under the MIT License."
    doc = f"{notice} {' '.join(f'w{i}' for i in range(gap))} {notice} {notice}"
    assert [(h[0], doc[h[3] : h[4]]) for h in find_licenses(doc, INDEX, 0.8, 16)] == [("MIT", notice[:-1])] * 3


def plain_best(code, text):
    """The whole table of a local alignment, word by word: (score, matched, first, last + 1, {template word: (text word, same)}) of its best cell."""
    best, rows = (0, 0, 0, 0, {}), [(0, 0, 0, ())] * (len(text) + 1)
    for i, c in enumerate(code):
        old, rows = rows, [(0, 0, 0, ())]
        for j, w in enumerate(text):
            score, matched, first, way = old[j]
            same = w == c
            options = [(score + (MATCH if same else -1), matched + same, first if score > 0 else j, ((way if score > 0 else ()), i, j, same))]
            options += [(s - 1, k, f, x) for s, k, f, x in (old[j + 1], rows[j])]
            top = max(options, key=lambda o: o[:3])
            rows.append(top if top[0] > 0 else (0, 0, 0, ()))
            if top[0] > best[0]:
                best = (top[0], top[1], top[2], j + 1, top[3])
    places, way = {}, best[4]
    while way:
        way, i, j, same = way
        places[i] = (j, same)
    return *best[:4], places


#: By hand: the words of each short form that tell its license, as runs without anything between them and the next word.
TELLING = {
    "licensed under the apache license version 2 0": ["apache license", "2"],
    "released under the mit license": ["mit license"],
    "licensed under the mit license": ["mit license"],
    "this work is licensed under the gnu general public license version 3": ["gnu general public license", "3"],
    "this work is licensed under the gnu lesser general public license version 3": ["gnu lesser general public license", "3"],
    "this work is licensed under the gnu affero general public license version 3": ["gnu affero general public license", "3"],
    "distributed under the boost software license version 1 0": ["boost software license", "1"],
    "licensed under cc by 4 0": ["cc by 4"],
    "licensed under cc by sa 4 0": ["cc by sa 4"],
    "licensed under cc by nc 4 0": ["cc by nc 4"],
    "this work is licensed under a creative commons attribution 4 0 international license": ["creative commons attribution 4", "international license"],
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": ["creative commons attribution sharealike 4", "international license"],
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": ["creative commons attribution noncommercial 4", "international license"],
}
#: By hand: in whole notices, the words that the relatives and other names would change.
IN_NOTICES = {"GPL-3.0": ["gnu general public license", "version 3"], "GPL-2.0": ["gnu general public license", "version 2"], "LGPL-2.1": ["gnu lesser general public license", "version 2 1"], "LGPL-3.0": ["gnu lesser general public license", "version 3"], "AGPL-3.0": ["gnu affero general public license", "version 3"], "MPL-2.0": ["mozilla public"], "EPL-2.0": ["eclipse public"], "Apache-2.0": ["apache license"]}


def plainly_told(name, text, span):
    """Whether the words between two places have what must stand there, read off the span itself."""
    key = " ".join(WORD.findall(text.lower()))
    runs = TELLING.get(key, IN_NOTICES.get(name, []) if len(key.split()) >= 20 else [])
    found = f" {' '.join(span)} "
    return all(f" {r} " in found for r in runs)


def plain_scan(text, min_coverage=0.8):
    """Every template aligned everywhere: found words are masked and the rest aligned again; overlaps go by score."""
    raw, words, best = WORD.findall(text.lower()), word_hashes(text).tolist(), []
    for name, texts in TEMPLATES.items():
        for t in texts:
            code, left = word_hashes(t).tolist(), list(words)
            while True:
                score, matched, first, last, _ = plain_best(code, left)
                if matched < min_coverage * len(code) - 1e-9:
                    break
                told = plainly_told(name, t, raw[first:last])
                if told or len(code) >= 20:
                    best.append((not told, -score, -matched / len(code), first, last, name if told else "unknown"))
                left[first:last] = [None] * (last - first)
    out = []
    for _, _, _, first, last, name in sorted(best):
        if all(last <= a or b <= first for a, b, _ in out):
            out.append((first, last, name))
    return sorted(out)


def changed(draw, words, share):
    n = int(share * len(words))
    at = set(draw.sample(range(len(words)), n))
    return [f"other{i}" if i in at else w for i, w in enumerate(words)]


def test_against_full_alignment_of_every_template():
    """Texts of noise and changed notices: the same mentions as by brute force."""
    draw, same, total = random.Random(5), 0, 0
    short = [(name, t) for name, texts in TEMPLATES.items() for t in texts if len(WORD.findall(t)) < 45]
    for _ in range(25):
        parts = []
        for _ in range(3):
            parts += [f"n{draw.randint(0, 50)}" for _ in range(draw.randint(0, 15))]
            parts += changed(draw, WORD.findall(draw.choice(short)[1]), draw.choice([0, 0.1, 0.2]))
        doc = " ".join(parts)
        spans = [m.span() for m in WORD.finditer(doc)]
        want = [(name, spans[a][0], spans[b - 1][1]) for a, b, name in plain_scan(doc)]
        got = [(h[0], h[3], h[4]) for h in find_licenses(doc, INDEX, 0.8, 16)]
        same += len(set(want) & set(got))
        total += len(set(want) | set(got))
    assert same / total >= 0.95, same / total


def recall(share, rounds=20):
    """Shares of changed notices that are reported at all, and under their own license; the words that tell the license stay."""
    draw, seen, right, total = random.Random(9), 0, 0, 0
    for name, texts in TEMPLATES.items():
        for t in texts:
            words = WORD.findall(t)
            groups, joined = telling_words(name, t, TEMPLATES)
            fixed = {i for g, _ in groups for i in g} | {i + d for i in joined for d in (0, 1)}
            free = [i for i in range(len(words)) if i not in fixed]
            for _ in range(rounds):
                at = set(draw.sample(free, min(len(free), int(share * len(words)))))
                hits = find_licenses(" ".join(["before", "it", *[f"other{i}" if i in at else w for i, w in enumerate(words)], "after", "it"]), INDEX, 0.8, 16)
                seen += bool(hits)
                right += any(h[0] == name for h in hits)
                total += 1
    return seen / total, right / total


@pytest.mark.parametrize("share", [0.05, 0.1, 0.15, 0.2])
def test_recall_with_changed_words(share):
    seen, right = recall(share)
    assert seen >= 0.99 and right >= 0.98, (seen, right)


@pytest.mark.parametrize(
    "text",
    [
        "Licensed under the BSD License.",
        "Licensed under the Apache License.",
        "Released under the Foo License.",
        "licensed under the bar license",
        "Distributed under the Eclipse Software License, Version 1.0.",
        "Licensed under CC BY-ND 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "Licensed under CC BY 3.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution 3.0 International License.",
        "This work is licensed under the GNU General Public License, version 2.",
        "This work is licensed under the Mozilla Public License, version 3.",
        "Licensed under the Apache License, Version 1.0.",
        "Licensed under the Foo License, Version 2.0.",
        "Released under the MIT-0 License.",
        "Distributed under the Boost Software License, Version 2.0.",
    ],
)
def test_other_names_and_numbers_are_not_attributed(text):
    assert find_licenses(f"Some words before. {text} And after it.", INDEX, 0.8, 16) == []


def test_precision_on_names_outside_the_templates():
    """Each short form with another name, number or an addition to the name: none is attributed. Whole notices with other names are unknown."""
    draw, wrong, total = random.Random(3), 0, 0
    for name, texts in TEMPLATES.items():
        for t in texts:
            words = WORD.findall(t)
            groups, _ = telling_words(name, t, TEMPLATES)
            for group, need in [g for g in groups if len(g[0]) <= 6]:  # names and numbers, no clauses
                for _ in range(20):
                    lost = set(draw.sample(group, len(group) - need + 1))
                    hits = find_licenses(" ".join(f"own{draw.randint(0, 9)}" if i in lost else w for i, w in enumerate(words)), INDEX, 0.8, 16)
                    wrong += any(h[0] == name for h in hits)
                    total += 1
    assert total > 400 and wrong == 0, (wrong, total)
    gpl = TEMPLATES["GPL-3.0"][1]
    assert [h[0] for h in find_licenses(gpl.replace("version 3", "version 7"), INDEX, 0.8, 16)] == ["unknown"]
    assert [h[0] for h in find_licenses(gpl.replace("GNU General", "GNU Greater General"), INDEX, 0.8, 16)] == ["unknown"]
    assert [h[0] for h in find_licenses(TEMPLATES["MPL-2.0"][0].replace("Mozilla", "Own"), INDEX, 0.8, 16)] == ["unknown"]


def test_right_names_beside_other_ones():
    text = "Licensed under the Foo License. Provided under the MIT License. Licensed under the terms of the MIT License."
    assert [h[0] for h in find_licenses(text, INDEX, 0.8, 16)] == ["MIT", "MIT"]


def test_fingerprints_meet_for_certain():
    for n in range(1, 400):
        k, window = fingerprint_of(n, 0.8)
        lost = int(0.2 * n + 1e-9)
        assert k + window - 1 <= max(1, -(-(n - lost) // (lost + 1)))


def test_relatives_are_told_apart():
    for name in ("AGPL-3.0", "GPL-3.0", "LGPL-3.0", "LGPL-2.1", "GPL-2.0", "BSD-2-Clause", "BSD-3-Clause"):
        for t in TEMPLATES[name]:
            assert [h[0] for h in find_licenses(t, INDEX, 0.8, 16)] == [name]


def test_a_word_that_repeats_very_often_is_quick():
    assert find_licenses("the license " * 20_000 + "under the " * 20_000, INDEX, 0.8, 16) == []


def test_templates_from_files(tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("One may do with these words whatever one likes, if one likes.")
    own = read_templates(str(tmp_path))
    assert [h[0] for h in find_licenses("so one may do with these words whatever one likes if one likes", TemplateIndex(own), 0.8, 16)] == ["Own-1.0"]
