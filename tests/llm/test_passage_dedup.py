import random

from orebed.llm.line_dedup import dedup_lines
from orebed.llm.passage_dedup import cut, dedup_passages

from .test_dedup_and_mix import frame


def brute_passages(rows, least):
    """The words that stay of each document, window by window; no two texts of the rows share an id."""
    seen, out = set(), {}
    for i, t in sorted({(i, t or "") for i, t, _ in rows}):
        words, gone = t.split(), set()
        for a in range(len(words) - least + 1):
            part = tuple(words[a : a + least])
            if part in seen:
                gone.update(range(a, a + least))
            seen.add(part)
        out[i] = [w for k, w in enumerate(words) if k not in gone]
    return out


def test_passage_inside_a_line_goes(spark):
    passage = " ".join(f"p{k}" for k in range(59))
    rows = [(1, f"one two {passage} three", "s"), (2, f"four\nfive {passage} six\nseven", "s"), (3, f"eight {passage.replace('p30 ', 'p30' + chr(10))} nine", "s")]
    assert all(r.removed_lines == 0 for r in dedup_lines(frame(spark, rows)).collect())
    got = {r.doc_id: r for r in dedup_passages(frame(spark, rows, extra=True)).collect()}
    assert got[1].text == rows[0][1] and got[1].removed_words == 0
    assert got[2].text == "four\nfive six\nseven" and (got[2].removed_words, got[2].removed_passages) == (59, 1)
    assert got[3].text == "eight nine"


def test_passages_against_plain_python(spark):
    rng = random.Random(7)
    pool = [[f"w{rng.randrange(30)}" for _ in range(rng.choice([4, 9, 14, 40]))] for _ in range(12)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randrange(1, 9)):
            part = list(rng.choice(pool))
            if rng.random() < 0.4:
                part[rng.randrange(len(part))] = f"x{i}"
            words += part[rng.randrange(3) :]
        rows.append((i, "".join(w + rng.choice([" ", " ", "\n"]) for w in words), "s"))
    rows += [(100, None, "s"), (101, "", "s"), (5, rows[5][1], "s"), (102, "a b c " * 40, "s"), (103, "same " * 60, "s")]
    for least in (10, 11):
        want = brute_passages(rows, least)
        got = dedup_passages(frame(spark, rows), min_words=least).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.text or "").split() == want[r.doc_id], r.doc_id
            assert r.text is not None or r.doc_id == 100
        assert sum(r.removed_words for r in got) > 500
    assert dedup_passages(frame(spark, [])).count() == 0


def test_cut_keeps_one_gap():
    assert cut("a\nb c\nd", [(1, 3)]) == ("a\nd", 2, 1)
    assert cut("a b c\nd", [(1, 2), (2, 3)]) == ("a\nd", 2, 1)
    assert cut("a b\n", [(0, 2)])[0] == "\n" and cut("a b c", [(0, 1)])[0] == "b c" and cut("a b c", [(2, 3)])[0] == "a b"
