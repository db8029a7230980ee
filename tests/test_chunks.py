"""Chunks against counting every prefix anew."""

import random
import re

from orebed.operators import chunks


def tokens(text):
    return len(re.findall(r"\w+|[^\w\s]", text))


def plain_parts(text, budget):
    out, rest = [], text.strip()
    while rest:
        if tokens(rest) <= budget:
            out.append(rest)
            break
        best = max(n for n in range(1, len(rest) + 1) if tokens(rest[:n]) <= budget and not re.match(r"\w\w", rest[n - 1 : n + 1]))
        floor = max(1, int(best * 0.8))
        blank = max(rest.rfind("\n", floor, best), rest.rfind(" ", floor, best))
        cut = blank if blank >= floor else best
        out.append(rest[:cut].strip())
        rest = rest[cut:].strip()
    return [p for p in out if p]


def random_text(r):
    words = ["a", "word", "слово", "x" * 30, "ends.", "Really?", "1.2", "no-break", "\n", "\n\n", "1.1 Clause", "## Head", "Раздел 3.1", "!!!", "  "]
    return " ".join(r.choice(words) for _ in range(r.randint(0, 120)))


def test_parts_against_counting(spark):
    r = random.Random(2)
    texts = [random_text(r)[:400] for _ in range(15)] + ["", "   ", "x" * 90, None]
    for budget in (2, 10, 40):
        for t in texts[:-1]:
            got = chunks.budget_parts(t, budget)
            assert got == plain_parts(t, budget), (t, budget)
            assert all(tokens(p) <= budget for p in got) and "".join("".join(got).split()) == "".join(t.split())
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    want = {(i, n, p) for i, t in enumerate(texts) for n, p in enumerate(plain_parts(t or "", 10))}
    assert {tuple(x) for x in chunks.split_to_budget(df, "id", "text", 10).collect()} == want


def test_structure(spark):
    r = random.Random(4)
    for _ in range(200):
        t = random_text(r)
        for size, overlap in ((60, 20), (200, 50), (200, 0)):
            got = chunks.structured_chunks(t, size, overlap)
            assert all(0 < len(c) <= size for c in got)
            # Nothing is lost: every word stands in the chunks in order.
            at, whole = 0, re.sub(r"\s+", "", "".join(got))
            for w in t.split():
                if len(w) <= 30:
                    at = whole.find(w, max(0, at - overlap * 3 - 60))
                    assert at >= 0, (w, t)
    text = "1.1 First clause. It has a second sentence.\n1.2 Next clause is here. And one more."
    assert chunks.structured_chunks(text, 500, 40) == ["1.1 First clause. It has a second sentence.\n\n1.2 Next clause is here. And one more."]
    assert chunks.structured_chunks(text, 75, 30) == ["1.1 First clause. It has a second sentence.", "It has a second sentence.\n\n1.2 Next clause is here. And one more."]
    assert chunks.structured_chunks("One two three. Four five six. Seven eight nine.", 32, 16) == ["One two three. Four five six.", "Four five six. Seven eight nine."]
    assert chunks.structured_chunks("y" * 100, 40, 10) == ["y" * 40, "y" * 40, "y" * 40]
    df = spark.createDataFrame([(1, text), (2, None), (3, " ")], "id int, text string")
    assert [(x.id, x.part) for x in chunks.split_by_structure(df, "id", "text", 75, 30).collect()] == [(1, 0), (1, 1)]


def test_chunks_go_in_small_batches(spark):
    from orebed.operators import chunks

    df = spark.createDataFrame([(i, f"One sentence. Another {i}.") for i in range(300)], "id int, text string").coalesce(1)
    out = chunks.split_by_structure(df, "id", "text", 15, 0)
    assert "MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.where("part = 1").count() == 300
