import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from orebed.llm.exact_dedup import exact_dedup
from orebed.llm import line_dedup
from orebed.llm.line_dedup import dedup_lines, fingerprints
from orebed.llm.mixing import WORD, apportion, mix_documents, mix_plan, source_targets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)
    return df.withColumns({"keep_id": F.lit("x"), "size": F.lit("y"), "removed_lines": F.lit(7), "node": F.lit(1), "_id": F.lit(2)}) if extra else df


ODD = [(1, None, "a"), (2, "", "b"), (3, "same text", None), (4, "same text", "a"), (4, "same text", "a"), (None, "same text", "a"), (None, None, None), (5, "word " * 30000, "a"), (6, "\n\n \t", "b")]


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup_against_plain_python(spark, keep):
    got = exact_dedup(frame(spark, ODD, extra=True), keep=keep).collect()
    groups = defaultdict(list)
    for i, t, _ in ODD:
        groups[t or ""].append(i)
    assert len(got) == len(ODD)
    pick = min if keep == "min" else max
    for r in got:
        ids = next(v for t, v in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (pick(known) if known else None)
        assert r.kept == (r.doc_id == r.keep_id)


def test_exact_dedup_tells_texts_apart_that_share_a_hash(spark):
    rows = [(1, "aaaa", "s"), (2, "bbbb", "s"), (3, "aaaa", "s"), (4, "cc", "s")]
    got = exact_dedup(frame(spark, rows), keep="min", content_hash=lambda t: F.length(t).cast("string")).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(1, 1, 2, True), (2, 2, 1, True), (3, 1, 2, False), (4, 4, 1, True)]


def test_exact_dedup_with_many_repeated_texts_takes_the_shuffled_join(spark):
    few, many = (exact_dedup(frame(spark, ODD), most_broadcast=n).collect() for n in (100, 0))
    assert sorted(map(str, few)) == sorted(map(str, many))


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert exact_dedup(empty).count() == dedup_lines(empty).count() == mix_plan(empty).count() == mix_documents(empty).count() == 0


def brute_lines(rows, least=50):
    seen, out = set(), {}
    for i, t in sorted({(i, t or "") for i, t, _ in rows}, key=lambda x: (x[0] is not None, x[0] or 0)):
        lines = t.split("\n")
        words = [len(x.split()) for x in lines]
        gone = set()
        new = []
        for a in range(len(lines)):
            if not words[a]:
                continue
            b, n = a, 0
            part = []
            while b < len(lines) and n < least:
                n += words[b]
                if words[b]:
                    part.append(lines[b])
                b += 1
            if n < least:
                continue
            if tuple(part) in seen:
                gone.update(range(a, b))
            seen.add(tuple(part))
            new.append(tuple(part))
        out[i, t] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_dedup_against_plain_python(spark):
    rng = random.Random(3)
    line = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randrange(99)) for _ in range(n))
    pool = [line(rng.choice([3, 9, 20, 55])) for _ in range(40)]
    passage = [line(20), line(3), line(30)]
    rows = []
    for i in range(40):
        body = [rng.choice([*pool, line(12), ""]) for _ in range(rng.randrange(1, 12))]
        if i % 3 == 0:
            at = rng.randrange(len(body) + 1)
            body[at:at] = passage
        rows.append((i, "\n".join(body), "s"))
    rows += [(100, None, "s"), (101, "", "s"), (5, rows[5][1], "s"), (102, "\n".join(passage * 3), "s")]
    want = brute_lines(rows)
    got = dedup_lines(frame(spark, rows, extra=True)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id == 100:
            assert r.text is None and r.removed_lines == 0
        else:
            assert r.text == want[r.doc_id, next(t or "" for i, t, _ in rows if i == r.doc_id)], r.doc_id
    assert sum(passage[2] in (r.text or "") for r in got) == 1


def test_selected_lines_are_the_least_of_their_windows(spark):
    """Each full window of lines selects its least line, and nothing else is selected."""
    rng = random.Random(6)
    rows = [(i, "\n".join(" ".join(f"w{rng.randint(0, 3)}" for _ in range(rng.randint(0, 6))) for _ in range(40)), "s") for i in range(5)]
    df = frame(spark, rows)
    least = {r.line: r.h for r in df.select(F.explode(F.split("text", "\n")).alias("line")).select("line", F.xxhash64("line").alias("h")).collect()}
    for i, text, _ in rows:
        lines = [(k, x) for k, x in enumerate(text.split("\n")) if x.split()]
        want = defaultdict(list)
        for a in range(len(lines)):
            words, b = 0, a
            while b < len(lines) and words < 20:
                words += len(lines[b][1].split())
                b += 1
            if words >= 20:
                at = min(range(a, b), key=lambda k: (least[lines[k][1]], k))
                want[at].append((lines[a][0], lines[b - 1][0]))
        got = fingerprints(df.where(F.col("doc_id") == i), "doc_id", "text", 20).collect()
        assert sorted([(w._pos, w._end) for w in r._windows] for r in got) == sorted(want.values())
        assert sorted(r._fp for r in got) == sorted(least[lines[k][1]] for k in want)


def test_line_dedup_rests_on_the_selected_lines(spark, monkeypatch):
    """Without the selected positions nothing is found; with them the later copies go."""
    run = "\n".join(f"line {i} of a run that repeats" for i in range(9))
    df = frame(spark, [(i, f"before {i}\n{run}\nafter {i}", "s") for i in range(4)])
    assert sorted(r.removed_lines for r in dedup_lines(df).collect()) == [0, 9, 9, 9]
    whole = fingerprints
    monkeypatch.setattr(line_dedup, "fingerprints", lambda *a: whole(*a).where("false"))
    assert dedup_lines(df).where("removed_lines > 0").count() == 0


def sainte_lague(votes, seats):
    won = Counter()
    for _ in range(seats):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return [won[i] for i in range(len(votes))]


@pytest.mark.parametrize("votes,seats", [([5, 3, 1], 9), ([1, 1, 1, 1], 2), ([100, 1, 1, 1], 17), ([7.5, 2.25, 0, 0.25], 40), ([3], 5)])
def test_apportion_is_sainte_lague(spark, votes, seats):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(votes)], "i long, v double")
    got = {r.i: r._quota for r in apportion(df, "v", F.lit(seats), "i").collect()}
    assert [got[i] for i in range(len(votes))] == sainte_lague(votes, seats)


def test_targets_stop_at_three_times_the_size(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 10), (None, 1000)], "_source string, size long")
    t = {r._source: (r.source_size, r.target) for r in source_targets(sizes).collect()}
    assert t["a"][1] == 30 and t["c"][1] <= 30 and abs(sum(x[1] for x in t.values()) - 2020) < 1e-6
    assert all(x[1] <= 3 * x[0] + 1e-9 for x in t.values())


def test_mix_takes_what_it_plans(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("w%d" % rng.randrange(50) for _ in range(rng.randrange(0, 200))), rng.choice(["a", "a", "a", "a", "b", "c", "d", None])) for i in range(400)]
    rows += [(1000, None, "a"), (1001, " \n", "b"), (1002, "x " * 5000, "c"), (3, rows[3][1], rows[3][2])]
    docs = frame(spark, rows, extra=True)
    plan = mix_plan(docs, shard_rows=50)
    got = plan.select("_id", "_source", "size", "source_size", "target", "taken").collect()
    again = plan.select("_id", "_source", "size", "source_size", "target", "taken").collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r._source] += r.taken
        target[r._source] = r.target
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.03 * t, s
    mixed = mix_documents(docs, shard_rows=50)
    assert mixed.columns == docs.columns
    words = {r[0]: r[1] for r in mixed.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(WORD)))).collect()}
    assert words == {s: n for s, n in taken.items() if n}


def test_mix_of_nothing_but_empty_texts(spark):
    got = mix_plan(frame(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [r.taken for r in got] == [0, 0] and {r.target for r in got} == {0.0}
