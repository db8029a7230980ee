"""Ordered folds and checks of answers against loops."""

import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from orebed.operators import answers, fold


def plain_pack(hits, budget, least=80):
    """hits: (rank, name, text, family) in order."""
    first, rest, seen = [], [], set()
    for h in sorted(hits):
        (rest if h[3] in seen else first).append(h)
        seen.add(h[3])
    used, out = 0, []
    for rank, name, text, _ in first + rest:
        clean = text or ""
        if "<br" in clean.lower():
            clean = re.sub(r"[ \t]{2,}", " ", re.sub(r"\*\*\s*\*\*", " ", re.sub(r"(?i)<br\s*/?>", " ", clean)))
        label, left = f"[{name or ''}]:\n", budget - used
        if len(label) + len(clean) > left:
            if left <= len(label) + least:
                continue
            clean = clean[: max(0, left - len(label) - 1)].rstrip(" ") + "…"
        if len(label) + len(clean) > left:
            continue
        used += len(label) + len(clean) + (2 if out else 0)
        out.append((rank, len(out) + 1, label + clean))
        if used >= budget:
            break
    return out


def test_packing_against_a_loop(spark):
    r = random.Random(3)
    rows = []
    for q in range(60):
        for rank in range(1, r.choice([1, 2, 8, 20])):
            text = r.choice([None, "", "x" * r.randint(1, 400), "word " * r.randint(1, 60), "a<br>b **<br/>** c  d", "ä" * 90 + " " * 30])
            rows.append((q, rank, r.choice(["a", "bb", None, "c" * 30]), text, r.choice(["f", "g", None])))
    df = spark.createDataFrame(rows, "q int, rank int, name string, text string, family string")
    for budget in (120, 300, 1000):
        got = {}
        for x in fold.pack_context(df, ["q"], "rank", F.col("name"), F.col("text"), F.col("family"), budget).collect():
            got.setdefault(x.q, []).append((x.rank, x.nth, x.part))
        want = {q: p for q in range(60) if (p := plain_pack([x[1:] for x in rows if x[0] == q], budget))}
        assert {q: sorted(p, key=lambda x: x[1]) for q, p in got.items()} == want
    oversized = spark.createDataFrame([(1, 1, "n", "y" * 50, "f"), (1, 2, "n", "z" * 100, "f"), (1, 3, "n", "short", "f")], df.schema)
    assert [x.rank for x in fold.pack_context(oversized, ["q"], "rank", F.col("name"), F.col("text"), F.col("family"), 70).collect()] == [1, 3]


def test_hits_within_reach_are_packed_alike(spark):
    """What the extents of texts leave out is never packed; of long texts only the first is left, whatever the order of families."""
    r = random.Random(4)
    rows = []
    for q in range(60):
        for rank in range(1, r.choice([2, 8, 20])):
            text = r.choice([None, "", "x" * r.randint(1, 400), "word " * r.randint(1, 60), "a<br>b **<br/>** c  d", "ä" * 90 + " " * 130 + "z" * 90, "y z" * 200])
            rows.append((q, rank, r.choice(["a", None, "c" * 30]), text, r.choice(["f", "g", None])))
    df = spark.createDataFrame(rows, "q int, rank int, name string, text string, family string")
    c, found = F.col, lambda d: sorted(map(tuple, d.collect()))
    for budget in (120, 300):
        near = fold.within_reach(df.withColumn("e", fold.extent(c("text"), budget)).drop("text"), ["q"], "rank", c("name"), c("e"), c("family"), budget).join(df.select("q", "rank", "text"), ["q", "rank"])
        got = fold.pack_beginnings(near.withColumn("b", fold.beginning(c("text"), budget)), ["q"], "rank", c("name"), c("b"), c("family"), budget, later=c("later"))
        assert found(got) == found(fold.pack_context(df, ["q"], "rank", c("name"), c("text"), c("family"), budget))
    long = df.limit(0).unionAll(spark.createDataFrame([(1, i, "n", "y" * 500, "f" if i < 9 else "g") for i in range(1, 10)], df.schema))
    assert [x["rank"] for x in fold.within_reach(long.withColumn("e", fold.extent(c("text"), 200)), ["q"], "rank", c("name"), c("e"), c("family"), 200).collect()] == [1]


def test_clusters_against_a_loop(spark):
    r = random.Random(5)
    rows = [(g, r.choice([None, float(r.randint(0, 40)), r.random() * 20, 1e6])) for g in "abc" for _ in range(120)]
    want = []
    for g in "abc":
        clusters = []
        for v in sorted(v for h, v in rows if h == g and v is not None):
            if not clusters or abs(v - sum(clusters[-1]) / len(clusters[-1])) > 1.5:
                clusters.append([v])
            else:
                clusters[-1].append(v)
        want += [(g, round(sum(c) / len(c), 4), len(c)) for c in clusters]
    df = spark.createDataFrame(rows, "g string, v double")
    got = [(x.g, round(x.centre, 4), x.n) for x in fold.mean_clusters(df, ["g"], "v", 1.5).collect()]
    assert sorted(got) == sorted(want)
    assert fold.mean_clusters(df.limit(0), ["g"], "v", 1.5).collect() == []


def test_combinations_against_the_product(spark):
    r = random.Random(8)
    rows = [(s, w, f"c{o}", r.choice([None, 1, 2, 2, 3, 10])) for s in "xy" for w in range(5) for o in range(r.randint(1, 5))]
    df = spark.createDataFrame(rows, "s string, w int, c string, p int")
    for k, cheap in itertools.product((1, 2, 4), (True, False)):
        want = []
        for s in "xy":
            works = {}
            for t, w, c, p in rows:
                if t == s and p is not None:
                    works.setdefault(w, []).append((p if cheap else -p, c))
            ways = sorted((sum(o[0] for o in x), [o[1] for o in x]) for x in itertools.product(*[works[w] for w in sorted(works)]))[:k]
            want += [(s, n, t if cheap else -t, c) for n, (t, c) in enumerate(ways, 1)]
        got = [(x.s, x.nth, int(x.total), list(x.codes)) for x in fold.best_combinations(df, "s", "w", "c", "p", k, cheap).collect()]
        assert sorted(got) == sorted(want)


def test_cache_by_text_and_vector(spark):
    cache = [("s", 1, "How many?", [1.0, 0.0], True), ("s", 2, "Other", [0.0, 1.0], True), ("s", 3, "Unverified", [0.6, 0.8], False), ("s", 4, "Zero", [0.0, 0.0], True), ("t", 5, "How many?", [1.0, 0.0], True), (None, 6, "x", [1.0, 0.0], True), ("s", 7, "Twin", [1.0, 0.0], True), ("s", 8, None, None, True)]
    asked = [("s", "exact", "  HOW   many? ", [-1.0, 0.0]), ("s", "near", "Roughly?", [0.9, 0.1]), ("s", "far", "Nothing", [-1.0, 0.0]), ("s", "zero", "Void", [0.0, 0.0]), ("u", "scopeless", "How many?", [1.0, 0.0]), (None, "null", "How many?", [1.0, 0.0]), ("s", "odd", "Length", [1.0]), ("t", "other", "Roughly?", [0.6, 0.8])]
    c = spark.createDataFrame(cache, "scope string, id int, q string, v array<double>, ok boolean")
    q = spark.createDataFrame(asked, "scope string, id string, q string, v array<double>")
    ask = lambda df, k=500: {x.qid: (x.entry, round(x.similarity, 4)) for x in answers.cached_answers(q, df.withColumnRenamed("id", "entry"), "id", "entry", "scope", "q", "v", "entry", F.col("ok"), 0.5, k).collect()}
    near = round(float(np.dot([0.9, 0.1], [1, 0]) / np.linalg.norm([0.9, 0.1])), 4)
    assert ask(c) == {"exact": (1, 1.0), "near": (7, near), "other": (5, 0.6)}  # of the twins the newest
    assert ask(c, 1) == {"other": (5, 0.6)}  # only the newest entry, which has no vector, is asked
    assert ask(c.limit(0)) == {}


def test_verdicts(spark):
    rows = [
        ("Any answer", "  ", "NO_DATA", "empty_context"),
        ("Any answer", None, "NO_DATA", "empty_context"),
        ("Толщина 250 мм!", "по проекту толщина — 250 мм, не менее", "VERIFIED", "answer_text_found_in_context"),
        ("Толщина 300 мм", "толщина 250 мм", "HALLUCINATION", "answer_numeric_claim_not_in_context"),
        ("толщина стены по разделу 5 от 12.03.2024", "толщина кирпичной стены 250", "VERIFIED", "lexical_overlap"),
        ("совсем иное дело", "толщина 250 мм", "NO_DATA", "rules_cannot_verify_overlap"),
        (None, "context", "NO_DATA", "rules_cannot_verify_overlap"),
    ]
    df = spark.createDataFrame(rows, "a string, c string, want string, why string")
    for x in answers.verdicts(df, "a", "c").collect():
        assert (x.verdict, x.reason) == (x.want, x.why), x


def test_claimed_numbers(spark):
    cases = {"высота 3,5 м и 12 шт": ["3.5"], "1) пункт 7, 99 и 100": ["100"], "в 2023 году 5 кг": ["5"], "12.05.2021 табл. 4": [], "7 чел, 8 столов": [], "есть 7 чел, 8 столов": ["7"], "1.000": [], "вес 1.000": ["1.000"], "": [], None: [], "рис 5-7 и 0250": ["0250"]}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for x in df.select("t", answers.claimed_numbers(F.col("t")).alias("n")).collect():
        assert sorted(x.n) == sorted(cases[x.t]), x


def test_unproven_numbers(spark):
    rows = [("сумма 15 030,72 и 1999 и 12 345", "всего 15030.72", ["12 345"]), ("100 200 300", None, ["100 200 300"]), (None, "x", []), ("123", "", [])]
    df = spark.createDataFrame(rows, "a string, c string, want array<string>")
    for x in df.select("want", answers.unproven_numbers(F.col("a"), F.col("c")).alias("n")).collect():
        assert x.n == x.want


def test_boosted_hits_hold_only_beginnings(spark, sf):
    from orebed.plans import retrieve

    hits = retrieve.boosted_hits(spark, sf, 100)
    assert "text" not in hits.columns and hits.selectExpr("max(length(begin.text)) = 100 and max(begin.chars) > 100").head()[0]
