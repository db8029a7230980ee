import random

import pytest
from pyspark.sql import functions as F

from orebed.operators import aggregate, cost, evaluate, graph, join, retrieval, sets, window
from orebed.session import checkpointed


def test_standard_aggregate(spark):
    rows = [("Раздел 1", "Кабель ВВГ", "01", 10.0, 100.0, None), ("Раздел 1", "Лоток", "02", 5.0, 200.0, None), ("Раздел 2", "Кабель НЮМ", "03", 3.0, 50.0, None)]
    df = spark.createDataFrame(rows, "section string, name string, code string, qty double, amount double, raw_row string")
    assert [(r.section, r.value) for r in aggregate.standard_aggregate(df, "amount", "sum", "section").collect()] == [("Раздел 1", 300.0), ("Раздел 2", 50.0)]
    assert aggregate.standard_aggregate(df, "amount", "sum", contains="кабель").head().value == 150.0
    assert aggregate.standard_aggregate(df, "amount", "count").head().value == 3
    for bad in ({"field": "nope"}, {"field": "qty", "op": "median"}, {"field": "qty", "group_by": "raw_row"}):
        with pytest.raises(ValueError):
            aggregate.standard_aggregate(df, **bad)


def test_values_from_the_raw_row(spark):
    rows = [(None, None, None, '{"Коли-\\nчество": "10", "Сумма": "100,50", "Раздел": "Раздел А"}'), (None, 0.0, 0.0, '{"Кол-во": "5", "Сумма": "200", "Раздел": "Раздел А"}'), (None, 7.0, None, '{"Кол-во": "999", "Сумма": "1 019,39", "Раздел": "Раздел Б"}')]
    df = spark.createDataFrame(rows, "section string, qty double, amount double, raw_row string")
    assert aggregate.standard_aggregate(df, "qty").head().value == 22.0
    assert round(aggregate.standard_aggregate(df, "amount").head().value, 2) == 1319.89
    assert {r.section: r.value for r in aggregate.standard_aggregate(df, "qty", group_by="section").collect()} == {"Раздел А": 15.0, "Раздел Б": 7.0}


def test_quotes(spark):
    rows = [("Кабель", "a", "2 300"), ("кабель.", "b", "2 400,0"), (" КАБЕЛЬ", "c", "2520"), ("Лоток", "a", "10"), ("Лоток", "b", None)]
    df = spark.createDataFrame(rows, "material string, supplier string, price string")
    from orebed.functions.numbers import price_number

    by = {r.material: r for r in aggregate.quote_analysis(df, "material", "supplier", price_number(F.col("price"))).collect()}
    assert by["кабель"].sufficient and by["кабель"].chosen_price == 2300.0 and by["кабель"].spread_pct == 9.6
    assert not by["лоток"].sufficient and by["лоток"].n_offers == 1
    mid = {r.material: r.chosen_supplier for r in aggregate.quote_analysis(df, "material", "supplier", price_number(F.col("price")), "median").collect()}
    assert mid["кабель"] == "b"


def test_plan_and_fact(spark):
    p = spark.createDataFrame([("a", 100.0), ("b", 50.0), ("c", 5.0)], "k string, q double")
    f = spark.createDataFrame([("a", 40.0), ("b", 65.0), ("d", 1.0)], "k string, q double")
    got = {r.k: r for r in join.plan_fact(p, f, "k", "q", "q").collect()}
    assert (got["a"].status, got["a"].delta, got["a"].remaining, got["a"].done_pct) == ("matched", -60.0, 60.0, 40.0)
    assert (got["b"].status, got["b"].delta, got["b"].done_pct) == ("over", 15.0, 130.0)
    assert (got["c"].status, got["d"].status) == ("plan_only", "fact_only")


def test_reconcile(spark):
    side = lambda rows: spark.createDataFrame(rows, "k string, q double")
    got = {r.k: r.status for r in join.reconcile({"x": side([("a", 10.0), ("a", 5.0), ("b", 100.0), ("c", 1.0), ("d", 5.0)]), "y": side([("a", 15.1), ("b", 90.0), ("d", 5.0)]), "z": side([("a", 15.0), ("b", 100.0)])}, "k", "q").collect()}
    assert got == {"a": "match", "b": "mismatch", "c": "single", "d": "gap"}


def test_fuzzy_first_line(spark):
    plan = spark.createDataFrame([("m", "кабель ввг", 2), ("m", "кабель", 1), ("m", "лот", 3)], "u string, n string, o long")
    fact = spark.createDataFrame([("m", "кабель ввг 3х1.5", 1), ("m", "лоток", 2), ("t", "кабель", 3)], "u string, n string, id long")
    assert {r.id: r.plan_line for r in join.fuzzy_first(plan, fact, "u", "n", "o", "id").collect()} == {1: 1, 2: None, 3: None}


def test_as_of(spark):
    l = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9)], "id long, k string, t long")
    r = spark.createDataFrame([("a", 2, 1.0), ("a", 5, 2.0), ("b", 10, 3.0)], "k string, t long, v double")
    assert {x.id: x.v for x in join.as_of(l, r, ["k"], "t", "t", ["v"]).collect()} == {1: 2.0, 2: None, 3: None}


def test_lookup_and_priority(spark):
    l = spark.createDataFrame([(1, "a"), (2, "z")], "id long, c string")
    r = spark.createDataFrame([("a", 5.0, 2), ("a", 7.0, 1)], "code string, price double, o long")
    assert {x.id: x.price for x in join.lookup(l, r, "c", "code", ["price"], [F.col("o")]).collect()} == {1: 7.0, 2: None}
    value, name = join.prioritised([("x", F.lit(None).cast("double")), ("y", F.lit(2.0))])
    assert tuple(spark.range(1).select(value, name).head()) == (2.0, "y")


def test_diff_and_latest(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 1), (3, "z", None)], "k long, s string, n int")
    b = spark.createDataFrame([(1, "x", 1), (2, "Y", 2), (4, "w", 1)], "k long, s string, n int")
    assert {r.k: (r.status, r.changed) for r in sets.keyed_diff(a, b, "k", ["s", "n"]).collect()} == {1: ("unchanged", ""), 2: ("changed", "s,n"), 3: ("removed", ""), 4: ("added", "")}
    assert {r.k: r.s for r in sets.priority_union([(1, a), (2, b)], ["k"], [F.col("s")]).collect()} == {1: "x", 2: "Y", 3: "z", 4: "w"}


def test_windows(spark):
    df = spark.createDataFrame([(1, i, "h" if i % 3 == 0 else "t") for i in range(9)], "d long, o long, s string")
    assert [r.h for r in window.carried(df, ["d"], ["o"], F.when(F.col("s") == "h", F.col("o")), "h").orderBy("o").collect()] == [0, 0, 0, 3, 3, 3, 6, 6, 6]
    assert [r.run for r in window.runs(df, ["d"], ["o"], F.col("s")).orderBy("o").collect()] == [1, 2, 2, 3, 4, 4, 5, 6, 6]
    assert [(r.parent_ord, r.child_ord) for r in window.parents(df, "d", "o").orderBy("o").collect()][3:5] == [(0, 3), (1, 0)]


def test_fusion(spark):
    rank = lambda ids: spark.createDataFrame([(x, i + 1) for i, x in enumerate(ids)], "id string, rank int")
    got = {r.id: r.score for r in retrieval.fuse([("d", 1.0, rank("abc")), ("l", 0.9, rank("ca"))], "id").collect()}
    assert abs(got["a"] - (1 / 61 + 0.9 / 62)) < 1e-12 and abs(got["b"] - 1 / 62) < 1e-12
    assert [r.id for r in retrieval.round_robin([rank("abc"), rank("cd")], "id").orderBy("place").collect()] == ["a", "c", "b", "d"]


def test_chunks_and_pages(spark):
    df = spark.createDataFrame([(1, "# A\nline one\nline two\n\n2 B\nx"), (2, "")], "id long, t string")
    assert [(r.chunk_ord, r.chunk) for r in retrieval.packed_chunks(df, "id", "t", 14).orderBy("id", "chunk_ord").collect()] == [(0, "# A\nline one"), (1, "line two"), (2, "2 B\nx")]
    assert spark.range(1).select(retrieval.pages_of(F.lit("abcdefghij"), 4, 1)).head()[0] == ["abcd", "defg", "ghij"]


def test_cosine_of_nothing(spark):
    zero, v = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(2.0))
    assert tuple(spark.range(1).select(retrieval.cosine(zero, v), retrieval.cosine(v, v)).head()) == (0.0, pytest.approx(1.0))


def test_graph(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(20, 21)], "a long, b long")
    got = {r.node: r.component for r in graph.components(e, "a", "b", checkpointed).collect()}
    assert got == {**dict.fromkeys(range(13), 0), 20: 20, 21: 20}
    states = spark.createDataFrame([(None, "WIP"), ("WIP", "Shared"), ("WIP", "Published"), ("Archived", "WIP"), ("Archived", "Archived")], "a string, b string")
    assert [r[0] for r in states.select(graph.allowed_transition(F.col("a"), F.col("b"))).collect()] == [True, True, False, False, True]


def test_components_against_union_find(spark):
    """Chains, stars and random edges; the chain needs more rounds than its logarithm only if steps did not double."""
    import random

    draw = random.Random(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 80)] + [(draw.randint(2000, 2200), draw.randint(2000, 2200)) for _ in range(120)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b", checkpointed).collect()}
    assert got == {x: find(x) for x in parent}


def test_cost(spark):
    df = spark.createDataFrame([("p", 100.0, 50.0, 20.0, 10.0)], "k string, w double, m double, mm double, t double")
    r = cost.position_totals(df, ["k"], F.col("w"), F.col("m"), F.col("mm"), F.col("t"), 95.5, 48).head()
    assert [float(x) for x in (r.direct, r.payroll, r.overhead, r.profit, r.total)] == [160.0, 120.0, 114.6, 57.6, 332.2]
    lines = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "k string, c double")
    assert {r.k: (r.blockers, r.priced_amount, r.full_amount) for r in cost.blocked_total(lines, "k", F.col("c")).collect()} == {"a": (1, 1.0, None), "b": (0, 2.0, 2.0)}
    options = spark.createDataFrame([("a", 1), ("a", 5), ("b", 10)], "w string, x long")
    assert tuple(cost.option_range(options, "w", "x").head()) == (11, 15, 2, 3)


def test_audits(spark):
    e = spark.createDataFrame([("a", 10), ("b", 4), ("c", 3), ("d", 9)], "k string, expected long")
    a = spark.createDataFrame([("a", 10), ("b", 1), ("c", 4), ("d", 8)], "k string, actual long")
    assert {r.k: r.status for r in evaluate.store_counts(e, a, "k").collect()} == {"a": "ok", "b": "damaged", "c": "extra", "d": "missing"}


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "k string, q double, t string, o long")
    assert aggregate.top_groups(none, ["k"], F.col("q"), "sum").count() == 0
    assert join.plan_fact(none, none, "k", "q", "q").count() == 0
    assert sets.keyed_diff(none, none, "k", ["q"]).count() == 0
    assert retrieval.bm25(none, "k", "t", ["x"]).count() == 0


def test_touching_boxes_against_all_pairs(spark):
    rng = random.Random(5)
    boxes = []
    for n in range(120):
        x, y = rng.uniform(-50, 50), rng.uniform(-50, 50)
        boxes.append((n, n % 2, x, y, x + rng.choice([0.0, 3.0, 40.0]), y + rng.choice([0.0, 2.0, 25.0])))
    boxes.append((120, 0, boxes[0][4] + 1.5, boxes[0][1 + 2], boxes[0][4] + 2.0, boxes[0][5]))  # at the tolerance exactly
    df = spark.createDataFrame(boxes, "node long, sheet long, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r.a, r.b) for r in graph.touching(df, "node", "sheet", 1.5, 10.0).collect())
    near = lambda a, b, lo, hi: a[lo] <= b[hi] + 1.5 and b[lo] <= a[hi] + 1.5
    assert got == [(a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and a[1] == b[1] and near(a, b, 2, 4) and near(a, b, 3, 5)]


def test_touching_boxes_of_small_and_large_sheets(spark):
    rng = random.Random(8)
    boxes = [(n, n % 7 % 4, x := rng.uniform(-90, 90), y := rng.uniform(-90, 90), x + rng.choice([0.0, 30.0, 90.0]), y + rng.choice([0.0, 20.0])) for n in range(150)]
    boxes += [(150, 1, None, 0.0, 1.0, 1.0), (151, None, 0.0, 0.0, 1.0, 1.0), (152, None, 0.0, 0.0, 1.0, 1.0)]
    columns = "node long, sheet long, x0 double, y0 double, x1 double, y1 double"
    df = spark.createDataFrame(boxes, columns)
    whole, mixed, cells = (sorted(map(tuple, graph.touching(df, "node", "sheet", 1.5, 10.0, few).collect())) for few in (200, 30, 0))
    assert whole == mixed == cells and len(whole) > 100
    wide = spark.createDataFrame([(1, 0, 0.0, 0.0, 5e9, 0.0), (2, 0, 4e9, 1.0, 4e9, 1.0), (3, 0, 4e9, 3.0, 6e9, 3.0)], columns)
    assert [tuple(r) for r in graph.touching(wide, "node", "sheet", 1.0, 1.0).collect()] == [(1, 2)]  # a row in each cell would be billions


def test_contracted_edges_keep_their_components(spark):
    def least(edges):
        root = {x: x for e in edges for x in e}
        find = lambda x: x if root[x] == x else find(root[x])
        for a, b in edges:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return {x: find(x) for x in root if find(x) != x}

    rng = random.Random(2)
    edges = [(k * 100 + i, k * 100 + i + 1) for k in range(5) for i in range(90)] + [(rng.randrange(600, 900), rng.randrange(600, 900)) for _ in range(250)] + [(7, 7), (3, 2), (2, 3)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "x long, y long")
    parts = [(r.a, r.b) for r in graph.contracted(df.repartition(3), "x", "y", 7).collect()]
    assert len(parts) < len(edges) and all(b < a for a, b in parts) and least(parts) == least(edges)
    assert dict(map(tuple, graph.contracted(df.coalesce(1), "x", "y").collect())) == least(edges)
    assert graph.contracted(df.where("false"), "x", "y").count() == 0


def test_window_overlap_and_card_score(spark):
    text = "x " * 2000 + "Kabel und rotes Rohr " + "y " * 2000
    df = spark.createDataFrame([(text, "Spec", "red ring"), (None, None, None), ("", "spec ring", "")], "t string, a string, b string")
    got = df.select(retrieval.window_overlap(F.col("t"), ["kabel", "rohr", "zinc"]).alias("o"), retrieval.card_score("spec red ring", [(F.col("a"), 20), (F.col("b"), 4)]).alias("s")).collect()
    assert got[0].o == pytest.approx(2 / 3) and got[2].o == 0
    assert [r.s for r in got] == [12 + 20 + 4 + 4, 0, 40]
