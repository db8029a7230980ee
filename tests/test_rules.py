"""Rules on cases that the tables do not offer."""

import datetime

import pytest
from pyspark.sql import functions as F

from orebed.functions import classify
from orebed.operators import graph, rules


def each(spark, cases, expression):
    """Cases by value against an expression of the column t."""
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    return {r.t: r.got for r in df.select("t", expression(F.col("t")).alias("got")).collect()}


def test_headings(spark):
    cases = {"## Title here\ntext": ("Title here", 2), "intro\n\n5.2.1 Clause text\n# Later": ("5.2.1 Clause text", 3), "1\n2\n3\n4\n5\n6\n# Too late": ("# Too late"[2:], 0), "abc": ("", 0), None: ("", 0), "#no heading": ("no heading", 0), "7. Point": ("7 Point", 1)}
    assert {k: tuple(v) for k, v in each(spark, cases, rules.heading_info).items()} == cases


def test_noise_and_garbage(spark):
    names = {"": True, None: True, "ab": True, "Раздел 1": True, "12 34": True, "x 5": True, "Cable": False, "Разделка": False}
    assert each(spark, names, rules.noise_name) == names
    dense = "A/" * 40
    texts = {f"{dense}\n{dense}\nwords": True, "B" * 100: True, "Ж" * 100: False, "short": False, None: False, "plain words of a text " * 9: False, f"{dense}\n" + "слово " * 20: False}
    assert each(spark, texts, rules.binary_garbage) == texts


def test_query_building(spark):
    cases = {
        "Какие требования ГОСТ Р 21.110-2013 к кабелям 3х1,5?": 'text : ("кабел"*) OR ("гост р 21.110-2013" OR "21.110-2013")',
        "где что": "",
        None: "",
        "fire": 'text : ("fire"*)',
    }
    got = each(spark, cases, rules.text_query)
    assert got["где что"] == got[None] == "" and got["fire"] == cases["fire"]
    assert '"гост р 21.110-2013"' in got["Какие требования ГОСТ Р 21.110-2013 к кабелям 3х1,5?"] and '"кабел' in got["Какие требования ГОСТ Р 21.110-2013 к кабелям 3х1,5?"]
    words = {"сколько метров кабеля 3х1,5 всего 100 и для": ["сколь", "метро", "кабел", "всего"], None: [], "A-12 100": ["a-12"]}
    assert {k: [w for w in v if w != "3х1"] for k, v in each(spark, words, rules.query_keywords).items()} == words


def test_best_fields(spark):
    rows = [("s", "cipher", "A-1", 0.5, 1), ("s", "cipher", "A-12", 0.5, 2), ("s", "cipher", "B", 0.4, 3), ("s", "title", "x", 0.1, 4), ("s", "title", "x", 0.9, 5), ("s", "empty", " ", 1.0, 6), ("s", "none", None, 1.0, 7), ("s", "tie", "aa", 0.5, 9), ("s", "tie", "bb", 0.5, 8)]
    df = spark.createDataFrame(rows, "sheet string, field string, value string, confidence double, n int")
    got = {r.field: (r.value, r.confidence, r.n_values, r.conflict) for r in rules.best_fields(df, ["sheet"], "field", "value", "confidence", "n").collect()}
    assert got == {"cipher": ("A-12", 0.5, 3, True), "title": ("x", 0.9, 1, False), "tie": ("bb", 0.5, 2, True)}


def test_progress(spark):
    df = spark.createDataFrame([(5, 10, 60, True), (10, 10, 60, True), (0, 10, 60, True), (5, 10, 60, False), (12, 10, 5, True), (1, 0, 5, True), (3, 9, 0, True)], "d long, t long, e long, r boolean")
    got = [tuple(x.p) for x in df.select(rules.progress_eta(F.col("d"), F.col("t"), F.col("e"), F.col("r")).alias("p")).collect()]
    assert got == [(50.0, 5.0, 60), (100.0, None, None), (0.0, None, None), (50.0, None, None), (100.0, None, None), (None, None, None), (33.3, None, None)]


def test_price_browse(spark):
    rows = [("01.1", "red ring", False, False), ("02.2", "big red ring", True, False), ("03.3", "ring", True, False), ("04.4", "red haulage", True, True), ("red ring", "none", False, True), ("05.5", "blue", False, False)]
    df = spark.createDataFrame(rows, "code string, name string, r boolean, t boolean")
    got = [x.code for x in rules.price_browse(df, "code", "name", " Red  RING ", F.col("r"), F.col("t")).collect()]
    assert got == ["red ring", "02.2", "03.3", "01.1"]
    assert "04.4" in [x.code for x in rules.price_browse(df, "code", "name", "red ring", F.col("r"), F.col("t"), asks_transport=True).collect()]


def test_missing_refs(spark):
    register = spark.createDataFrame([("АБ-12/3", 1), ("Q", 2), ("zz", 3), ("long reference", 4), ("--", 5), (None, 6), ("xx12 y", 7)], "ref string, n int")
    files = spark.createDataFrame([("проект АБ12.3 план",), ("q",), ("ong-ref",), ("12",), (None,)], "f string")
    assert sorted(r.n for r in rules.missing_refs(register, "ref", files, "f").collect()) == [3]


def test_outline(spark):
    text = "Раздел 2 «Second part»\nраздел 10. Tenth\nРаздел 2 Again\nПодраздел 2(1) Inner one.\nРаздел 3 abc\nпункт 1 First"
    got = [(r.kind, r.number, r.title, r.place) for r in rules.outline(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string"), "id", "t", ["Раздел", "Подраздел", "Пункт"]).orderBy("place").collect()]
    assert got == [("пункт", "1", "First", 1), ("Раздел", "2", "«Second part", 2), ("Подраздел", "2(1)", "Inner one", 3), ("раздел", "10", "Tenth", 4)]


def test_promotions_and_pages(spark):
    hits = spark.createDataFrame([("q", 1, "plan", "text"), ("q", 2, "AB-1 sheet", "x"), ("q", 3, "other", "see ab-1 and cd"), ("q", 4, None, None)], "q string, rank int, name string, content string")
    got = rules.promoted(hits, "q", "rank", F.col("name"), F.col("content"), F.array(F.lit("ab-1"), F.lit("cd"))).orderBy("place").collect()
    assert [(r.rank, r.promotion) for r in got] == [(3, 6), (2, 4), (1, 0), (4, 0)]
    seen, after = [], None
    while page := [tuple(r) for r in rules.paged(hits.select("q", "rank"), ["q", "rank"], after, 3).collect()]:
        seen += page
        after = page[-1]
    assert seen == [("q", i) for i in (1, 2, 3, 4)]


def test_canonical_json(spark):
    a, b = '{"b": [1, {"y": null, "x": "ü"}], "a": 1.50}', '{ "a":1.5,"b":[1,{"x":"ü","y":null}] }'
    got = each(spark, [a, b, "no json", None], rules.canonical_json)
    assert got[a] == got[b] == '{"a":1.5,"b":[1,{"x":"ü","y":null}]}' and got["no json"] is None and got[None] is None


def test_binding_status(spark):
    rows = [(1.0, "ГЭСН01-02-003-04", True, "кг", "т", True, "accepted"), (None, "ГЭСН01-02-003-04", True, "кг", "т", True, "quantity is missing"), (1.0, "01-02-003-04", True, "кг", "т", True, "full typed norm code is required"), (0.0, "ГЭСН01-02-003-04", False, "т", "т", True, "exact norm code not found"), (1.0, "ГЭСН01-02-003-04", True, "м", "т", True, "unit mismatch"), (1.0, "ГЭСН01-02-003-04", True, "т", "т", False, "unsafe_source")]
    df = spark.createDataFrame(rows, "q double, c string, k boolean, u string, n string, t boolean, want string")
    for r in df.select("want", rules.binding_status(*[F.col(c) for c in "qckunt"]).alias("s")).collect():
        assert r.want in (r.s.status, r.s.reason), r


def test_periods(spark):
    day = datetime.date
    cases = {"за март 2024 года": (day(2024, 3, 1), day(2024, 3, 31)), "Май 2023": (day(2023, 5, 1), day(2023, 5, 31)), "с 01.02.2024 по 15.02.2024": (day(2024, 2, 1), day(2024, 2, 15)), "по 15.02.2024": (None, day(2024, 2, 15)), "": (None, None), None: (None, None)}
    got = each(spark, cases, lambda t: F.struct(*[c.alias(n) for c, n in zip(classify.period(t), "ab", strict=True)]))
    assert {k: tuple(v) for k, v in got.items()} == cases


def test_membership_and_number_edges(spark):
    docs = spark.createDataFrame([("p", "d", "1", 2), ("p", "d", "2", 3), ("p", "e", "1", 5), (None, "e", "1", 1)], "p string, d string, x string, n long")
    nodes, edges = graph.membership(docs, [("project", "p"), ("dataset", "d"), ("document", "x")], F.col("n"))
    got = {r.id: (r.kind, r.label, r.parent, r.children, r.size) for r in nodes.collect()}
    assert got["project:p"] == ("project", "p", None, 2, 10) and got["dataset:p:d"] == ("dataset", "d", "project:p", 2, 5) and len(got) == 2 + 3 + 4
    assert edges.count() == 3 + 4
    m = spark.createDataFrame([(n, s) for n in ("a", "b") for s in range(5)], "number string, source int")
    owners = spark.createDataFrame([("a", 0), ("b", 0)], "number string, target int")
    assert [(r.source, r.target, r.weight) for r in graph.number_edges(m, owners, 3).collect()] == [(1, 0, 2), (2, 0, 2)]
    assert graph.number_edges(m, owners, 5, 2).count() == 2


@pytest.mark.parametrize("limit", [1, 2])
def test_pages_of_an_empty_table(spark, limit):
    assert rules.paged(spark.createDataFrame([], "a int"), ["a"], [5], limit).collect() == []


def test_machinists(spark):
    from orebed.operators import cost

    catalog = spark.createDataFrame([("M1", 1.0, "D1"), ("M2", 0.5, "D2"), ("M3", 0.0, None), ("M4", 2.0, None)], "code string, crew_hours double, driver_code string")
    rows = [
        ("fits", "machine", "M1", 2.0), ("fits", "machine", "M2", 4.0), ("fits", "machine", "M3", 9.0), ("fits", "machinist", " ", 4.0), ("fits", "labour", "L", 1.0),
        ("off", "machine", "M1", 2.0), ("off", "machinist", None, 2.1), ("half", "machine", "M4", 1.0), ("half", "machinist", "", 2.0),
        ("unknown", "machine", None, 1.0), ("unknown", "machinist", "", 1.0), ("none", "machine", "M1", 1.0), ("named", "machinist", "D9", 1.0), ("named", "machine", "M1", None),
    ]
    out, told = cost.machinists(spark.createDataFrame(rows, "p string, kind string, code string, quantity double"), catalog, "p")
    assert {r.p: r.status for r in told.collect()} == {"fits": "reconciled", "off": "unresolved", "half": "unresolved", "unknown": "unresolved", "none": "not_applicable", "named": "not_applicable"}
    got = sorted(tuple(r) for r in out.where("p = 'fits'").collect())
    assert got == [("fits", "labour", "L", 1.0), ("fits", "machine", "M1", 2.0), ("fits", "machine", "M2", 4.0), ("fits", "machine", "M3", 9.0), ("fits", "machinist", "D1", 2.0), ("fits", "machinist", "D2", 2.0)]
    assert out.where("p <> 'fits'").count() == 9


def test_quality_report(spark):
    cases = {"a<br>b<BR/>": (True, False, True), "|" * 8: (True, False, True), "word " * 30: (False, True, False), "слово " * 30: (False, False, False), "1" * 150: (False, False, False), None: (False, False, True)}
    assert {k: tuple(v) for k, v in each(spark, cases, rules.chunk_quality).items()} == cases
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", None), ("b", "x", 1), ("b", None, 1)], "g string, t string, m int")
    got = {r.g: (r.n, r.incomplete_pct, r.completeness, r.copies, r.shared_texts) for r in rules.quality_report(df, "g", "t", ["t", "m"]).collect()}
    assert got == {"a": (2, 50.0, 0.75, 1, 1), "b": (2, 50.0, 0.75, 1, 1)}


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_period_searches_a_text_once_for_all_months(spark):
    from orebed.functions import classify

    df = spark.createDataFrame([("за март 2024 года",), ("май 2023",), ("мая 2022",), (None,), ("ничего",)], "t string")
    both = df.repartition(2).select(*classify.period(df["t"]))
    assert plan_of(both).count("regexp_extract") <= 10
    assert sorted(str(r[0]) for r in both.collect()) == ["2022-05-01", "2023-05-01", "2024-03-01", "None", "None"]


def test_quality_report_reads_texts_once(spark, sf):
    from orebed.operators import rules

    report = rules.quality_report(spark.read.parquet(f"{sf}/documents.parquet"), "source", "text", ["text", "lang"])
    assert plan_of(report).count("parquet") == 1
