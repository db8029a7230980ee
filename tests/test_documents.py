import pytest
from pyspark.sql import functions as F

from orebed.functions import classify
from orebed.functions.numbers import safe_number
from orebed.operators import documents


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()[0]


@pytest.mark.parametrize("header,field", [("№ п/п", "pos"), ("Наименование работ", "name"), ("Ед.изм.", "unit"), ("Кол-во", "qty"), ("Цена", "price"), ("Сумма", "amount"), ("Foo", "skip")])
def test_headers(spark, header, field):
    assert one(spark, classify.header_field(F.lit(header))) == field


def test_types(spark):
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    assert one(spark, classify.document_type(arr("Наименование", "Цена"), F.lit("Лист1"))) == "SMETA"
    assert one(spark, classify.document_type(arr("Поз.", "Кол-во"), F.lit(""))) == "SPEC"
    assert one(spark, classify.document_type(arr("x"), F.lit("Акт скрытых работ"))) == "AOSR"
    assert one(spark, classify.document_type(arr("x"), F.lit("y"))) == "TABLE"
    sig = {"loads": ["line", "power", "current"], "cables": ["cable", "length"]}
    assert one(spark, classify.signature_type(arr("Cable", "Length m"), F.lit(""), sig)) == "cables"
    assert one(spark, classify.signature_type(arr("q"), F.lit("List of power"), sig)) == "loads"
    assert one(spark, classify.signature_type(arr("q"), F.lit(""), sig)) == "unknown"


def test_gates_and_words(spark):
    levels = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    assert [one(spark, classify.most_restrictive(levels(*x))) for x in (["P1"], ["P1", "P2"], ["P1", "zz"], [])] == ["P1", "P2", "P0", "P0"]
    assert one(spark, classify.nearest_word(F.lit("кабль"), ["кабель", "лоток"])) == "кабель"
    assert one(spark, classify.nearest_word(F.lit("abcdef"), ["uvwxyz"])) == "abcdef"
    assert one(spark, classify.switched_layout(F.lit("rf,tkm"))) == "кабель"
    assert one(spark, classify.quantity(F.lit("мощность 12,5 кВт"), "кВт")) == 12.5


@pytest.mark.parametrize("text,first,last", [("объём за март 2024", "2024-03-01", "2024-03-31"), ("за май 2023", "2023-05-01", "2023-05-31"), ("с 01.02.2024 по 15.02.2024", "2024-02-01", "2024-02-15"), ("по 15.02.2024", None, "2024-02-15"), ("всё", None, None)])
def test_periods(spark, text, first, last):
    a, b = classify.period(F.lit(text))
    assert tuple(spark.range(1).select(a.cast("string"), b.cast("string")).head()) == (first, last)


def test_rows_become_standard_rows(spark):
    cells = {"Наименование": " Кабель ", "Кол-во": "1 000,5", "Ед.": "м", "Цена": "abc"}
    df = spark.createDataFrame([(cells,)], "cells map<string,string>")
    out = documents.normalise_rows(df, "cells", F.lit("SPEC"), F.lit("T"), F.lit("f.xlsx"), {"Наименование": "name", "Кол-во": "qty", "Ед.": "unit", "Цена": "price", "Прочее": "skip"})
    r = out.head()
    assert (r.name, r.qty, r.unit, r.price, r.doc_type, r.mark) == ("Кабель", 1000.5, "м", None, "SPEC", "") and "Кабель" in r.raw_row
    assert out.select(documents.row_text()).head()[0] == "Наименование: Кабель\nКоличество: 1000.5 м"


def test_clauses_and_their_differences(spark):
    old = spark.createDataFrame([(1, "1 First\nalpha\n1.1 Sub\nbeta\n2 Second\ngamma")], "id long, t string")
    got = {r.clause: (r.start, r.end, r.body) for r in documents.clauses(old, "id", "t").collect()}
    assert got == {"1": (0, 3, "1 First\nalpha\n1.1 Sub\nbeta"), "1.1": (2, 3, "1.1 Sub\nbeta"), "2": (4, 5, "2 Second\ngamma")}
    new = spark.createDataFrame([(1, "1 First\nalpha!\n3 Third")], "id long, t string")
    diff = {r.clause: (r.status, r.similarity) for r in documents.text_diff(documents.clauses(old, "id", "t"), documents.clauses(new, "id", "t"), "clause", "body").collect()}
    assert diff["2"] == ("removed", None) and diff["3"] == ("added", None) and diff["1"][0] == "changed" and 0 < diff["1"][1] < 1


def test_longest_root(spark):
    f = spark.createDataFrame([("/a/b/c/x.txt",), ("/a/y.txt",), ("/z/q.txt",)], "path string")
    r = spark.createDataFrame([("/a",), ("/a/b",), ("/a/bb",)], "r string")
    assert {x.path: x.root for x in documents.longest_root(f, "path", r, "r").collect()} == {"/a/b/c/x.txt": "/a/b", "/a/y.txt": "/a", "/z/q.txt": None}


def test_tables_move_up(spark):
    df = spark.createDataFrame([(1, i, i in (2, 7, 9, 10)) for i in range(1, 12)], "g long, r long, t boolean")
    got = [r.r for r in documents.table_slots(df, "g", "r", F.col("t"), 4, 3).orderBy("new_rank").collect()]
    assert got == [1, 2, 7, 9, 3, 4, 5, 6, 8, 10, 11]


def test_errors_and_rules(spark):
    cases = [("a b", "A  b", "whitespace_case"), ("12", "13", "numeric_value"), ("к1", "k1", "char_confusion"), ("x", " ", "empty_pred"), ("x", "y", "text_value"), ("x", "x", None)]
    for e, a, want in cases:
        assert one(spark, documents.error_class(F.lit(e), F.lit(a), safe_number)) == want
    c = spark.createDataFrame([("a", "r1", None), ("b", "r1", None), ("b", "r2", None), ("c", "r1", "r9"), ("d", "r1", "r2"), ("d", "r2", "r2")], "k string, rule string, pick string")
    assert {r.k: (r.status, r.rule) for r in documents.rules_of(c, "k", "rule", "pick").collect()} == {"a": ("resolved", "r1"), "b": ("ambiguous", ""), "c": ("rejected", ""), "d": ("resolved", "r2")}
