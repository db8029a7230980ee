import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from orebed.operators.retrieval import query_window
from orebed.plans.tools import TOOLS
from orebed.schema import STANDARD_ROW
from orebed.sources import sheets, stores

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook() -> bytes:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS}><sheets><sheet name="Прайс" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>Код</t></si><si><t>Наименование</t></si><si><r><t>Ка</t></r><r><t>бель</t></r></si></sst>")
        rows = '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>Цена</t></is></c></row><row><c r="A2" t="inlineStr"><is><t>01.7</t></is></c><c r="B2" t="s"><v>2</v></c><c r="D2"><v>12.5</v></c></row><row><c r="A3" t="inlineStr"><is><t>02.1</t></is></c><c r="D3" t="inlineStr"><is><t>—</t></is></c></row>'
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {NS}><sheetData>{rows}</sheetData></worksheet>")
    return data.getvalue()


def test_spreadsheet_to_prices(spark, tmp_path):
    (tmp_path / "p.xlsx").write_bytes(workbook())
    rows = sheets.xlsx_rows(spark, str(tmp_path))
    got = rows.orderBy("row").collect()
    assert [(r.sheet, r.row, r.cells) for r in got] == [("Прайс", 0, {"Код": "01.7", "Наименование": "Кабель", "Цена": "12.5"}), ("Прайс", 1, {"Код": "02.1", "Наименование": "", "Цена": "—"})]
    assert {r.field for r in sheets.mapped_cells(rows).collect()} == {"code", "name", "price"}
    cell = lambda k: F.col("cells")[k]
    prices = sheets.price_rows(rows, cell("Код"), cell("Наименование"), {"current": cell("Цена")}, "77", "2024Q1").orderBy("code").collect()
    assert [(r.code, r.current, r.region) for r in prices] == [("01.7", 12.5, "77"), ("02.1", None, "77")]


def test_json_texts(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"t": "Title", "parts": [{"x": 1, "deep": {"deeper": {"no": 1}}}, "tail"]}))
    (tmp_path / "b.json").write_text("{broken")
    got = {r.path[-6:]: r.text for r in sheets.json_texts(spark, str(tmp_path)).collect()}
    assert got == {"a.json": "t: Title\nx: 1\ntail", "b.json": None}


def test_column_profile(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "3"), (None, "x")], "k string, v string")
    got = {r.column: r for r in sheets.column_profile(df).collect()}
    assert (got["v"].n, got["v"].lo, got["v"].hi, got["v"].total) == (4, 1.0, 3.0, 6.0)
    assert (got["k"].n, got["k"].n_distinct, got["k"].lo, got["k"].examples) == (3, 2, None, ["a", "b"])


def test_only_whole_versions_are_promoted(spark, tmp_path):
    root = f"file://{tmp_path}"
    spark.range(3).write.parquet(f"{root}/v1")
    spark.range(5).write.parquet(f"{root}/v2")
    stores.promote(spark, root, "v1", 3)
    with pytest.raises(ValueError):
        stores.promote(spark, root, "v2", 4)
    assert stores.current(spark, root).count() == 3
    stores.promote(spark, root, "v2", 5)
    assert stores.current(spark, root).count() == 5


def test_merge_and_training_set(spark, tmp_path):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 2)], "k long, s string, n int")
    b = spark.createDataFrame([(2, None, "new"), (3, "z", "new")], "k long, s string, extra string")
    assert sorted(tuple(r) for r in stores.merged(a, b, ["k"]).collect()) == [(1, "x", 1, None), (2, "y", 2, "new"), (3, "z", None, "new")]
    rec = spark.createDataFrame([("a", "verified"), ("b", "rejected"), ("c", "verified")], "image string, verdict string")
    assert stores.training_set(rec, f"{tmp_path}/out", "verdict") == {"verified": 2, "rejected": 1}
    assert spark.read.json(f"{tmp_path}/out").count() == 2


def test_tools_take_only_what_is_allowed(spark):
    row = {f.name: None for f in STANDARD_ROW} | {"section": "A", "qty": 2.0, "source_file": "f", "pos": "1", "raw_row": "{}"}
    df = spark.createDataFrame([tuple(row[f.name] for f in STANDARD_ROW)] * 2, STANDARD_ROW)
    r = TOOLS["sum_with_evidence"](df, value="qty", group_by="section").head()
    assert (r.value, r.n_sources, r.evidence) == (4.0, 1, ["f#1"])
    for bad in ({"field": "qty"}, {"field": "qty", "op": "drop"}, {"field": "raw_row", "op": "sum"}, {"field": "qty", "op": "sum", "sql": "x"}, {"field": 1, "op": "sum"}):
        with pytest.raises(ValueError):
            TOOLS["aggregate"](df, **bad)


def test_query_window(spark):
    text = F.lit("x" * 500 + " Кабель " + "y" * 500)
    got = spark.range(1).select(query_window(text, ["лоток", "кабель"], 100)).head()[0]
    assert "Кабель" in got and len(got) == 100
