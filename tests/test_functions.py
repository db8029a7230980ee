import pytest
from pyspark.sql import functions as F

from orebed.functions import codes, numbers, tables, text, units


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()[0]


@pytest.mark.parametrize(
    "f,cell,want",
    [
        (numbers.safe_number, "1 019,39", 1019.39),
        (numbers.safe_number, "1 000", 1000.0),
        (numbers.safe_number, "NaN", None),
        (numbers.safe_number, "abc", None),
        (numbers.safe_number, None, None),
        (numbers.first_number, "137,39 м2", 137.39),
        (numbers.first_number, "1.234,5 шт", 1234.5),
        (numbers.first_number, "1,234.5", 1234.5),
        (numbers.first_number, "итого: -12.", -12.0),
        (numbers.first_number, "нет", None),
        (numbers.local_number, "664 711,12", 664711.12),
        (numbers.local_number, "1.234,5 руб", 1234.5),
        (numbers.price_number, "—", None),
        (numbers.price_number, "х", None),
        (numbers.price_number, "2 300", 2300.0),
    ],
)
def test_numbers(spark, f, cell, want):
    assert one(spark, f(F.lit(cell).cast("string"))) == want


def test_shown_numbers_and_money(spark):
    assert one(spark, numbers.shown_number(F.lit(1234567.0))) == "1 234 567"
    assert one(spark, numbers.shown_number(F.lit(1234.5))) == "1 234.50"
    assert str(one(spark, numbers.money(F.lit(0.125)))) == "0.13"


def test_text(spark):
    assert one(spark, text.name_key(F.lit("  Кабель \n ВВГ "))) == "кабель ввг"
    assert one(spark, text.material_key(F.lit(" Щётка; "))) == "щетка"
    assert one(spark, text.compact(F.lit("a  b c d"), 4)) == "a b…"
    assert one(spark, text.subject_key(F.lit("RE: Fwd: re[2]: Plan  B"))) == "plan b"
    assert one(spark, text.heading_level(F.lit("### Three"))) == 3 and one(spark, text.heading_level(F.lit("1.2.3 Deep"))) == 3
    assert one(spark, text.norm_references(F.lit("по СП 1.13130 и гост  Р 123, снова СП 1.13130"))) == ["СП 1.13130", "ГОСТ Р 123"]
    assert one(spark, text.without_markup(F.lit("a<br/>b " + "Q" * 300 + "\n\n\n\nc"))) == "a b \n\nc"
    assert one(spark, text.repaired(F.lit("Привет".encode().decode("latin-1")))) == "Привет"
    assert one(spark, text.repaired(F.lit("plain"))) == "plain"


@pytest.mark.parametrize("word,stem", [("кабелями", "кабелям"), ("лотки", "лотк"), ("мост", "мост"), ("cables", "cables"), ("требований", "требовани")])
def test_stem(spark, word, stem):
    assert one(spark, text.stem(F.lit(word))) == stem


def test_tokens(spark):
    assert one(spark, text.tokens(F.lit("Какие нормы для СП 4.13130? Ёмкость кабеля..."))) == ["4.13130", "емкост", "кабел"]
    assert one(spark, text.term_id(F.lit("кабел"))) == 1080722290


def test_units_and_codes(spark):
    assert one(spark, units.unit_key(F.lit(" КВ.М "))) == "м²" and one(spark, units.unit_key(F.lit("рулон"))) == "рулон" and one(spark, units.unit_key(F.lit(None).cast("string"))) == ""
    assert one(spark, units.converted(F.lit(1500.0), F.lit("кг"), F.lit("тн"))) == 1.5 and one(spark, units.converted(F.lit(1.0), F.lit("м"), F.lit("кг"))) is None
    assert one(spark, units.measure_factor(F.lit("100 м2"))) == 100.0
    assert one(spark, codes.bare_code(F.lit("ГЭСН 12-01-034"))) == "12-01-034"
    assert [one(spark, codes.resource_kind(F.lit(c))) for c in ("1-100-20", "91.05.01", "КАЦ-1", "01.7.03", "zz")] == ["labor", "machine", "price_item", "material", "unknown"]
    assert [one(spark, codes.sheet_format(F.lit(a), F.lit(b))) for a, b in ((297, 210), (420, 891), (100, 100))] == ["A4", "A3x3", None]
    assert one(spark, codes.file_parts(F.lit("B1_HVAC_02_L3_20240101.pdf"))).floor == "02"


def test_raw_rows(spark):
    raw = F.lit('{"№": "1", "Коли-\\nчество": "1 019,39", "Объём": "5", "Раздел": " А  Б "}')
    assert one(spark, tables.raw_number(raw, ["колич", "объём"])) == 1019.39
    assert one(spark, tables.raw_text(raw, ["раздел"])) == "А Б"
    assert one(spark, tables.raw_number(F.lit("broken {"), ["колич"])) is None and one(spark, tables.raw_number(F.lit("{bad"), ["колич"])) is None
