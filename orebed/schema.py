"""The standard row of a normalised project table, and the vocabularies that go with it."""

from __future__ import annotations

from pyspark.sql import types as T

#: The fields of the standard row with their types, in order.
FIELDS = [
    ("doc_type", "string"), ("doc_title", "string"), ("source_file", "string"),
    ("pos", "string"), ("section", "string"), ("subsection", "string"),
    ("name", "string"), ("code", "string"), ("mark", "string"),
    ("unit", "string"), ("qty", "double"), ("qty_per_unit", "double"),
    ("price", "double"), ("amount", "double"), ("amount_mat", "double"), ("amount_work", "double"),
    ("work_volume", "double"), ("work_done", "double"), ("work_since_start", "double"),
    ("work_name", "string"), ("norms_refs", "string"), ("materials_used", "string"), ("date_start", "string"), ("date_end", "string"),
    ("position", "string"), ("designation", "string"), ("weight_unit", "double"), ("weight_total", "double"),
    ("note", "string"), ("raw_row", "string"), ("source_page", "int"), ("table_index", "int"), ("needs_ocr", "boolean"), ("extractor", "string"),
]
TEXT_FIELDS = [name for name, kind in FIELDS if kind == "string"]
NUMBER_FIELDS = [name for name, kind in FIELDS if kind == "double"]
_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "boolean": T.BooleanType()}

STANDARD_ROW = T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in FIELDS])

#: Document types.
DOC_TYPES = ["KS2", "AOSR", "SPEC", "VEDOMOST", "SMETA", "TABLE"]

#: What a table may be summed by and grouped by, and with which operations.
NUMERIC = ["qty", "price", "amount", "amount_mat", "amount_work", "weight_total", "work_done", "work_volume", "work_since_start"]
GROUPABLE = ["section", "subsection", "doc_type", "doc_title", "unit", "name", "code", "mark", "source_file"]
OPERATIONS = ["sum", "count", "avg", "min", "max"]

#: Parts of raw column names that point to a field.
RAW_KEY_HINTS = {
    "qty": ["кол-во", "колич", "объем", "объём"],
    "price": ["расцен", "цена", "цен"],
    "amount": ["сумм", "стоимост", "итого", "руб"],
    "amount_mat": ["материал"],
    "amount_work": ["работ", "труд", "зп"],
    "weight_total": ["масса", "вес"],
    "work_done": ["выполнено"],
    "work_volume": ["объем работ", "объём работ"],
    "work_since_start": ["с начала"],
}
RAW_GROUP_HINTS = {
    "section": ["раздел", "глава", "этап"],
    "subsection": ["подраздел", "подэтап"],
    "unit": ["ед.изм", "ед. изм", "единица", "ед-ца"],
    "name": ["наименован"],
    "code": ["код", "шифр"],
    "mark": ["марка", "обозначен"],
}

#: Spellings of units.
UNIT_ALIASES = {
    "шт": "шт", "шт.": "шт", "штук": "шт", "штука": "шт", "штуки": "шт",
    "компл": "компл", "компл.": "компл", "к-т": "компл", "комплект": "компл", "комплектов": "компл",
    "м": "м", "м.": "м", "метр": "м", "метров": "м",
    "пог.м": "пог.м", "п.м": "пог.м", "п.м.": "пог.м", "пог. м": "пог.м", "пм": "пог.м",
    "м2": "м²", "м²": "м²", "кв.м": "м²", "кв. м": "м²", "кв.м.": "м²",
    "м3": "м³", "м³": "м³", "куб.м": "м³", "куб. м": "м³", "куб.м.": "м³",
    "кг": "кг", "кг.": "кг",
    "т": "т", "т.": "т", "тн": "т", "тонн": "т",
    "л": "л", "л.": "л", "литр": "л", "литров": "л",
}

#: Words that a query leaves out, and suffixes in the order in which the stemmer tries them.
STOP_WORDS = [
    "какие", "какой", "какая", "какое", "каких", "каким", "какими", "где", "смотреть", "требования", "нормы", "норма", "требование",
    "найти", "пункт", "раздел", "свод", "правил", "гост", "сп", "случаях", "случае", "случай", "выполнять", "выполнение", "делать",
    "допускается", "допускать", "почему", "зачем", "что", "кто", "как", "когда", "куда", "откуда", "нужно", "должно", "следует",
    "необходимо", "быть", "может", "можно", "ли", "или", "для", "при", "под", "над", "все", "всех", "всеми", "чем", "тем", "только",
]
#: Words that say nothing about whether an answer stands on its context.
VALIDATION_STOP_WORDS = [
    "что", "это", "как", "так", "при", "для", "или", "над", "под", "если", "есть", "нужно", "нужен", "должна", "должен", "должно",
    "должны", "может", "могут", "более", "менее", "также", "либо", "иные", "иной", "иная", "такой", "такая", "такие", "через",
    "между", "после", "перед", "очень", "весь", "вся", "всех", "всем", "одного", "одной", "одним", "любом", "любой", "любых",
]
ENDINGS = [
    "иями", "ям", "ыми", "ейший", "ейшая", "ейшее", "ейшие", "ейших", "ого", "его", "ому", "ему", "ыми", "ими", "ых", "их", "ою", "ею",
    "ая", "яя", "ое", "ее", "ые", "ие", "ым", "им", "ом", "ем", "ах", "ях", "ов", "ев", "ей", "ам", "ям", "ит", "ет", "ут", "ют", "ат",
    "ят", "ти", "а", "ев", "ов", "е", "и", "й", "о", "у", "ы", "ь", "я", "ю", "ию",
]
