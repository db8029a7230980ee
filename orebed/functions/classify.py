"""Rule ladders: header mapping, document types, categories and routes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of a header that point to a standard field; the first rule that fits counts.
HEADER_RULES = [
    ("pos", ["№", "номер", "поз", "позиция", "п/п"]),
    ("section", ["раздел", "глава", "этап"]),
    ("subsection", ["подраздел", "подэтап"]),
    ("name", ["наименование", "наимен."]),
    ("amount", ["сумма", "итого", "всего"]),
    ("amount_mat", ["материал", "материалы"]),
    ("amount_work", ["работа", "работы", "зп", "оплата труда"]),
    ("work_done", ["выполнено", "отчет", "отчёт"]),
    ("work_since_start", ["с начала", "накопительно"]),
    ("price", ["цена", "стоимость ед", "единичная"]),
    ("qty_per_unit", ["расход", "на единицу"]),
    ("qty", ["кол-во", "количество", "объем", "объём", "qty"]),
    ("unit", ["ед.изм", "единица", "изм.", "ед."]),
    ("name", ["наименование", "работ", "оборудован", "материал", "ресурс"]),
    ("code", ["шифр", "код", "расценка", "артикул"]),
    ("mark", ["марка", "тип", "модель"]),
    ("norms_refs", ["норматив", "гост", "сп ", "снип", "ту"]),
    ("designation", ["обозначение", "документ"]),
    ("weight_unit", ["масса ед", "масса 1"]),
    ("weight_total", ["масса общ", "общая масса"]),
    ("note", ["примеч", "комментар", "основание"]),
]

#: Parts of headers and sheet names that point to a document type.
TYPE_HINTS = {
    "KS2": ["выполненных работ", "кс-2", "кс2", "акт приёмки", "период"],
    "AOSR": ["скрытых работ", "аоср", "освидетельствования", "скрытые работы"],
    "SPEC": ["спецификация", "обозначение", "масса", "поз.", "позиция", "гост 21.110"],
    "VEDOMOST": ["ведомость", "чертежей", "ссылочных документов", "лист", "формат"],
    "SMETA": ["смета", "расценка", "норма", "гэсн", "фер", "тер", "гранд"],
}


def any_of(text: Column, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def ladder(text: Column, rules: Sequence[tuple[str, Sequence[str]]], otherwise: str | None) -> Column:
    """The label of the first rule of which any part is in the text."""
    out = F.lit(otherwise).cast("string")
    for label, parts in reversed(rules):
        out = F.when(any_of(text, parts), F.lit(label)).otherwise(out)
    return out


def header_field(header: Column) -> Column:
    """The standard field of a header, or skip."""
    return ladder(F.lower(F.trim(header)), HEADER_RULES, "skip")


def document_type(headers: Column, sheet: Column) -> Column:
    """The type of a table by its headers (an array) and its sheet's name; TABLE without any hint, the first of equal scores."""
    text = F.lower(F.concat_ws(" ", headers, sheet))
    priced = any_of(text, ["цена", "сумма", "стоимость", "расценка"])
    listed = any_of(text, ["позиция", "поз.", "поз "]) & any_of(text, ["кол-во", "количество", "ед.изм", "единица"])
    scores = F.array(*[sum((text.contains(h).cast("int") for h in hints), F.lit(0)) for hints in TYPE_HINTS.values()])
    best = F.array_position(scores, F.array_max(scores))
    return F.when(priced, "SMETA").when(listed, "SPEC").when(F.array_max(scores) > 0, F.element_at(F.array(*[F.lit(k) for k in TYPE_HINTS]), best.cast("int"))).otherwise("TABLE")


def signature_type(headers: Column, title: Column, signatures: dict[str, Sequence[str]], least: float = 0.34) -> Column:
    """The table type whose signature has the greatest share of words in the headers, with a bonus for one in the title; unknown below `least`."""
    text = F.lower(F.array_join(headers, " "))
    scores = []
    for words in signatures.values():
        share = sum((text.contains(w).cast("double") for w in words), F.lit(0.0)) / len(words)
        longest = F.greatest(*[F.when(F.lower(title).contains(w), F.lit(len(w))).otherwise(0) for w in words], F.lit(0))
        scores.append(share + F.when(longest > 0, 1.5 + 0.03 * longest).otherwise(0.0))
    s = F.array(*scores)
    return F.when(F.array_max(s) >= least, F.element_at(F.array(*[F.lit(k) for k in signatures]), F.array_position(s, F.array_max(s)).cast("int"))).otherwise("unknown")


def complexity(needs_ocr: Column, size: Column, pages: Column, structured: Column) -> Column:
    """How hard a document is to read: needs_ocr, heavy (over 50 MB or 200 pages), structured or simple."""
    heavy = (size > 50 * 1024 * 1024) | (pages > 200)
    return F.when(needs_ocr, "needs_ocr").when(heavy, "heavy").when(structured, "structured").otherwise("simple")


def most_restrictive(levels: Column) -> Column:
    """Of an array of P0, P2 and P1 (in growing freedom) the strictest; anything else, and no level at all, is P0."""
    known = F.forall(levels, lambda x: x.isin("P1", "P2"))
    return F.when((F.size(levels) == 0) | ~known, "P0").when(F.array_contains(levels, "P2"), "P2").otherwise("P1")


def routing_score(hits: Column, coded: Column) -> Column:
    """min(1, 0.38 + 0.18 per term + 0.12 for a code); 0 without any term."""
    return F.when(hits > 0, F.least(F.lit(1.0), 0.38 + 0.18 * hits + F.when(coded, 0.12).otherwise(0.0))).otherwise(0.0)


def nearest_word(word: Column, words: Sequence[str]) -> Column:
    """The nearest of a short list by edit distance: 1 edit up to six letters, 2 from seven on, lengths at most 2 apart; else the word itself."""
    allowed = F.when(F.length(word) <= 6, 1).otherwise(2)
    near = F.array(*[F.struct(F.levenshtein(word, F.lit(w)).alias("d"), F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in enumerate(words)])
    fit = F.filter(near, lambda x: (x["d"] <= allowed) & (F.abs(F.length(x["w"]) - F.length(word)) <= 2))
    return F.coalesce(F.array_min(fit)["w"], word)


def switched_layout(text: Column) -> Column:
    """Latin keys read as the Cyrillic letters in their places. Fixed values."""
    return F.translate(text, "qwertyuiop[]asdfghjkl;'zxcvbnm,.`", "йцукенгшщзхъфывапролджэячсмитьбюё")


#: Month stems.
MONTHS = ["январ", "феврал", "март", "апрел", "ма", "июн", "июл", "август", "сентябр", "октябр", "ноябр", "декабр"]


def period(text: Column) -> tuple[Column, Column]:
    """First and last day of "март 2024", "с 01.02.2024 по 15.02.2024", "с …" or "по …"; null for an open end."""
    low = F.lower(text)
    named = F.regexp_extract(low, r"(?:январ|феврал|март|апрел|ма[йяе]|июн|июл|август|сентябр|октябр|ноябр|декабр)\p{L}*\s+[0-9]{4}", 0)
    number = lambda m: F.coalesce(*[F.when(m.startswith(x) & ((F.lit(x) != "ма") | ~m.startswith("март")), F.lit(i + 1)) for i, x in enumerate(MONTHS)])
    # A lambda's argument is worked out once: the text is searched once for all months.
    first = F.get(F.transform(F.array(named), lambda m: F.make_date(F.nullif(F.right(m, F.lit(4)), F.lit("")).cast("int"), number(m), F.lit(1))), 0)
    day = lambda pattern: F.to_date(F.nullif(F.regexp_extract(low, pattern + r"\s*([0-9]{2}\.[0-9]{2}\.[0-9]{4})", 1), F.lit("")), "dd.MM.yyyy")
    return F.coalesce(day(r"\bс"), first), F.coalesce(day(r"\bпо"), F.last_day(first))


def quantity(text: Column, unit: str) -> Column:
    """The first number before a unit, with comma or dot."""
    found = F.regexp_extract(text, rf"(?iu)([0-9]+(?:[.,][0-9]+)?)\s*(?:{unit})(?!\p{{L}})", 1)
    return F.replace(found, F.lit(","), F.lit(".")).try_cast("double")
