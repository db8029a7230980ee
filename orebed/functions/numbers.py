"""Numbers in text cells, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = "[\\s  ]"


def as_double(text: Column) -> Column:
    """try_cast that also takes no words such as NaN for numbers."""
    return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))


def safe_number(cell: Column) -> Column:
    """Blanks gone, comma as the decimal point; null where the rest is no number."""
    return as_double(F.replace(F.regexp_replace(cell, BLANK, ""), F.lit(","), F.lit(".")))


def first_number(cell: Column) -> Column:
    """The first number of a cell; of two kinds of separators the last one is decimal."""
    found = F.regexp_replace(F.regexp_extract(F.regexp_replace(cell, BLANK, ""), r"(-?[0-9][0-9.,]*)", 1), "[.,]+$", "")
    comma, dot = F.length(found) - F.locate(",", F.reverse(found)), F.length(found) - F.locate(".", F.reverse(found))
    both = found.contains(",") & found.contains(".")
    plain = (
        F.when(both & (comma > dot), F.replace(F.replace(found, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(both, F.replace(found, F.lit(","), F.lit("")))
        .otherwise(F.replace(found, F.lit(","), F.lit(".")))
    )
    return as_double(plain)


def local_number(cell: Column) -> Column:
    """Dots as thousands and a comma as the decimal point where both occur; else either one is decimal."""
    kept = F.regexp_replace(cell, r"[^0-9,.+-]", "")
    both = kept.contains(",") & kept.contains(".")
    return as_double(F.replace(F.when(both, F.replace(kept, F.lit("."), F.lit(""))).otherwise(kept), F.lit(","), F.lit(".")))


def price_number(cell: Column) -> Column:
    """A price; dashes and x mean that there is none."""
    bare = F.lower(F.regexp_replace(cell, BLANK, ""))
    return F.when(bare.isin("", "-", "–", "—", "x", "х"), None).otherwise(safe_number(cell))


def shown_number(value: Column) -> Column:
    """A whole number where it is one within 1e-6, else two decimals; thousands apart by spaces."""
    whole = F.abs(value - F.round(value)) < 1e-6
    return F.replace(F.when(whole, F.format_number(F.round(value), 0)).otherwise(F.format_number(value, 2)), F.lit(","), F.lit(" "))


def money(value: Column) -> Column:
    """Wide decimal first, then two places: both halves away from zero, alike in every engine."""
    return F.round(value.cast("decimal(28,6)"), 2)
