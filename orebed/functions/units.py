"""Units of measure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import UNIT_ALIASES


def unit_key(unit: Column) -> Column:
    """The usual spelling of a unit; an unknown one stays, trimmed and in lower case."""
    clean = F.replace(F.lower(F.trim(unit)), F.lit("ё"), F.lit("е"))
    known = F.create_map(*[F.lit(x) for pair in UNIT_ALIASES.items() for x in pair])
    return F.coalesce(known[clean], clean, F.lit(""))


def converted(value: Column, source: Column, target: Column) -> Column:
    """kg and t by 1000; equal units stay; null for units that do not fit."""
    a, b = unit_key(source), unit_key(target)
    return F.when(a == b, value).when((a == "кг") & (b == "т"), value / 1000).when((a == "т") & (b == "кг"), value * 1000)


def measure_factor(measure: Column) -> Column:
    """100 of "100 м2"; 1 without a number in front."""
    return F.coalesce(F.regexp_extract(measure, r"^\s*([0-9]+(?:[.,][0-9]+)?)\s*\S", 1).try_cast("double"), F.lit(1.0))
