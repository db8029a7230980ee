"""Cells of raw rows kept as JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import first_number
from .text import name_key


def raw_cells(raw: Column) -> Column:
    """A JSON object as a map of texts; anything else as an empty one."""
    return F.coalesce(F.when(raw.startswith("{"), F.from_json(raw, "map<string,string>")), F.create_map().cast("map<string,string>"))


def raw_key(key: Column) -> Column:
    """A column name in comparable form; a hyphen before a line break joins its word."""
    return F.replace(name_key(key), F.lit("- "), F.lit(""))


def _hit(key: Column, hints: Sequence[str]) -> Column:
    out = F.lit(False)
    for h in hints:
        out = out | raw_key(key).contains(h)
    return out


def raw_number(raw: Column, hints: Sequence[str]) -> Column:
    """The number in the first cell, in the order of the source, whose name has a hint and which holds a number."""
    cells = F.map_entries(raw_cells(raw))
    numbers = F.transform(F.filter(cells, lambda e: _hit(e["key"], hints)), lambda e: first_number(e["value"]))
    return F.get(F.filter(numbers, lambda x: x.isNotNull()), 0)


def raw_text(raw: Column, hints: Sequence[str]) -> Column:
    """The text of the first cell whose name has a hint and which is not empty."""
    texts = F.transform(F.filter(F.map_entries(raw_cells(raw)), lambda e: _hit(e["key"], hints)), lambda e: F.trim(F.regexp_replace(e["value"], r"\s+", " ")))
    return F.get(F.filter(texts, lambda x: (x != "") & ~F.lower(x).isin("nan", "none")), 0)
