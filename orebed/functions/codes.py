"""Codes of norms, prices, files and sheets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bare_code(code: Column) -> Column:
    """A code without blanks and its alphabetic base in front."""
    return F.regexp_replace(F.regexp_replace(code, r"\s+", ""), r"^[\p{L}]+[:\-_]?", "")


def resource_kind(code: Column) -> Column:
    """What a resource code stands for, by its prefix."""
    c = F.upper(F.trim(code))
    return (
        F.when(c.startswith("П"), "project_quantity")
        .when(c.startswith("ТЦ_") | c.startswith("КАЦ"), "price_item")
        .when(c.rlike("^1-"), "labor")
        .when(c.rlike("^4-"), "machinist")
        .when(c.startswith("91."), "machine")
        .when(c.rlike(r"^[0-9]{2}\."), "material")
        .otherwise("unknown")
    )


def file_parts(name: Column) -> Column:
    """building, system, floor, line and date of a file name with underscores."""
    p = F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "_")
    return F.struct(*[F.get(p, i).alias(n) for i, n in enumerate(("building", "system", "floor", "line", "date"))])


def sheet_format(width: Column, height: Column, tolerance: float = 3.0) -> Column:
    """A0 to A4, or a multiple such as A4x3: the short side is the base's long side and the long side n short ones."""
    a, b = F.least(width, height), F.greatest(width, height)
    base = {"A0": (841, 1189), "A1": (594, 841), "A2": (420, 594), "A3": (297, 420), "A4": (210, 297)}
    out = F.lit(None).cast("string")
    for name, (s, l) in base.items():
        n = F.round(b / s)
        out = F.coalesce(out, F.when((F.abs(a - l) <= tolerance) & (n >= 3) & (F.abs(b - s * n) <= tolerance * n), F.concat(F.lit(f"{name}x"), n.cast("int").cast("string"))))
    for name, (s, l) in base.items():
        out = F.when((F.abs(a - s) <= tolerance) & (F.abs(b - l) <= tolerance), F.lit(name)).otherwise(out)
    return out


def collection_key(code: Column) -> Column:
    """Family and two-digit collection of a norm's code, such as ГЭСНм:38."""
    return F.concat(F.regexp_extract(code, r"^\s*(\p{L}+)", 1), F.lit(":"), F.regexp_extract(code, r"([0-9]{2})-", 1))
