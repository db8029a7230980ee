"""Spreadsheets, JSON documents and what is known of their columns."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import header_field
from ..functions.numbers import price_number
from .files import binary, clean_matrix

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_matrices(data: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """(name, rows of texts) of each sheet of an .xlsx file, from its XML."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_MAIN}si")]
    sheets = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]
    files = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    for name, file in zip(sheets, files, strict=False):
        rows = []
        for row in ElementTree.fromstring(z.read(file)).iter(f"{_MAIN}row"):
            cells: dict[int, str] = {}
            for c in row.findall(f"{_MAIN}c"):
                value = c.find(f"{_MAIN}v")
                text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t")) if c.get("t") == "inlineStr" else "" if value is None else value.text or ""
                cells[_column(c.get("r"))] = shared[int(text)] if c.get("t") == "s" and text else text
            rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        yield name, rows


def xlsx_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, cells as a map): headers are found by clean_matrix; one task reads whole files, never part of one."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"], strict=True):
                for sheet, matrix in sheet_matrices(bytes(data)):
                    names, body = clean_matrix(matrix)
                    rows = [(file, sheet, i, json.dumps(dict(zip(names, r, strict=True)), ensure_ascii=False)) for i, r in enumerate(body)]
                    yield pd.DataFrame(rows, columns=["path", "sheet", "row", "cells"])

    raw = binary(spark, path, "*.xlsx").select("path", "content").mapInPandas(read, "path string, sheet string, row int, cells string")
    return raw.withColumn("cells", F.from_json("cells", "map<string,string>"))


def mapped_cells(rows: DataFrame, cells: str = "cells") -> DataFrame:
    """(…, field, value): every cell with its header's standard field; skipped headers are left out."""
    keys = [c for c in rows.columns if c != cells]
    return rows.select(*keys, F.explode(cells).alias("header", "value")).withColumn("field", header_field(F.col("header"))).where("field <> 'skip'")


def price_rows(rows: DataFrame, code: Column, name: Column, prices: dict[str, Column], region: str, quarter: str) -> DataFrame:
    """Typed price rows of one region and quarter; a dash is no price, and rows without a code are left out."""
    typed = rows.select(F.trim(code).alias("code"), F.trim(name).alias("name"), *[price_number(c).alias(k) for k, c in prices.items()])
    return typed.where("code <> ''").withColumns({"region": F.lit(region), "quarter": F.lit(quarter)})


def json_texts(spark: SparkSession, path: str, depth: int = 2) -> DataFrame:
    """(path, text): all texts of JSON files down to a depth, in the order of the file."""

    def walk(value, left: int) -> Iterator[str]:
        if isinstance(value, dict) and left >= 0:
            for k, v in value.items():
                if isinstance(v, (dict, list)):
                    yield from walk(v, left - 1)
                elif v not in (None, ""):
                    yield f"{k}: {v}"
        elif isinstance(value, list) and left >= 0:
            for v in value:
                yield from walk(v, left - 1) if isinstance(v, (dict, list)) else [str(v)]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.append((name, "\n".join(walk(json.loads(bytes(data)), depth))))
                except ValueError:
                    rows.append((name, None))
            yield pd.DataFrame(rows, columns=["path", "text"])

    return binary(spark, path, "*.json").select("path", "content").mapInPandas(read, "path string, text string")


def column_profile(df: DataFrame, examples: int = 5) -> DataFrame:
    """Per column: values that are not null, numbers with their least, greatest and sum where at least three and half of them are numbers, and a few distinct values.

    One pass over all columns as rows of (column, value), with map-side combining.
    """
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns])).alias("x")).select("x.*").where("value is not null")
    number = F.col("value").try_cast("double")
    distinct = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.min(number).alias("v"))
    out = distinct.groupBy("column").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_distinct"), F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("n_numbers"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum(F.col("v") * F.col("n")).alias("total")
    )
    from pyspark.sql import Window

    first = distinct.withColumn("rn", F.row_number().over(Window.partitionBy("column").orderBy("value"))).where(F.col("rn") <= examples)
    few = first.groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("examples"))
    numeric = F.col("n_numbers") >= F.greatest(F.lit(3), F.col("n") / 2)
    return out.join(few, "column").select("column", "n", "n_distinct", *[F.when(numeric, F.col(c)).alias(c) for c in ("lo", "hi", "total")], "examples")
