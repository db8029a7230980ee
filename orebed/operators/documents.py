"""Clauses, cards, packets and answers: operators on documents and their parts."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.tables import raw_cells
from ..schema import NUMBER_FIELDS, STANDARD_ROW


def normalise_rows(rows: DataFrame, cells: str, doc_type: Column, title: Column, source: Column, mapping: dict[str, str]) -> DataFrame:
    """Standard rows from rows with a map of cells: numbers parsed, texts trimmed, the row itself kept as JSON."""
    from ..functions.numbers import safe_number

    fields = {f: h for h, f in reversed(mapping.items()) if f != "skip"}
    out = []
    for f in STANDARD_ROW:
        cell = F.col(cells)[fields[f.name]] if f.name in fields else None
        if f.name in ("doc_type", "doc_title", "source_file", "raw_row"):
            c = {"doc_type": doc_type, "doc_title": title, "source_file": source, "raw_row": F.to_json(F.col(cells))}[f.name]
        elif cell is None:
            c = F.lit("" if f.dataType.typeName() == "string" else None)
        else:
            c = safe_number(cell) if f.name in NUMBER_FIELDS else F.coalesce(F.trim(cell), F.lit(""))
        out.append(c.cast(f.dataType).alias(f.name))
    return rows.select(*out)


#: Labels of the lines of a row's text.
LABELS = [("section", "Раздел"), ("name", "Наименование"), ("code", "Обозначение/Артикул"), ("mark", "Марка/Тип")]


def row_text(limit: int = 1200) -> Column:
    """A standard row as labelled lines; without any of them the raw row, cut to the limit."""
    lines = [F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{label}: "), F.col(c))) for c, label in LABELS]
    lines.append(F.when((F.col("unit") != "") & F.col("qty").isNotNull(), F.concat(F.lit("Количество: "), F.col("qty").cast("string"), F.lit(" "), F.col("unit"))))
    lines += [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{label}: "), F.format_string("%.2f", F.col(c)))) for c, label in (("price", "Цена"), ("amount", "Сумма"))]
    text = F.concat_ws("\n", *lines)
    return F.when(text != "", text).otherwise(F.substring("raw_row", 1, limit))


def clauses(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, clause, level, start, end, body): numbered clauses of each text, each as far as the next one that is not deeper.

    For each level that a text has, the last heading at or above it tells
    which clause of that level a line belongs to, if any: one running value a
    line and level, so that the work grows with lines times levels.
    """
    lines = docs.select(id_col, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    number = F.nullif(F.regexp_extract("line", r"^\s*([0-9]+(?:\.[0-9]+)*)\.?\s+\S", 1), F.lit(""))
    lines = lines.withColumn("clause", number).withColumn("level", F.when(F.col("clause").isNotNull(), F.size(F.split("clause", r"\."))))
    deepest = F.max("level").over(Window.partitionBy(id_col))
    each = lines.withColumn("_deepest", deepest).where("_deepest is not null").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_deepest"))))
    so_far = Window.partitionBy(id_col, "_k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("level") <= F.col("_k"), F.struct("level", "clause", F.col("pos").alias("start")))
    each = each.withColumn("_open", F.last(head, ignorenulls=True).over(so_far)).where("_open.level = _k")
    body = F.array_join(F.sort_array(F.collect_list(F.struct("pos", "line")))["line"], "\n")
    return each.groupBy(id_col, "_open").agg(F.max("pos").alias("end"), body.alias("body")).select(id_col, "_open.clause", "_open.level", "_open.start", "end", "body")


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff and Obershelp's ratio to three places: no built-in function has it."""
    return pd.Series([None if x is None or y is None else round(difflib.SequenceMatcher(None, x, y).ratio(), 3) for x, y in zip(a, b, strict=True)])


def text_diff(old: DataFrame, new: DataFrame, key: str, body: str) -> DataFrame:
    """added, removed, changed (with similarity) or unchanged by clause."""
    j = old.select(key, F.col(body).alias("_o")).join(new.select(key, F.col(body).alias("_n")), key, "full")
    status = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") == F.col("_n"), "unchanged").otherwise("changed")
    j = j.withColumn("status", status)
    changed = j.where("status = 'changed'").withColumn("similarity", similarity("_o", "_n"))
    same = j.where("status <> 'changed'").withColumn("similarity", F.when(F.col("status") == "unchanged", 1.0))
    return changed.unionByName(same).select(key, "status", "similarity")


def longest_root(files: DataFrame, path: str, roots: DataFrame, root: str) -> DataFrame:
    """Each file with the longest root above it, by joining all of its own parents: an equi-join, however many roots."""
    parts = F.split(F.col(path), "/")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    j = files.select(path, F.explode(parents).alias("_p")).join(roots.select(F.col(root).alias("_p")).distinct(), "_p")
    best = j.groupBy(path).agg(F.max_by("_p", F.length("_p")).alias("root"))
    return files.join(best, path, "left")


def quality_gate(hits: DataFrame, by: str, covered: Column, source: str, score: str) -> DataFrame:
    """good, weak, degraded or needs_clarification from term coverage, number of sources and the top score."""
    t = hits.groupBy(by).agg(F.avg(covered.cast("double")).alias("coverage"), F.countDistinct(source).alias("n_sources"), F.max(score).alias("top"), F.count(F.lit(1)).alias("n"))
    verdict = F.when((F.col("coverage") >= 0.6) & (F.col("top") >= 0.45), "good").when((F.col("coverage") >= 0.35) | (F.col("top") >= 0.45), "weak").when(F.col("n") > 0, "degraded").otherwise("needs_clarification")
    return t.withColumn("quality", verdict)


def golden_cases(cases: DataFrame, hits: DataFrame, case: str, least: int) -> DataFrame:
    """Per case: enough hits, and any hit that has all of must_find; a case without hits fails."""
    j = cases.join(hits, case, "left")
    has = F.forall("must_find", lambda t: F.coalesce(F.lower(F.col("content")).contains(F.lower(t)), F.lit(False)))
    return j.groupBy(case).agg(F.count("content").alias("n"), F.max(has.cast("int")).alias("_f")).select(case, "n", (F.col("n") >= least).alias("enough"), (F.col("_f") == 1).alias("found"))


def volume_cards(parts: DataFrame, by: str, primary: Column, confidence: str, basis: str) -> DataFrame:
    """One card per volume: complete with one primary document, ambiguous with several, partial without."""
    t = parts.groupBy(by).agg(F.count_if(primary).alias("n_primary"), F.count(F.lit(1)).alias("n"), F.min(confidence).alias("confidence"), F.array_join(F.sort_array(F.collect_set(basis)), "+").alias("basis"))
    return t.withColumn("status", F.when(F.col("n_primary") == 1, "complete").when(F.col("n_primary") > 1, "ambiguous").otherwise("partial"))


def table_slots(ranked: DataFrame, by: str, rank: str, is_table: Column, window: int, slots: int) -> DataFrame:
    """new_rank with at least `slots` tables among the first `window` rows, where there are so many.

    The first tables behind the window move to its end; the last rows in it
    that are no tables make room and keep their order behind it.
    """
    group = Window.partitionBy(by)
    inside = F.col(rank) <= window
    t = ranked.withColumn("_t", is_table)
    lacking = F.greatest(F.lit(slots) - F.sum((inside & F.col("_t")).cast("int")).over(group), F.lit(0))
    behind = F.sum((~inside & F.col("_t")).cast("int")).over(group.orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("_moved", ~inside & F.col("_t") & (behind <= lacking))
    from_end = F.sum((inside & ~F.col("_t")).cast("int")).over(group.orderBy(F.desc(rank)).rowsBetween(Window.unboundedPreceding, 0))
    out = inside & ~F.col("_t") & (from_end <= F.sum(F.col("_moved").cast("int")).over(group))
    place = F.when(F.col("_moved"), 1).when(inside & ~out, 0).otherwise(2)
    return t.withColumn("_place", place).withColumn("new_rank", F.row_number().over(group.orderBy("_place", rank))).drop("_t", "_moved", "_place")


def flatten_json(df: DataFrame, id_col: str, raw: str) -> DataFrame:
    """(id, key, value) of JSON objects; anything else has no rows."""
    return df.select(id_col, F.explode(raw_cells(F.col(raw))).alias("key", "value"))


def error_class(expected: Column, actual: Column, number_of) -> Column:
    """Why a cell is wrong: whitespace_case, numeric_value, char_confusion, empty_pred or text_value; null where it is right."""
    flat = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    confused = lambda c: F.translate(flat(c), "авекмнорстухё0", "abekmhopctyxeo")
    return (
        F.when(expected.eqNullSafe(actual), F.lit(None).cast("string"))
        .when(F.coalesce(F.trim(actual), F.lit("")) == "", "empty_pred")
        .when(flat(expected) == flat(actual), "whitespace_case")
        .when(confused(expected) == confused(actual), "char_confusion")
        .when(number_of(expected).isNotNull() & number_of(actual).isNotNull(), "numeric_value")
        .otherwise("text_value")
    )


def rules_of(candidates: DataFrame, by: str, rule: str, chosen: str | None = None) -> DataFrame:
    """resolved with exactly one candidate or a chosen one among them; rejected with another choice; ambiguous or unresolved else."""
    t = candidates.groupBy(by).agg(F.sort_array(F.collect_set(rule)).alias("options"), *([F.max(chosen).alias("_c")] if chosen else []))
    c = F.col("_c") if chosen else F.lit(None).cast("string")
    status = F.when(c.isNotNull() & F.array_contains("options", c), "resolved").when(c.isNotNull(), "rejected").when(F.size("options") == 1, "resolved").when(F.size("options") > 1, "ambiguous").otherwise("unresolved")
    return t.select(by, F.size("options").alias("n_options"), status.alias("status"), F.coalesce(F.when(status == "resolved", F.coalesce(c, F.get("options", 0))), F.lit("")).alias("rule"))


def answers_from_cache(cache: DataFrame, question: Column, scope: str, fresh: Column, order: str) -> DataFrame:
    """The newest fresh answer of an equal question in its scope."""
    rows = cache.where(fresh).withColumn("_q", question)
    return rows.groupBy(scope, "_q").agg(F.max_by("answer", order).alias("answer"), F.count(F.lit(1)).alias("n")).withColumnRenamed("_q", "question")


def provenance(df: DataFrame, by: Sequence[str], value: Column, locator: Column, first: int = 5) -> DataFrame:
    """A sum with evidence: number of sources and the first few locators in order."""
    keyed = df.select(*by, value.alias("_v"), locator.alias("_l"))
    w = Window.partitionBy(*by).orderBy("_l")
    top = keyed.select(*by, "_l").distinct().withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= first).groupBy(*by).agg(F.sort_array(F.collect_list("_l")).alias("evidence"))
    return keyed.groupBy(*by).agg(F.sum("_v").alias("value"), F.countDistinct("_l").alias("n_sources")).join(top, list(by))
