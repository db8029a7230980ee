"""Answers: a cache that is asked by vectors, and checks of an answer against its context."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import name_key
from ..schema import VALIDATION_STOP_WORDS

#: Questions of a scope that one group holds on average.
BLOCK = 4096


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a matrix; a null vector, or one of another length than the first, is zero."""
    lists = column.combine_chunks()
    lengths = np.where(np.asarray(lists.is_valid()), np.diff(lists.offsets.to_numpy()), 0)
    width = int(lengths.max(initial=0))
    out = np.zeros((len(lists), width))
    whole = np.flatnonzero(lengths == width) if width else []
    starts = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    for i in whole:
        out[i] = np.nan_to_num(values[starts[i] : starts[i] + width])
    return out


def _asked(questions: pa.Table, cached: pa.Table) -> pa.Table:
    names = ["qid", "entry", "similarity"]
    if not questions.num_rows or not cached.num_rows:
        return pa.table([questions.column("qid").slice(0, 0), cached.column("entry").slice(0, 0), pa.array([], pa.float64())], names)
    order = cached.sort_by([("newness", "ascending")])
    q, c = _vectors(questions.column("vector")), _vectors(order.column("vector"))
    width = max(q.shape[1], c.shape[1])
    q, c = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] in (0, width) else np.zeros((len(m), width)) for m in (q, c))
    norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None, :]
    near = np.divide(q @ c.T, norms, out=np.zeros_like(norms), where=norms > 0).round(9)
    keys = np.array(order.column("question").to_pylist(), object)
    for i, key in enumerate(questions.column("question").to_pylist()):
        near[i, keys == key] = 1.0
    best = near.argmax(axis=1)  # the first of equal ones, which is the newest
    return pa.table([questions.column("qid"), order.column("entry").take(pa.array(best)), pa.array(near[np.arange(len(q)), best])], names)


def cached_answers(questions: DataFrame, cache: DataFrame, qid: str, entry: str, scope: str, question: str, vector: str, created: str, verified: Column, threshold: float, newest: int = 500) -> DataFrame:
    """(qid, entry, similarity): for each question the entry of its scope that is nearest, if it reaches the threshold.

    Of a scope's verified entries the `newest` are asked, a bounded list. An
    equal question, blanks and case apart, is 1; others have the cosine of the
    vectors, 0 where a norm is 0. Of equally near ones the newest counts, then
    the least entry. Scopes are dealt in blocks of questions, to each of which
    the scope's list goes; a null scope has no cache, and similarities must be
    above 0.
    """
    w = Window.partitionBy(scope).orderBy(F.desc_nulls_last(created), entry)
    kept = cache.where(verified & F.col(scope).isNotNull()).withColumn("newness", F.row_number().over(w)).where(F.col("newness") <= newest)
    kept = kept.select(F.col(scope).alias("scope"), F.col(entry).alias("entry"), name_key(F.col(question)).alias("question"), F.col(vector).cast("array<double>").alias("vector"), "newness")
    asked = questions.where(F.col(scope).isNotNull()).select(F.col(scope).alias("scope"), F.col(qid).alias("qid"), name_key(F.col(question)).alias("question"), F.col(vector).cast("array<double>").alias("vector"))
    blocks = asked.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    asked = asked.join(blocks, "scope").withColumn("block", F.pmod(F.xxhash64("qid"), "blocks")).drop("blocks")
    sent = kept.join(blocks, "scope").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    schema = f"qid {asked.schema['qid'].dataType.simpleString()}, entry {kept.schema['entry'].dataType.simpleString()}, similarity double"
    found = asked.groupBy("scope", "block").cogroup(sent.groupBy("scope", "block")).applyInArrow(_asked, schema)
    return found.where((F.col("similarity") > 0) & (F.col("similarity") >= threshold))


def rule_text(text: Column) -> Column:
    """Lower case, everything but letters, digits and underscores as single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+", " "))


#: What may stand before a number that is no claim, and units that make any number one.
BEFORE = r"(?:раздел|п\.|пункт[ы]?|постановлени[ея]|№|от|n|рис|рисунок|таблиц[аы]|табл\.|стр\.)\s*[0-9]+(?:[-–—][0-9]+)?"
UNITS = r"(?:м\b|мм\b|см\b|мин\b|ч\b|сек\b|кг\b|°|ei|re|r\b|еи\b|квт\b|вт\b|чел\b|г\b|литр|куб)"


def claimed_numbers(text: Column) -> Column:
    """Distinct numbers that a text claims: with decimals, with a unit, or from 100 on; dates, years, and numbers of lists, sections and figures do not count."""
    t = F.lower(F.coalesce(text, F.lit("")))
    for pattern in (r"\b[0-9]{1,2}[.,/][0-9]{1,2}[.,/][0-9]{2,4}\b", r"\b(?:19|20)[0-9]{2}\b", r"(?m)^[^\S\n]*[0-9]+[\s.)-]"):
        t = F.regexp_replace(t, pattern, "")
    t = F.regexp_replace(F.replace(t, F.lit("\n"), F.lit(" ")), BEFORE, "")
    pattern = F.lit(rf"(?U)\b([0-9]+(?:[,.][0-9]+)?)\b(?=(\s*{UNITS})?)")
    found = F.arrays_zip(F.regexp_extract_all(t, pattern, 1).alias("n"), F.regexp_extract_all(t, pattern, 2).alias("u"))
    number = lambda x: F.replace(x["n"], F.lit(","), F.lit("."))
    claims = F.filter(found, lambda x: number(x).contains(".") | (x["u"] != "") | (x["n"].cast("decimal(38,0)") >= 100))
    return F.array_distinct(F.transform(claims, number))


def lexical_overlap(answer: Column, context: Column) -> Column:
    """The share of an answer's words of four letters or more, without stop words, that stand in the context; 0 without any."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(answer, F.lit(""))), F.lit("[а-яёa-z0-9]{4,}"), 0), lambda t: ~t.isin(*VALIDATION_STOP_WORDS))
    near = rule_text(context)
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda t: F.contains(near, t))) / F.size(words)).otherwise(0.0)


def verdicts(pairs: DataFrame, answer: str, context: str, threshold: float = 0.35) -> DataFrame:
    """pairs with overlap, numbers (those of the answer that the context lacks), verdict and reason.

    NO_DATA without a context; VERIFIED where the context holds the answer as
    it is; HALLUCINATION where both have numbers and one of the answer's is
    not in the context; VERIFIED from the threshold of overlap on; else NO_DATA.
    """
    a, c = F.col(answer), F.col(context)
    df = pairs.withColumns({"_a": claimed_numbers(a), "_c": claimed_numbers(c), "_ta": rule_text(a), "_tc": rule_text(c), "overlap": lexical_overlap(a, c)})
    lacking = F.sort_array(F.array_except("_a", "_c"))
    blank = lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")) == ""
    reason = (
        F.when(blank(c), "empty_context")
        .when(~blank(a) & F.contains("_tc", F.col("_ta")), "answer_text_found_in_context")
        .when((F.size("_a") > 0) & (F.size("_c") > 0) & (F.size(lacking) > 0), "answer_numeric_claim_not_in_context")
        .when(F.col("overlap") >= threshold, "lexical_overlap")
        .otherwise("rules_cannot_verify_overlap")
    )
    verdict = F.when(F.col("reason").isin("answer_text_found_in_context", "lexical_overlap"), "VERIFIED").when(F.col("reason") == "answer_numeric_claim_not_in_context", "HALLUCINATION").otherwise("NO_DATA")
    return df.withColumns({"numbers": lacking, "reason": reason}).withColumn("verdict", verdict).drop("_a", "_c", "_ta", "_tc")


def unproven_numbers(answer: Column, context: Column, most: int = 5) -> Column:
    """The first numbers of an answer, of four digits or more and no years, whose digits do not stand in the context; separators do not count."""
    near = F.regexp_replace(F.coalesce(context, F.lit("")), r"[ \u00a0.,]", "")
    digits = lambda t: F.regexp_replace(t, "[^0-9]", "")
    found = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"[0-9][0-9 \u00a0.,]{2,}[0-9]"), 0)
    return F.slice(F.filter(found, lambda t: (F.length(digits(t)) >= 4) & ~digits(t).rlike("^(19[0-9]{2}|20[0-9]{2})$") & ~F.contains(near, digits(t))), 1, most)
