"""Exact de-duplication by a 128-bit content hash, with bytes compared inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of


def content_md5(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    content_hash: Callable[[Column], Column] = content_md5,
    most_broadcast: int = 500_000,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text counts as empty. `keep`
    says whether the smallest ("min") or largest ("max") id of equal texts
    stays. Rows that repeat both id and text get the same verdict, so all of
    them are kept or dropped together; ids that are null count as the last
    choice and stay only in a group without any other id. Empty input gives
    an empty result; further columns of the input are ignored.

    The hash (16 bytes) decides which rows may be equal. Hashes are counted
    after map-side combining, and those that repeat are written. Where there
    are at most most_broadcast of them they are broadcast: then no other row
    travels, and the verdicts need no shuffle at all. A larger table is joined
    by a shuffle of all rows, with their texts for the comparison. Either way
    the texts of repeated hashes are grouped by (hash, text) after map-side
    combining, so that a group of a third of all rows arrives as one row per
    task, and two texts that share a hash stay apart.
    """
    best = F.max if keep == "max" else F.min
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    rows = rows.withColumn("_hash", content_hash(F.col("_text")))

    groups = rows.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"), best("_id").alias("_best")).where("_n > 1")
    groups = stored(groups, "repeated-hashes")
    few = groups.count() <= most_broadcast
    known = F.broadcast if few else lambda df: df

    texts = rows.join(known(groups.select("_hash")), "_hash", "left_semi").groupBy("_hash", "_text").agg(F.count(F.lit(1)).alias("_tn"), best("_id").alias("_tbest"))
    # A hash with more than one text: its rows are told apart by the text itself. There is hardly ever one, so the
    # texts are compared first, and only if one is found do all rows send their texts again.
    clashing = texts.groupBy("_hash").agg(F.count(F.lit(1)).alias("_texts")).where("_texts > 1").select("_hash")
    clashing = stored(clashing, "hash-clashes")

    verdicts = rows.select("_hash", "_id", F.sha2("_text", 256).alias("text_sha256")).join(known(groups), "_hash", "left")
    verdicts = verdicts.select("_hash", "_id", "text_sha256", F.coalesce("_n", F.lit(1)).alias("_n"), F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_best")).alias("_best"))
    if clashing.limit(1).count():
        apart = rows.join(clashing, "_hash", "left_semi").join(texts, ["_hash", "_text"])
        apart = apart.select("_hash", "_id", F.sha2("_text", 256).alias("text_sha256"), F.col("_tn").alias("_n"), F.col("_tbest").alias("_best"))
        verdicts = verdicts.join(clashing, "_hash", "left_anti").unionByName(apart)
    return verdicts.select(
        F.col("_id").alias(id_col),
        F.col("_best").alias("keep_id"),
        F.col("_n").cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_best")).alias("kept"),
        "text_sha256",
    )
