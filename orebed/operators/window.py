"""Ordinals, neighbours and carried values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def samples(df: DataFrame, by: str, order: Sequence[Column], limit: int) -> DataFrame:
    """The first rows of each group with their number."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit)


def neighbours(df: DataFrame, by: str, order: str, text: str, limit: int = 1200) -> DataFrame:
    """Text before and after within the group, cut to the limit."""
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumns({"context_before": F.substring(F.lag(text).over(w), 1, limit), "context_after": F.substring(F.lead(text).over(w), 1, limit)})


def window_of(df: DataFrame, by: str, order: str, text: str, radius: int) -> DataFrame:
    """Number and length of the texts within a radius of each row."""
    w = Window.partitionBy(by).orderBy(order).rangeBetween(-radius, radius)
    return df.withColumns({"window_n": F.count(text).over(w), "window_chars": F.sum(F.length(text)).over(w)})


def carried(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], value: Column, name: str) -> DataFrame:
    """The last value that is not null, and whether it is inherited."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({name: F.last(value, ignorenulls=True).over(w), f"{name}_inherited": value.isNull()})


def parents(df: DataFrame, by: str, order: str, size: int = 4) -> DataFrame:
    """Windows of a fixed number of rows: parent number, place in it and a short id."""
    n = F.floor(F.col(order) / size).cast("long")
    return df.withColumns({"parent_ord": n, "child_ord": (F.col(order) % size).cast("long"), "parent_id": F.substring(F.sha2(F.concat_ws("|", F.col(by).cast("string"), n.cast("string")), 256), 1, 24)})


def runs(df: DataFrame, by: Sequence[str], order: Sequence[str], signature: Column) -> DataFrame:
    """A number for each run of adjacent rows with an equal signature: fragments of one logical table."""
    w = Window.partitionBy(*by).orderBy(*order)
    change = (~signature.eqNullSafe(F.lag(signature).over(w))).cast("int")
    return df.withColumn("_new", change).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def best_by(df: DataFrame, by: Sequence[str], order: Sequence[Column], take: Sequence[str]) -> DataFrame:
    """The best row of each group, by max of a struct: no sort."""
    return df.groupBy(*by).agg(F.max_by(F.struct(*take), F.struct(*order)).alias("_b"), F.count(F.lit(1)).alias("n")).select(*by, "_b.*", "n")


def with_rank(df: DataFrame, by: Sequence[str], score: str, tie: str, name: str = "rank") -> DataFrame:
    """Rank from 1 by score, ties by identity."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie)))


def sessions(df: DataFrame, by: str, time: str, gap_seconds: int) -> DataFrame:
    """Number of the session of each row: a new one starts after a gap."""
    w = Window.partitionBy(by).orderBy(time, "event_id") if "event_id" in df.columns else Window.partitionBy(by).orderBy(time)
    at = F.unix_micros(F.col(time).cast("timestamp"))
    gap = at - F.lag(at).over(w)
    return df.withColumn("_new", (gap.isNull() | (gap > gap_seconds * 1_000_000)).cast("int")).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
