"""Integrity, comparison and evaluation reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(df: DataFrame, by: Sequence[str], expected: Column, actual: Column) -> DataFrame:
    """Rows, right ones and their share, by group."""
    right = F.count_if(expected.eqNullSafe(actual))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), right.alias("correct"), F.round(right / F.count(F.lit(1)), 6).alias("accuracy"))


def confusion(df: DataFrame, expected: Column, actual: Column) -> DataFrame:
    return df.groupBy(expected.alias("expected"), actual.alias("actual")).agg(F.count(F.lit(1)).alias("n"))


def latency_summary(df: DataFrame, by: str, status: str, value: str) -> DataFrame:
    """Rows by group, with mean and inclusive 95th percentile to three places."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col(value).cast("decimal(18,6)")).cast("double"), 3).alias("mean"), F.round(F.percentile(value, 0.95), 3).alias("p95"), F.countDistinct(status).alias("n_status"))


def store_counts(expected: DataFrame, actual: DataFrame, key: str, damaged_share: float = 0.25) -> DataFrame:
    """Expected against actual counts by key: ok, missing, extra or damaged (at least two and a share of all)."""
    j = expected.join(actual, key, "full").select(key, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"))
    lost = F.col("expected") - F.col("actual")
    return j.withColumn("status", F.when(lost == 0, "ok").when(lost < 0, "extra").when((lost >= 2) & (lost >= damaged_share * F.col("expected")), "damaged").otherwise("missing"))


def binding_quality(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Full outer join of bindings: right, wrong, made up and unbound."""
    j = expected.select(key, F.col("value").alias("e")).join(actual.select(key, F.col("value").alias("a")), key, "full")
    return j.agg(
        F.count(F.lit(1)).alias("works"),
        F.count_if(F.col("e").isNotNull() & (F.col("e") == F.col("a"))).alias("correct"),
        F.count_if(F.col("e").isNotNull() & F.col("a").isNotNull() & (F.col("e") != F.col("a"))).alias("wrong"),
        F.count_if(F.col("e").isNull() & F.col("a").isNotNull()).alias("made_up"),
        F.count_if(F.col("e").isNotNull() & F.col("a").isNull()).alias("unbound"),
    )
