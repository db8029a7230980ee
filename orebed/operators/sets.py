"""Set operations, distinct rows, differences and audits of repetition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key, by max of a struct with map-side combining."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*by, "_r.*")


def priority_union(sources: Sequence[tuple[int, DataFrame]], by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows of several sources; of equal keys the one of the highest priority stays, then the last in order."""
    every = None
    for priority, df in sources:
        part = df.withColumn("priority", F.lit(priority))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    return latest(every, by, [F.col("priority"), *order])


def keyed_diff(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """added, removed, changed or unchanged by key, and which columns changed."""
    o = old.select(F.col(key).alias("_k"), F.struct(*columns).alias("_o"))
    n = new.select(F.col(key).alias("_k"), F.struct(*columns).alias("_n"))
    differs = F.array_compact(F.array(*[F.when(~F.col(f"_o.{c}").eqNullSafe(F.col(f"_n.{c}")), F.lit(c)) for c in columns]))
    status = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.size(differs) > 0, "changed").otherwise("unchanged")
    return o.join(n, "_k", "full").select(F.col("_k").alias(key), status.alias("status"), F.when(status == "changed", F.array_join(differs, ",")).otherwise("").alias("changed"))


def ordered_distinct(values: Column) -> Column:
    return F.array_distinct(values)


def duplicate_clusters(df: DataFrame, text: str, group: str) -> DataFrame:
    """Texts that stand in more than one group, with rows, groups and surplus copies."""
    return (
        df.groupBy(F.sha2(F.col(text), 256).alias("content_hash"))
        .agg(F.count(F.lit(1)).alias("n"), F.countDistinct(group).alias("n_groups"))
        .where("n_groups > 1")
        .withColumn("surplus", F.col("n") - 1)
    )


def preferred_kinds(df: DataFrame, by: str, kind: str, detail: str, average: str) -> DataFrame:
    """Of alternative rows of a group the detailed ones, else the average ones, else all; other kinds stay."""
    has = df.groupBy(by).agg(F.max((F.col(kind) == detail).cast("int")).alias("_d"), F.max((F.col(kind) == average).cast("int")).alias("_a"))
    keep = F.when(F.col("_d") == 1, F.col(kind) != average).otherwise(F.lit(True))
    return df.join(has, by).where(keep).drop("_d", "_a")


def collisions(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys whose rows differ in any of the columns."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.countDistinct(c).alias(f"n_{c}") for c in columns]).where(" or ".join(f"n_{c} > 1" for c in columns))
