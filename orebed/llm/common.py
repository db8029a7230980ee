"""What the corpus operators share: scratch space, table loading, safe renaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import clear_scratch, scratch, ship, slices, stored  # noqa: F401  shared with the operators outside of llm


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def hash128(col: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of different seeds."""
    return F.xxhash64(col), F.xxhash64(F.lit(0x5EED), col)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns whose names an operator needs for its own results."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
