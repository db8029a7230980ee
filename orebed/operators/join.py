"""Lookups, reconciliations and matches between project tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in the given order."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def lookup(left: DataFrame, right: DataFrame, key: str, right_key: str, take: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """left with columns of the first matching row of right, null without one."""
    found = first_wins(right.select(right_key, *take, *[o.alias(f"_o{i}") for i, o in enumerate(order)]), right_key, [F.col(f"_o{i}") for i in range(len(order))])
    found = found.select(F.col(right_key).alias("_key"), *take)
    return left.join(found, left[key] == found["_key"], "left").drop("_key")


def prioritised(sources: Sequence[tuple[str, Column]]) -> tuple[Column, Column]:
    """(value, name of the source): the first source that is not null; "missing" without any."""
    value, name = F.lit(None), F.lit("missing")
    for label, column in reversed(sources):
        value, name = F.coalesce(column, value), F.when(column.isNotNull(), F.lit(label)).otherwise(name)
    return value, name


def as_of(left: DataFrame, right: DataFrame, key: Sequence[str], left_time: str, right_time: str, take: Sequence[str]) -> DataFrame:
    """left with columns of right's latest row of the same key that is not later: one sort of both by key and time."""
    l = left.select(*left.columns, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(F.struct(*take)).schema[0].dataType).alias("_r"))
    r = right.select(*[(F.col(c) if c in key else F.lit(None).cast(left.schema[c].dataType)).alias(c) for c in left.columns], F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*take).alias("_r"))
    w = Window.partitionBy(*key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("_r", F.last("_r", ignorenulls=True).over(w))
    return both.where("_side = 1").select(*left.columns, *[F.col(f"_r.{c}").alias(c) for c in take])


def agreement(values: Column, tolerance: float = 0.01, least: float = 1e-6) -> Column:
    """Whether the greatest and least of an array differ by no more than the tolerance allows."""
    most = F.array_max(F.transform(values, F.abs))
    return F.array_max(values) - F.array_min(values) <= F.greatest(F.lit(least), F.lit(tolerance) * most)


def reconcile(sides: dict[str, DataFrame], key: str, qty: str, tolerance: float = 0.01) -> DataFrame:
    """Quantities of several documents by key: single, mismatch, gap or match, in this precedence.

    Every side is summed by key first; one aggregation pivots the few sides,
    so no side is joined.
    """
    every = None
    for name, df in sides.items():
        part = df.select(key, F.lit(name).alias("_side"), F.col(qty).alias("_q"))
        every = part if every is None else every.unionByName(part)
    by_side = [F.sum(F.when(F.col("_side") == n, F.col("_q"))).alias(n) for n in sides]
    out = every.groupBy(key).agg(*by_side)
    present = F.filter(F.array(*[F.col(n) for n in sides]), lambda x: x.isNotNull())
    status = (
        F.when(F.size(present) <= 1, "single")
        .when(~agreement(present, tolerance), "mismatch")
        .when(F.size(present) < len(sides), "gap")
        .otherwise("match")
    )
    return out.withColumn("status", status)


def plan_fact(plan: DataFrame, fact: DataFrame, key: str, planned: str, done: str, eps: float = 1e-6) -> DataFrame:
    """Full outer join of sums: plan_only, fact_only, matched or over, with what is left and the share done."""
    j = plan.select(key, F.col(planned).alias("planned")).join(fact.select(key, F.col(done).alias("done")), key, "full")
    status = F.when(F.col("done").isNull(), "plan_only").when(F.col("planned").isNull(), "fact_only").when(F.col("done") > F.col("planned") + eps, "over").otherwise("matched")
    delta = F.coalesce("done", F.lit(0)) - F.coalesce("planned", F.lit(0))
    return j.select(key, "planned", "done", status.alias("status"), delta.alias("delta"), F.greatest(F.coalesce("planned", F.lit(0)) - F.coalesce("done", F.lit(0)), F.lit(0)).alias("remaining"), F.round(F.col("done") * 100 / F.nullif(F.col("planned"), F.lit(0)), 1).alias("done_pct"))


def containment_pairs(left: DataFrame, right: DataFrame, block: str, shortest: int = 4) -> DataFrame:
    """(block, left, right) of the distinct names of two frames (block, name) that are equal, or one of which contains the other.

    A name of at least `shortest` characters that another one contains begins
    somewhere in it with its first `shortest` characters: these join the
    other's character grams, an equi-join that lays out no pairs without a
    common gram.
    """
    l, r = left.select(block, F.col(left.columns[1]).alias("left")).distinct(), right.select(block, F.col(right.columns[1]).alias("right")).distinct()

    def inside(short: DataFrame, s: str, long: DataFrame, n: str) -> DataFrame:
        starts = F.sequence(F.lit(1), F.greatest(F.length(n) - shortest + 1, F.lit(1)))
        grams = long.withColumn("_g", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substr(F.col(n), i, F.lit(shortest))))))
        heads = short.where(F.length(s) >= shortest).withColumn("_g", F.substring(s, 1, shortest))
        return heads.join(grams, [block, "_g"]).where(F.col(n).contains(F.col(s))).select(block, "left", "right")

    equal = l.join(r.withColumn("_n", F.col("right")), (l[block] == r[block]) & (F.col("left") == F.col("_n"))).select(l[block], "left", "right")
    return equal.unionByName(inside(l, "left", r, "right")).unionByName(inside(r, "right", l, "left")).distinct()


def fuzzy_first(plan: DataFrame, fact: DataFrame, block: str, name: str, plan_order: str, fact_id: str, shortest: int = 4) -> DataFrame:
    """Each fact with the first plan line of its block whose name is equal, or contains or is contained in its own; null without one.

    Distinct names are compared once, so repeated lines cost nothing; facts
    are independent of each other.
    """
    pn = plan.groupBy(block, F.col(name).alias("left")).agg(F.min(plan_order).alias("_first"))
    pairs = containment_pairs(plan.select(block, name), fact.select(block, name), block, shortest)
    hit = pairs.join(pn, [block, "left"]).groupBy(block, "right").agg(F.min("_first").alias("plan_line"))
    return fact.select(block, F.col(name).alias("right"), fact_id).join(hit, [block, "right"], "left").select(fact_id, block, F.col("right").alias(name), "plan_line")


def two_way_missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has: missing (only left) and extra (only right)."""
    l, r = left.select(key).distinct(), right.select(key).distinct()
    return l.join(r, key, "left_anti").withColumn("finding", F.lit("missing")).unionByName(r.join(l, key, "left_anti").withColumn("finding", F.lit("extra")))


def expand(position: DataFrame, norm: DataFrame, key: str, norm_key: str, qty: Column, per_unit: Column) -> DataFrame:
    """Positions times their norm's resources, with qty = round(per_unit x position qty, 6)."""
    j = position.join(norm, F.col(key) == F.col(norm_key))
    return j.withColumn("resource_qty", F.round(qty.cast("decimal(18,6)") * per_unit.cast("decimal(18,6)"), 6))
