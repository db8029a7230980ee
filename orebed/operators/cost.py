"""Estimate arithmetic in exact decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import money


def line_cost(qty: Column, price: Column) -> Column:
    """qty x price to two places; null without a price."""
    return F.round(qty.cast("decimal(14,4)") * price.cast("decimal(14,4)"), 2)


def position_totals(df: DataFrame, by: list[str], wages: Column, machines: Column, machinists: Column, materials: Column, overhead_pct: Column | float, profit_pct: Column | float) -> DataFrame:
    """Direct cost, payroll fund, overhead, profit and total by position, each rounded to two places.

    direct = wages + machines + materials; payroll = wages + machinists;
    overhead and profit are percentages of the payroll fund.
    """
    t = df.groupBy(*by).agg(*[F.coalesce(F.sum(money(c)), F.lit(0)).cast("decimal(20,2)").alias(n) for n, c in (("wages", wages), ("machines", machines), ("machinists", machinists), ("materials", materials))])
    pct = lambda p: (p if isinstance(p, Column) else F.lit(p)).cast("decimal(6,2)")
    t = t.withColumns({"direct": (F.col("wages") + F.col("machines") + F.col("materials")).cast("decimal(20,2)"), "payroll": (F.col("wages") + F.col("machinists")).cast("decimal(20,2)")})
    t = t.withColumns({"overhead": F.round(F.col("payroll") * pct(overhead_pct) / F.lit(100).cast("decimal(3,0)"), 2), "profit": F.round(F.col("payroll") * pct(profit_pct) / F.lit(100).cast("decimal(3,0)"), 2)})
    return t.withColumn("total", F.col("direct") + F.col("overhead") + F.col("profit"))


def blocked_total(df: DataFrame, by: str, cost: Column) -> DataFrame:
    """Sum of the priced lines; full_amount only where every line has a price."""
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(cost.isNull()).alias("blockers"), F.coalesce(F.sum(cost), F.lit(0)).alias("priced_amount"), F.when(F.count_if(cost.isNull()) == 0, F.sum(cost)).alias("full_amount")
    )


def quantity_audit(df: DataFrame, by: str, qty: Column, declared: Column, tolerance: float = 0.001) -> DataFrame:
    """Summed against declared quantities: ok or conflict."""
    t = df.groupBy(by).agg(F.sum(qty).alias("summed"), F.max(declared).alias("declared"))
    return t.withColumn("status", F.when(F.abs(F.col("summed") - F.col("declared")) <= tolerance, "ok").otherwise("conflict"))


def option_range(options: DataFrame, work: str, amount: str) -> DataFrame:
    """Least and greatest total over all choices of one option for each work.

    Works are independent, so the extremes of the product of options are the
    sums of the works' extremes; no combination is laid out.
    """
    each = options.groupBy(work).agg(F.min(amount).alias("lo"), F.max(amount).alias("hi"), F.count(F.lit(1)).alias("n"))
    return each.agg(F.sum("lo").alias("min_amount"), F.sum("hi").alias("max_amount"), F.count(F.lit(1)).alias("works"), F.sum("n").alias("options"))


def machinists(resources: DataFrame, catalog: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Rows (by, kind, code, quantity) with the anonymous machinists of a position replaced by those of its machines, and (by, status, source_hours, derived_hours) of each position.

    resources are rows (by, kind, code, quantity), catalog rows (code,
    crew_hours, driver_code), one a code. A position is reconciled only if
    every machine has a crew and a driver, or neither, and the hours so
    derived are the anonymous ones within 0.1% (0.0001 at least); else it is
    unresolved and stays as it is. Without machines or anonymous machinists
    it is not_applicable.
    """
    code, quantity = F.trim(F.coalesce("code", F.lit(""))), F.coalesce(F.col("quantity"), F.lit(0.0))
    rows = resources.withColumns({"code": code, "quantity": quantity.cast("double")})
    anonymous = (F.col("kind") == "machinist") & (F.col("code") == "")
    crew, driver = F.coalesce("crew_hours", F.lit(0.0)), F.coalesce("driver_code", F.lit(""))
    m = rows.where("kind = 'machine'").join(catalog.select("code", F.lit(1).alias("_known"), "crew_hours", "driver_code"), "code", "left")
    lacking = F.col("_known").isNull() | ((crew > 0) != (driver != ""))
    m = m.withColumns({"_lacking": lacking.cast("int"), "_hours": F.when(~lacking & (crew > 0), F.round(F.col("quantity") * crew, 6))})
    machines = m.groupBy(by).agg(F.sum("_lacking").alias("_lacking"), F.round(F.coalesce(F.sum("_hours"), F.lit(0.0)), 6).alias("derived_hours"))
    source = rows.where(anonymous).groupBy(by).agg(F.round(F.sum("quantity"), 6).alias("source_hours"))
    fits = (F.col("_lacking") == 0) & (F.abs(F.col("source_hours") - F.col("derived_hours")) <= F.greatest(F.lit(0.0001), F.abs("source_hours") * 0.001))
    status = F.when(F.col("_lacking").isNull() | F.col("source_hours").isNull(), "not_applicable").when(fits, "reconciled").otherwise("unresolved")
    told = rows.select(by).distinct().join(machines, by, "left").join(source, by, "left").select(by, status.alias("status"), "source_hours", "derived_hours")
    settled = told.where("status = 'reconciled'").select(by, F.lit(True).alias("_settled"))
    kept = rows.join(settled, by, "left").where(F.col("_settled").isNull() | ~anonymous).select(by, "kind", "code", "quantity")
    derived = m.where("_hours is not null").join(settled, by).select(by, F.lit("machinist").alias("kind"), F.col("driver_code").alias("code"), F.col("_hours").alias("quantity"))
    return kept.unionByName(derived), told
