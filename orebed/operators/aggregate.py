"""Grouped aggregates over project tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import money
from ..functions.tables import raw_number, raw_text
from ..functions.text import material_key, name_key
from ..functions.units import unit_key
from ..schema import GROUPABLE, NUMERIC, OPERATIONS, RAW_GROUP_HINTS, RAW_KEY_HINTS


def contains_any(columns: Sequence[str], pattern: str) -> Column:
    """Whether a pattern occurs in any of the columns, whatever the case; null does not match."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).rlike(f"(?iu){pattern}"), F.lit(False))
    return out


def top_groups(df: DataFrame, by: Sequence[str], value: Column, op: str, limit: int = 100) -> DataFrame:
    """One of sum, count, avg, min and max of value by group, largest first; null groups count, and a sum of nothing is 0."""
    if op not in OPERATIONS:
        raise ValueError(f"op {op!r} is not one of {OPERATIONS}")
    agg = {"sum": F.coalesce(F.sum(value), F.lit(0)), "count": F.count(value), "avg": F.avg(value), "min": F.min(value), "max": F.max(value)}[op]
    out = df.groupBy(*by).agg(agg.alias("value"), F.count(F.lit(1)).alias("n_rows"))
    return out.orderBy(F.desc_nulls_last("value"), *[F.asc_nulls_last(b) for b in by]).limit(limit)


def standard_value(field: str, raw: str = "raw_row") -> Column:
    """A typed field, or the raw row's number where the field is empty or 0."""
    typed = F.when(F.col(field) != 0, F.col(field))
    return F.coalesce(typed, raw_number(F.col(raw), RAW_KEY_HINTS.get(field, [])))


def standard_aggregate(df: DataFrame, field: str, op: str = "sum", group_by: str | None = None, contains: str | None = None, limit: int = 100) -> DataFrame:
    """Aggregate of a standard table by one of its fields, with values and groups from the raw row where cells are empty."""
    for given, allowed in ((field, NUMERIC), (op, OPERATIONS), (group_by, [None, *GROUPABLE])):
        if given not in allowed:
            raise ValueError(f"{given!r} is not one of {allowed}")
    if contains:
        df = df.where(contains_any([c for c in ("name", "code") if c in df.columns], contains))
    df = df.withColumn("_value", standard_value(field))
    if group_by is None:
        return top_groups(df.withColumn("_all", F.lit("all")), ["_all"], F.col("_value"), op, 1).drop("_all")
    group = F.coalesce(F.nullif(F.trim(F.col(group_by)), F.lit("")), raw_text(F.col("raw_row"), RAW_GROUP_HINTS.get(group_by, [])), F.lit(""))
    return top_groups(df.withColumn("_group", group), ["_group"], F.col("_value"), op, limit).withColumnRenamed("_group", group_by)


def consolidate(df: DataFrame, by: Sequence[Column], names: Sequence[str], qty: Column, ref: Column, order: Sequence[Column]) -> DataFrame:
    """Lines with equal keys as one: qty (null if no row has one), rows without qty, rows, distinct refs, and the first display values.

    "First" is by `order`; the refs are counted, and the first one is named.
    """
    first = F.struct(*order)
    keys = [k.alias(f"_k{i}") for i, k in enumerate(by)]
    rows = df.select(*keys, *[F.col(n) for n in names], qty.alias("_qty"), ref.alias("_ref"), first.alias("_first"))
    return (
        rows.groupBy(*[f"_k{i}" for i in range(len(keys))])
        .agg(
            *[F.min_by(n, "_first").alias(n) for n in names],
            F.sum("_qty").alias("qty"),
            F.count_if(F.col("_qty").isNull()).alias("qty_missing_rows"),
            F.count(F.lit(1)).alias("source_rows"),
            F.countDistinct("_ref").alias("sources"),
            F.min_by("_ref", "_first").alias("first_source"),
        )
        .drop(*[f"_k{i}" for i in range(len(keys))])
    )


def positions(df: DataFrame, name: str, unit: str, qty: Column, order: Sequence[Column]) -> DataFrame:
    """By name key and unit: total, rows without qty, rows, and the longest spelling of the name (the first of equals)."""
    longest = F.struct((-F.length(name)).alias("l"), *order)
    rows = df.select(name_key(F.col(name)).alias("name_key"), unit_key(F.col(unit)).alias("unit"), F.col(name).alias("_name"), qty.alias("_qty"), longest.alias("_longest"))
    return rows.groupBy("name_key", "unit").agg(
        F.min_by("_name", "_longest").alias("name"), F.sum("_qty").alias("qty"), F.count_if(F.col("_qty").isNull()).alias("missing"), F.count(F.lit(1)).alias("n_rows")
    )


def rollup_counts(df: DataFrame, levels: Sequence[str], **sums: Column) -> DataFrame:
    """Counts and sums on every level of a hierarchy, with subtotals and the grand total; level says how many keys hold."""
    return df.rollup(*levels).agg(
        *[F.grouping(c).alias(f"_g{i}") for i, c in enumerate(levels)], F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(k) for k, v in sums.items()]
    ).select(*levels, "n", *sums, (F.lit(len(levels)) - sum(F.col(f"_g{i}").cast("int") for i in range(len(levels)))).alias("level"))


def pivot_map(df: DataFrame, by: Sequence[str], kind: str, value: Column) -> DataFrame:
    """Total by group, and a map from kind to its total: two small aggregates, whatever kinds there are."""
    cells = df.groupBy(*by, kind).agg(F.sum(value).alias("_v"), F.count(F.lit(1)).alias("_n"))
    return cells.groupBy(*by).agg(F.sum("_v").alias("total"), F.sum("_n").alias("n_rows"), F.sort_array(F.collect_list(F.struct(F.col(kind).alias("kind"), F.col("_v").alias("value")))).alias("by_kind"))


def quote_analysis(quotes: DataFrame, material: str, supplier: str, price: Column, strategy: str = "min", enough: int = 3) -> DataFrame:
    """Per material: number of offers, least and greatest price, spread in percent, chosen supplier and price, and whether offers are enough.

    "min" takes the cheapest offer, "median" the one nearest to the median;
    ties go to the lower price and then to the supplier's name.
    """
    if strategy not in ("min", "median"):
        raise ValueError(f"strategy {strategy!r}")
    rows = quotes.select(material_key(F.col(material)).alias("material"), F.col(supplier).alias("_s"), price.alias("_p")).where("material <> ''")
    # One row a material, price and supplier: what a hot material costs grows with its prices, not with its offers.
    rows = rows.groupBy("material", "_p", "_s").agg(F.count("_p").alias("_n"))
    cheapest = F.min_by(F.when(F.col("_p").isNotNull(), F.struct("_s", "_p")), F.when(F.col("_p").isNotNull(), F.struct("_p", "_s")))
    stats = rows.groupBy("material").agg(F.sum("_n").alias("n_offers"), F.min("_p").alias("price_min"), F.max("_p").alias("price_max"), F.percentile("_p", 0.5, F.greatest("_n", F.lit(1))).alias("price_median"), cheapest.alias("_best"))
    if strategy == "median":
        near = F.abs(F.col("_p").cast("double") - F.col("price_median"))
        chosen = rows.join(stats.select("material", "price_median"), "material").where("_p is not null").groupBy("material").agg(F.min_by(F.struct("_s", "_p"), F.struct(near, "_p", "_s")).alias("_best"))
        stats = stats.drop("_best").join(chosen, "material", "left")
    return stats.select(
        "material", "n_offers", "price_min", "price_max", "price_median",
        F.col("_best._s").alias("chosen_supplier"), F.col("_best._p").alias("chosen_price"),
        F.round((F.col("price_max") - F.col("price_min")).cast("double") / F.nullif(F.col("price_min"), F.lit(0)).cast("double") * 100, 1).alias("spread_pct"),
        (F.col("n_offers") >= enough).alias("sufficient"),
    )


def section_totals(df: DataFrame, section: str, cost: Column) -> DataFrame:
    """Total and rows of each section, and its share of all."""
    t = df.groupBy(section).agg(F.sum(money(cost)).alias("total"), F.count(F.lit(1)).alias("n_rows"))
    whole = F.broadcast(df.agg(F.sum(money(cost)).alias("_whole")).withColumn("_one", F.lit(1)))  # one row
    share = F.round(F.col("total").cast("double") / F.col("_whole").cast("double") * 100, 2)
    return t.withColumn("_one", F.lit(1)).join(whole, "_one").select(section, "total", "n_rows", share.alias("share_pct"))


def corpus_profile(df: DataFrame, by: str, text: str, short: int = 120) -> DataFrame:
    """Texts, characters, empty, short, heading-like and table-like texts by document or source."""
    n = F.length(F.trim(F.coalesce(F.col(text), F.lit(""))))
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(n).alias("chars"),
        F.count_if(n == 0).alias("empty"),
        F.count_if((n > 0) & (n < short)).alias("short"),
        F.count_if(F.col(text).rlike(r"^(#{1,6} |[0-9]+(\.[0-9]+)* )")).alias("heading_like"),
        F.count_if(F.length(F.regexp_replace(F.col(text), r"[^|]", "")) >= 8).alias("table_like"),
    )


def shared_properties(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """For each group the values that all of its rows have in common, null where they differ."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.when((F.min(c) == F.max(c)) & (F.count(c) == F.count(F.lit(1))), F.min(c)).alias(c) for c in columns])


def status_counts(df: DataFrame, by: str, status: str, kinds: Sequence[str]) -> DataFrame:
    """Rows in all and of each status, by group."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(status) == k).alias(k.lower()) for k in kinds])


def subject_totals(rows: DataFrame, name: str, subjects: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(subject, field, total, rows) over all rows whose name has the subject: the first of the fields that the subject has values in."""
    told = F.array(*[F.when(F.col(name).contains(s), F.lit(s)) for s in subjects])
    each = rows.withColumn("subject", F.explode(F.filter(told, lambda s: s.isNotNull())))
    sums = each.groupBy("subject").agg(*[F.sum(f).alias(f) for f in fields], F.count(F.lit(1)).alias("rows"))
    field = F.coalesce(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in fields], F.lit(fields[-1]))
    return sums.select("subject", field.alias("field"), F.coalesce(*fields).alias("total"), "rows")
