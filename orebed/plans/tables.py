"""Queries over the relational tables: aggregates, joins, sets, costs and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, numbers, units
from ..functions.text import name_key
from ..operators import aggregate, cost, evaluate, graph, join, rules, sets, window
from ..session import table
from .registry import query


def price(c: str = "l_extendedprice") -> Column:
    return F.col(c).cast("decimal(18,2)")


def d(c: Column) -> Column:
    return c.cast("double")


def doubles(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def parts_sold(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))


AGG = """SELECT p_type, CAST({op} AS DOUBLE) AS value, count(*) AS n_rows FROM part JOIN lineitem ON l_partkey = p_partkey
WHERE p_name ILIKE '%ring%' GROUP BY p_type ORDER BY value DESC, p_type LIMIT 10"""


def _table_agg(op: str, sql: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = parts_sold(spark, sf).where(aggregate.contains_any(["p_name"], "ring"))
        return doubles(aggregate.top_groups(rows, ["p_type"], price(), op, 10), "value")

    run.__name__ = f"table_agg_{op}"
    run.__doc__ = f"AGG01, FLT01, TOP01: {op} by group over a filtered join, largest first."
    return query(AGG.format(op=sql))(run)


table_agg_sum = _table_agg("sum", "coalesce(sum(l_extendedprice::DECIMAL(18,2)), 0)")
table_agg_count = _table_agg("count", "count(l_extendedprice)")
table_agg_min = _table_agg("min", "min(l_extendedprice)")
table_agg_max = _table_agg("max", "max(l_extendedprice)")


@query("SELECT p_type, round(sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / count(*), 2) AS value FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_type")
def table_agg_avg(spark, sf):
    """AGG01: mean by group, from an exact sum."""
    return parts_sold(spark, sf).groupBy("p_type").agg(F.round(d(F.sum(price())) / F.count(price()), 2).alias("value"))


@query("""SELECT event_type, CAST(sum(coalesce(nullif(value, 0)::DECIMAL(18,2), try_cast(props->>'k' AS DECIMAL(18,2)))) AS DOUBLE) AS value, count(*) AS n_rows
FROM events GROUP BY event_type""")
def raw_fallback_agg(spark, sf):
    """AGG02: a typed cell that is empty or 0 falls back to the JSON row."""
    from ..functions.tables import raw_number

    e = table(spark, sf, "events").withColumn("v", F.coalesce(F.when(F.col("value") != 0, F.col("value")).cast("decimal(18,2)"), raw_number(F.col("props"), ["k"]).cast("decimal(18,2)")))
    return doubles(aggregate.top_groups(e, ["event_type"], F.col("v"), "sum"), "value")


@query("""SELECT l_returnflag AS section, lower(trim(p_name)) AS name_key, l_linestatus AS unit, CAST(sum(l_quantity::DECIMAL(18,2)) AS DOUBLE) AS qty,
count(*) FILTER (WHERE l_quantity IS NULL) AS qty_missing_rows, count(*) AS source_rows, count(DISTINCT l_orderkey) AS sources,
arg_min(l_orderkey, l_orderkey * 100 + l_linenumber) AS first_source
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3""")
def bor_consolidate(spark, sf):
    """AGG04: bill of quantities by section, name and unit."""
    names = table(spark, sf, "part").select("p_partkey", name_key(F.col("p_name")).alias("name_key"))  # once a part, not once a line
    rows = table(spark, sf, "lineitem").join(names, F.col("l_partkey") == F.col("p_partkey")).select("l_returnflag", "l_linestatus", "name_key", "l_quantity", "l_orderkey", "l_linenumber")
    out = aggregate.consolidate(rows, [F.col("l_returnflag"), F.col("name_key"), F.col("l_linestatus")], ["l_returnflag", "name_key", "l_linestatus"], price("l_quantity"), F.col("l_orderkey"), [F.col("l_orderkey"), F.col("l_linenumber")])
    return doubles(out.withColumnsRenamed({"l_returnflag": "section", "l_linestatus": "unit"}), "qty")


@query("""WITH works AS (SELECT 'small' AS k, 'cutting' AS work UNION ALL SELECT 'small', 'fitting' UNION ALL SELECT 'red', 'painting' UNION ALL SELECT 'red', 'fitting')
SELECT l_returnflag AS section, work, CAST(sum(l_quantity::DECIMAL(18,2)) AS DOUBLE) AS qty, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN works ON p_name LIKE k || ' %' GROUP BY 1, 2""")
def spec_to_works(spark, sf):
    """AGG05, PRJ28: items become one or more works by a dictionary and are summed."""
    rules = {"small": ["cutting", "fitting"], "red": ["painting", "fitting"]}
    works = F.lit(None).cast("array<string>")
    for word, done in rules.items():
        works = F.when(F.col("p_name").startswith(f"{word} "), F.array(*[F.lit(w) for w in done])).otherwise(works)
    return parts_sold(spark, sf).withColumn("work", F.explode(works)).groupBy(F.col("l_returnflag").alias("section"), "work").agg(d(F.sum(price("l_quantity"))).alias("qty"), F.count(F.lit(1)).alias("n"))


@query("""SELECT lower(trim(p_name)) AS name_key, lower(p_brand) AS unit, arg_min(p_name, (-length(p_name))::BIGINT * 1000000000 + p_partkey) AS name, CAST(sum(l_quantity::DECIMAL(18,2)) AS DOUBLE) AS qty,
count(*) FILTER (WHERE l_quantity IS NULL) AS missing, count(*) AS n_rows FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def position_sums(spark, sf):
    """AGG06: positions by name and unit with the longest spelling."""
    return doubles(aggregate.positions(parts_sold(spark, sf), "p_name", "p_brand", price("l_quantity"), [F.col("p_partkey")]), "qty")


@query("""SELECT l_partkey, l_linestatus, CAST(sum(l_quantity::DECIMAL(18,2)) AS DOUBLE) AS total, count(*) AS entries FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_returnflag IN ('A', 'R') GROUP BY 1, 2""")
def field_journal(spark, sf):
    """AGG07, FLT04: sums of a journal under optional clauses."""
    clauses = {"from": F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp"), "to": F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp"), "flags": F.col("l_returnflag").isin("A", "R"), "status": None}
    rows = table(spark, sf, "lineitem")
    for clause in (c for c in clauses.values() if c is not None):
        rows = rows.where(clause)
    return rows.groupBy("l_partkey", "l_linestatus").agg(d(F.sum(price("l_quantity"))).alias("total"), F.count(F.lit(1)).alias("entries"))


@query("""SELECT coalesce(nullif(trim(c_mktsegment), ''), '—') AS zone, count(*) AS n, CAST(sum(c_acctbal::DECIMAL(18,2)) AS DOUBLE) AS total FROM customer GROUP BY 1""")
def zone_hubs(spark, sf):
    """AGG09: zones with a dash for blanks."""
    zone = F.coalesce(F.nullif(F.trim("c_mktsegment"), F.lit("")), F.lit("—"))
    return table(spark, sf, "customer").groupBy(zone.alias("zone")).agg(F.count(F.lit(1)).alias("n"), d(F.sum(price("c_acctbal"))).alias("total"))


@query("""SELECT r_name, n_name, c_mktsegment, count(*) AS n, CAST(sum(c_acctbal::DECIMAL(18,2)) AS DOUBLE) AS balance, 3 - grouping(r_name) - grouping(n_name) - grouping(c_mktsegment) AS level
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)""")
def hier_rollup(spark, sf):
    """AGG10: three-level roll-up with subtotals."""
    c = table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("k"), F.sum(price("c_acctbal")).alias("b"))
    rows = c.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = aggregate.rollup_counts(rows, ["r_name", "n_name", "c_mktsegment"], customers=F.col("k"), balance=F.col("b")).drop("n").withColumnRenamed("customers", "n")
    return doubles(out, "balance")


@query("""SELECT p_brand, count(*) AS n, CASE WHEN min(p_type) = max(p_type) THEN min(p_type) END AS p_type, CASE WHEN min(p_size) = max(p_size) THEN min(p_size) END AS p_size
FROM part GROUP BY p_brand, p_name""")
def shared_properties(spark, sf):
    """AGG10: values that all rows of a group have in common."""
    return aggregate.shared_properties(table(spark, sf, "part"), ["p_brand", "p_name"], ["p_type", "p_size"]).drop("p_name")


@query("""SELECT l_suppkey, count(*) AS n_rows, CAST(sum(l_quantity::DECIMAL(18,2)) AS DOUBLE) AS quantity, CAST(sum(l_extendedprice::DECIMAL(18,2)) AS DOUBLE) AS price, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders
FROM lineitem GROUP BY l_suppkey""")
def load_aggregates(spark, sf):
    """AGG11: several sums and distinct counts by panel."""
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_rows"), d(F.sum(price("l_quantity"))).alias("quantity"), d(F.sum(price())).alias("price"), F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_orderkey").alias("orders"))


@query("""WITH c AS (SELECT p_type, l_returnflag AS k, sum(l_quantity::DECIMAL(18,2)) AS v, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT p_type, CAST(sum(v) AS DOUBLE) AS total, CAST(sum(n) AS BIGINT) AS n_rows, string_agg(k || '=' || CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY k) AS by_kind FROM c GROUP BY p_type""")
def inventory_pivot(spark, sf):
    """AGG12: total and a map of totals by kind."""
    out = aggregate.pivot_map(parts_sold(spark, sf), ["p_type"], "l_returnflag", price("l_quantity"))
    return out.select("p_type", d(F.col("total")).alias("total"), "n_rows", F.array_join(F.transform("by_kind", lambda x: F.concat(x["kind"], F.lit("="), x["value"].cast("long").cast("string"))), ",").alias("by_kind"))


@query("""SELECT l_returnflag, CAST(sum(l_extendedprice::DECIMAL(18,2)) AS DOUBLE) AS total, count(*) AS n_rows,
round(sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / (SELECT sum(l_extendedprice::DECIMAL(18,2)) FROM lineitem)::DOUBLE * 100, 2) AS share_pct FROM lineitem GROUP BY 1""")
def section_totals(spark, sf):
    """AGG13: estimate sections with their share of the whole."""
    return doubles(aggregate.section_totals(table(spark, sf, "lineitem"), "l_returnflag", F.col("l_extendedprice")), "total")


@query("""SELECT CAST(o_orderpriority AS VARCHAR) AS o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1""")
def status_counters(spark, sf):
    """AGG24, JOI02: rows of each status by group."""
    return aggregate.status_counts(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("""SELECT substr(p_brand, 1, 7) AS family, p_type AS collection, count(*) AS n, min(p_partkey) AS first_key, CAST(sum(p_retailprice::DECIMAL(18,2)) AS DOUBLE) AS total FROM part GROUP BY 1, 2""")
def norm_navigation(spark, sf):
    """AGG17: a catalog by code prefixes."""
    return table(spark, sf, "part").groupBy(F.substring("p_brand", 1, 7).alias("family"), F.col("p_type").alias("collection")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_key"), d(F.sum(price("p_retailprice"))).alias("total"))


KAC = """WITH q AS (SELECT lower(trim(p_name)) AS material, s_name AS supplier, ((l_extendedprice::DECIMAL(18,2) * 100)::BIGINT * 10 + 6) // 12 / 100.0::DOUBLE AS price FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
s AS (SELECT material, count(*) AS n_offers, min(price) AS price_min, max(price) AS price_max, quantile_cont(price, 0.5) AS price_median FROM q GROUP BY 1),
r AS (SELECT q.*, s.price_median, row_number() OVER (PARTITION BY q.material ORDER BY {near}, q.price, q.supplier) AS rn FROM q JOIN s USING (material))
SELECT s.material, n_offers, price_min, price_max, s.price_median, r.supplier AS chosen_supplier, r.price AS chosen_price, round((price_max - price_min) / price_min * 100, 1) AS spread_pct, n_offers >= 3 AS sufficient FROM s JOIN r ON r.material = s.material AND rn = 1"""


def _kac(strategy: str, near: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = parts_sold(spark, sf).join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        rows = rows.withColumn("net", F.round(price() / F.lit(1.2).cast("decimal(2,1)"), 2).cast("double"))
        return aggregate.quote_analysis(rows, "p_name", "s_name", F.col("net"), strategy)

    run.__name__ = f"kac_{strategy}"
    run.__doc__ = f"AGG18: quotes per material, {strategy} choice, net of tax."
    return query(KAC.format(near=near))(run)


kac_min = _kac("min", "0")
kac_median = _kac("median", "abs(q.price - s.price_median)")


@query("""SELECT o_orderkey, CAST(o_totalprice::DECIMAL(18,2) AS DOUBLE) AS orders, CAST(s.v AS DOUBLE) AS lines, CASE WHEN s.v IS NULL OR o_orderkey IS NULL THEN 'single'
WHEN greatest(o_totalprice::DECIMAL(18,2), s.v) - least(o_totalprice::DECIMAL(18,2), s.v) > greatest(0.000001, 0.01 * greatest(abs(o_totalprice::DECIMAL(18,2)), abs(s.v))::DOUBLE) THEN 'mismatch' ELSE 'match' END AS status
FROM orders FULL JOIN (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,2)) AS v FROM lineitem GROUP BY 1) s ON o_orderkey = l_orderkey WHERE o_orderkey IS NOT NULL""")
def reconcile_status(spark, sf):
    """EVL02, AGG06: quantities of two documents by key."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), price("o_totalprice").alias("q"))
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), price().alias("q"))
    out = join.reconcile({"orders": o, "lines": l}, "k", "q").join(o.select("k"), "k", "left_semi")
    return doubles(out.withColumnRenamed("k", "o_orderkey"), "orders", "lines")


@query("""WITH p AS (SELECT p_partkey AS k, p_size::DECIMAL(18,2) * 20 AS planned FROM part), f AS (SELECT l_partkey AS k, sum(l_quantity::DECIMAL(18,2)) AS done FROM lineitem GROUP BY 1)
SELECT k, planned::DOUBLE AS planned, done::DOUBLE AS done, CASE WHEN done IS NULL THEN 'plan_only' WHEN planned IS NULL THEN 'fact_only' WHEN done > planned THEN 'over' ELSE 'matched' END AS status,
(coalesce(done, 0) - coalesce(planned, 0))::DOUBLE AS delta, greatest(coalesce(planned, 0) - coalesce(done, 0), 0)::DOUBLE AS remaining, round(done::DOUBLE * 100 / planned::DOUBLE, 1) AS done_pct FROM p FULL JOIN f USING (k)""")
def plan_fact(spark, sf):
    """EVL01, JOI08: plan against fact, full outer."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), d(F.col("p_size") * 20).alias("planned"))
    f = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(d(F.sum(price("l_quantity"))).alias("done"))
    return join.plan_fact(p, f, "k", "planned", "done")


@query("""WITH p AS (SELECT p_brand AS block, lower(p_name) AS name, min(p_partkey) AS line FROM part WHERE p_size <= 10 GROUP BY 1, 2), f AS (SELECT p_partkey, p_brand AS block, lower(split_part(p_name, ' ', 2)) AS name FROM part WHERE p_size > 10)
SELECT f.p_partkey, f.block, f.name, min(p.line) AS plan_line FROM f LEFT JOIN p ON p.block = f.block AND (p.name = f.name OR (least(length(p.name), length(f.name)) >= 4 AND (contains(p.name, f.name) OR contains(f.name, p.name)))) GROUP BY 1, 2, 3""")
def plan_fact_fuzzy(spark, sf):
    """JOI08: facts to the first plan line with a containing or contained name."""
    part = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("block"), F.lower("p_name").alias("name"), "p_size")
    plan = part.where("p_size <= 10")
    fact = part.where("p_size > 10").withColumn("name", F.split_part("name", F.lit(" "), F.lit(2)))
    return join.fuzzy_first(plan, fact, "block", "name", "p_partkey", "p_partkey")


@query("""WITH book AS (SELECT p_name, arg_min(p_retailprice, p_partkey) AS price, min(p_partkey) AS k FROM part WHERE p_size < 25 GROUP BY 1)
SELECT part.p_partkey, book.price AS found_price FROM part LEFT JOIN book USING (p_name)""")
def price_lookup_first_wins(spark, sf):
    """JOI04: exact lookup, the first of duplicate codes."""
    part = table(spark, sf, "part")
    book = part.where("p_size < 25").select(F.col("p_name").alias("code"), F.col("p_retailprice").alias("found_price"), "p_partkey")
    return join.lookup(part.select("p_partkey", "p_name"), book, "p_name", "code", ["found_price"], [F.col("p_partkey")]).select("p_partkey", "found_price")


@query("""SELECT p_partkey, coalesce(CASE WHEN p_size = 1 THEN 1.0 END, CASE WHEN p_size < 20 THEN p_retailprice END, q.m) AS price,
CASE WHEN p_size = 1 THEN 'manual' WHEN p_size < 20 THEN 'book' WHEN q.m IS NOT NULL THEN 'quote' ELSE 'missing' END AS price_source
FROM part LEFT JOIN (SELECT l_partkey, min(l_extendedprice) AS m FROM lineitem GROUP BY 1) q ON l_partkey = p_partkey""")
def price_resolution(spark, sf):
    """JOI05: manual price, then price book, then quote, else missing."""
    quotes = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.min("l_extendedprice").alias("quote"))
    p = table(spark, sf, "part").join(quotes, F.col("p_partkey") == F.col("l_partkey"), "left")
    value, source = join.prioritised([("manual", F.when(F.col("p_size") == 1, F.lit(1.0))), ("book", F.when(F.col("p_size") < 20, F.col("p_retailprice"))), ("quote", F.col("quote"))])
    return p.select("p_partkey", value.alias("price"), source.alias("price_source"))


@query("""SELECT o_orderkey, l_partkey, CAST(round(l_quantity::DECIMAL(18,6) * p_size::DECIMAL(18,6), 6) AS DOUBLE) AS resource_qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey""")
def norm_expansion(spark, sf):
    """JOI06: positions become their norm's resources."""
    o = table(spark, sf, "orders").select("o_orderkey")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(table(spark, sf, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return join.expand(o, lines, "o_orderkey", "l_orderkey", F.col("l_quantity"), F.col("p_size")).select("o_orderkey", "l_partkey", d(F.col("resource_qty")).alias("resource_qty"))


@query("""SELECT p_partkey, p_name, p_retailprice, priority FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY priority DESC) AS rn FROM (
SELECT p_partkey, p_name, p_retailprice, 10 AS priority FROM part UNION ALL SELECT p_partkey, upper(p_name), p_retailprice + 1, 20 FROM part WHERE p_size > 40)) WHERE rn = 1""")
def priority_overlay(spark, sf):
    """JOI07, SET01, SET02: a seed over a base catalog."""
    base = table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")
    seed = table(spark, sf, "part").where("p_size > 40").select("p_partkey", F.upper("p_name").alias("p_name"), (F.col("p_retailprice") + 1).alias("p_retailprice"))
    return sets.priority_union([(10, base), (20, seed)], ["p_partkey"], [F.col("p_name")])


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
SELECT k, 'missing' AS finding FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'extra' FROM b WHERE k NOT IN (SELECT k FROM a)""")
def register_two_way(spark, sf):
    """JOI20, JOI10: keys that only one of two registers has."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return join.two_way_missing(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "k")


RATES = [("1992-01-01", 1.0), ("1995-01-01", 1.12), ("1997-07-01", 1.2), ("2000-01-01", 1.31)]


@query("""WITH rates(since, rate) AS (VALUES (TIMESTAMP '1992-01-01', 1.0), (TIMESTAMP '1995-01-01', 1.12), (TIMESTAMP '1997-07-01', 1.2), (TIMESTAMP '2000-01-01', 1.31))
SELECT o_orderkey, rate::DOUBLE AS rate FROM orders ASOF LEFT JOIN rates ON o_orderdate >= since""")
def asof_rate(spark, sf):
    """JOI14: the rate in force on a date, from a small dated list."""
    rate = F.lit(None).cast("double")
    for since, value in RATES:
        rate = F.when(F.col("o_orderdate") >= F.lit(since).cast("timestamp"), value).otherwise(rate)
    return table(spark, sf, "orders").select("o_orderkey", rate.alias("rate"))


@query("""SELECT e.event_id, p.value AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p
ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_join(spark, sf):
    """JOI14: as-of join by key and time through one sort, no range join."""
    e = table(spark, sf, "events")
    errors = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    purchases = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_purchase"))
    return join.as_of(errors, purchases, ["user_id"], "ts", "ts", ["last_purchase"]).select("event_id", "last_purchase")


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')""")
def orphan_customers(spark, sf):
    """JOI16: rows without a match."""
    return table(spark, sf, "customer").join(table(spark, sf, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    """JOI16: keys that stand more than once."""
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("""SELECT s_suppkey, coalesce(x.n, 0) AS n_lines, x.n IS NOT NULL AS matched, coalesce(x.q, 0)::DOUBLE AS qty FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n, sum(l_quantity::DECIMAL(18,2)) AS q FROM lineitem GROUP BY 1) x ON l_suppkey = s_suppkey""")
def load_cable_match(spark, sf):
    """JOI11: left lookup of sums, with a flag."""
    x = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum(price("l_quantity")).alias("q"))
    j = table(spark, sf, "supplier").join(x, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return j.select("s_suppkey", F.coalesce("n", F.lit(0)).alias("n_lines"), F.col("n").isNotNull().alias("matched"), d(F.coalesce("q", F.lit(0))).alias("qty"))


@query("""WITH m AS (SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS whole, s.v AS parts FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,2)) AS v FROM lineitem GROUP BY 1) s ON l_orderkey = o_orderkey)
SELECT o_orderkey, CASE WHEN abs(whole - parts) <= greatest(0.0001, 0.001 * whole::DOUBLE) THEN 'derived' ELSE 'aggregate' END AS used FROM m""")
def machinist_gate(spark, sf):
    """JOI12: parts replace a whole only if they add up to it."""
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(price()).alias("v"))
    m = table(spark, sf, "orders").join(s, F.col("o_orderkey") == F.col("l_orderkey"))
    whole = price("o_totalprice")
    fits = d(F.abs(whole - F.col("v"))) <= F.greatest(F.lit(0.0001), 0.001 * d(whole))
    return m.select("o_orderkey", F.when(fits, "derived").otherwise("aggregate").alias("used"))


@query("""SELECT o_custkey, max(o_orderdate) AS latest, arg_max(o_orderkey, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS o_orderkey, count(*) AS n FROM orders GROUP BY 1""")
def latest_order(spark, sf):
    """WIN11, SET02: the latest row of each key by max of a struct."""
    return window.best_by(table(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], ["o_orderdate", "o_orderkey"]).withColumnRenamed("o_orderdate", "latest")


@query("""SELECT a.k, CASE WHEN a.k IS NULL THEN NULL WHEN b.k IS NULL THEN 'removed' ELSE CASE WHEN a.s = b.s AND a.p = b.p THEN 'unchanged' ELSE 'changed' END END AS status,
CASE WHEN b.k IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN a.s <> b.s THEN 's' END, CASE WHEN a.p <> b.p THEN 'p' END], lambda x: x IS NOT NULL), ',') END AS changed
FROM (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p FROM orders) a LEFT JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 11 = 0 THEN '0' ELSE o_orderpriority END AS p FROM orders WHERE o_orderkey % 5 <> 0) b ON a.k = b.k""")
def keyed_diff(spark, sf):
    """SET06, EVL04: differences of two versions by key."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    new = o.where("k % 5 <> 0").withColumns({"s": F.when(F.col("k") % 7 == 0, "X").otherwise(F.col("s")), "p": F.when(F.col("k") % 11 == 0, "0").otherwise(F.col("p"))})
    return sets.keyed_diff(o, new, "k", ["s", "p"])


@query("""WITH h AS (SELECT l_orderkey, max((l_returnflag = 'R')::INT) AS d FROM lineitem GROUP BY 1) SELECT l.l_orderkey, l_linenumber, l_returnflag FROM lineitem l JOIN h USING (l_orderkey) WHERE NOT (d = 1 AND l_returnflag = 'A')""")
def alternative_kinds(spark, sf):
    """SET04: detailed rows replace average ones."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return sets.preferred_kinds(l, "l_orderkey", "l_returnflag", "R", "A")


@query("SELECT p_name AS k, count(*) AS n, count(DISTINCT p_type) AS n_p_type, count(DISTINCT p_brand) AS n_p_brand FROM part GROUP BY 1 HAVING n_p_type > 1 OR n_p_brand > 1")
def title_collisions(spark, sf):
    """SET10: equal names with other metadata."""
    return sets.collisions(table(spark, sf, "part"), "p_name", ["p_type", "p_brand"]).withColumnRenamed("p_name", "k")


@query("""SELECT DISTINCT l_suppkey AS source, l_partkey AS target, l_returnflag AS kind FROM lineitem""")
def relation_dedup(spark, sf):
    """SET07: relations once each."""
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("kind")).distinct()


@query("""WITH l AS (SELECT l_orderkey, l_returnflag, round(l_quantity::DECIMAL(14,4) * (l_extendedprice / 100)::DECIMAL(14,4), 2) AS c FROM lineitem),
t AS (SELECT l_orderkey, coalesce(sum(c) FILTER (WHERE l_returnflag = 'N'), 0) AS wages, coalesce(sum(c) FILTER (WHERE l_returnflag = 'R'), 0) AS machines, coalesce(sum(round(c * 0.3, 2)) FILTER (WHERE l_returnflag = 'R'), 0) AS machinists, coalesce(sum(c) FILTER (WHERE l_returnflag = 'A'), 0) AS materials FROM l GROUP BY 1)
SELECT l_orderkey, (wages + machines + materials)::DOUBLE AS direct, (wages + machinists)::DOUBLE AS payroll, round((wages + machinists) * 0.955, 2)::DOUBLE AS overhead, round((wages + machinists) * 0.48, 2)::DOUBLE AS profit,
(wages + machines + materials + round((wages + machinists) * 0.955, 2) + round((wages + machinists) * 0.48, 2))::DOUBLE AS total FROM t""")
def cost_position(spark, sf):
    """CST02, AGG19: position totals with overhead and profit on the payroll fund."""
    l = table(spark, sf, "lineitem").withColumn("c", cost.line_cost(F.col("l_quantity"), F.col("l_extendedprice") / 100))
    pick = lambda flag, c: F.when(F.col("l_returnflag") == flag, c)
    out = cost.position_totals(l, ["l_orderkey"], pick("N", F.col("c")), pick("R", F.col("c")), pick("R", F.round(F.col("c") * F.lit(0.3).cast("decimal(2,1)"), 2)), pick("A", F.col("c")), 95.5, 48)
    return doubles(out.select("l_orderkey", "direct", "payroll", "overhead", "profit", "total"), "direct", "payroll", "overhead", "profit", "total")


@query("""WITH l AS (SELECT l_orderkey, CASE WHEN l_partkey % 10 <> 0 THEN round(l_quantity::DECIMAL(14,4) * (l_extendedprice / 100)::DECIMAL(14,4), 2) END AS c FROM lineitem)
SELECT l_orderkey, count(*) AS n_lines, count(*) FILTER (WHERE c IS NULL) AS blockers, coalesce(sum(c), 0)::DOUBLE AS priced_amount, CASE WHEN count(*) = count(c) THEN sum(c) END::DOUBLE AS full_amount FROM l GROUP BY 1""")
def cost_blockers(spark, sf):
    """CST03, AGG20: no whole amount while a price is missing."""
    l = table(spark, sf, "lineitem").withColumn("c", F.when(F.col("l_partkey") % 10 != 0, cost.line_cost(F.col("l_quantity"), F.col("l_extendedprice") / 100)))
    return doubles(cost.blocked_total(l, "l_orderkey", F.col("c")), "priced_amount", "full_amount")


@query("""SELECT l_orderkey, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS summed, max(l_linenumber * 25)::DOUBLE AS declared, CASE WHEN abs(sum(l_quantity::DECIMAL(18,2))::DOUBLE - max(l_linenumber * 25)) <= 0.001 THEN 'ok' ELSE 'conflict' END AS status FROM lineitem GROUP BY 1""")
def quantity_audit(spark, sf):
    """AGG22: summed against declared quantities."""
    l = table(spark, sf, "lineitem").select("l_orderkey", price("l_quantity").alias("q"), d(F.col("l_linenumber") * 25).alias("declared"))
    t = l.groupBy("l_orderkey").agg(d(F.sum("q")).alias("q"), F.max("declared").alias("declared"))
    return cost.quantity_audit(t, "l_orderkey", F.col("q"), F.col("declared"))


@query("""WITH o AS (SELECT p_name, min(p_retailprice::DECIMAL(18,2)) AS lo, max(p_retailprice::DECIMAL(18,2)) AS hi, count(*) AS n FROM part GROUP BY 1) SELECT sum(lo)::DOUBLE AS min_amount, sum(hi)::DOUBLE AS max_amount, count(*) AS works, CAST(sum(n) AS BIGINT) AS options FROM o""")
def option_range(spark, sf):
    """AGG21: extremes over all choices without their product."""
    return doubles(cost.option_range(table(spark, sf, "part").withColumn("a", price("p_retailprice")), "p_name", "a"), "min_amount", "max_amount")


@query("""WITH u AS (SELECT l_orderkey, l_linenumber, l_quantity::DECIMAL(18,2) AS q, CASE l_returnflag WHEN 'A' THEN 'кг' WHEN 'R' THEN 'т' ELSE 'шт' END AS unit FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE unit WHEN 'кг' THEN q::DOUBLE / 1000 WHEN 'т' THEN q::DOUBLE END AS tonnes, unit FROM u""")
def unit_conversion(spark, sf):
    """PRJ08, PRJ09, CST06: units by alias, converted where they fit."""
    unit = F.when(F.col("l_returnflag") == "A", " КГ. ").when(F.col("l_returnflag") == "R", "тонн").otherwise("штук")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", units.converted(F.col("l_quantity"), unit, F.lit("т")).alias("tonnes"), units.unit_key(unit).alias("unit"))


@query("""SELECT o_orderkey, o_totalprice AS simple, o_totalprice AS first, o_totalprice AS local FROM orders""")
def number_parsing(spark, sf):
    """PRJ04 to PRJ07: numbers written in several ways give the same value back."""
    fixed = F.format_number("o_totalprice", 2)
    spaced = F.replace(F.replace(fixed, F.lit(","), F.lit(" ")), F.lit("."), F.lit(","))
    dotted = F.translate(fixed, ",.", ".,")
    return table(spark, sf, "orders").select("o_orderkey", numbers.safe_number(spaced).alias("simple"), numbers.first_number(F.concat(F.lit("= "), fixed, F.lit(" м2"))).alias("first"), numbers.local_number(dotted).alias("local"))


@query("""SELECT p_partkey, CASE WHEN code LIKE '91.%' THEN 'machine' WHEN code LIKE '1-%' THEN 'labor' WHEN code LIKE '4-%' THEN 'machinist' WHEN regexp_matches(code, '^[0-9]{2}\\.') THEN 'material' ELSE 'unknown' END AS kind
FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '91.05.01' WHEN 1 THEN '1-100-20' WHEN 2 THEN '4-100-30' ELSE lpad(p_size::VARCHAR, 2, '0') || '.1.02' END AS code FROM part)""")
def resource_kinds(spark, sf):
    """PRJ13: categories of resources by prefix."""
    n = F.col("p_size") % 4
    code = F.when(n == 0, "91.05.01").when(n == 1, "1-100-20").when(n == 2, "4-100-30").otherwise(F.concat(F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit(".1.02")))
    return table(spark, sf, "part").select("p_partkey", codes.resource_kind(code).alias("kind"))


@query("""WITH e AS (SELECT s_nationkey AS source, c_nationkey AS target, count(*) AS weight FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
d AS (SELECT source AS node, 1 AS o, 0 AS i, weight FROM e UNION ALL SELECT target, 0, 1, weight FROM e) SELECT node, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(weight) AS BIGINT) AS weight FROM d GROUP BY 1""")
def trade_graph(spark, sf):
    """GRF02, GRF06: in and out degrees of a weighted graph."""
    j = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return graph.degrees(j.groupBy(F.col("s_nationkey").alias("source"), F.col("c_nationkey").alias("target")).agg(F.count(F.lit(1)).alias("weight")))


@query("""SELECT 'region' AS kind, r_name AS parent, n_name AS child, 1 AS depth FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'nation', n_name, s_name, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def containment(spark, sf):
    """GRF07: parent and child edges of a hierarchy."""
    n, r, s = (table(spark, sf, t) for t in ("nation", "region", "supplier"))
    a = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit("region").alias("kind"), F.col("r_name").alias("parent"), F.col("n_name").alias("child"), F.lit(1).alias("depth"))
    return a.unionAll(s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.lit("nation"), "n_name", "s_name", F.lit(2)))


@query("""WITH x AS (SELECT o_custkey AS k, count(*) AS expected FROM orders GROUP BY 1), a AS (SELECT o_custkey AS k, count(DISTINCT o_orderkey) AS actual FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'N' GROUP BY 1)
SELECT k, coalesce(expected, 0) AS expected, coalesce(actual, 0) AS actual, CASE WHEN coalesce(expected, 0) = coalesce(actual, 0) THEN 'ok' WHEN coalesce(actual, 0) > coalesce(expected, 0) THEN 'extra' WHEN coalesce(expected, 0) - coalesce(actual, 0) >= 2 AND coalesce(expected, 0) - coalesce(actual, 0) >= 0.25 * coalesce(expected, 0) THEN 'damaged' ELSE 'missing' END AS status FROM x FULL JOIN a USING (k)""")
def integrity_audit(spark, sf):
    """EVL05, EVL10: a customer's orders against those of them with lines that were not returned."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    there = table(spark, sf, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("o_orderkey"))
    return evaluate.store_counts(o.groupBy("k").agg(F.count(F.lit(1)).alias("expected")), o.join(there, "o_orderkey", "left_semi").groupBy("k").agg(F.count(F.lit(1)).alias("actual")), "k")


@query("""WITH e AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders), a AS (SELECT l_orderkey AS k, CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) ELSE 'P' END AS v FROM lineitem GROUP BY 1)
SELECT count(*) AS works, count(*) FILTER (WHERE e.v = a.v) AS correct, count(*) FILTER (WHERE e.v <> a.v) AS wrong, count(*) FILTER (WHERE e.v IS NULL AND a.v IS NOT NULL) AS made_up, count(*) FILTER (WHERE e.v IS NOT NULL AND a.v IS NULL) AS unbound FROM e FULL JOIN a ON e.k = a.k""")
def binding_quality(spark, sf):
    """EVL09: the status of each order against that which its lines give it."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("value"))
    one = F.min("l_linestatus") == F.max("l_linestatus")
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.when(one, F.min("l_linestatus")).otherwise("P").alias("value"))
    return evaluate.binding_quality(o, lines, "k")


@query("""WITH s AS (SELECT p_partkey, p_name, lower(p_brand || ' ' || p_name) AS hay, regexp_matches(p_brand, '^Brand#[12]')::INT AS resource_code, p_type = 'PROMO' AS transport FROM part),
k AS (SELECT *, (list_contains(string_split(hay, ' '), 'red')::INT + list_contains(string_split(hay, ' '), 'ring')::INT) AS n_tokens, contains(hay, 'red ring')::INT AS phrase_match FROM s)
SELECT p_partkey, resource_code, phrase_match, (n_tokens = 2)::INT AS all_tokens, n_tokens FROM k WHERE n_tokens + phrase_match > 0 AND NOT transport ORDER BY resource_code DESC, phrase_match DESC, all_tokens DESC, n_tokens DESC, p_name, p_partkey LIMIT 50""")
def price_browse(spark, sf):
    """TOP02: the first prices for a phrase by five signs; transport left out, top k as the feature."""
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    rows = p.withColumn("code", F.concat(F.lpad(F.col("p_partkey").cast("string"), 12, "0"), F.lit(" "), "p_brand"))
    return rules.price_browse(rows, "code", "p_name", "red ring", F.col("p_brand").rlike("^Brand#[12]"), F.col("p_type") == "PROMO", 50).select("p_partkey", "resource_code", "phrase_match", "all_tokens", "n_tokens")


@query("""SELECT * FROM (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn <= 3""")
def top_per_group(spark, sf):
    """WIN01: the first rows of each group, limited before the shuffle."""
    return window.samples(table(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice"), "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")], 3)


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40""")
def paged_read(spark, sf):
    """TOP10: a page in a stable order."""
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20)


@query("""WITH s AS (SELECT p_brand, p_partkey, p_retailprice AS score, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn, lead(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS second FROM part)
SELECT p_brand, p_partkey, score, second, CASE WHEN second IS NULL OR round((score - second)::DECIMAL(18,6), 2) >= 2 THEN 'selected' ELSE 'needs_choice' END AS decision FROM s WHERE rn = 1""")
def clear_gap(spark, sf):
    """TOP06: the best candidate only if it stands clear of the second."""
    from ..operators.retrieval import clear_winner

    p = table(spark, sf, "part").select("p_brand", "p_partkey", F.col("p_retailprice").alias("score"))
    out = clear_winner(p, "p_brand", "score", "p_partkey", 2.0)
    return out.select("p_brand", "p_partkey", "score", "second", "decision")


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS sum_qty, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS sum_base, sum(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(4,2)))::DOUBLE AS sum_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, sf):
    """AGG01 over several measures: the classic pricing summary."""
    disc = price() * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))
    return table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp")).groupBy("l_returnflag", "l_linestatus").agg(d(F.sum(price("l_quantity"))).alias("sum_qty"), d(F.sum(price())).alias("sum_base"), d(F.sum(disc)).alias("sum_disc"), F.count(F.lit(1)).alias("n"))
