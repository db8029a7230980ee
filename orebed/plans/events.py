"""Queries over events: sessions, windows, state per key and change detection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate, graph, sets, window
from ..session import checkpointed, table
from ..streaming import requests
from .registry import query


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM events GROUP BY 1, 2""")
def tumbling_events(spark, sf):
    """STR11: tumbling windows."""
    e = table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))
    return e.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("""SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS s FROM events) GROUP BY 1, 2""")
def sliding_events(spark, sf):
    """STR11: sliding windows."""
    e = table(spark, sf, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return e.select(F.col("w.start").alias("start"), "event_type", "n")


SESSIONS = """WITH g AS (SELECT *, (lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL '6 hours')::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)"""


@query(f"""{SESSIONS} SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY 1, 2""")
def session_events(spark, sf):
    """STR11, STR10: sessions by gap."""
    s = window.sessions(table(spark, sf, "events"), "user_id", "ts", 6 * 3600)
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1""")
def latest_state(spark, sf):
    """STR05, STR06, CTL01: the last state of each key."""
    e = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    return sets.latest(e, ["user_id"], [F.col("ts"), F.col("event_id")])


@query("""SELECT user_id, event_type, count(*) AS n, max(event_id) AS cursor FROM events GROUP BY 1, 2""")
def incremental_cursor(spark, sf):
    """STR01: the cursor of each folder."""
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("cursor"))


@query("""SELECT substr(sha256(user_id || '|' || event_type || '|' || value), 1, 32) AS id, count(*) AS n, min(event_id) AS first_event FROM (SELECT user_id, event_type, CAST(round(value * 100) AS BIGINT) AS value, event_id FROM events) GROUP BY 1""")
def canonical_dedup(spark, sf):
    """STR02, ARR05: one row for each canonical id."""
    key = F.substring(F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.round(F.col("value") * 100).cast("long").cast("string")), 256), 1, 32)
    return table(spark, sf, "events").groupBy(key.alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("""WITH a AS (SELECT user_id, count(*) AS size, max(ts) AS mtime FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), b AS (SELECT user_id, count(*) AS size, max(ts) AS mtime FROM events GROUP BY 1)
SELECT user_id, CASE WHEN a.user_id IS NULL THEN 'added' WHEN b.user_id IS NULL THEN 'removed' WHEN a.size = b.size AND a.mtime = b.mtime THEN 'unchanged' ELSE 'changed' END AS status FROM a FULL JOIN b USING (user_id)""")
def snapshot_changes(spark, sf):
    """STR03, STR04, SRC19: one snapshot against the next."""
    e = table(spark, sf, "events")
    snap = lambda df: df.groupBy("user_id").agg(F.count(F.lit(1)).alias("size"), F.max("ts").alias("mtime"))
    return sets.keyed_diff(snap(e.where(F.col("ts") < F.lit("2024-01-15").cast("timestamp"))), snap(e), "user_id", ["size", "mtime"]).select("user_id", "status")


@query("""WITH t AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT before, event_type AS after, count(*) AS n FROM t WHERE before IS NOT NULL GROUP BY 1, 2""")
def transitions(spark, sf):
    """GRF08: which state follows which."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = table(spark, sf, "events").select(F.lag("event_type").over(w).alias("before"), F.col("event_type").alias("after")).where("before is not null")
    return t.groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type, count(*) AS n, round(avg(value::DECIMAL(18,6))::DOUBLE, 3) AS mean, round(quantile_cont(value, 0.95), 3) AS p95, count(DISTINCT user_id) AS n_status FROM events GROUP BY 1""")
def eval_summary(spark, sf):
    """EVL08: mean and inclusive 95th percentile."""
    return evaluate.latency_summary(table(spark, sf, "events"), "event_type", "user_id", "value")


@query("""SELECT event_id, try_cast(props->>'k' AS BIGINT) AS k, len(json_keys(props)) AS n_keys FROM events""")
def json_leaves(spark, sf):
    """ARR01, ARR02: JSON cells as maps."""
    from ..functions.tables import raw_cells

    cells = raw_cells(F.col("props"))
    return table(spark, sf, "events").select("event_id", cells["k"].try_cast("long").alias("k"), F.size(F.map_keys(cells)).alias("n_keys"))


@query("""SELECT user_id, string_agg(event_type, ',' ORDER BY f) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY 1, 2) GROUP BY 1""")
def first_seen_order(spark, sf):
    """SET05, ARR03: distinct values in the order of their first sight."""
    f = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("f"))
    return f.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("f", "event_type")))["event_type"], ",").alias("kinds"))


@query("""SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts)) AS BIGINT) AS so_far FROM events GROUP BY 1, 2""")
def progress(spark, sf):
    """WIN10: running counts by day."""
    e = table(spark, sf, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return e.withColumn("so_far", F.sum("n").over(Window.partitionBy("user_id").orderBy("day")))


@query("""WITH RECURSIVE n AS (SELECT DISTINCT regexp_extract(url, '//([^/?#]*)', 1) AS h, 'page ' || page_id AS p FROM pages), e AS (SELECT h AS a, p AS b FROM n UNION ALL SELECT p, h FROM n),
r AS (SELECT DISTINCT a, a AS seen FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.seen = e.a) SELECT a AS node, min(seen) AS component FROM r GROUP BY 1""")
def connected_parts(spark, sf):
    """GRF05: connected components of hosts and their pages: as many as there are hosts."""
    edges = table(spark, sf, "pages").select(F.regexp_extract("url", "//([^/?#]*)", 1).alias("a"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("b"))
    return graph.components(edges.distinct(), "a", "b", checkpointed)


@query("""SELECT event_id, CASE WHEN before IS NULL OR ts - before > INTERVAL '1 hour' THEN 'miss' WHEN same IS DISTINCT FROM props THEN 'stale' ELSE 'hit' END AS outcome FROM (SELECT *, lag(ts) OVER w AS before, lag(props) OVER w AS same FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))""")
def session_cache(spark, sf):
    """TXT19: a request is served by the one before it of its session and kind, within an hour and under the same fingerprint."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = table(spark, sf, "events").withColumns({"before": F.lag("ts").over(w), "same": F.lag(F.sha2("props", 256)).over(w)})
    late = F.col("ts") > F.col("before") + F.expr("INTERVAL 1 HOUR")
    outcome = F.when(F.col("before").isNull() | late, "miss").when(~F.col("same").eqNullSafe(F.sha2("props", 256)), "stale").otherwise("hit")
    return e.select("event_id", outcome.alias("outcome"))


@query("""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tm, kind, event_id) AS i FROM (SELECT event_id, user_id, CASE event_type WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 ELSE 1 END AS kind, length(props)::VARCHAR AS req, event_id::VARCHAR AS resp, epoch_us(ts) AS tm FROM events)),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::VARCHAR AS req, NULL::VARCHAR AS st, NULL::VARCHAR AS resp, NULL::BIGINT AS tm, NULL::VARCHAR AS outcome, NULL::VARCHAR AS replayed FROM e
  UNION ALL SELECT user_id, i, event_id, CASE WHEN outcome IN ('started') THEN req WHEN outcome = 'released' OR NOT live THEN NULL ELSE oreq END, CASE outcome WHEN 'started' THEN 'in_progress' WHEN 'stored' THEN 'completed' ELSE ost END,
    CASE outcome WHEN 'started' THEN NULL WHEN 'stored' THEN resp ELSE oresp END, CASE WHEN outcome IN ('started', 'stored') THEN tm ELSE oat END, outcome, CASE WHEN outcome = 'completed' THEN oresp END FROM (
    SELECT *, CASE WHEN kind = 1 AND NOT live THEN 'started' WHEN kind = 1 AND mine THEN ost WHEN kind = 1 THEN 'conflict' WHEN kind = 2 AND mine THEN 'stored' WHEN kind = 3 AND mine AND ost = 'in_progress' THEN 'released' ELSE 'lost' END AS outcome FROM (
      SELECT e.*, f.req AS oreq, f.st AS ost, f.resp AS oresp, f.tm AS oat, f.req IS NOT NULL AND f.tm >= e.tm - 7200000000 AS live, f.req IS NOT NULL AND f.tm >= e.tm - 7200000000 AND f.req = e.req AS mine FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)))
SELECT event_id, outcome, replayed FROM f WHERE i > 0""")
def request_log(spark, sf):
    """STR05: claims of a key with conflicts, replays and a time to live of two hours; a user is a key, purchases complete, errors release."""
    kind = F.when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "release").otherwise("begin")
    e = table(spark, sf, "events").select("event_id", "user_id", kind.alias("kind"), F.length("props").alias("request"), F.col("event_id").cast("string").alias("response"), F.col("ts").cast("timestamp").alias("ts"))
    return requests.request_outcomes(e, ["user_id"], "kind", "request", "response", "ts", "event_id", 7200)
