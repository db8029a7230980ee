"""Queries for rules, clauses, cards, gates and provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, numbers
from ..operators import documents
from ..session import table
from .registry import query


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'legal' WHEN contains(lower(text), 'token =') THEN 'secret' WHEN contains(text, '|') THEN 'table' WHEN contains(text, '!!') THEN 'loud' ELSE 'prose' END AS kind FROM documents""")
def document_kinds(spark, sf):
    """PRJ01, PRJ34, SRC21: the first rule of a ladder that fits."""
    kind = classify.ladder(F.lower("text"), [("legal", ["license"]), ("secret", ["token ="]), ("table", ["|"]), ("loud", ["!!"])], "prose")
    return table(spark, sf, "documents").select("doc_id", kind.alias("kind"))


@query("""SELECT doc_id, CASE WHEN contains(text, '###') THEN 'needs_ocr' WHEN n_chars > 52428800 OR n_chars // 3000 > 200 THEN 'heavy' WHEN contains(text, '|') THEN 'structured' ELSE 'simple' END AS complexity FROM documents""")
def document_complexity(spark, sf):
    """SRC20, SRC21: how hard a text is to read."""
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", classify.complexity(t.contains("###"), F.col("n_chars"), F.expr("n_chars div 3000"), t.contains("|")).alias("complexity"))


@query("""WITH l AS (SELECT source, list(DISTINCT CASE WHEN contains(text, 'token =') THEN 'P1' WHEN contains(text, '@') THEN 'P2' ELSE 'P1' END) AS levels FROM documents GROUP BY 1) SELECT source, CASE WHEN list_contains(levels, 'P2') THEN 'P2' ELSE 'P1' END AS level FROM l""")
def sensitivity_gate(spark, sf):
    """FLT13: the strictest level of a scope."""
    level = F.when(F.col("text").contains("token ="), "P1").when(F.col("text").contains("@"), "P2").otherwise("P1")
    return table(spark, sf, "documents").groupBy("source").agg(F.collect_set(level).alias("l")).select("source", classify.most_restrictive(F.col("l")).alias("level"))


@query("""WITH h AS (SELECT conv_id, turn, contains(lower(text), 'the ')::INT + contains(lower(text), ' and ')::INT + contains(lower(text), ' of ')::INT AS hits, regexp_matches(text, '[0-9]{4}') AS coded FROM conversations)
SELECT conv_id, turn, round(CASE WHEN hits > 0 THEN least(1.0, 0.38 + 0.18 * hits + CASE WHEN coded THEN 0.12 ELSE 0 END) ELSE 0 END::DOUBLE, 4) AS score FROM h""")
def routing_scores(spark, sf):
    """TXT16: score of a domain by its terms."""
    low = F.lower("text")
    hits = low.contains("the ").cast("int") + low.contains(" and ").cast("int") + low.contains(" of ").cast("int")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.round(classify.routing_score(hits, F.col("text").rlike("[0-9]{4}")), 4).alias("score"))


@query("""WITH w AS (SELECT event_id, event_type || substr('xyz', 1, (event_id % 3)::INT) AS word FROM events), n AS (SELECT event_id, word, t.w AS t, levenshtein(word, t.w) AS d, t.i FROM w, (VALUES ('click', 0), ('view', 1), ('purchase', 2), ('error', 3), ('scroll', 4)) t(w, i)
WHERE abs(length(t.w) - length(word)) <= 2 AND levenshtein(word, t.w) <= CASE WHEN length(word) <= 6 THEN 1 ELSE 2 END)
SELECT w.event_id, coalesce(arg_min(n.t, n.d * 10 + n.i), w.word) AS word FROM w LEFT JOIN n USING (event_id) GROUP BY w.event_id, w.word""")
def typo_correction(spark, sf):
    """PRJ24: the nearest of a short list of words."""
    word = F.concat("event_type", F.expr("substring('xyz', 1, cast(event_id % 3 as int))"))
    return table(spark, sf, "events").select("event_id", classify.nearest_word(word, ["click", "view", "purchase", "error", "scroll"]).alias("word"))


@query("""SELECT doc_id, try_cast(nullif(regexp_extract(text, '([0-9]{1,3})\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}', 1), '') AS DOUBLE) AS octet FROM documents""")
def physical_quantities(spark, sf):
    """PRJ26: the first number before a pattern, typed."""
    return table(spark, sf, "documents").select("doc_id", F.regexp_extract("text", r"([0-9]{1,3})\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", 1).try_cast("double").alias("octet"))


@query("""SELECT user_id, count(*) FILTER (WHERE value > 60) AS n_primary, count(*) AS n, min(value) AS confidence, string_agg(DISTINCT event_type, '+' ORDER BY event_type) AS basis,
CASE count(*) FILTER (WHERE value > 60) WHEN 1 THEN 'complete' WHEN 0 THEN 'partial' ELSE 'ambiguous' END AS status FROM events GROUP BY 1""")
def volume_cards(spark, sf):
    """AGG26: cards with a status by the number of primary parts."""
    return documents.volume_cards(table(spark, sf, "events"), "user_id", F.col("value") > 60, "value", "event_type")


@query("""SELECT source, round(avg(contains(lower(text), 'the ')::INT), 6) AS coverage, count(DISTINCT lang) AS n_sources, max(least(n_chars, 10000) / 10000.0::DOUBLE) AS top, count(*) AS n,
CASE WHEN avg(contains(lower(text), 'the ')::INT) >= 0.6 AND max(least(n_chars, 10000) / 10000.0::DOUBLE) >= 0.45 THEN 'good' WHEN avg(contains(lower(text), 'the ')::INT) >= 0.35 OR max(least(n_chars, 10000) / 10000.0::DOUBLE) >= 0.45 THEN 'weak' ELSE 'degraded' END AS quality FROM documents GROUP BY 1""")
def retrieval_quality(spark, sf):
    """TXT14: a ladder over coverage, sources and the top score."""
    d = table(spark, sf, "documents").withColumn("score", F.least("n_chars", F.lit(10000)) / 10000)
    return documents.quality_gate(d, "source", F.lower("text").contains("the "), "lang", "score").withColumn("coverage", F.round("coverage", 6))


@query("""WITH d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, contains(text, '|') AS t FROM documents),
a AS (SELECT *, greatest(2 - sum((r <= 8 AND t)::INT) OVER (PARTITION BY source), 0) AS lacking, sum((r > 8 AND t)::INT) OVER (PARTITION BY source ORDER BY r) AS behind, sum((r <= 8 AND NOT t)::INT) OVER (PARTITION BY source ORDER BY r DESC) AS from_end FROM d),
b AS (SELECT *, r > 8 AND t AND behind <= lacking AS moved FROM a), c AS (SELECT *, CASE WHEN moved THEN 1 WHEN r <= 8 AND (t OR from_end > sum(moved::INT) OVER (PARTITION BY source)) THEN 0 ELSE 2 END AS place FROM b)
SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY place, r) AS new_rank FROM c""")
def table_appendix(spark, sf):
    """TOP11: tables move up into the first places."""
    from pyspark.sql import Window

    d = table(spark, sf, "documents").select("source", "doc_id", F.col("text").contains("|").alias("t"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("r"))
    return documents.table_slots(d, "source", "r", F.col("t"), 8, 2).select("source", "doc_id", "new_rank")


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS value, count(DISTINCT l_orderkey) AS n_sources, list_sort(list_slice(list_sort(list(DISTINCT l_orderkey)), 1, 5)) AS evidence FROM lineitem GROUP BY 1, 2""")
def evidence_packets(spark, sf):
    """UDF06, AGG03: a sum that names its sources."""
    out = documents.provenance(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_quantity").cast("decimal(18,2)"), F.col("l_orderkey"))
    return out.withColumn("value", F.col("value").cast("double"))


@query("""SELECT p_name AS k, CAST(len(list(DISTINCT p_type)) AS INT) AS n_options, CASE WHEN count(DISTINCT p_type) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN count(DISTINCT p_type) = 1 THEN min(p_type) ELSE '' END AS rule FROM part GROUP BY 1""")
def norm_candidates(spark, sf):
    """JOI17, JOI21: resolved only with exactly one candidate."""
    return documents.rules_of(table(spark, sf, "part").withColumnRenamed("p_name", "k"), "k", "p_type")


@query("""SELECT event_id, key, value FROM (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events) x, LATERAL (SELECT json_extract_string(props, '$.' || key) AS value)""")
def json_properties(spark, sf):
    """ARR02, JOI03: properties as rows."""
    return documents.flatten_json(table(spark, sf, "events"), "event_id", "props")


@query("""SELECT role AS scope, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS question, arg_max(conv_id, conv_id * 1000 + turn) AS answer, count(*) AS n FROM conversations GROUP BY 1, 2""")
def answer_cache(spark, sf):
    """TXT18: the newest answer of an equal question; without times, every answer is fresh."""
    from ..functions.text import name_key

    c = table(spark, sf, "conversations").select(F.col("role").alias("scope"), "text", "turn", F.col("conv_id").alias("answer"), (F.col("conv_id") * 1000 + F.col("turn")).alias("o"))
    return documents.answers_from_cache(c, name_key(F.col("text")), "scope", F.lit(True), "o")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'whitespace_case' WHEN o_orderkey % 4 = 1 THEN 'empty_pred' WHEN o_orderkey % 4 = 2 THEN 'numeric_value' END AS error FROM orders""")
def error_taxonomy(spark, sf):
    """AGG23: why a cell differs."""
    expected = F.col("o_totalprice").cast("string")
    n = F.col("o_orderkey") % 4
    actual = F.when(n == 0, F.concat(F.lit(" "), expected)).when(n == 1, "").when(n == 2, (F.col("o_totalprice") + 1000000).cast("string")).otherwise(expected)
    return table(spark, sf, "orders").select("o_orderkey", documents.error_class(expected, actual, numbers.safe_number).alias("error"))


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS root FROM pages""")
def root_match(spark, sf):
    """JOI19: each path with the longest root above it."""
    p = table(spark, sf, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("path"))
    p = p.withColumn("path", F.concat("path", F.lit("/"), F.col("page_id").cast("string")))
    roots = p.select(F.split("path", "/")[0].alias("r")).distinct()
    return documents.longest_root(p, "path", roots, "r").select("page_id", "root")


@query("""WITH b AS (SELECT item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM benchmark), d AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM documents)
SELECT b.item_id, count(d.doc_id) AS n, count(d.doc_id) >= 1 AS enough, count(d.doc_id) >= 1 AS found FROM b LEFT JOIN d ON b.t <> '' AND contains(' ' || d.t || ' ', ' ' || b.t || ' ') GROUP BY 1""")
def golden_cases(spark, sf):
    """EVL06: cases whose whole passage must be found by a search over all documents."""
    from ..functions.text import name_key
    from ..operators.retrieval import phrase_hits

    b = table(spark, sf, "benchmark").select("item_id", name_key(F.col("text")).alias("must_find"))
    d = table(spark, sf, "documents").select("doc_id", name_key(F.col("text")).alias("content"))
    hits = phrase_hits(d, "doc_id", "content", b, "item_id", "must_find").select("item_id", "content")
    return documents.golden_cases(b.withColumn("must_find", F.array("must_find")), hits, "item_id", 1)
