"""Queries of search: fields with weights and tiers, contents by id, totals of a subject, cards, coverage of several rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregate, graph, retrieval
from ..schema import ENDINGS, STOP_WORDS
from ..session import checkpointed, table
from . import texts
from .registry import ORACLE_SQL, query
from .tables import parts_sold, price

TERMS = ["red", "ring", "brass"]
FIELDS = {"p_name": 4.0, "p_type": 1.0}


def _fielded_sql() -> str:
    """The formula written out for each field and term."""
    cells = [(f, q, f"{f}_{i}") for f in FIELDS for i, q in enumerate(TERMS)]
    counts = ", ".join(f"len(list_filter(string_split(lower({f}), ' '), lambda x: x = '{q}')) AS {c}" for f, q, c in cells)
    lengths = ", ".join(f"len(string_split(lower({f}), ' ')) AS {f}_len" for f in FIELDS)
    stats = ", ".join([*(f"avg({f}_len) AS {f}_mean" for f in FIELDS), *(f"count(*) FILTER ({c} > 0) AS df_{c}" for _, _, c in cells)])
    score = " + ".join(f"{FIELDS[f]} * ln(1 + (n - df_{c} + 0.5) / (df_{c} + 0.5)) * {c} * 2.2 / ({c} + 1.2 * (0.25 + 0.75 * {f}_len / {f}_mean))" for f, _, c in cells)
    every = " AND ".join("(" + " OR ".join(f"{f}_{i} > 0" for f in FIELDS) + ")" for i in range(len(TERMS)))
    some = " OR ".join(f"{c} > 0" for _, _, c in cells)
    return f"""WITH c AS (SELECT p_partkey, {counts}, {lengths} FROM part), s AS (SELECT count(*) AS n, {stats} FROM c),
h AS (SELECT p_partkey, CASE WHEN {every} THEN 'all' ELSE 'any' END AS tier, round({score}, 6) AS score FROM c, s WHERE {some})
SELECT p_partkey, tier, score, row_number() OVER (ORDER BY tier, score DESC, p_partkey) AS rank FROM h ORDER BY rank LIMIT 40"""


@query(_fielded_sql())
def fielded_bm25(spark, sf):
    """TXT08: weighted columns; rows with all terms first, then rows with any."""
    hits = retrieval.fielded_bm25(table(spark, sf, "part"), "p_partkey", FIELDS, TERMS, tokenise=lambda c: F.split(F.lower(c), " "))
    hits = hits.withColumn("score", F.round("score", 6))
    return retrieval.ranked(hits.orderBy("tier", F.desc("score"), "p_partkey").limit(40), ["tier", F.desc("score"), "p_partkey"], "rank")


@query("SELECT c.vec_id AS doc_id, c.score, d.source, d.n_chars, d.text FROM (" + ORACLE_SQL["cosine_topk"] + ") c JOIN documents d ON d.doc_id = c.vec_id")
def hydrated_hits(spark, sf):
    """JOI21: the contents of found ids, by one join on the id."""
    from .catalog import QUERIES

    hits = QUERIES["cosine_topk"](spark, sf).select(F.col("vec_id").alias("doc_id"), "score")
    return retrieval.hydrated(hits, table(spark, sf, "documents").select("doc_id", "source", "n_chars", "text"), "doc_id")


@query("""SELECT p.page_id, regexp_extract(p.url, '//([^/?#]*)', 1) AS location, s.pages, s.first FROM pages p LEFT JOIN (SELECT regexp_extract(url, '//([^/?#]*)', 1) AS location, count(*) AS pages, min(page_id) AS first FROM pages GROUP BY 1) s ON s.location = regexp_extract(p.url, '//([^/?#]*)', 1)""")
def registry_locations(spark, sf):
    """JOI18: each entry of a registry with its location's entry."""
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "//([^/?#]*)", 1).alias("location"))
    locations = p.groupBy("location").agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first"))
    return p.join(locations, "location", "left").select("page_id", "location", "pages", "first")


@query("""WITH r AS (SELECT s.subject, l.l_extendedprice::DECIMAL(18,2) AS amount, l.l_quantity::DECIMAL(18,2) AS qty, lower(p_name) AS name FROM lineitem l JOIN part ON l_partkey = p_partkey JOIN (SELECT unnest(['ring', 'bolt', 'plate']) AS subject) s ON contains(lower(p_name), s.subject)),
n AS (SELECT subject, qty, CASE WHEN NOT contains(name, 'bolt') THEN amount END AS amount FROM r)
SELECT subject, CASE WHEN count(amount) > 0 THEN 'amount' ELSE 'qty' END AS field, CASE WHEN count(amount) > 0 THEN sum(amount) ELSE sum(qty) END::DOUBLE AS total, count(*) AS rows FROM n GROUP BY 1""")
def subject_totals(spark, sf):
    """AGG03: the sum over all rows of a subject, of amounts or, where a subject has none, of quantities."""
    rows = parts_sold(spark, sf).select(F.lower("p_name").alias("name"), price().alias("amount"), price("l_quantity").alias("qty"))
    rows = rows.withColumn("amount", F.when(~F.col("name").contains("bolt"), F.col("amount")))
    out = aggregate.subject_totals(rows, "name", ["ring", "bolt", "plate"], ["amount", "qty"])
    return out.withColumn("total", F.col("total").cast("double"))


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents), b AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS rank FROM documents WHERE n_chars > 0),
e AS (SELECT doc_id, rank, 0 AS i FROM a WHERE rank <= 30 UNION ALL SELECT doc_id, rank, 1 FROM b WHERE rank <= 30), f AS (SELECT doc_id, min(rank * 10 + i) AS spot FROM e GROUP BY 1)
SELECT doc_id, row_number() OVER (ORDER BY spot) AS place FROM f""")
def coverage_merge(spark, sf):
    """TXT28: two rankings in turns; a row that comes again keeps its first place."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    longest = retrieval.ranked(d.orderBy(F.desc("n_chars"), "doc_id").limit(30), [F.desc("n_chars"), "doc_id"], "rank")
    shortest = retrieval.ranked(d.where("n_chars > 0").orderBy("n_chars", "doc_id").limit(30), ["n_chars", "doc_id"], "rank")
    return retrieval.round_robin([longest, shortest], "doc_id")


RERANK = ", ".join(f"'{t}'" for t in texts.TERMS)


@query(f"""WITH r AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) AS rank FROM documents),
h AS (SELECT *, list_min(list_filter(list_transform([{RERANK}], lambda t: strpos(lower(text), t)), lambda p: p > 0)) AS spot FROM r WHERE rank <= 25),
w AS (SELECT *, {texts.TOK.format("substr(text, greatest(1, coalesce(spot, 1) - 800)::BIGINT, 1600)")} AS near FROM h),
s AS (SELECT *, len(list_filter([{RERANK}], lambda t: list_contains(near, t))) / 4.0 AS overlap FROM w)
SELECT doc_id, source, rank, overlap::DOUBLE AS overlap, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN rank <= 20 THEN overlap END DESC NULLS LAST, rank) AS rerank_rank FROM s""")
def window_rerank(spark, sf):
    """TXT13: each source's best 25 of a ranking, the first 20 in the order of the terms around the first of them in the text."""
    w = Window.partitionBy("source").orderBy(F.desc_nulls_last("n_chars"), "doc_id")
    best = table(spark, sf, "documents").select("doc_id", "source", "n_chars", "text").withColumn("rank", F.row_number().over(w)).where("rank <= 25")
    best = best.withColumn("overlap", retrieval.window_overlap(F.col("text"), texts.TERMS))
    return retrieval.reranked(best, "source", "rank", 20, F.col("overlap")).select("doc_id", "source", "rank", "overlap", "rerank_rank")


CARD = {"p_type": 20, "p_name": 4, "p_brand": 2, "p_size": 1}


def _card_sql() -> str:
    """Each word's weight for each field, and the weight of the phrase."""
    key = lambda f: f"lower(trim(regexp_replace({f}::VARCHAR, '\\s+', ' ', 'g')))"
    cells = [f"contains(' ' || {key(f)} || ' ', ' {t} ')::INT * {w}" for t in ("economy", "red", "ring") for f, w in CARD.items()]
    phrase = f"contains(concat_ws(' ', {', '.join(key(f) for f in CARD)}), 'economy red ring')::INT * 12"
    return f"SELECT p_partkey, score, row_number() OVER (ORDER BY score DESC, p_partkey) AS rank FROM (SELECT p_partkey, {' + '.join([phrase, *cells])} AS score FROM part) WHERE score > 0 ORDER BY rank LIMIT 50"


@query(_card_sql())
def card_search(spark, sf):
    """TOP05: cards by the phrase and by each word's weight in each field, top k."""
    score = retrieval.card_score("economy red ring", [(F.col(f).cast("string"), w) for f, w in CARD.items()])
    order = [F.desc("score"), "p_partkey"]
    return retrieval.ranked(table(spark, sf, "part").select("p_partkey", score.alias("score")).where("score > 0").orderBy(*order).limit(50), order, "rank")


def _stem_sql() -> str:
    """The ordered endings as one case over a token t."""
    cut = " ".join(f"WHEN ends_with(t, '{e}') AND length(t) >= {len(e) + 4} THEN left(t, length(t) - {len(e)})" for e in ENDINGS)
    return f"CASE WHEN length(t) < 4 OR NOT regexp_full_match(t, '[а-яё]+') THEN t {cut} ELSE t END"


@query(f"""WITH k AS (SELECT doc_id, unnest({texts.TOK.format("text")}) AS t FROM documents), s AS (SELECT doc_id, {_stem_sql()} AS term FROM k WHERE t NOT IN ({", ".join(f"'{w}'" for w in sorted(STOP_WORDS))}))
SELECT term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM s GROUP BY 1""")
def stemmed_terms(spark, sf):
    """PRJ14, PRJ23: search tokens without stop words and endings, with their frequencies."""
    posts = retrieval.postings(table(spark, sf, "documents"), "doc_id", "text", T.tokens)
    return retrieval.document_frequencies(posts, "doc_id").select("term", "cf", "df")


@query("""WITH RECURSIVE b AS (SELECT l_orderkey * 100 + l_linenumber AS id, l_orderkey AS sheet, date_diff('day', DATE '1992-01-01', min(l_shipdate)::DATE) AS x0, date_diff('day', DATE '1992-01-01', max(l_shipdate)::DATE) + max(l_quantity) AS x1, l_linenumber * 100 AS y FROM lineitem GROUP BY l_orderkey, l_linenumber),
e AS (SELECT a.id AS a, c.id AS b FROM b a JOIN b c ON a.sheet = c.sheet AND a.x0 <= c.x1 + 100 AND c.x0 <= a.x1 + 100 AND abs(a.y - c.y) <= 100),
r AS (SELECT id, id AS seen FROM b UNION SELECT r.id, e.b FROM r JOIN e ON r.seen = e.a) SELECT id AS node, min(seen) AS component FROM r GROUP BY 1""")
def touching_boxes(spark, sf):
    """GRF05: an order's lines as boxes of days and places; components of the boxes that touch within 100."""
    day = lambda c: F.datediff(c, F.lit("1992-01-01").cast("date"))
    b = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(day(F.min("l_shipdate")).cast("double").alias("x0"), (day(F.max("l_shipdate")) + F.max("l_quantity")).alias("x1"))
    b = b.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("node"), F.col("l_orderkey").alias("sheet"), "x0", "x1", *[(F.col("l_linenumber") * 100.0).alias(y) for y in ("y0", "y1")])
    parts = graph.components(graph.contracted(graph.touching(b, "node", "sheet", 100, 200), "a", "b"), "a", "b", checkpointed)
    return b.select("node").join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
