"""Queries over texts, chunks, pages and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregate, evaluate, graph, retrieval, sets, window
from ..session import table
from .registry import query

#: The tokens of the text search in SQL: at least three characters of [0-9a-zа-я.-], without outer dots and hyphens.
TOK = r"list_filter(list_transform(regexp_extract_all(replace(replace(lower({}), 'ß', 'ss'), 'ё', 'е'), '[0-9a-zа-я.-]{{2,}}'), lambda t: trim(t, '.-')), lambda t: length(t) >= 3)"


def docs_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


@query(r"""SELECT source, count(*) AS n, CAST(sum(length(trim(text))) AS BIGINT) AS chars, count(*) FILTER (WHERE trim(text) = '') AS empty, count(*) FILTER (WHERE trim(text) <> '' AND length(trim(text)) < 120) AS short,
count(*) FILTER (WHERE regexp_matches(text, '^(#{1,6} |[0-9]+(\.[0-9]+)* )')) AS heading_like, count(*) FILTER (WHERE length(text) - length(replace(text, '|', '')) >= 8) AS table_like FROM documents GROUP BY 1""")
def corpus_profile(spark, sf):
    """AGG14, EVL11: profile of texts by source."""
    return aggregate.corpus_profile(docs_of(spark, sf), "source", "text")


@query("""SELECT lang, count(*) AS n, count(DISTINCT source) AS sources, CAST(sum(n_chars) AS BIGINT) AS chars, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY 1""")
def dataset_statistics(spark, sf):
    """AGG15: counts of a dataset."""
    return docs_of(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"), F.sum("n_chars").alias("chars"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@query("""SELECT source, doc_id, n_chars, rn FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 3""")
def row_number_samples(spark, sf):
    """WIN01: first rows of each source."""
    return window.samples(docs_of(spark, sf).select("source", "doc_id", "n_chars"), "source", [F.desc("n_chars"), F.col("doc_id")], 3)


@query("""SELECT conv_id, turn, substr(lag(text) OVER w, 1, 1200) AS context_before, substr(lead(text) OVER w, 1, 1200) AS context_after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def neighbour_context(spark, sf):
    """WIN03, TXT15: text before and after."""
    return window.neighbours(table(spark, sf, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "context_before", "context_after")


@query("""SELECT conv_id, turn, count(text) OVER w AS window_n, CAST(sum(length(text)) OVER w AS BIGINT) AS window_chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def neighbour_window(spark, sf):
    """WIN02: rows within a radius."""
    return window.window_of(table(spark, sf, "conversations"), "conv_id", "turn", "text", 2).select("conv_id", "turn", "window_n", "window_chars")


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS heading, role <> 'user' AS heading_inherited FROM conversations""")
def heading_ffill(spark, sf):
    """WIN04, WIN05: the last heading carried on."""
    c = table(spark, sf, "conversations")
    return window.carried(c, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("text")), "heading").select("conv_id", "turn", "heading", "heading_inherited")


@query("""SELECT conv_id, turn, turn // 4 AS parent_ord, turn % 4 AS child_ord, substr(sha256(conv_id || '|' || (turn // 4)), 1, 24) AS parent_id FROM conversations""")
def parent_windows(spark, sf):
    """WIN06: fixed-size parents."""
    return window.parents(table(spark, sf, "conversations"), "conv_id", "turn").select("conv_id", "turn", "parent_ord", "child_ord", "parent_id")


@query("""SELECT conv_id, turn, CAST(sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run FROM (SELECT *, (role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn))::INT AS new FROM conversations)""")
def table_fragments(spark, sf):
    """WIN09: adjacent rows of one signature."""
    return window.runs(table(spark, sf, "conversations"), ["conv_id"], ["turn"], F.col("role")).select("conv_id", "turn", "run")


@query("""SELECT sha256(text) AS content_hash, count(*) AS n, count(DISTINCT source) AS n_groups, count(*) - 1 AS surplus FROM documents GROUP BY text HAVING count(DISTINCT source) > 1""")
def dup_clusters(spark, sf):
    """SET09, PRJ22: one text in several sources."""
    return sets.duplicate_clusters(docs_of(spark, sf), "text", "source")


@query("""SELECT sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS k, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1""")
def identity_dedup(spark, sf):
    """SET03, SET08: the first row of each identity."""
    return docs_of(spark, sf).groupBy(F.sha2(T.name_key(F.col("text")), 256).alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH t AS (SELECT doc_id, {TOK.format("text")} AS l FROM documents) SELECT term, doc_id, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, len(l) AS len, unnest(l) AS term FROM t) GROUP BY 1, 2""")
def bm25_postings(spark, sf):
    """TXT04: term counts of every document."""
    return retrieval.postings(docs_of(spark, sf), "doc_id", "text", T.simple_tokens).select("term", "doc_id", "tf", "len")


@query(f"""WITH t AS (SELECT doc_id, unnest({TOK.format("text")}) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf, round(ln(1 + (n - count(DISTINCT doc_id) + 0.5) / (count(DISTINCT doc_id) + 0.5)), 6) AS idf FROM t, n GROUP BY term, n""")
def idf_weights(spark, sf):
    """TXT05: document frequencies and weights of all terms."""
    docs = docs_of(spark, sf)
    df = retrieval.document_frequencies(retrieval.postings(docs, "doc_id", "text", T.simple_tokens), "doc_id")
    return df.select("term", "df", "cf", F.round(F.log(1 + (F.lit(docs.count()) - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


BM25 = f"""t AS (SELECT doc_id, {TOK.format("text")} AS l FROM documents), s AS (SELECT count(*) AS n, avg(len(l)) AS a FROM t),
q AS (SELECT unnest(['the', 'eau', 'thand', 'stand']) AS term), p AS (SELECT q.term, doc_id, len(l) AS len, len(list_filter(l, lambda x: x = q.term)) AS tf FROM t, q),
d AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM p GROUP BY 1),
scores AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))) AS score FROM p JOIN d USING (term), s WHERE tf > 0 GROUP BY 1)"""
TERMS = ["the", "eau", "thand", "stand"]


@query(f"""WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM scores ORDER BY round(score, 6) DESC, doc_id LIMIT 25""")
def bm25_topk(spark, sf):
    """TXT07, TXT08: lexical search over all documents, top k as the feature."""
    s = retrieval.bm25(docs_of(spark, sf), "doc_id", "text", TERMS, tokenise=T.simple_tokens)
    return s.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(25)


COS = """(SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score FROM embeddings)"""


def query_vector(spark: SparkSession, sf: str) -> list[float]:
    """The vector of row 0; without it, one that is near to nothing."""
    row = table(spark, sf, "embeddings").where("vec_id = 0").select("embedding").head()
    return row[0] if row and row[0] else [0.0]


@query(f"""SELECT vec_id, round(score, 6) AS score FROM {COS} WHERE label IS NOT NULL ORDER BY round(score, 6) DESC, vec_id LIMIT 20""")
def cosine_topk(spark, sf):
    """TXT09: dense search behind a payload filter."""
    e = table(spark, sf, "embeddings").where("label is not null")
    q = F.array(*[F.lit(float(x)) for x in query_vector(spark, sf)])
    return e.select("vec_id", F.round(retrieval.cosine(F.col("embedding"), q), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(20)


@query(f"""WITH {BM25}, a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS r FROM scores), b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY round(score, 6) DESC, vec_id) AS r FROM {COS})
SELECT id, round(sum(w), 9) AS score, count(*) AS n_rankings FROM (SELECT id, 0.9 / (60 + r) AS w FROM a WHERE r <= 50 UNION ALL SELECT id, 1.0 / (60 + r) FROM b WHERE r <= 50) GROUP BY 1""")
def rrf_fusion(spark, sf):
    """TXT10, TXT11, TXT28, WIN07: two rankings fused by reciprocal ranks."""
    lexical = retrieval.bm25(docs_of(spark, sf), "doc_id", "text", TERMS, tokenise=T.simple_tokens).select(F.col("doc_id").alias("id"), F.round("score", 6).alias("score"))
    q = F.array(*[F.lit(float(x)) for x in query_vector(spark, sf)])
    dense = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.round(retrieval.cosine(F.col("embedding"), q), 6).alias("score"))
    ranked = [df.orderBy(F.desc("score"), "id").limit(50).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))) for df in (lexical, dense)]
    out = retrieval.fuse([("lexical", 0.9, ranked[0]), ("dense", 1.0, ranked[1])], "id")
    return out.select("id", F.round("score", 9).alias("score"), "n_rankings")


@query(f"""WITH s AS (SELECT vec_id, label, round(score, 6) AS score FROM {COS}), k AS (SELECT *, max(score) OVER () AS best FROM s), f AS (SELECT * FROM k WHERE score >= 0.45 OR score >= 0.8 * best),
t AS (SELECT label, max(score) AS family_score FROM f GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3) SELECT vec_id, f.label, score, family_score FROM f JOIN t ON f.label = t.label""")
def source_concentrate(spark, sf):
    """TOP07: hits of the families with the best hits."""
    q = F.array(*[F.lit(float(x)) for x in query_vector(spark, sf)])
    hits = table(spark, sf, "embeddings").select("vec_id", "label", F.round(retrieval.cosine(F.col("embedding"), q), 6).alias("score"))
    return retrieval.concentrate(hits, "label", "score").select("vec_id", "label", "score", "family_score")


@query("""SELECT label, count(*) AS n, round(avg(list_cosine_similarity(embedding::DOUBLE[], c)), 6) AS mean_to_first FROM embeddings JOIN (SELECT label AS l, arg_min(embedding::DOUBLE[], vec_id) AS c FROM embeddings GROUP BY 1) ON label = l GROUP BY 1""")
def vector_spread(spark, sf):
    """TXT09 by group: mean similarity to the group's first vector."""
    e = table(spark, sf, "embeddings")
    first = e.groupBy(F.col("label").alias("l")).agg(F.min_by("embedding", "vec_id").alias("c"))
    j = e.join(first, F.col("label") == F.col("l"))
    return j.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(retrieval.cosine(F.col("embedding"), F.col("c"))), 6).alias("mean_to_first"))


@query(r"""SELECT conv_id, turn, list_sort(list_distinct(list_filter(regexp_extract_all(text, '[0-9]{4,}'), lambda x: NOT regexp_matches(x, '^(19|20)[0-9]{2}$')))) AS numbers FROM conversations""")
def numeric_provenance(spark, sf):
    """TXT20: numbers that an answer would have to prove."""
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sort_array(retrieval.digit_runs(F.col("text"))).alias("numbers"))


@query(f"""WITH p AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM conversations), t AS (SELECT conv_id, turn, list_distinct({TOK.format("text")}) AS a, {TOK.format("asked")} AS q FROM p WHERE role = 'assistant' AND asked IS NOT NULL)
SELECT conv_id, turn, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, q)) / len(a) ELSE 0 END, 6) AS overlap FROM t""")
def rules_overlap(spark, sf):
    """TXT21, TXT22: overlap of an answer's tokens with the question's."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = table(spark, sf, "conversations").withColumn("asked", F.lag("text").over(w)).where("role = 'assistant' and asked is not null")
    return p.select("conv_id", "turn", F.round(retrieval.token_overlap(T.simple_tokens(F.col("text")), T.simple_tokens(F.col("asked"))), 6).alias("overlap"))


@query(r"""SELECT h AS host, regexp_extract(x, '^/([^/?#]*)', 1) AS target, count(*) AS weight, 'link' AS kind FROM (SELECT regexp_extract(url, '//([^/?#]*)', 1) AS h, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS x FROM pages) GROUP BY 1, 2""")
def ref_graph(spark, sf):
    """GRF01, GRF03: edges from hosts to what their pages link to."""
    links = F.transform(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1), lambda x: F.regexp_extract(x, "^/([^/?#]*)", 1))
    p = table(spark, sf, "pages").select(F.regexp_extract("url", "//([^/?#]*)", 1).alias("host"), links.alias("links"))
    return graph.mentions(p, "host", F.col("links"), "link").withColumnRenamed("source", "host")


@query(r"""WITH m AS (SELECT page_id AS source, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS target FROM pages), e AS (SELECT source, target, count(*) AS weight FROM m GROUP BY 1, 2), o AS (SELECT target, min(source) AS owner FROM e GROUP BY 1)
SELECT source, owner AS destination, CAST(sum(weight) AS BIGINT) AS weight FROM e JOIN o USING (target) WHERE source <> owner GROUP BY 1, 2""")
def reference_owners(spark, sf):
    """GRF03: a number's mentions point to its first owner."""
    m = graph.mentions(table(spark, sf, "pages"), "page_id", F.regexp_extract_all("html", F.lit(r'href="/([^"]*)"'), 1), "link")
    return graph.reference_edges(m, m)


@query("""SELECT doc_id, CASE WHEN length(t) > 80 THEN rtrim(substr(t, 1, 79)) || '…' ELSE t END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)""")
def snippets(spark, sf):
    """PRJ17: one line of at most 80 characters."""
    return docs_of(spark, sf).select("doc_id", T.compact(F.col("text"), 80).alias("snippet"))


@query("""SELECT doc_id, n, len(list_filter(ls, lambda x: trim(x) <> '')) AS lines, length(ls[1]) AS heading_chars FROM (SELECT doc_id, n_chars AS n, string_split(text, chr(10)) AS ls FROM documents)""")
def outline(spark, sf):
    """TXT24, PRJ21: lines and the first line of each text."""
    ls = F.split("text", "\n", -1)
    return docs_of(spark, sf).select("doc_id", F.col("n_chars").alias("n"), F.size(F.filter(ls, lambda x: F.trim(x) != "")).alias("lines"), F.length(ls[0]).alias("heading_chars"))


@query("""WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)), f AS (SELECT * FROM l WHERE trim(line) <> ''),
b AS (SELECT *, sum(regexp_matches(line, '^(#{1,6}\\s+\\S|[0-9]+(\\.[0-9]+)*\\.?\\s+\\S)')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM f),
p AS (SELECT *, floor((sum(length(line) + 1) OVER (PARTITION BY doc_id, block ORDER BY pos) - 1) / 800.0) AS part FROM b)
SELECT doc_id, min(pos) AS start_line, string_agg(line, chr(10) ORDER BY pos) AS chunk, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) - 1 AS chunk_ord FROM p GROUP BY doc_id, block, part""")
def packed_chunks(spark, sf):
    """TXT01: chunks that start at headings and fill up to a size."""
    return retrieval.packed_chunks(docs_of(spark, sf), "doc_id", "text", 800)


@query("""WITH p AS (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 200, 1), 1800)) AS a FROM documents) SELECT doc_id, CAST(a // 1800 AS INT) AS page, substr(text, a + 1, 2000) AS part FROM p""")
def overlap_pages(spark, sf):
    """TXT03, TXT02: slices that overlap."""
    d = docs_of(spark, sf).select("doc_id", F.posexplode(retrieval.pages_of(F.col("text"), 2000, 200)).alias("page", "part"))
    return d.select("doc_id", "page", "part")


@query("""SELECT l.quality, count(*) AS n, count(*) FILTER (WHERE (length(text) - length(replace(text, '!!', '')) > 20)::INT = 1 - l.quality) AS correct, round(count(*) FILTER (WHERE (length(text) - length(replace(text, '!!', '')) > 20)::INT = 1 - l.quality) / count(*), 6) AS accuracy FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY 1""")
def eval_accuracy(spark, sf):
    """EVL07, EVL13: a rule's answers against labels."""
    j = table(spark, sf, "labels").join(docs_of(spark, sf), "doc_id")
    loud = F.length("text") - F.length(F.replace(F.col("text"), F.lit("!!"), F.lit(""))) > 20
    return evaluate.accuracy(j, ["quality"], F.lit(1) - F.col("quality"), loud.cast("int"))


@query("""SELECT quality AS expected, toxic AS actual, count(*) AS n FROM labels GROUP BY 1, 2""")
def label_confusion(spark, sf):
    """EVL07: expected by actual."""
    return evaluate.confusion(table(spark, sf, "labels"), F.col("quality"), F.col("toxic"))


@query("""SELECT width, count(*) AS n FROM (SELECT least(n_chars // 500, 20) AS width FROM documents) GROUP BY 1""")
def chunk_density(spark, sf):
    """EVL12: distribution of lengths."""
    return docs_of(spark, sf).groupBy(F.least(F.expr("n_chars div 500"), F.lit(20)).alias("width")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT lang, count(*) AS n, count(*) FILTER (WHERE NOT regexp_matches(text, '[A-Za-z]')) AS no_latin, count(*) FILTER (WHERE length(text) >= 120 AND length(regexp_replace(text, '[^|]', '', 'g')) >= 8) AS tables FROM documents GROUP BY 1""")
def quality_heuristics(spark, sf):
    """TXT26, FLT07, FLT08: scripts and tables."""
    t = F.col("text")
    return docs_of(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(~t.rlike("[A-Za-z]")).alias("no_latin"), F.count_if((F.length(t) >= 120) & (F.length(F.regexp_replace(t, r"[^|]", "")) >= 8)).alias("tables"))


@query("""SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'ring')""")
def keyword_filter(spark, sf):
    """FLT02, FLT03: all keywords."""
    low = F.lower("text")
    return docs_of(spark, sf).where(low.contains("the") & low.contains("ring")).select("doc_id")


@query("""SELECT conv_id, turn, round(CASE WHEN contains(lower(text), 'the ') THEN 0.38 + 0.18 ELSE 0 END + CASE WHEN regexp_matches(text, '[0-9]{4,}') THEN 0.12 ELSE 0 END, 2) AS score,
CASE WHEN contains(lower(text), 'the ') THEN 'english' WHEN contains(lower(text), ' der ') THEN 'german' WHEN contains(lower(text), ' de ') THEN 'romance' ELSE 'other' END AS route FROM conversations""")
def query_routing(spark, sf):
    """TXT16: a ladder of keywords and a score."""
    low = F.lower("text")
    route = F.when(low.contains("the "), "english").when(low.contains(" der "), "german").when(low.contains(" de "), "romance").otherwise("other")
    score = F.when(low.contains("the "), 0.38 + 0.18).otherwise(0.0) + F.when(F.col("text").rlike("[0-9]{4,}"), 0.12).otherwise(0.0)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.round(score, 2).alias("score"), route.alias("route"))


@query("""SELECT conv_id, max(turn) AS last_turn, count(*) AS n, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY 1""")
def mail_threads(spark, sf):
    """STR10, TOP13: threads with their members in order."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return c.select("conv_id", "last_turn", "n", F.array_join("r.role", ">").alias("roles"))


@query("""SELECT source, doc_id, hits FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY hits DESC, doc_id) AS rn FROM (SELECT source, doc_id, (length(lower(text)) - length(replace(lower(text), 'thand', ''))) // 5 AS hits FROM documents)) WHERE rn = 1""")
def evidence_boost(spark, sf):
    """TOP08, TOP12: the text of each source with the most matches."""
    low = F.lower("text")
    hits = ((F.length(low) - F.length(F.replace(low, F.lit("thand"), F.lit("")))) / 5).cast("long")
    return window.best_by(docs_of(spark, sf).select("source", "doc_id", hits.alias("hits")), ["source"], [F.col("hits"), -F.col("doc_id")], ["doc_id", "hits"]).select("source", "doc_id", "hits")
