"""Queries for names, codes, mail, registers, clusters and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, codes, numbers, text
from ..operators import documents, graph, join
from ..session import checkpointed, table
from .registry import query
from .tables import d, parts_sold, price


@query("""SELECT p_partkey, lower(trim(regexp_replace('  ' || p_name || ' ;', '\\s+', ' ', 'g'))) AS name_key, rtrim(lower(trim(p_name)), ' .,;:') AS material, upper(p_brand) AS display FROM part""")
def name_keys(spark, sf):
    """PRJ10, PRJ11: keys of names."""
    raw = F.concat(F.lit("  "), "p_name", F.lit(" ;"))
    return table(spark, sf, "part").select("p_partkey", text.name_key(raw).alias("name_key"), text.material_key(raw).alias("material"), F.upper("p_brand").alias("display"))


@query("""SELECT p_partkey, regexp_matches(p_brand, '^Brand#[0-9]{1,2}$') AS is_code, substr(p_brand, 7) AS bare FROM part""")
def code_predicates(spark, sf):
    """PRJ11, PRJ12: whether a text is a code, and the code alone."""
    return table(spark, sf, "part").select("p_partkey", F.col("p_brand").rlike("^Brand#[0-9]{1,2}$").alias("is_code"), F.regexp_replace(codes.bare_code(F.col("p_brand")), "^#", "").alias("bare"))


@query("""SELECT o_orderkey, CASE WHEN abs(o_totalprice - round(o_totalprice)) < 1e-6 THEN replace(format('{:,}', CAST(round(o_totalprice) AS BIGINT)), ',', ' ') ELSE replace(format('{:,.2f}', o_totalprice), ',', ' ') END AS shown FROM orders""")
def shown_numbers(spark, sf):
    """PRJ18: numbers as people write them."""
    return table(spark, sf, "orders").select("o_orderkey", numbers.shown_number(F.col("o_totalprice")).alias("shown"))


@query("""SELECT conv_id, turn, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS subject FROM conversations""")
def mail_subjects(spark, sf):
    """PRJ19: subjects without any number of reply prefixes."""
    subject = F.concat(F.lit("RE: Fwd: re[2]: "), F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", text.subject_key(subject).alias("subject"))


@query("""SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, 'href="/([A-Za-z]+)"', 1))) AS links, regexp_extract(url, '^https?://(?:www\\.|m\\.|blog\\.)?([^/?#]*)', 1) AS site FROM pages""")
def wiki_links(spark, sf):
    """PRJ25, GRF01: links and sites of pages."""
    return table(spark, sf, "pages").select("page_id", F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="/([A-Za-z]+)"'), 1))).alias("links"), F.regexp_extract("url", r"^https?://(?:www\.|m\.|blog\.)?([^/?#]*)", 1).alias("site"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size * 1.0 WHEN p_size % 3 = 1 THEN p_retailprice END AS qty FROM part""")
def quantity_fallback(spark, sf):
    """PRJ27, FLT06: the first quantity that is there."""
    p = table(spark, sf, "part")
    qty = F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("double"))
    done = F.when(F.col("p_size") % 3 == 1, F.col("p_retailprice"))
    return p.select("p_partkey", F.coalesce(qty, done).alias("qty"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'A4' WHEN 1 THEN 'A4x3' END AS format FROM part""")
def sheet_formats(spark, sf):
    """PRJ29: formats of sheets by their sides."""
    n = F.col("p_size") % 3
    a, b = F.when(n == 0, 297.5).when(n == 1, 630.0).otherwise(333.0), F.when(n == 0, 210.0).when(n == 1, 297.0).otherwise(77.0)
    return table(spark, sf, "part").select("p_partkey", codes.sheet_format(a, b).alias("format"))


@query("""SELECT p_partkey, split_part(p_name, ' ', 1) AS building, split_part(p_name, ' ', 2) AS system, p_size::VARCHAR AS floor FROM part""")
def file_names(spark, sf):
    """PRJ30: parts of structured file names."""
    name = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_size").cast("string"), F.lit(".pdf"))
    return table(spark, sf, "part").select("p_partkey", codes.file_parts(name).alias("f")).select("p_partkey", "f.building", "f.system", "f.floor")


@query("""SELECT p_partkey, round((p_size::DOUBLE * 2 + p_retailprice / 4) * 3, 6) AS value FROM part""")
def formulas(spark, sf):
    """PRJ31: an arithmetic formula over named values, compiled to an expression."""
    from ..functions.formula import compiled

    return table(spark, sf, "part").select("p_partkey", F.round(compiled("(S * 2 + P / 4) * 3", {"S": F.col("p_size").cast("double"), "P": F.col("p_retailprice")}), 6).alias("value"))


@query("""SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'loads' WHEN p_type = 'STANDARD' THEN 'cables' ELSE 'unknown' END AS kind FROM part""")
def table_signatures(spark, sf):
    """PRJ33: table types by signature."""
    t = F.col("p_type")
    headers = F.when(t == "ECONOMY", F.array(F.lit("Line"), F.lit("Power"), F.lit("Current A"))).when(t == "STANDARD", F.array(F.lit("Cable"), F.lit("Length, m"))).otherwise(F.array(F.lit("zz")))
    return table(spark, sf, "part").select("p_partkey", classify.signature_type(headers, F.lit(""), {"loads": ["line", "power", "current"], "cables": ["cable", "length"]}).alias("kind"))


@query("""SELECT conv_id, turn FROM conversations WHERE role = 'user' AND contains(lower(text), 'the') AND turn >= 2""")
def mail_filter(spark, sf):
    """FLT05, JOI18: clauses that are given, on a folded haystack."""
    c = table(spark, sf, "conversations")
    for clause in (F.col("role") == "user", text.folded(F.col("text")).contains("the"), F.col("turn") >= 2):
        c = c.where(clause)
    return c.select("conv_id", "turn")


@query("""SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z])the([^a-z]|$)') AND regexp_matches(lower(text), '(^|[^a-z])thea')""")
def term_boundaries(spark, sf):
    """FLT09: short terms match whole words, long ones their beginning."""
    low = F.lower("text")
    return table(spark, sf, "documents").where(low.rlike("(^|[^a-z])the([^a-z]|$)") & low.rlike("(^|[^a-z])thea")).select("doc_id")


@query("""SELECT p_partkey FROM part WHERE p_name ILIKE '%ring%' AND p_brand ILIKE '%brand#1%' AND p_type ILIKE '%econ%'""")
def element_filter(spark, sf):
    """FLT10: each clause a substring, whatever the case."""
    return table(spark, sf, "part").where(F.col("p_name").ilike("%ring%") & F.col("p_brand").ilike("%brand#1%") & F.col("p_type").ilike("%econ%")).select("p_partkey")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') < '1995-06-01' AS expired FROM orders""")
def expiry_flags(spark, sf):
    """FLT11: ISO dates compared as texts."""
    return table(spark, sf, "orders").select("o_orderkey", (F.date_format("o_orderdate", "yyyy-MM-dd") < "1995-06-01").alias("expired"))


@query("""SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src3')""")
def scope_resolution(spark, sf):
    """FLT12, SRC23: a scope as a filter that reaches the scan."""
    return table(spark, sf, "documents").where(F.col("source").isin("src1", "src3")).select("doc_id", "source")


@query("""WITH latest AS (SELECT o_custkey AS k, max(o_orderdate) AS rev FROM orders GROUP BY 1) SELECT o.o_orderkey, o.o_custkey FROM orders o JOIN latest l ON o.o_custkey = l.k AND o.o_orderdate = l.rev""")
def current_revisions(spark, sf):
    """JOI13, JOI03: only rows of the current revision."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    latest = o.groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderdate").alias("rev"))
    return o.join(latest, (F.col("o_custkey") == F.col("k")) & (F.col("o_orderdate") == F.col("rev"))).select("o_orderkey", "o_custkey")


CLUSTERS = """WITH RECURSIVE n AS (SELECT DISTINCT p_brand AS u, p_name AS name FROM part UNION SELECT DISTINCT p_brand, split_part(p_name, ' ', 2) FROM part),
e AS (SELECT a.u, a.name AS x, b.name AS y FROM n a JOIN n b ON a.u = b.u AND (a.name = b.name OR least(length(a.name), length(b.name)) >= 4 AND (contains(a.name, b.name) OR contains(b.name, a.name)))),
r AS (SELECT u, x, y FROM e UNION SELECT r.u, r.x, e.y FROM r JOIN e ON r.u = e.u AND r.y = e.x) SELECT u, x AS name, min(y) AS cluster FROM r GROUP BY 1, 2"""


@query(CLUSTERS)
def name_clusters(spark, sf):
    """JOI09: names of one unit that contain each other, as connected components: the result does not hang on the order of rows."""
    p = table(spark, sf, "part")
    n = p.select(F.col("p_brand").alias("u"), F.col("p_name").alias("name")).union(p.select("p_brand", F.split_part("p_name", F.lit(" "), F.lit(2)))).distinct()
    pairs = join.containment_pairs(n, n, "u").select(F.concat_ws("\u0001", "u", "left").alias("a"), F.concat_ws("\u0001", "u", "right").alias("b"))
    c = graph.components(pairs, "a", "b", checkpointed)
    part = lambda c, i: F.split_part(c, F.lit("\u0001"), F.lit(i))
    return c.select(part("node", 1).alias("u"), part("node", 2).alias("name"), part("component", 2).alias("cluster"))


@query("""SELECT l_linestatus AS system, p_name AS name, p_brand AS unit, coalesce(sum(l_quantity::DECIMAL(18,2)), 0)::DOUBLE AS qty, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3""")
def as_built(spark, sf):
    """AGG08: as-built quantities, nulls as 0."""
    return parts_sold(spark, sf).groupBy(F.col("l_linestatus").alias("system"), F.col("p_name").alias("name"), F.col("p_brand").alias("unit")).agg(d(F.coalesce(F.sum(price("l_quantity")), F.lit(0))).alias("qty"), F.count(F.lit(1)).alias("n"))


@query("""SELECT regexp_extract(url, '\\.([a-z]+)(?:[/:?#]|$)', 1) AS extension, regexp_extract(url, '//([^/?#]*)', 1) AS parent, count(*) AS files, CAST(sum(length(html)) AS BIGINT) AS size FROM pages GROUP BY 1, 2""")
def file_map_statistics(spark, sf):
    """AGG16, SRC19: files and sizes by kind and folder."""
    return table(spark, sf, "pages").groupBy(F.regexp_extract("url", r"\.([a-z]+)(?:[/:?#]|$)", 1).alias("extension"), F.regexp_extract("url", "//([^/?#]*)", 1).alias("parent")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("html")).alias("size"))


@query("""SELECT sha256(lower(text)) AS k, min(doc_id) AS doc_id, arg_min(n_chars, doc_id) AS value FROM documents GROUP BY lower(text)""")
def indicators(spark, sf):
    """AGG25: numbered rows, the first of equal ones."""
    rows = table(spark, sf, "documents").select(F.sha2(F.lower("text"), 256).alias("k"), "doc_id", F.col("n_chars").alias("value"))
    return join.first_wins(rows, "k", [F.col("doc_id")])


@query("""WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split('1 Start' || chr(10) || replace(text, '. ', chr(10) || '1.1 Part' || chr(10)), chr(10)) AS ls FROM documents)),
h AS (SELECT *, regexp_extract(line, '^\\s*([0-9]+(?:\\.[0-9]+)*)\\.?\\s+\\S', 1) AS clause FROM l), c AS (SELECT *, len(string_split(clause, '.')) AS level FROM h WHERE clause <> ''),
e AS (SELECT a.doc_id, a.pos AS start, a.clause, coalesce(min(b.pos), 2147483647) AS stop FROM c a LEFT JOIN c b ON a.doc_id = b.doc_id AND b.pos > a.pos AND b.level <= a.level GROUP BY 1, 2, 3)
SELECT e.doc_id, e.clause, e.start, max(l.pos) AS last, sum(length(l.line))::BIGINT AS chars FROM e JOIN l ON l.doc_id = e.doc_id AND l.pos >= e.start AND l.pos < e.stop GROUP BY 1, 2, 3""")
def clause_segments(spark, sf):
    """WIN08, TXT23: clauses as far as the next heading that is not deeper."""
    marked = F.concat(F.lit("1 Start\n"), F.replace(F.col("text"), F.lit(". "), F.lit("\n1.1 Part\n")))
    docs = table(spark, sf, "documents").select("doc_id", marked.alias("text"))
    c = documents.clauses(docs, "doc_id", "text")
    return c.select("doc_id", "clause", "start", F.col("end").alias("last"), F.length(F.replace(F.col("body"), F.lit("\n"), F.lit(""))).cast("long").alias("chars"))


@query("""SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') ORDER BY p_partkey LIMIT 15""")
def substring_search(spark, sf):
    """TOP03: the first matches in the order of the source."""
    return table(spark, sf, "part").where(F.lower("p_name").contains("ring")).select("p_partkey", "p_name").orderBy("p_partkey").limit(15)


@query("""WITH m AS (SELECT doc_id, contains(lower(text), 'thand') AS a, contains(lower(text), 'stand') AS b FROM documents) SELECT doc_id, CASE WHEN a AND b THEN 'and' ELSE 'or' END AS tier FROM m WHERE (SELECT bool_or(a AND b) FROM m) AND a AND b OR NOT (SELECT bool_or(a AND b) FROM m) AND (a OR b)""")
def search_fallback(spark, sf):
    """TXT29, TXT06, JOI15, FLT02: all terms, and any of them only where no row has all."""
    low = F.lower("text")
    m = table(spark, sf, "documents").select("doc_id", low.contains("thand").alias("a"), low.contains("stand").alias("b")).where("a or b")
    both = F.col("a") & F.col("b")
    every = bool(m.agg(F.max(both)).head()[0])
    return m.where(both if every else F.lit(True)).select("doc_id", F.when(both, "and").otherwise("or").alias("tier"))


@query("""SELECT conv_id, turn, CASE WHEN contains(lower(text), 'the ') THEN text || ' article' ELSE text END AS expanded FROM conversations WHERE role = 'user'""")
def query_expansion(spark, sf):
    """TXT17, TXT12: synonyms from a dictionary are appended."""
    t = F.col("text")
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.when(F.lower(t).contains("the "), F.concat(t, F.lit(" article"))).otherwise(t).alias("expanded"))


@query("""SELECT event_id, CASE WHEN isfinite(value) THEN value END AS value FROM events""")
def json_safe(spark, sf):
    """ARR04: numbers that are not finite become null."""
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v).alias("value"))


@query("""SELECT kind, count(*) AS n FROM (SELECT 'member' AS kind, doc_id FROM documents UNION ALL SELECT 'lang', doc_id FROM documents WHERE lang IS NOT NULL UNION ALL SELECT 'label', l.doc_id FROM labels l JOIN documents d ON d.doc_id = l.doc_id) GROUP BY 1""")
def knowledge_graph(spark, sf):
    """GRF04: edges of several kinds in one frame, counted by kind."""
    docs = table(spark, sf, "documents")
    edges = docs.select(F.lit("member").alias("kind"), "doc_id").unionAll(docs.where("lang is not null").select(F.lit("lang"), "doc_id")).unionAll(table(spark, sf, "labels").join(docs.select("doc_id"), "doc_id").select(F.lit("label"), "doc_id"))
    return edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey, l_linenumber, (l_quantity::DECIMAL(18,2) * CASE l_returnflag WHEN 'A' THEN 1.15 WHEN 'R' THEN 1.25 ELSE 1.0 END)::DOUBLE AS adjusted FROM lineitem""")
def coefficients(spark, sf):
    """CST01, UDF05: a coefficient per kind, 1 by default."""
    k = F.lit("1.00").cast("decimal(4,2)")
    for kind, value in {"A": "1.15", "R": "1.25"}.items():
        k = F.when(F.col("l_returnflag") == kind, F.lit(value).cast("decimal(4,2)")).otherwise(k)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", d(price("l_quantity") * k).alias("adjusted"))


@query("""WITH b AS (SELECT l_orderkey AS k, l_linenumber AS line, l_quantity AS qty FROM lineitem), r AS (SELECT k, line, CASE WHEN line = 1 THEN qty * 2 ELSE qty END AS qty FROM b WHERE line <> 3 UNION ALL SELECT DISTINCT k, 9, 1.0 FROM b) SELECT k, line, qty FROM r""")
def resource_bindings(spark, sf):
    """CST04, JOI07: replace one resource, leave one out, add one."""
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("qty"))
    replaced = b.where("line <> 3").withColumn("qty", F.when(F.col("line") == 1, F.col("qty") * 2).otherwise(F.col("qty")))
    return replaced.unionByName(b.select("k").distinct().select("k", F.lit(9).alias("line"), F.lit(1.0).alias("qty")))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'unsafe_source' WHEN o_totalprice > 0 AND o_orderpriority <> '5-LOW' THEN 'accepted' ELSE 'rejected' END AS verdict FROM orders""")
def norm_validation(spark, sf):
    """CST05: accepted, rejected or from an unsafe source."""
    ok = (F.col("o_totalprice") > 0) & (F.col("o_orderpriority") != "5-LOW")
    return table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "unsafe_source").when(ok, "accepted").otherwise("rejected").alias("verdict"))


@query("""SELECT o_orderkey, sum(l_quantity::DECIMAL(18,2) * p_size)::DOUBLE AS qty, count(*) AS traced FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def quantity_trace(spark, sf):
    """CST07: parent times child quantities with the number of sources."""
    j = parts_sold(spark, sf).join(table(spark, sf, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_orderkey").agg(d(F.sum(price("l_quantity") * F.col("p_size"))).alias("qty"), F.count(F.lit(1)).alias("traced"))


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS steps, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1""")
def status_flow(spark, sf):
    """STR07: the latest state of each item, and its errors."""
    e = table(spark, sf, "events")
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count(F.lit(1)).alias("steps"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("""SELECT time_bucket(INTERVAL '10 minutes', ts) AS at, count(*) AS n, max(value) AS peak FROM events GROUP BY 1""")
def metric_samples(spark, sf):
    """STR08: samples at fixed intervals."""
    w = table(spark, sf, "events").groupBy(F.window("ts", "10 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak"))
    return w.select(F.col("w.start").alias("at"), "n", "peak")


@query("""SELECT d.doc_id, coalesce(l.toxic, -1) AS decided, CASE WHEN l.toxic = 1 THEN 'computed_issue' WHEN l.doc_id IS NULL THEN 'manual' ELSE 'supported' END AS status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def document_review(spark, sf):
    """EVL14: rules first, decisions of people over them."""
    j = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").withColumn("_seen", F.lit(True)), "doc_id", "left")
    status = F.when(F.col("toxic") == 1, "computed_issue").when(F.col("_seen").isNull(), "manual").otherwise("supported")
    return j.select("doc_id", F.coalesce("toxic", F.lit(-1)).alias("decided"), status.alias("status"))


@query("""WITH t AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY source, text) AS n FROM documents) SELECT doc_id FROM t WHERE rn = 1 AND n = 1""")
def unique_chunks(spark, sf):
    """SNK03, O10: texts that no other row repeats need new vectors."""
    docs = table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("doc_id"))
    alone = docs.groupBy("source", "h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1")
    return first.join(alone, "doc_id").select("doc_id")


@query("""SELECT doc_id, CASE WHEN lang = 'de' THEN 'de' ELSE 'other' END AS k, regexp_replace(replace(replace(text, '<br>', ' '), '<br/>', ' '), '\\n{3,}', chr(10) || chr(10), 'g') AS clean FROM documents""")
def clean_texts(spark, sf):
    """PRJ15, PRJ16: markup and payloads out of texts, broken encodings repaired."""
    from ..functions.text import repaired, without_markup

    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.when(F.col("lang") == "de", "de").otherwise("other").alias("k"), without_markup(repaired(F.col("text"))).alias("clean"))


@query("""SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]{4,}'), lambda t: length(t) >= 12))) AS long_words FROM documents""")
def keyword_sets(spark, sf):
    """PRJ14, FLT03, PRJ23: distinct long words of each text."""
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0), lambda t: F.length(t) >= 12)
    return table(spark, sf, "documents").select("doc_id", F.array_sort(F.array_distinct(words)).alias("long_words"))




@query("""SELECT p_partkey, split_part(p_brand, '#', 1) || ':' || lpad(p_size::VARCHAR, 2, '0') AS key FROM part""")
def collection_keys(spark, sf):
    """PRJ32: family and collection of a code."""
    code = F.concat(F.split_part("p_brand", F.lit("#"), F.lit(1)), F.lit(" "), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("-01-001"))
    return table(spark, sf, "part").select("p_partkey", codes.collection_key(code).alias("key"))


@query("""SELECT d.doc_id, d.source, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE d.source IN ('src1', 'src2') AND l.quality = 1""")
def filtered_hits(spark, sf):
    """JOI01: an index joined to its contents behind filters."""
    hits = table(spark, sf, "labels").where("quality = 1").select("doc_id", "quality")
    return table(spark, sf, "documents").where(F.col("source").isin("src1", "src2")).select("doc_id", "source").join(hits, "doc_id")


@query("""SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN r <= 5 THEN -n_chars END NULLS LAST, r) AS rerank_rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)""")
def reranked_heads(spark, sf):
    """TXT13: the head of each ranking in a new order, the tail as it was."""
    from pyspark.sql import Window

    from ..operators.retrieval import reranked

    r = table(spark, sf, "documents").select("source", "doc_id", "n_chars", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("r"))
    return reranked(r, "source", "r", 5, F.col("n_chars")).select("doc_id", "rerank_rank")


@query("""SELECT event_id, try_cast(props->>'k' AS BIGINT) AS k FROM events""")
def structured_extraction(spark, sf):
    """TXT25: a JSON object salvaged from a text, under a schema."""
    from ..operators.retrieval import valid_json

    said = F.concat(F.lit("Here it is: "), "props", F.lit(" - done"))
    return table(spark, sf, "events").select("event_id", valid_json(said, "k bigint")["k"].alias("k"))


@query("""SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM labels UNION ALL SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) GROUP BY 1""")
def sidecar_index(spark, sf):
    """TXT30, SET08: an append-only index takes only what it lacks."""
    from ..operators.retrieval import sidecar

    docs = table(spark, sf, "documents").select("doc_id")
    return sidecar(table(spark, sf, "labels").select("doc_id"), docs, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS extra FROM orders""")
def merged_versions(spark, sf):
    """CTL01, CTL02: new rows over old ones, with a column more."""
    from ..sources.stores import merged

    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s"), "o_totalprice")
    new = o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "X").alias("s"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("extra"))
    return merged(o.drop("o_totalprice"), new, ["o_orderkey"])


@query("""WITH c AS (SELECT 'p_brand' AS k, p_brand AS v FROM part UNION ALL SELECT 'p_size', p_size::VARCHAR FROM part UNION ALL SELECT 'p_type', p_type FROM part) SELECT k AS "column", count(v) AS n, count(DISTINCT v) AS n_distinct,
CASE WHEN k = 'p_size' THEN min(try_cast(v AS DOUBLE)) END AS lo, CASE WHEN k = 'p_size' THEN max(try_cast(v AS DOUBLE)) END AS hi, CASE WHEN k = 'p_size' THEN sum(try_cast(v AS DOUBLE)) END AS total FROM c GROUP BY 1""")
def column_profiles(spark, sf):
    """SRC12: what the columns of a sheet hold."""
    from ..sources.sheets import column_profile

    return column_profile(table(spark, sf, "part").select("p_brand", "p_size", "p_type")).drop("examples")


@query("""SELECT DISTINCT source AS ref, min(doc_id) OVER (PARTITION BY source) AS first FROM documents""")
def table_refs(spark, sf):
    """SRC04: references of all sources, with their first row."""
    return table(spark, sf, "documents").groupBy(F.col("source").alias("ref")).agg(F.min("doc_id").alias("first"))
