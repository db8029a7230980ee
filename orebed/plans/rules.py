"""Queries of rules over texts that are made of the given tables' values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify
from ..functions.text import norm_references
from ..operators import cost, documents, graph, rules
from ..sources import files
from ..session import table
from .registry import query
from .retrieve import QUESTIONS_SQL, STOPS, questions_of

MONTHS = ["январь", "февраль", "март", "апрель", "май", "июнь", "июль", "август", "сентябрь", "октябрь", "ноябрь", "декабрь"]


def memos(spark: SparkSession, sf: str) -> DataFrame:
    """A line of an order as people write it, with the header of its column."""
    l = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    whole = lambda c: F.col(c).cast("long").cast("string")
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month("l_shipdate"))
    text = F.concat(F.lit("Кабель "), "p_name", F.lit(": "), whole("l_quantity"), F.lit(" м по ГОСТ Р "), whole("p_size"), F.lit("."), whole("l_suppkey"), F.lit(", см. ИСО и СП "), whole("l_linenumber"), F.lit(" за "), month, F.lit(" "), F.year("l_shipdate").cast("string"), F.lit(" года"))
    header = F.when(F.col("l_returnflag") == "A", " Кол-во, шт ").when(F.col("l_returnflag") == "R", "ЦЕНА за ед.").otherwise("Наименование работ")
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("memo"), header.alias("header"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN 'qty' WHEN 'R' THEN 'price' ELSE 'name' END AS field, 'ГОСТ Р ' || p_size || '.' || l_suppkey || ' СП ' || l_linenumber AS refs,
CAST(l_quantity AS BIGINT)::DOUBLE AS metres, date_trunc('month', l_shipdate)::DATE AS first_day, last_day(l_shipdate) AS last_day FROM lineitem JOIN part ON l_partkey = p_partkey""")
def memo_fields(spark, sf):
    """PRJ01, PRJ20, PRJ25, PRJ26: the field of a header, and references, quantity and period of a text."""
    m = memos(spark, sf)
    first, last = classify.period(F.col("memo"))
    return m.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", classify.header_field(F.col("header")).alias("field"), F.array_join(norm_references(F.col("memo")), " ").alias("refs"), classify.quantity(F.col("memo"), "м").alias("metres"), first.alias("first_day"), last.alias("last_day"))


@query(r"""WITH l AS (SELECT doc_id, list_transform(string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS ls FROM documents),
h AS (SELECT *, list_filter(ls[1:6], lambda x: regexp_matches(x, '^#{1,6}\s+\S') OR regexp_matches(x, '^[0-9]+(\.[0-9]+)*\.?\s+\S'))[1] AS head, coalesce(list_filter(list_transform(ls, lambda x: trim(x, ' #' || chr(9))), lambda x: length(x) BETWEEN 4 AND 160)[1], '') AS plain FROM l)
SELECT doc_id, CASE WHEN head IS NULL THEN plain WHEN head LIKE '#%' THEN regexp_replace(head, '^#{1,6}\s+', '') ELSE regexp_extract(head, '^([0-9]+(?:\.[0-9]+)*)\.?\s+(\S.*)$', 1) || ' ' || regexp_extract(head, '^([0-9]+(?:\.[0-9]+)*)\.?\s+(\S.*)$', 2) END AS heading,
CASE WHEN head IS NULL THEN 0 WHEN head LIKE '#%' THEN length(regexp_extract(head, '^(#{1,6})', 1)) ELSE len(string_split(regexp_extract(head, '^([0-9]+(?:\.[0-9]+)*)', 1), '.')) END AS level FROM h""")
def section_headings(spark, sf):
    """PRJ21: the heading of each text and its level."""
    return table(spark, sf, "documents").select("doc_id", rules.heading_info(F.col("text")).alias("h")).select("doc_id", "h.heading", "h.level")


@query(r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, split_part(coalesce(text, ''), ' ', 1) AS name FROM documents)
SELECT doc_id, length(trim(name)) < 3 OR length(regexp_replace(name, '[^\p{L}]', '', 'g')) < 2 AS noise,
length(t) >= 40 AND (len(list_filter(string_split(t, chr(10)), lambda x: length(x) > 60 AND NOT contains(x, ' ') AND contains(x, '/'))) >= 2
  OR length(replace(substr(t, 1, 200), chr(10), '')) > 80 AND length(replace(substr(t, 1, 200), chr(10), '')) - length(replace(replace(substr(t, 1, 200), chr(10), ''), ' ', '')) < 3) AS garbage FROM t""")
def noise_predicates(spark, sf):
    """FLT07, FLT08: whether the first word is no name, and whether the text is encoded data."""
    return table(spark, sf, "documents").select("doc_id", rules.noise_name(F.split_part(F.coalesce("text", F.lit("")), F.lit(" "), F.lit(1))).alias("noise"), rules.binary_garbage(F.col("text")).alias("garbage"))


@query(rf"""WITH {QUESTIONS_SQL}, w AS (SELECT qid, list_distinct(list_transform(list_filter(regexp_extract_all(coalesce(question, ''), '[0-9A-Za-zА-Яа-яЁё][0-9A-Za-zА-Яа-яЁё.\-]*'), lambda t: length(t) >= 3), lambda t: lower(t))) AS ts,
  list_filter(list_transform(list_filter(regexp_extract_all(lower(coalesce(question, '')), '[0-9A-Za-zА-Яа-яЁё_.-]{{3,}}'), lambda t: NOT regexp_full_match(t, '[0-9]+') AND t NOT IN ({STOPS})), lambda t: CASE WHEN length(t) > 5 AND regexp_full_match(t, '\p{{L}}+') THEN substr(t, 1, 5) ELSE t END), lambda s: s NOT IN ({STOPS})) AS keywords FROM questions) SELECT w.qid, array_to_string(w.keywords, ' ') AS keywords,
least(6, len(list_filter(w.ts, lambda t: regexp_matches(t, '[0-9 .]')))) AS refs, least(12, len(list_filter(w.ts, lambda t: NOT regexp_matches(t, '[0-9 .]') AND t NOT IN ({STOPS})))) AS words FROM w""")
def search_queries(spark, sf):
    """TXT06, FLT03: every question as a full-text query, told by the number of its parts, and its keywords."""
    q = questions_of(spark, sf).withColumn("q", rules.text_query(F.col("question")))
    body, refs = F.regexp_extract("q", r"^text : \(([^)]*)\)", 1), F.regexp_extract("q", r"(?:^| OR )\(([^)]*)\)$", 1)
    n = lambda c: F.when(c == "", 0).otherwise(F.size(F.split(c, " OR ")))
    return q.select("qid", F.array_join(rules.query_keywords(F.col("question")), " ").alias("keywords"), n(refs).alias("refs"), n(body).alias("words"))


@query("""WITH c AS (SELECT l_orderkey, l_returnflag, p_name, max(l_discount) AS d, length(p_name) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
t AS (SELECT l_orderkey, l_returnflag, p_name, d, n, min(l_linenumber) AS line FROM c JOIN (SELECT l_orderkey AS k, l_returnflag AS f, p_name AS v, l_discount AS x, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey) ON k = l_orderkey AND f = l_returnflag AND v = p_name AND x = d GROUP BY ALL)
SELECT l_orderkey, l_returnflag, arg_max(p_name, (d, n, -line)) AS value, max(d) AS confidence, count(*) AS n_values, count(*) > 1 AS conflict FROM t GROUP BY 1, 2 HAVING count(*) = count(DISTINCT (d, n, line))""")
def field_candidates(spark, sf):
    """WIN11: of each field of an order the value with the highest confidence, then the longest, then the first line; conflicts told."""
    l = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    best = rules.best_fields(l, ["l_orderkey"], "l_returnflag", "p_name", "l_discount", "l_linenumber")
    # Two lines of one number are two candidates that nothing tells apart: the SQL leaves such fields out, and so does this query.
    seen = l.groupBy("l_orderkey", "l_returnflag", "p_name").agg(F.max(F.struct("l_discount", F.length("p_name"), -F.col("l_linenumber").cast("long"))).alias("r"))
    told = seen.groupBy("l_orderkey", "l_returnflag").agg((F.count(F.lit(1)) == F.countDistinct("r")).alias("told")).where("told")
    return best.join(told.drop("told"), ["l_orderkey", "l_returnflag"], "left_semi")


@query("""WITH c AS (SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, date_diff('second', min(o_orderdate), max(o_orderdate)) AS elapsed FROM orders GROUP BY 1)
SELECT o_custkey, round(100.0::DOUBLE * done / total, 1) AS percent, CASE WHEN done > 0 AND done < total AND elapsed > 0 THEN round(done::DOUBLE / elapsed * 60, 1) END AS rate_per_min, CASE WHEN done > 0 AND done < total AND elapsed > 0 THEN round((total - done) * elapsed / done)::BIGINT END AS eta_seconds FROM c""")
def order_eta(spark, sf):
    """WIN10: percent, rate and time left of each customer's orders."""
    o = table(spark, sf, "orders").withColumn("at", F.unix_seconds(F.col("o_orderdate").cast("timestamp")))
    c = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), (F.max("at") - F.min("at")).alias("elapsed"))
    return c.select("o_custkey", rules.progress_eta(F.col("done"), F.col("total"), F.col("elapsed"), F.lit(True)).alias("p")).select("o_custkey", "p.*")


@query("""WITH f AS (SELECT DISTINCT replace(lower(p_name), ' ', '') AS f FROM part WHERE p_brand = 'Brand#11')
SELECT DISTINCT p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM f WHERE contains(replace(lower(p_name), ' ', ''), f) OR contains(f, replace(lower(p_name), ' ', '')))""")
def missing_files(spark, sf):
    """JOI10: names of a register that no file's name holds or stands in."""
    p = table(spark, sf, "part")
    return rules.missing_refs(p.select("p_name").distinct(), "p_name", p.where("p_brand = 'Brand#11'").select(F.col("p_name").alias("file")), "file")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, p_name, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS nth FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, 'Раздел' AS kind, l_linenumber::VARCHAR AS number, p_name AS title, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS place FROM l WHERE nth = 1""")
def outlines(spark, sf):
    """TXT24: the numbered items of each order's text; the first of a number counts."""
    l = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    line = F.concat(F.lit("Раздел "), F.col("l_linenumber").cast("string"), F.lit(".  «"), "p_name", F.lit("»."))
    texts = l.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_partkey", "l_suppkey", line.alias("t")))), lambda x: x["t"]), "\n").alias("text"))  # a few lines an order
    clean = texts.withColumn("text", F.replace("text", F.lit("«"), F.lit("")))
    return rules.outline(clean, "l_orderkey", "text", ["Раздел", "Подраздел", "Пункт"])


@query("""WITH r AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) AS rank FROM documents), h AS (SELECT * FROM r WHERE rank <= 25),
s AS (SELECT doc_id, source, rank, list_sum(list_transform(['1', 'stand', 'eau'], lambda t: CASE WHEN contains(lower(source), t) THEN 4 WHEN contains(lower(text), t) THEN 3 ELSE 0 END))::INT AS promotion FROM h)
SELECT doc_id, source, rank, promotion, row_number() OVER (PARTITION BY source ORDER BY promotion DESC, rank) AS place FROM s""")
def exact_promotions(spark, sf):
    """TOP12: exact terms in a hit's name or text move it up, the rest stays in order."""
    w = Window.partitionBy("source").orderBy(F.desc_nulls_last("n_chars"), "doc_id")
    hits = table(spark, sf, "documents").select("doc_id", "source", "n_chars", "text").withColumn("rank", F.row_number().over(w)).where("rank <= 25")
    terms = F.array(F.lit("1"), F.lit("stand"), F.lit("eau"))
    return rules.promoted(hits, "source", "rank", F.col("source"), F.col("text"), terms).select("doc_id", "source", "rank", "promotion", "place")


@query("""SELECT substr(sha256('{"inner":{"kind":"' || event_type || '","user":' || user_id || '},"k":' || regexp_extract(props, '([0-9]+)', 1) || '}'), 1, 16) AS id, count(*) AS n, min(event_id) AS first_event FROM events GROUP BY 1""")
def canonical_rows(spark, sf):
    """ARR05: rows of equal JSON, whatever the order of its keys and its blanks."""
    number = F.regexp_extract("props", "([0-9]+)", 1)
    one = F.concat(F.lit('{"k": '), number, F.lit(', "inner": {"user": '), F.col("user_id").cast("string"), F.lit(', "kind": "'), "event_type", F.lit('"}}'))
    other = F.concat(F.lit('{ "inner" : {"kind":"'), "event_type", F.lit('" , "user":'), F.col("user_id").cast("string"), F.lit(' },"k":'), number, F.lit("}"))
    text = F.when(F.col("value") > 10, one).otherwise(other)
    return table(spark, sf, "events").groupBy(F.substring(F.sha2(rules.canonical_json(text), 256), 1, 16).alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("""SELECT p_partkey, CASE WHEN p_retailprice < 905 THEN 'rejected' WHEN p_size > 40 THEN 'rejected' WHEN p_type = 'PROMO' THEN 'rejected' WHEN p_type NOT IN ('ECONOMY', 'SMALL') THEN 'rejected' WHEN p_brand < 'Brand#3' THEN 'accepted' ELSE 'unsafe_source' END AS status,
CASE WHEN p_retailprice < 905 THEN 'quantity is missing' WHEN p_size > 40 THEN 'full typed norm code is required' WHEN p_type = 'PROMO' THEN 'exact norm code not found' WHEN p_type NOT IN ('ECONOMY', 'SMALL') THEN 'unit mismatch' ELSE '' END AS reason FROM part""")
def norm_bindings(spark, sf):
    """CST05: bindings checked for quantity, typed code, norm and convertible units; norms of untrusted sources told."""
    two = F.lpad(F.col("p_size").cast("string"), 2, "0")
    code = F.concat(F.lit("ГЭСН"), two, F.lit("-01-"), F.lpad(F.col("p_size").cast("string"), F.when(F.col("p_size") > 40, 2).otherwise(3), F.lit("0")), F.lit("-01"))
    unit = F.when(F.col("p_type") == "ECONOMY", "кг").when(F.col("p_type") == "SMALL", "т").otherwise("шт")
    quantity = F.when(F.col("p_retailprice") >= 905, F.col("p_retailprice"))
    status = rules.binding_status(quantity, code, F.col("p_type") != "PROMO", unit, F.lit("т"), F.col("p_brand") < "Brand#3")
    return table(spark, sf, "part").select("p_partkey", status.alias("s")).select("p_partkey", "s.status", "s.reason")


@query("SELECT source, doc_id FROM documents WHERE source > 'src1' OR (source = 'src1' AND doc_id > 100) ORDER BY source, doc_id LIMIT 200")
def scrolled_page(spark, sf):
    """SRC23: the page after a key, a limit as the feature."""
    return rules.paged(table(spark, sf, "documents").select("source", "doc_id"), ["source", "doc_id"], ["src1", 100], 200)


CREWS_SQL = "crews AS (SELECT DISTINCT p_brand AS code, CASE WHEN p_brand < 'Brand#4' THEN substr(p_brand, 7, 1)::DOUBLE / 4 ELSE 0 END AS crew, CASE WHEN p_brand < 'Brand#4' THEN 'D' || substr(p_brand, 7, 1) ELSE '' END AS driver FROM part WHERE p_brand < 'Brand#5'), m AS (SELECT l_orderkey AS k, p_brand, l_quantity AS q FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query(f"""WITH {CREWS_SQL}, h AS (SELECT k, sum(round(q * crew, 6)) AS hours, count(*) FILTER (crews.code IS NULL) AS lacking FROM m LEFT JOIN crews ON p_brand = crews.code GROUP BY 1),
s AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN round(coalesce(hours, 0), 6) WHEN 'O' THEN round(coalesce(hours, 0) + 1, 6) END AS source, round(hours, 6) AS derived, lacking FROM (SELECT o_orderkey, min(o_orderstatus) AS o_orderstatus FROM orders GROUP BY 1) JOIN h ON k = o_orderkey)
SELECT k AS o_orderkey, CASE WHEN source IS NULL THEN 'not_applicable' WHEN lacking = 0 AND abs(source - coalesce(derived, 0)) <= greatest(0.0001, source * 0.001) THEN 'reconciled' ELSE 'unresolved' END AS status, source AS source_hours, coalesce(derived, 0) AS derived_hours FROM s""")
def machinist_hours(spark, sf):
    """JOI12: machinists of each order's machines in place of an anonymous sum, where all are known and the hours agree."""
    p = table(spark, sf, "part")
    digit = F.substring("p_brand", 7, 1)
    low = F.col("p_brand") < "Brand#4"
    catalog = p.where("p_brand < 'Brand#5'").select(F.col("p_brand").alias("code"), F.when(low, digit.cast("double") / 4).otherwise(0.0).alias("crew_hours"), F.when(low, F.concat(F.lit("D"), digit)).otherwise("").alias("driver_code")).distinct()
    machines = table(spark, sf, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("o_orderkey"), F.lit("machine").alias("kind"), F.col("p_brand").alias("code"), F.col("l_quantity").alias("quantity"))
    hours = machines.join(catalog, "code", "left").groupBy("o_orderkey").agg(F.sum(F.round(F.col("quantity") * F.col("crew_hours"), 6)).alias("h"))
    o = table(spark, sf, "orders").groupBy("o_orderkey").agg(F.min("o_orderstatus").alias("s")).join(hours, "o_orderkey")
    said = o.where("s in ('F', 'O')").select("o_orderkey", F.lit("machinist").alias("kind"), F.lit(None).cast("string").alias("code"), (F.coalesce("h", F.lit(0.0)) + F.when(F.col("s") == "O", 1.0).otherwise(0.0)).alias("quantity"))
    return cost.machinists(machines.join(o.select("o_orderkey"), "o_orderkey", "left_semi").unionByName(said), catalog, "o_orderkey")[1]


@query(r"""WITH f AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') || '/' || page_id AS path FROM pages), r AS (SELECT DISTINCT unnest([split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) AS root FROM f)
SELECT page_id, arg_max(root, length(root)) AS root FROM f JOIN r ON starts_with(path, root || '/') GROUP BY 1""")
def nested_roots(spark, sf):
    """JOI19: the longest of nested roots above each path: hosts, and folders of hosts."""
    path = F.concat(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""), F.lit("/"), F.col("page_id").cast("string"))
    f = table(spark, sf, "pages").select("page_id", path.alias("path"))
    parts = F.split("path", "/")
    roots = f.select(F.explode(F.array(parts[0], F.concat(parts[0], F.lit("/"), parts[1]))).alias("r")).distinct()
    return documents.longest_root(f, "path", roots, "r").select("page_id", "root")


@query("""WITH a AS (SELECT o_custkey AS path, count(*) AS size, max(o_orderdate) AS mtime FROM orders WHERE o_orderdate < TIMESTAMP '2000-06-01' GROUP BY 1), b AS (SELECT o_custkey AS path, count(*) AS size, max(o_orderdate) AS mtime FROM orders WHERE o_orderstatus <> 'F' OR o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1)
SELECT path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.size = b.size AND abs(epoch_ms(a.mtime) - epoch_ms(b.mtime)) < 1000 THEN 'unchanged' ELSE 'updated' END AS status FROM a FULL JOIN b USING (path)""")
def file_changes(spark, sf):
    """SRC19, STR04: what has changed between two snapshots of files, by size and time."""
    o = table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    snapshot = lambda rows: rows.groupBy(F.col("o_custkey").alias("path")).agg(F.count(F.lit(1)).alias("size"), F.max("o_orderdate").alias("mtime"))
    return files.changes(snapshot(o.where("o_orderdate < timestamp '2000-06-01'")), snapshot(o.where("o_orderstatus <> 'F' or o_orderdate >= timestamp '1996-01-01'")))


@query("""WITH s AS (SELECT o_orderkey, o_custkey, o_orderdate, CASE o_orderpriority WHEN '1-URGENT' THEN 'WIP' WHEN '2-HIGH' THEN 'Shared' WHEN '3-MEDIUM' THEN 'Published' ELSE 'Archived' END AS state FROM orders),
l AS (SELECT *, lag(state) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM s)
SELECT o_orderkey, before, state, before IS NULL OR before = state OR (before = 'WIP' AND state IN ('Shared', 'Archived')) OR (before = 'Shared' AND state <> 'Shared') OR (before = 'Published' AND state IN ('WIP', 'Archived')) AS allowed FROM l""")
def lifecycle_steps(spark, sf):
    """GRF08: whether each step between states is one that documents may take."""
    state = F.when(F.col("o_orderpriority") == "1-URGENT", "WIP").when(F.col("o_orderpriority") == "2-HIGH", "Shared").when(F.col("o_orderpriority") == "3-MEDIUM", "Published").otherwise("Archived")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf, "orders").withColumn("state", state).withColumn("before", F.lag("state").over(w))
    return o.select("o_orderkey", "before", "state", graph.allowed_transition(F.col("before"), F.col("state")).alias("allowed"))


@query("""SELECT p_partkey, translate(lower(p_name), 'qwertyuiop[]asdfghjkl;''zxcvbnm,.`', 'йцукенгшщзхъфывапролджэячсмитьбюё') AS typed FROM part""")
def switched_layouts(spark, sf):
    """PRJ24: names typed in the other keyboard layout."""
    return table(spark, sf, "part").select("p_partkey", classify.switched_layout(F.lower("p_name")).alias("typed"))


@query("""WITH q AS (SELECT source, text, (len(regexp_extract_all(t, '(?i)<br\\s*/?>')) >= 2 OR length(t) - length(replace(t, '|', '')) >= 8)::INT AS b,
(length(t) >= 120 AND CASE WHEN c + l > 0 THEN c / (c + l) ELSE 1 END < 0.15)::INT AS noise, (length(t) < 120)::INT AS s, ((text IS NOT NULL AND text <> '')::INT + (lang IS NOT NULL AND lang <> '')::INT + (n_chars IS NOT NULL)::INT) / 3 AS f, sha256(t) AS h FROM (
  SELECT *, coalesce(text, '') AS t, length(regexp_replace(coalesce(text, ''), '[^а-яёА-ЯЁ]', '', 'g')) AS c, length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS l FROM documents)),
g AS (SELECT source, count(*) AS n, round(100 * avg(b::DOUBLE), 1) AS broken_tables_pct, round(100 * avg(noise::DOUBLE), 1) AS language_noise_pct, round(100 * avg(s::DOUBLE), 1) AS short_pct, round(100 * avg((f < 1)::INT::DOUBLE), 1) AS incomplete_pct, round(avg(f), 3) AS completeness FROM q GROUP BY 1),
h AS (SELECT h, source, count(*) AS n, min(source) OVER (PARTITION BY h) AS first, count(*) OVER (PARTITION BY h) AS groups FROM q GROUP BY h, source)
SELECT g.*, copies, shared_texts FROM g JOIN (SELECT source, CAST(sum(n - (source = first)::INT) AS BIGINT) AS copies, count(*) FILTER (groups > 1) AS shared_texts FROM h GROUP BY 1) USING (source)""")
def ingestion_report(spark, sf):
    """EVL11, TXT26: quality of the texts of each source, and copies."""
    return rules.quality_report(table(spark, sf, "documents"), "source", "text", ["text", "lang", "n_chars"])
