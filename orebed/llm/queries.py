"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import functools
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .divergence import source_divergence
from .exact_dedup import exact_dedup
from .langid import identify_languages, page_evidence, train_profiles
from .licenses import scan_licenses
from .line_dedup import dedup_lines
from .media import media_features
from .mixing import mix_plan
from .ngram_join import ngram_jaccard_join
from .packing import pack_documents
from .passage_dedup import dedup_passages
from .pii import replace_personal_data
from .prefix_trie import conversation_trie
from .sentencepiece_codec import encode_documents
from .warc import archive_pages


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (host: source) and pages (declared in the html element, host: address) under one set of priors.

    lang is what the profiles are fitted on, so it is no evidence for a document.
    """
    docs = table(spark, sf_dir, "documents")
    profiles = train_profiles(docs)
    rows = docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", F.lit(None).cast("string").alias("declared"), F.col("source").alias("host"))
    pages = page_evidence(table(spark, sf_dir, "pages")).select(F.lit(None).cast("long").alias("doc_id"), "page_id", "text", "declared", "host")
    return identify_languages(rows.unionAll(pages), profiles, carry=["doc_id", "page_id"])


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), "size", "source_size", "target", "taken")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "removed_lines")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@functools.cache
def _drawn_key(application: str) -> str:
    return secrets.token_hex(32)


def pii_key(spark: SparkSession) -> str:
    """The setting orebed.pii.key. Where it is unset, a local master's synthetic tables get a public key, and a cluster's application draws a secret one, whose surrogates agree within the application only."""
    key = spark.conf.get("orebed.pii.key", None)
    if key:
        return key
    context = spark.sparkContext
    return "key of the synthetic tables" if context.master.startswith("local") else _drawn_key(context.applicationId)


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_personal_data(table(spark, sf_dir, "documents"), pii_key(spark)).select("doc_id", "text", "n_entities", "entity_kinds", "entities")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(table(spark, sf_dir, "documents")).select("doc_id", "text", "removed_words", "removed_passages")


_ALL = (
    op1_ngram_jaccard_join,
    op2_license_scan,
    op3_language_id,
    op4_mix_sources,
    op5_line_dedup,
    op6_warc,
    op7_media_columns,
    op8_exact_dedup,
    op9_sentencepiece,
    op10_pii_surrogates,
    op11_conversation_trie,
    op12_packing,
    op13_source_divergence,
    passage_dedup,
)
QUERIES = {f.__name__: f for f in _ALL}

#: Lines are found by their text, not by hashes, and windows by lists of them.
LINE_DEDUP_SQL = r"""
WITH docs AS (SELECT DISTINCT doc_id, text FROM documents),
lines AS (
  SELECT doc_id, text, unnest(range(len(l))) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM docs)),
worded AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw FROM lines
  WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) > 0),
placed AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id, text ORDER BY pos) - nw AS before FROM worded),
windows AS (
  SELECT doc_id, text, pos, list(line) OVER w AS ls, sum(nw) OVER w AS words, max(pos) OVER w AS last FROM placed
  WINDOW w AS (PARTITION BY doc_id, text ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)),
full_windows AS (SELECT * FROM windows WHERE words >= 50),
later AS (
  SELECT doc_id, text, pos, last FROM (
    SELECT *, row_number() OVER (PARTITION BY ls ORDER BY doc_id NULLS FIRST, text, pos) AS nth FROM full_windows)
  WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, text, unnest(range(pos, last + 1)) AS pos FROM later),
kept AS (
  SELECT l.doc_id, l.text, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS rest, count(g.pos) AS removed
  FROM lines l LEFT JOIN gone g ON l.doc_id IS NOT DISTINCT FROM g.doc_id AND l.text IS NOT DISTINCT FROM g.text AND l.pos = g.pos
  GROUP BY l.doc_id, l.text)
SELECT d.doc_id, CASE WHEN k.removed = 0 THEN d.text ELSE coalesce(k.rest, '') END AS text, k.removed AS removed_lines
FROM documents d JOIN kept k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND d.text IS NOT DISTINCT FROM k.text
"""

EXACT_DEDUP_SQL = """
SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER t AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))
"""

#: Caps are found round by round, and seats are given out by ranking every quotient.
MIX_SQL = r"""
WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
src AS (
  SELECT *, ([5.0, 2.0, 1.0])[(sid - 1) % 3 + 1]::DOUBLE AS w FROM (
    SELECT source, sum(size)::BIGINT AS ss, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM docs GROUP BY source)),
m AS (SELECT sum(ss)::BIGINT AS m FROM src),
levels AS (
  SELECT a.sid, (m.m - coalesce(sum(3 * b.ss) FILTER (WHERE b.r < a.r), 0))::DOUBLE / sum(b.w) FILTER (WHERE b.r >= a.r) AS x, a.ratio
  FROM (SELECT *, 3 * ss / w AS ratio, row_number() OVER (ORDER BY 3 * ss / w, sid) AS r FROM src) a,
    (SELECT *, row_number() OVER (ORDER BY 3 * ss / w, sid) AS r FROM src) b, m
  GROUP BY a.sid, a.ratio, m.m),
level AS (SELECT coalesce(max(x) FILTER (WHERE ratio >= x), 0) AS x FROM levels),
t AS (SELECT src.*, CASE WHEN 3 * ss / w < levels.x THEN (3 * ss)::DOUBLE ELSE least((3 * ss)::DOUBLE, w * level.x) END AS target FROM src JOIN levels USING (sid), level),
b AS (SELECT *, greatest(1, least(2048, floor((SELECT min(target) FROM t WHERE target > 0) / 100)))::BIGINT AS blk FROM t),
house AS (SELECT floor(sum(target) / any_value(blk) + 0.5)::BIGINT AS seats FROM b),
won AS (
  SELECT sid, count(*) AS quota FROM (
    SELECT sid, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, sid, k) AS nth
    FROM (SELECT sid, target, unnest(range(house.seats)) AS k FROM b, house WHERE target > 0))
  WHERE nth <= (SELECT seats FROM house) GROUP BY sid),
placed AS (
  SELECT d.*, b.sid, b.ss, b.target, b.blk, coalesce(won.quota, 0) AS source_quota,
    ('0x' || substr(md5('mix|shard|' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT % ceil(b.n / 8192)::BIGINT AS shard
  FROM docs d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN won ON won.sid = b.sid),
cells AS (SELECT sid, shard, sum(size)::BIGINT AS cell, any_value(source_quota) AS source_quota, any_value(blk) AS blk FROM placed GROUP BY sid, shard),
cell_won AS (
  SELECT sid, shard, count(*) AS quota FROM (
    SELECT sid, shard, source_quota, row_number() OVER (PARTITION BY sid ORDER BY cell / (2 * k + 1) DESC, shard, k) AS nth
    FROM (SELECT *, unnest(range(source_quota)) AS k FROM cells))
  WHERE nth <= source_quota GROUP BY sid, shard),
plan AS (
  SELECT c.sid, c.shard, c.cell, coalesce(q.quota, 0) * blk AS asked, greatest(1, (cell + blk - 1) // blk) AS blocks
  FROM cells c LEFT JOIN cell_won q ON q.sid = c.sid AND q.shard = c.shard),
rows AS (
  SELECT p.*, plan.cell, plan.asked, plan.blocks, CASE WHEN cell = 0 THEN 0 ELSE least(3, asked // cell) END AS passes,
    ('0x' || substr(md5('mix|block|' || coalesce(source, '') || '|' || shard), 1, 12))::BIGINT % plan.blocks AS off,
    (sum(size) OVER (PARTITION BY p.sid, p.shard ORDER BY md5('mix|order|' || coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING))::BIGINT AS e
  FROM placed p JOIN plan USING (sid, shard)),
extra AS (SELECT *, e - size AS s, CASE WHEN cell = 0 OR passes >= 3 THEN 0 ELSE least(blocks, floor((asked - passes * cell) / blk + 0.5)::BIGINT) END AS extra FROM rows),
words AS (
  SELECT doc_id, source, size, ss, target, passes, len(list_filter(range(s, e), lambda w: ((w // blk + 1) * extra + off) // blocks > ((w // blk) * extra + off) // blocks)) AS picked
  FROM extra)
SELECT doc_id, source, size, ss AS source_size, target, (passes * size + picked)::BIGINT AS taken FROM words
"""

#: unbin turns the digest's hexadecimal digits to base32 five bits at a time.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p),
bits AS (SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: lpad(to_base(('0x' || substr(hex, i, 1))::BIGINT, 2), 4, '0')), 'string_agg', '') AS b FROM d)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (
    16 * substr(b, 5 * i + 1, 1)::INT + 8 * substr(b, 5 * i + 2, 1)::INT + 4 * substr(b, 5 * i + 3, 1)::INT + 2 * substr(b, 5 * i + 4, 1)::INT + substr(b, 5 * i + 5, 1)::INT + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM bits
"""

#: Nodes are told apart by their turns as JSON, and subtrees are summed up along the turns of their least member.
TRIE_SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS nth
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'r': r, 't': t} ORDER BY nth) AS l FROM turns GROUP BY conv_id),
lent AS (
  SELECT *, conv_id - conv_id % 100 AS base, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda s, x: list_reduce(list_prepend(xor(s, x), list_value(0, 0, 0, 0, 0, 0, 0, 0)::BIGINT[]), lambda u, z: xor(u >> 1, (u & 1) * 3988292384))), 4294967295::BIGINT) % 6 AS h
  FROM own),
built AS (SELECT c.conv_id, list_concat(coalesce(b.l[1:c.h], []), c.l[c.h + 1:]) AS l FROM lent c LEFT JOIN own b ON b.conv_id = c.base),
prefixes AS (
  SELECT conv_id, d, len(l) = d AS ends, CASE WHEN d = 0 THEN 0 ELSE length(l[d].t) END AS chars, to_json(l[1:d])::VARCHAR AS k, CASE WHEN d > 0 THEN to_json(l[1:d - 1])::VARCHAR END AS up
  FROM (SELECT conv_id, l, unnest(range(len(l) + 1)) AS d FROM built)),
nodes AS (
  SELECT k, any_value(up) AS up, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM prefixes GROUP BY k),
counted AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN (SELECT up, count(*) AS n FROM nodes GROUP BY up) c ON c.up = n.k),
below AS (
  SELECT p.k, sum((n.n_children = 0)::INT)::BIGINT AS n_leaves, sum(n.saved)::BIGINT AS saved_tokens
  FROM counted n JOIN prefixes p ON p.conv_id = n.conv_id AND p.d <= n.depth GROUP BY p.k)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
FROM counted n JOIN below b USING (k) LEFT JOIN nodes u ON u.k = n.up
"""

#: Every kept term of every group is laid out, and pairs are priced term by term.
DIVERGENCE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
occ AS (
  SELECT lang, source, t, count(*) AS c, count(DISTINCT id) AS d FROM (SELECT id, lang, source, unnest(ts) AS t FROM docs) GROUP BY ALL),
kept AS (SELECT lang, t, sum(c)::HUGEINT AS c FROM occ GROUP BY lang, t HAVING sum(d) >= 3),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM kept GROUP BY lang),
counts AS (
  SELECT g.lang, g.source, k.t, coalesce(o.c, 0)::HUGEINT AS c, k.c AS lc, l.v, l.n AS ln
  FROM (SELECT DISTINCT lang, source FROM docs) g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN occ o ON o.lang = g.lang AND o.source = g.source AND o.t = k.t),
shares AS (
  SELECT lang, source, t, c, 1 + 1000000000 * (c + 1) // (sum(c) OVER (PARTITION BY lang, source)::HUGEINT + v) AS p, 1 + 1000000000 * (lc + 1) // (ln + v) AS q
  FROM counts),
priced AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN priced p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', t, (p - q) * (p - q) // q FROM shares WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

ORACLE_SQL = {"op13_source_divergence": DIVERGENCE_SQL, "op11_conversation_trie": TRIE_SQL, "op6_warc": WARC_SQL, "op4_mix_sources": MIX_SQL, "op5_line_dedup": LINE_DEDUP_SQL, "op8_exact_dedup": EXACT_DEDUP_SQL}
