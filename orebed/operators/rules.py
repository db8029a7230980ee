"""Ladders and small decisions by fixed rules: headings, noise, query building, candidates, progress, outlines, promotions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_references, stem
from ..schema import STOP_WORDS
from .join import containment_pairs


def heading_info(text: Column) -> Column:
    """(heading, level) of a text: the first markdown or numbered heading among its first six lines; else the first line of 4 to 160 characters, with level 0."""
    lines = F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    numbered = r"^([0-9]+(?:\.[0-9]+)*)\.?\s+(\S.*)$"

    def told(x: Column) -> Column:
        marks = F.regexp_extract(x, r"^(#{1,6})\s+\S", 1)
        number = F.regexp_extract(x, numbered, 1)
        md = F.struct(F.regexp_replace(x, r"^#{1,6}\s+", "").alias("heading"), F.length(marks).alias("level"))
        return F.when(marks != "", md).otherwise(F.struct(F.concat(number, F.lit(" "), F.regexp_extract(x, numbered, 2)).alias("heading"), F.size(F.split(number, r"\.")).alias("level")))

    head = F.filter(F.slice(lines, 1, 6), lambda x: x.rlike(r"^#{1,6}\s+\S") | x.rlike(numbered))
    plain = F.filter(F.transform(lines, lambda x: F.btrim(x, F.lit(" #\t"))), lambda x: F.length(x).between(4, 160))
    fallback = F.struct(F.coalesce(F.get(plain, 0), F.lit("")).alias("heading"), F.lit(0).alias("level"))
    return F.when(F.size(head) > 0, told(F.get(head, 0))).otherwise(fallback)


def noise_name(name: Column, section: str = r"(?iuU)^(раздел|подраздел|глава|этап)\b") -> Column:
    """Whether a name is no position: under three characters, the heading of a section, or fewer than two letters."""
    s = F.trim(F.coalesce(name, F.lit("")))
    return (F.length(s) < 3) | s.rlike(section) | (F.length(F.regexp_replace(s, r"[^\p{L}]", "")) < 2)


def binary_garbage(text: Column) -> Column:
    """Whether a chunk of 40 characters or more is encoded data: two dense lines of over 60 characters, or a long beginning without Cyrillic letters and with under three blanks."""
    t = F.coalesce(text, F.lit(""))
    dense = F.filter(F.split(t, "\n", -1), lambda x: (F.length(x) > 60) & ~F.contains(x, F.lit(" ")) & F.contains(x, F.lit("/")))
    start = F.replace(F.substring(t, 1, 200), F.lit("\n"), F.lit(""))
    bare = (F.length(start) > 80) & ~start.rlike("[Ѐ-ӿ]") & (F.length(start) - F.length(F.replace(start, F.lit(" "), F.lit(""))) < 3)
    return (F.length(t) >= 40) & ((F.size(dense) >= 2) | bare)


def query_keywords(question: Column) -> Column:
    """Words of a question for substring predicates: of three characters or more, no numbers or stop words, longer words of letters cut to five."""
    words = F.regexp_extract_all(F.lower(F.coalesce(question, F.lit(""))), F.lit("[0-9A-Za-zА-Яа-яЁё_.-]{3,}"), 0)
    pairs = F.transform(F.filter(words, lambda t: ~t.rlike("^[0-9]+$")), lambda t: F.struct(t.alias("t"), F.when((F.length(t) > 5) & t.rlike(r"^\p{L}+$"), F.substring(t, 1, 5)).otherwise(t).alias("s")))
    return F.transform(F.filter(pairs, lambda x: ~x["t"].isin(*STOP_WORDS) & ~x["s"].isin(*STOP_WORDS)), lambda x: x["s"])


def text_query(question: Column) -> Column:
    """A question as a full-text query: up to 12 words for the text, stemmed to prefixes, or up to 6 quoted phrases with digits and references for any column; empty without terms."""
    folded = lambda c: F.replace(F.lower(c), F.lit("ё"), F.lit("е"))
    words = F.filter(F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(r"[0-9A-Za-zА-Яа-яЁё][0-9A-Za-zА-Яа-яЁё.\-]*"), 0), lambda t: F.length(t) >= 3)
    terms = F.array_distinct(F.transform(F.concat(norm_references(F.coalesce(question, F.lit(""))), words), folded))
    is_ref = lambda t: t.rlike("[0-9 .]")
    quoted = lambda t: F.concat(F.lit('"'), t, F.lit('"'))
    body = F.filter(terms, lambda t: ~is_ref(t) & ~t.isin(*STOP_WORDS))
    shown = F.transform(body, lambda t: F.when((F.length(t) >= 4) & (F.length(stem(t)) >= 3) & stem(t).rlike(r"^\p{L}+$"), F.concat(quoted(stem(t)), F.lit("*"))).otherwise(quoted(t)))
    refs = F.transform(F.filter(terms, is_ref), quoted)
    body_clause = F.when(F.size(shown) > 0, F.concat(F.lit("text : ("), F.array_join(F.slice(shown, 1, 12), " OR "), F.lit(")")))
    ref_clause = F.when(F.size(refs) > 0, F.concat(F.lit("("), F.array_join(F.slice(refs, 1, 6), " OR "), F.lit(")")))
    return F.concat_ws(" OR ", body_clause, ref_clause)


def best_fields(candidates: DataFrame, by: Sequence[str], field: str, value: str, confidence: str, tie: str) -> DataFrame:
    """(by…, field, value, confidence, distinct, conflict): of each field the value with the highest confidence, then the longest, then the least tie; conflict if there are others."""
    rank = F.struct(F.col(confidence), F.length(value), -F.col(tie).cast("long"))
    kept = candidates.where(F.col(value).isNotNull() & (F.trim(value) != ""))
    best = kept.groupBy(*by, field, value).agg(F.max(rank).alias("_r"))  # a row a value, so that distinct values are counted without sets
    out = best.groupBy(*by, field).agg(F.max_by(value, "_r").alias("value"), F.max("_r").alias("_r"), F.count(F.lit(1)).alias("n_values"))
    return out.select(*by, field, "value", F.col(f"_r.{confidence}").alias("confidence"), "n_values", (F.col("n_values") > 1).alias("conflict"))


def progress_eta(done: Column, total: Column, elapsed: Column, running: Column) -> Column:
    """(percent, rate_per_min, eta_seconds): the two last only while something runs and some of it is done."""
    percent = F.when(total > 0, F.round(100.0 * F.least(done, total) / total, 1))
    moving = running & (done > 0) & (total > 0) & (done < total) & (elapsed > 0)
    return F.struct(percent.alias("percent"), F.when(moving, F.round(done / elapsed * 60, 1)).alias("rate_per_min"), F.when(moving, F.round((total - done) * elapsed / done).cast("long")).alias("eta_seconds"))


def price_browse(rows: DataFrame, code: str, name: str, phrase: str, resource: Column, transport: Column, limit: int = 20, asks_transport: bool = False) -> DataFrame:
    """The first rows of a price list for a phrase, in the order of five signs: the exact code, a resource's code, the phrase, all its words, how many of them; then name and code.

    Rows of transport count only where they are asked for or meant by their code.
    """
    phrase = " ".join(phrase.lower().split())
    words = list(dict.fromkeys(phrase.split()))
    hay = F.lower(F.concat_ws(" ", code, name))
    held = F.split(hay, r"\s+")
    n = sum((F.array_contains(held, w).cast("int") for w in words), F.lit(0))
    exact = (F.lower(code) == phrase).cast("int")
    signs = rows.withColumns({"code_match": exact, "resource_code": resource.cast("int"), "phrase_match": F.contains(hay, F.lit(phrase)).cast("int"), "all_tokens": (n == len(words)).cast("int"), "n_tokens": n})
    met = signs.where("code_match + phrase_match + n_tokens > 0").where(~transport | F.lit(asks_transport) | (F.col("code_match") == 1))
    return met.orderBy(*[F.desc(c) for c in ("code_match", "resource_code", "phrase_match", "all_tokens", "n_tokens")], name, code).limit(limit)


def missing_refs(register: DataFrame, ref: str, files: DataFrame, file: str) -> DataFrame:
    """Rows of a register whose reference neither holds nor stands in the name of any file; references without letters or digits are left out.

    References and names meet on grams of characters, not each with each.
    """
    normal = lambda c: F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[^\p{L}\p{N}]", "")
    wanted = register.withColumn("_ref", normal(ref)).where("_ref <> ''")
    one = F.lit(1)
    a = wanted.select(one.alias("_b"), F.col("_ref").alias("name")).distinct()
    b = files.select(one.alias("_b"), normal(file).alias("name")).where("name <> ''").distinct()
    met = containment_pairs(a, b, "_b")
    for n in (1, 2, 3):  # names too short for these grams are grams themselves
        short = F.length("name") == n
        met = met.unionByName(containment_pairs(a.where(short), b, "_b", n)).unionByName(containment_pairs(a, b.where(short), "_b", n))
    met = met.select(F.col("left").alias("_ref")).distinct()
    return wanted.join(met, "_ref", "left_anti").drop("_ref")


def outline(docs: DataFrame, id_col: str, text: str, kinds: Sequence[str]) -> DataFrame:
    """(id, kind, number, title, place) of the numbered items of a text: the first with a title of four characters for each kind and number, in the order of the numbers."""
    pattern = rf"(?iu)\b({'|'.join(kinds)})\s+([0-9]+(?:\([0-9]+\))?)\.?\s+([^\n]+)"
    parts = [F.regexp_extract_all(text, F.lit(pattern), i) for i in (1, 2, 3)]
    rows = docs.select(id_col, F.posexplode(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("kind", "number", "title"), strict=True)])).alias("_n", "_x")).select(id_col, "_n", "_x.*")
    rows = rows.withColumns({"title": F.btrim(F.regexp_replace("title", r"\s+", " "), F.lit(" .,:;»\"”")), "_k": F.lower("kind")}).where(F.length("title") >= 4)
    first = rows.groupBy(id_col, "_k", "number").agg(F.min_by(F.struct("kind", "title"), "_n").alias("_f"), F.min("_n").alias("_n"))
    order = [F.regexp_extract("number", "^([0-9]+)", 1).cast("int"), F.coalesce(F.regexp_extract("number", r"\(([0-9]+)\)", 1).try_cast("int"), F.lit(0)), F.col("_n")]
    return first.select(id_col, "_f.kind", "number", "_f.title", F.row_number().over(Window.partitionBy(id_col).orderBy(*order)).alias("place"))


def promoted(hits: DataFrame, by: str, rank: str, name: Column, content: Column, terms: Column, in_name: int = 4, in_content: int = 3) -> DataFrame:
    """hits with promotion and place: each of the terms counts in_name where the name holds it, else in_content where the text does; the order by promotion, then rank."""
    low_name, low = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(content, F.lit("")))
    score = F.aggregate(terms, F.lit(0), lambda s, t: s + F.when(F.contains(low_name, t), in_name).when(F.contains(low, t), in_content).otherwise(0))
    return hits.withColumn("promotion", score).withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("promotion"), rank)))


def canonical_json(text: Column) -> Column:
    """JSON with the keys of every object in order and without blanks; null for what is no JSON."""
    return F.to_json(F.try_parse_json(text))


def binding_status(quantity: Column, code: Column, known: Column, source_unit: Column, norm_unit: Column, trusted: Column) -> Column:
    """(status, reason) of a norm chosen for a work: rejected without a quantity, a whole typed code, the norm or units that convert; unsafe_source where the norm's source is not trusted."""
    from ..functions.units import converted

    reason = (
        F.when(quantity.isNull() | (quantity < 0), "quantity is missing")
        .when(~F.coalesce(code, F.lit("")).rlike(r"^[A-ZА-ЯЁ][A-Za-zА-Яа-яЁё]*[0-9]{2}-[0-9]{2}-[0-9]{3}-[0-9]{2}$"), "full typed norm code is required")
        .when(~known, "exact norm code not found")
        .when(converted(F.lit(1.0), source_unit, norm_unit).isNull(), "unit mismatch")
    )
    return F.struct(F.when(reason.isNotNull(), "rejected").when(trusted, "accepted").otherwise("unsafe_source").alias("status"), F.coalesce(reason, F.lit("")).alias("reason"))


def paged(rows: DataFrame, order: Sequence[str], after: Sequence | None, size: int) -> DataFrame:
    """One page of rows in the order of a unique key: those after the last key of the page before, so that a page costs its own rows and none is skipped or repeated."""
    if after is not None:
        rows = rows.where(F.struct(*[F.col(c) for c in order]) > F.struct(*[F.lit(v).alias(c) for c, v in zip(order, after, strict=True)]))
    return rows.orderBy(*order).limit(size)




def chunk_quality(text: Column) -> Column:
    """(broken_table, language_noise, short) of a chunk: two break tags or eight pipes; 120 characters with under 15% Cyrillic letters; under 120 characters."""
    t = F.coalesce(text, F.lit(""))
    letters = F.struct(*[F.length(F.regexp_replace(t, f"[^{c}]++", "")).alias(n) for n, c in (("c", "а-яёА-ЯЁ"), ("l", "A-Za-z"))])
    tags = F.regexp_count(t, F.lit(r"(?i)<br\s*/?>"))
    pipes = F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit("")))
    # A lambda's argument is worked out once, however often it is named.
    share = F.get(F.transform(F.array(letters), lambda x: F.when(x["c"] + x["l"] > 0, x["c"] / (x["c"] + x["l"])).otherwise(1.0)), 0)
    return F.struct(((tags >= 2) | (pipes >= 8)).alias("broken_table"), ((F.length(t) >= 120) & (share < 0.15)).alias("language_noise"), (F.length(t) < 120).alias("short"))


def quality_report(points: DataFrame, by: str, text: str, required: Sequence[str]) -> DataFrame:
    """A row a group: chunks, percentages of broken tables, language noise, short and incomplete ones, mean completeness, and copies of texts beyond the first within all groups.

    Texts are read once: rows meet by hash and group, with their sums, and
    what follows counts these. A text's copy counts for the group whose row is
    not the first in the order of the group's names.
    """
    filled = sum((F.coalesce(F.col(c).cast("string"), F.lit("")) != "").cast("int") for c in required) / len(required)
    rows = points.select(F.col(by), chunk_quality(F.col(text)).alias("q"), filled.alias("_full"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("_h"))
    signs = {"broken_tables_pct": F.col("q.broken_table"), "language_noise_pct": F.col("q.language_noise"), "short_pct": F.col("q.short"), "incomplete_pct": F.col("_full") < 1}
    held = rows.groupBy("_h", by).agg(F.count(F.lit(1)).alias("_n"), F.sum("_full").alias("_full"), *[F.count_if(c).alias(n) for n, c in signs.items()])
    w = Window.partitionBy("_h")
    held = held.withColumns({"_first": F.min(by).over(w), "_groups": F.count(by).over(w)})
    pct = lambda c: F.round(100 * (F.sum(c) / F.sum("_n")), 1)
    shares = [F.sum("_n").alias("n"), *[pct(n).alias(n) for n in signs], F.round(F.sum("_full") / F.sum("_n"), 3).alias("completeness")]
    copies = [F.sum(F.col("_n") - (F.col(by) == F.col("_first")).cast("int")).alias("copies"), F.when(F.col(by).isNotNull(), F.count_if(F.col("_groups") > 1)).alias("shared_texts")]
    return held.groupBy(by).agg(*shares, *copies)
