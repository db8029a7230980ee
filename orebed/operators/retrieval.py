"""Chunks, postings, BM25, vectors and fusion of rankings."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import name_key, simple_tokens, tokens
from ..session import checkpointed, spread


def term_counts(df: DataFrame, terms: str) -> DataFrame:
    """df with its column of term arrays replaced by arrays of (term, tf), counted inside the row: sorted and cut where the term changes.

    The sorted array and the places are columns of their own, as Catalyst
    evaluates an expression in a lambda again for every element.
    """
    others = [c for c in df.columns if c != terms]
    s = df.select(*others, F.sort_array(terms).alias("_s"))
    cuts = s.withColumn("_p", F.filter(F.sequence(F.lit(1), F.greatest(F.size("_s"), F.lit(1))), lambda i: (i == 1) | (F.get("_s", i - 1) != F.get("_s", i - 2))))
    counted = F.transform("_p", lambda p, j: F.struct(F.get("_s", p - 1).alias("term"), (F.coalesce(F.get("_p", j + 1), F.size("_s") + 1) - p).cast("long").alias("tf")))
    return cuts.select(*others, F.when(F.size("_s") > 0, counted).alias(terms))


def laid_out(df: DataFrame, counts: str) -> DataFrame:
    """A row for each (term, tf). The outer form, as a filter that Spark infers for the inner one would be pushed below and count again."""
    return df.select(*[c for c in df.columns if c != counts], F.inline_outer(counts)).where("term is not null")


def postings(docs: DataFrame, id_col: str, text: str, tokenise=tokens) -> DataFrame:
    """(term, id, tf, len): term counts of each document, with its number of tokens; counted inside the document's row, without a shuffle."""
    t = spread(docs.select(id_col, text)).select(F.col(id_col), tokenise(F.col(text)).alias("_t")).withColumn("len", F.size("_t"))
    return laid_out(term_counts(t, "_t"), "_t").select("term", id_col, "tf", "len")


def document_frequencies(posts: DataFrame, id_col: str) -> DataFrame:
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def bm25(docs: DataFrame, id_col: str, text: str, query: Sequence[str], k1: float = 1.2, b: float = 0.75, tokenise=tokens) -> DataFrame:
    """(id, score) of the documents with any of the query's terms.

    Only the query's terms become postings: texts are tokenised once, in a pass
    that also gives lengths. Its counts, a few numbers a document, are
    checkpointed, so that statistics and scores read them instead of texts.
    """
    t = spread(docs.select(id_col, text)).select(F.col(id_col), tokenise(F.col(text)).alias("_t")).withColumn("len", F.size("_t"))
    counted = checkpointed(t.select(id_col, "len", *[(F.size("_t") - F.size(F.array_remove("_t", q))).alias(f"tf{i}") for i, q in enumerate(query)]))
    stats = counted.agg(F.count(F.lit(1)), F.avg("len"), *[F.count_if(F.col(f"tf{i}") > 0) for i in range(len(query))]).head()  # one row
    n, mean = stats[0], float(stats[1] or 1)
    scored = counted.where(" or ".join(f"tf{i} > 0" for i in range(len(query))))
    score = F.lit(0.0)
    for i in range(len(query)):
        tf, df = F.col(f"tf{i}"), stats[2 + i]
        score = score + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / mean))
    return scored.select(id_col, score.alias("score"))


def fielded_bm25(docs: DataFrame, id_col: str, fields: dict[str, float], query: Sequence[str], k1: float = 1.2, b: float = 0.75, tokenise=tokens) -> DataFrame:
    """(id, tier, score) of the rows with any of the terms: the weighted sum of each column's BM25; tier "all" has every term in some column.

    Lengths, frequencies and the number of rows are one row of sums over all rows.
    """
    t = docs.select(id_col, *[tokenise(F.col(f)).alias(f) for f in fields])
    cells = [(f, i, q) for f in fields for i, q in enumerate(query)]
    counted = checkpointed(t.select(id_col, *[F.size(f).alias(f"len_{f}") for f in fields], *[(F.size(f) - F.size(F.array_remove(f, q))).alias(f"tf_{f}_{i}") for f, i, q in cells]))
    stats = counted.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"len_{f}").alias(f"mean_{f}") for f in fields], *[F.count_if(F.col(f"tf_{f}_{i}") > 0).alias(f"df_{f}_{i}") for f, i, _ in cells]).head()
    score = F.lit(0.0)
    for f, i, _ in cells:
        tf, df, n = F.col(f"tf_{f}_{i}"), stats[f"df_{f}_{i}"], stats["n"]
        score = score + fields[f] * math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col(f"len_{f}") / float(stats[f"mean_{f}"] or 1)))
    has = [" or ".join(f"tf_{f}_{i} > 0" for f in fields) for i in range(len(query))]
    every = F.expr(" and ".join(f"({h})" for h in has))
    return counted.where(" or ".join(has)).select(id_col, F.when(every, "all").otherwise("any").alias("tier"), score.alias("score"))


def hydrated(hits: DataFrame, contents: DataFrame, id_col: str) -> DataFrame:
    """Hits with the contents of their ids; a hit without contents goes."""
    return hits.join(contents, id_col)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where a norm is 0."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def dense_top_k(vectors: DataFrame, id_col: str, vector: str, query: Sequence[float], k: int, where: Column | None = None) -> DataFrame:
    """The k nearest by cosine; payload filters come before any score."""
    df = vectors if where is None else vectors.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.select(id_col, cosine(F.col(vector), q).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def fuse(rankings: Sequence[tuple[str, float, DataFrame]], id_col: str, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of (name, weight, ranked rows with rank): score and how many rankings hold the row."""
    every = None
    for name, weight, df in rankings:
        part = df.select(id_col, (F.lit(weight) / (k + F.col("rank"))).alias("_w"), F.lit(name).alias("_from"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(id_col).agg(F.sum("_w").alias("score"), F.countDistinct("_from").alias("n_rankings"))


def ranked(top: DataFrame, order: Sequence, name: str) -> DataFrame:
    """A bounded list of hits with its ranks: the window has no key, so only a top-k belongs here."""
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def round_robin(rankings: Sequence[DataFrame], id_col: str) -> DataFrame:
    """Rank 1 of every ranking, then rank 2 and so on; a row that comes again keeps its first place."""
    every = None
    for i, df in enumerate(rankings):
        part = df.select(id_col, F.struct(F.col("rank"), F.lit(i).alias("i")).alias("_at"))
        every = part if every is None else every.unionByName(part)
    first = every.groupBy(id_col).agg(F.min("_at").alias("_at"))
    return first.select(id_col, F.row_number().over(Window.orderBy("_at")).alias("place"))


def phrase_hits(docs: DataFrame, id_col: str, text: str, phrases: DataFrame, case: str, phrase: str, most: int = 8) -> DataFrame:
    """(case, id, text) of the documents that hold a phrase as a run of words; both are words parted by single spaces.

    Phrases and documents meet by the hash of the phrase's first words, up to
    `most` of them, and the whole phrase is compared then. The lengths of
    these grams are those that phrases have, at most `most` numbers.
    """
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    wanted = phrases.select(case, F.col(phrase).alias("_phrase"), words(F.col(phrase)).alias("_w")).where("size(_w) > 0")
    wanted = wanted.withColumn("_n", F.least(F.size("_w"), F.lit(most))).withColumn("_gram", F.xxhash64(F.slice("_w", F.lit(1), F.col("_n"))))
    sizes = sorted(r[0] for r in wanted.select("_n").distinct().collect())
    split = docs.select(id_col, words(F.col(text)).alias("_w"))
    grams = None
    for n in sizes:
        at = F.when(F.size("_w") >= n, F.sequence(F.lit(1), F.size("_w") - n + 1))
        some = split.select(id_col, "_w", F.explode(at).alias("_i")).select(id_col, F.xxhash64(F.slice("_w", F.col("_i"), F.lit(n))).alias("_gram"), F.lit(n).alias("_n"))
        grams = some if grams is None else grams.unionAll(some)
    if grams is None:
        return phrases.select(case).limit(0).join(docs.select(id_col, text), F.lit(False))
    met = grams.join(wanted.select(case, "_phrase", "_n", "_gram"), ["_n", "_gram"]).select(case, "_phrase", id_col).distinct()
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return met.join(docs.select(id_col, text), id_col).where(spaced(F.col(text)).contains(spaced(F.col("_phrase")))).select(case, id_col, text)


def concentrate(hits: DataFrame, family: str, score: str, floor: float = 0.45, ratio: float = 0.8, families: int = 3) -> DataFrame:
    """Hits above the floor (or near the best one) of the families with the best hits."""
    greatest = hits.agg(F.max(score)).head()[0] or 0.0
    best = hits.where((F.col(score) >= floor) | (F.col(score) >= ratio * greatest))
    top = best.groupBy(family).agg(F.max(score).alias("family_score")).orderBy(F.desc("family_score"), family).limit(families)
    return best.join(F.broadcast(top), family)  # at most `families` rows


def clear_winner(hits: DataFrame, by: str, score: str, tie: str, gap: float) -> DataFrame:
    """The best hit of each group, and whether it stands clear of the second one."""
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    r = hits.withColumns({"_rn": F.row_number().over(w), "_next": F.lead(score).over(w)}).where("_rn = 1")
    decision = F.when(F.col("_next").isNull() | (F.round(F.col(score) - F.col("_next"), 2) >= gap), "selected").otherwise("needs_choice")
    return r.withColumn("decision", decision).withColumnRenamed("_next", "second").drop("_rn")


def pages_of(text: Column, size: int, overlap: int) -> Column:
    """Slices of at most size characters, each overlap characters into the one before."""
    n = F.greatest(F.length(text) - overlap, F.lit(1))
    starts = F.sequence(F.lit(0), F.floor((n - 1) / (size - overlap)).cast("int"))
    return F.transform(starts, lambda i: F.substr(text, i * (size - overlap) + 1, F.lit(size)))


def packed_chunks(docs: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """Lines packed into chunks: a heading starts a new block, and blocks fill a chunk up to the size.

    A chunk's number grows where a heading begins or the characters since the
    document's start pass the next multiple of size, which needs no loop.
    """
    lines = docs.select(id_col, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")).where("trim(line) <> ''")
    w = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("line").rlike(r"^(#{1,6}\s+\S|[0-9]+(\.[0-9]+)*\.?\s+\S)")
    lines = lines.withColumn("_block", F.sum(heading.cast("int")).over(w))
    w2 = Window.partitionBy(id_col, "_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("_part", F.floor((F.sum(F.length("line") + 1).over(w2) - 1) / size))
    packed = lines.groupBy(id_col, "_block", "_part").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("_l"))
    out = packed.select(id_col, F.col("_l")[0]["pos"].alias("start_line"), F.array_join(F.col("_l.line"), "\n").alias("chunk"))
    return out.withColumn("chunk_ord", F.row_number().over(Window.partitionBy(id_col).orderBy("start_line")) - 1)


def digit_runs(text: Column) -> Column:
    """Numbers of at least four digits that are no years, without separators."""
    runs = F.regexp_extract_all(F.regexp_replace(text, r"(?<=[0-9])[   ,.](?=[0-9]{3})", ""), F.lit(r"[0-9]{4,}"), 0)
    return F.filter(F.array_distinct(runs), lambda x: ~x.rlike("^(19|20)[0-9]{2}$"))


def token_overlap(a: Column, b: Column) -> Column:
    """Share of a's distinct tokens that b has too."""
    a = F.array_distinct(a)
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def sidecar(index: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """An append-only index: rows whose key it has already are left out."""
    return index.unionByName(new.dropDuplicates([key]).join(index.select(key), key, "left_anti"))


def reranked(ranked: DataFrame, by: str, rank: str, head: int, score: Column) -> DataFrame:
    """The first `head` rows of each query in the order of a new score, the tail as it was."""
    s = F.when(F.col(rank) <= head, score)
    w = Window.partitionBy(by).orderBy(F.desc_nulls_last("_s"), rank)
    return ranked.withColumn("_s", s).withColumn("rerank_rank", F.row_number().over(w)).drop("_s")


def query_window(text: Column, terms: Sequence[str], width: int = 1600) -> Column:
    """The part of a text around the first term of a query that it has, at most width characters."""
    places = F.array(*[F.locate(t.lower(), F.lower(text)) for t in terms])
    first = F.coalesce(F.array_min(F.filter(places, lambda p: p > 0)), F.lit(1))
    return F.substr(text, F.greatest(F.lit(1), first - width // 2), F.lit(width))


def window_overlap(text: Column, terms: Sequence[str], width: int = 1600) -> Column:
    """A score for reranking: the share of the query's terms that the part of the text around the first of them has."""
    return token_overlap(F.array(*[F.lit(t) for t in terms]), simple_tokens(query_window(text, terms, width)))


def card_score(phrase: str, fields: Sequence[tuple[Column, int]], whole: int = 12) -> Column:
    """Weight of a table's card: `whole` where all fields together hold the phrase, and a field's own weight for each of the phrase's words in it."""
    keys = [(F.coalesce(name_key(c), F.lit("")), weight) for c, weight in fields]
    score = F.concat_ws(" ", *[k for k, _ in keys]).contains(phrase.lower()).cast("int") * whole
    for term in phrase.lower().split():
        for key, weight in keys:
            score = score + F.concat(F.lit(" "), key, F.lit(" ")).contains(f" {term} ").cast("int") * weight
    return score


def valid_json(text: Column, schema: str) -> Column:
    """The JSON object in a text, under a schema; null where there is none or a field does not fit."""
    span = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.from_json(span, schema, {"mode": "PERMISSIVE"})
