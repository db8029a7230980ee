"""How far the sources of a language lie apart in the words that they use."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, slices, stored, text_of

UNIT = 1_000_000_000
#: Counts that a task holds before it hands them on.
HELD_TERMS = 300_000
#: Terms of a block of the matrix products, on average.
BLOCK_TERMS = 4096
#: Columns of a tile of a product.
TILE = 2048
#: Everything but letters A to Z, a to z and what is not ASCII parts terms; only A to Z are lower-cased.
LOWERED = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

COUNTED = "lang string, source string, term string, n long, docs long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term) met in a row of batches; a null term stands for the group itself."""
    names = [f.split()[0] for f in COUNTED.split(", ")]
    schema = pa.schema([(n, t) for n, t in zip(names, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)])
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            terms = list(n)
            columns = [[lang] * len(terms), [source] * len(terms), [t.decode() for t in terms], [n[t] for t in terms], [docs[t] for t in terms]]
            yield from (pa.RecordBatch.from_pydict(dict(zip(names, columns, strict=True)), schema=schema).slice(i, 20_000) for i in range(0, len(terms), 20_000))
        yield pa.RecordBatch.from_pylist([{"lang": lang, "source": source, "n": 0, "docs": 0} for lang, source in groups], schema=schema)
        groups.clear()

    for batch in slices(batches):
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            terms = text.encode().translate(LOWERED).split()
            n.update(terms)
            docs.update(set(terms))
        if sum(len(n) for n, _ in groups.values()) > HELD_TERMS:
            yield from rows()
    if groups:
        yield from rows()


def term_counts(docs: DataFrame, least_docs: int = 3) -> DataFrame:
    """(lang, term, n, sources): the kept terms of each language, with the count of each source that has it; a row with a null term lists all sources of a language."""
    ship(docs.sparkSession)
    rows = docs.select(*[text_of(c).alias(c) for c in ("lang", "source", "text")]).mapInArrow(_counted, COUNTED)
    by_source = rows.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = by_source.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("sources"))  # a source has one row here
    return by_term.where(F.col("term").isNull() | (F.col("docs") >= least_docs)).drop("docs")


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (count + 1) / (total + terms)), in whole numbers."""
    return F.expr(f"1 + (cast({count} + 1 as decimal(19,0)) * {UNIT}BD) div cast({total} + {terms} as decimal(19,0))")


def _tables(counts: np.ndarray) -> Iterator[np.ndarray]:
    """Blocks of rows (terms) in the order of their totals, halved until their levels fill one tile or 64 rows are left."""
    if len(counts) > 64 and sum(len(np.unique(c)) for c in counts.T) > TILE:
        yield from _tables(counts[: len(counts) // 2])
        yield from _tables(counts[len(counts) // 2 :])
    elif len(counts):
        yield counts


def priced_pairs(counts: np.ndarray, totals: list[int]) -> np.ndarray:
    """Sums, over the rows of counts (terms x groups), of floor((p - q)^2 / q) of each ordered pair of groups; totals are the groups' N + V.

    A column stands for a (group, count level), level 0 among them; the
    one-hot matrix times its transpose has the joint table of the levels of
    any two groups. Its cells are whole numbers under 2^24, exact in single
    precision, and each is priced once.
    """
    groups = counts.shape[1]
    sums = np.zeros((groups, groups), np.int64)
    for block in _tables(counts[np.argsort(counts.sum(axis=1), kind="stable")]):
        levels = [np.unique(c, return_inverse=True) for c in block.T]
        group = np.repeat(np.arange(groups), [len(u) for u, _ in levels])
        first = np.cumsum([0, *[len(u) for u, _ in levels]])
        p = np.array([1 + UNIT * (int(c) + 1) // totals[g] for g, (u, _) in enumerate(levels) for c in u], np.int64)
        hot = np.zeros((len(block), len(p)), np.float32)
        for g, (_, codes) in enumerate(levels):
            hot[np.arange(len(block)), first[g] + codes] = 1
        tiles = range(0, len(p), TILE)
        for i in tiles:
            for j in tiles:
                joint = (hot[:, i : i + TILE].T @ hot[:, j : j + TILE]).astype(np.int64)
                apart = p[i : i + TILE, None] - p[None, j : j + TILE]
                joint *= apart * apart // p[None, j : j + TILE]
                gi, gj = group[i : i + TILE], group[j : j + TILE]
                joint = np.add.reduceat(joint, np.flatnonzero(np.r_[True, gi[1:] != gi[:-1]]), axis=0)
                joint = np.add.reduceat(joint, np.flatnonzero(np.r_[True, gj[1:] != gj[:-1]]), axis=1)
                sums[np.ix_(np.unique(gi), np.unique(gj))] += joint
    return sums


PRICED = "lang string, source string, item string, value long"


def _priced(terms: pa.Table, groups: pa.Table) -> pa.Table:
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    if not terms.num_rows or groups.num_rows < 2:
        return schema.empty_table()
    names = groups.column("source").to_pylist()
    place = {s: i for i, s in enumerate(names)}
    totals = [n + v for n, v in zip(groups.column("total").to_pylist(), groups.column("terms").to_pylist(), strict=True)]
    lists = terms.column("sources").combine_chunks()
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    cells = lists.flatten()
    counts = np.zeros((len(lists), len(names)), np.int64)
    counts[row, [place[s] for s in cells.field("source").to_pylist()]] = cells.field("n").to_numpy()
    sums = priced_pairs(counts, totals)
    a, b = np.nonzero(~np.eye(len(names), dtype=bool))
    lang = [groups.column("lang")[0].as_py()] * len(a)
    return pa.table([pa.array(lang, pa.string()), pa.array([names[i] for i in a], pa.string()), pa.array([names[i] for i in b], pa.string()), pa.array(sums[a, b])], schema=schema)


def _maybe_broadcast(df: DataFrame, rows: int = 100_000) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def source_divergence(docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: the distance of each source to the other sources of its language, and its `top` telling terms.

    Null text, lang or source is empty. A language keeps the terms that stand
    in at least least_docs of its rows (repeated rows count again). With N the
    count of all kept terms and V their number, a source or language gives a
    term p = 1 + floor(10^9 (count + 1) / (N + V)), and p against q costs
    floor((p - q)^2 / q). Part "pair": the sum over all kept terms against each
    other source, 0 without kept terms. Part "term": the kept terms that a
    source has with p above the language's q. Ranks go by value, ties by the
    UTF-8 item. No documents, no rows; other columns are left out.

    Terms are counted in the tasks that read, so a hot source or word travels
    as a row a task. Blocks of terms meet the groups of their language, and
    give a row a pair of sources: neither terms nor joint tables meet in one
    task. The number of sources of a language is what a row of `term_counts`
    and the result, all pairs of them, grow with.
    """
    kept = stored(term_counts(docs, least_docs), "divergence_terms")
    terms, none = kept.where("term is not null"), kept.where("term is null")
    flat = terms.select("lang", "term", F.col("n").alias("lang_n"), F.inline("sources"))
    totals = flat.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total"))
    groups = none.select("lang", F.explode("sources.source").alias("source")).join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = stored(groups.fillna(0, ["total", "terms", "lang_total"]), "divergence_groups")
    blocks = F.ceil(F.col("terms") / BLOCK_TERMS)
    sized = _maybe_broadcast(langs.select("lang", blocks.alias("blocks")))
    dealt = terms.join(sized, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "sources")
    asked = groups.where("terms > 0").select("lang", "source", "total", "terms", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
    priced = dealt.groupBy("lang", "block").cogroup(asked.groupBy("lang", "block")).applyInArrow(_priced, PRICED)
    values = priced.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    others = groups.select("lang", "source").join(none.select("lang", F.col("sources.source").alias("all")), "lang").select("lang", "source", F.explode("all").alias("item")).where("item <> source")
    pairs = others.join(values, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    with_shares = flat.join(_maybe_broadcast(groups), ["lang", "source"]).withColumns({"p": share("n", "total", "terms"), "q": share("lang_n", "lang_total", "terms")})
    telling = with_shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(telling.withColumn("rank", rank).where(F.col("rank") <= top))
