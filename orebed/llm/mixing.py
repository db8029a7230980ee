"""Mixing sources to target weights by Sainte-Laguë apportionment of equal word blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_of, without

WORD = r"[^\x20\x09-\x0D]+"
PIECE = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def seeded(*parts: Column | str, digits: int = 12) -> Column:
    """A whole number from md5 over the parts, null as empty."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """_source, _sid, _rows, source_size, target: what each source gets of all words.

    `sizes` has _source and size. Sources stand by code point with null last
    and take the weights in turn. A target is weight x level, at most
    max_repeat x the source's size; the level is where the targets add up to
    all words. In the order of cap / weight the capped sources come first,
    which gives the level in one pass over one row per source.
    """
    s = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    s = s.withColumn("_sid", F.row_number().over(by_name).cast("long"))
    s = s.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_sid") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", F.col("source_size") * max_repeat)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "_sid").rowsBetween(Window.unboundedPreceding, 0)
    left = F.sum("source_size").over(whole) - (F.sum("_cap").over(by_ratio) - F.col("_cap"))
    open_weight = F.sum("_w").over(whole) - (F.sum("_w").over(by_ratio) - F.col("_w"))
    s = s.withColumn("_level", left.cast("double") / open_weight)
    s = s.withColumn("_capped", F.col("_cap") / F.col("_w") < F.col("_level"))
    level = F.max(F.when(~F.col("_capped"), F.col("_level"))).over(whole)
    target = F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(F.least(F.col("_cap").cast("double"), F.col("_w") * F.coalesce(level, F.lit(0.0))))
    return s.select("_source", "_sid", "_rows", "source_size", target.alias("target"))


def apportion(cells: DataFrame, votes: str, seats: Column, order: str, by: Sequence[str] = ()) -> DataFrame:
    """cells with _quota: Sainte-Laguë seats for each cell, by highest quotients votes / (2 k + 1) within each group of `by`.

    `seats` is the same in all rows of a group; equal quotients go by `order`.
    With c votes a seat, cell i has floor(c v_i + 1/2) seats. One c is low
    enough to give too few seats and another high enough to give too many
    (they differ by the number of cells), so only the quotients between the
    two are laid out and ranked: at most about two rows for each cell, however
    many seats there are.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    v = F.col(votes).cast("double")
    n, total = F.count(F.lit(1)).over(group), F.sum(v).over(group)
    seat = lambda c: F.floor(c * v + 0.5).cast("long")
    low = F.greatest(F.lit(0.0), seats - n / 2 - 1) / F.nullif(total, F.lit(0.0))
    high = (seats + n / 2 + 1) / F.nullif(total, F.lit(0.0))
    cells = cells.withColumns({"_seats": seats.cast("long"), "_low": F.coalesce(seat(low), F.lit(0)), "_high": F.coalesce(seat(high), F.lit(0))})
    cells = cells.withColumn("_open", F.col("_seats") - F.sum("_low").over(group))
    keys = list(dict.fromkeys([*by, order]))
    contested = cells.where("_high > _low").select(*keys, votes, "_open", F.explode(F.sequence("_low", F.col("_high") - 1)).alias("_k"))
    ranked = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy((F.col(votes) / (2 * F.col("_k") + 1)).desc(), order, "_k")
    won = contested.withColumn("_rank", F.row_number().over(ranked)).where("_rank <= _open").groupBy(*keys).agg(F.count(F.lit(1)).alias("_won"))
    return cells.join(won, keys, "left").withColumn("_quota", F.col("_low") + F.coalesce("_won", F.lit(0))).drop("_seats", "_low", "_high", "_open", "_won")


def mix_plan(
    docs: DataFrame,
    source_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    weights: Sequence[float] = (5, 2, 1),
    max_repeat: int = 3,
    block_words: int = 2048,
    blocks_at_least: int = 100,
    shard_rows: int = 8192,
    seed: str = "mix",
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per document: _id, _source, size, source_size, target, taken, and how the mix takes it.

    Words are `[^\\x20\\x09-\\x0D]+`; a null text has none. Blocks are of
    block_words words, fewer where the smallest positive target would not hold
    blocks_at_least of them. Blocks go to sources by Sainte-Laguë quotients of
    their targets, then to each source's shards (about shard_rows documents,
    by a seeded hash of the id) by quotients of their words. In a shard the
    documents stand in seeded order; the quota takes whole passes and then a
    seeded systematic selection of the remaining number of blocks, so that a
    document's words taken follow from its place alone: no block is laid out
    as a row. No document is taken more than max_repeat times.

    Documents without words are taken with 0 words. Ids that repeat or are
    null only share their places' hash; equal rows are interchangeable. An
    empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"), *[F.col(f"`{c}`").alias(f"_of_{c}") for c in carry])
    sizes = stored(rows.select("_source", "size", "_id"), "mix-sizes") if not carry else rows
    sources = source_targets(sizes, weights, max_repeat)
    whole = Window.partitionBy(F.lit(0))
    block = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.min(F.when(F.col("target") > 0, F.col("target"))).over(whole) / blocks_at_least))).cast("long")
    sources = sources.withColumn("_block", F.coalesce(block, F.lit(1)))
    seats = F.floor(F.sum("target").over(whole) / F.col("_block") + 0.5).cast("long")
    sources = stored(apportion(sources, "target", seats, "_sid").withColumnRenamed("_quota", "_source_quota"), "mix-sources")

    placed = sizes.join(sources.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    shards = F.ceil(F.col("_rows") / shard_rows).cast("long")
    placed = placed.withColumn("_shard", seeded(F.lit(seed), F.lit("shard"), F.col("_id")) % shards)
    cells = placed.groupBy("_sid", "_shard").agg(F.sum("size").alias("_cell"), F.first("_source_quota").alias("_source_quota"))
    cells = apportion(cells, "_cell", F.max("_source_quota").over(Window.partitionBy("_sid")), "_shard", ["_sid"]).select("_sid", "_shard", "_cell", "_quota")

    in_order = Window.partitionBy("_sid", "_shard").orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.coalesce(F.col("_id").cast("string"), F.lit("")))), F.col("_id").asc_nulls_first(), "size")
    placed = placed.withColumn("_end", F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_start", F.expr("_end - size"))
    placed = placed.join(cells, ["_sid", "_shard"])
    asked = "_quota * _block"
    placed = placed.withColumn("_passes", F.expr(f"if(_cell = 0, 0L, least({max_repeat}L, ({asked}) div _cell))"))
    placed = placed.withColumn("_blocks", F.expr("greatest(1L, (_cell + _block - 1) div _block)"))
    placed = placed.withColumn("_extra", F.expr(f"if(_cell = 0 or _passes >= {max_repeat}, 0L, least(_blocks, cast(floor(({asked} - _passes * _cell) / _block + 0.5) as bigint)))"))
    placed = placed.withColumn("_offset", seeded(F.lit(seed), F.lit("block"), F.col("_source"), F.col("_shard")) % F.col("_blocks"))
    placed = placed.withColumn("taken", F.expr(f"_passes * size + ({_before('_end')}) - ({_before('_start')})"))
    return placed


def _chosen(block: str) -> str:
    """SQL for the number of chosen blocks before `block`: of every _blocks blocks, _extra at even distances from a seeded start."""
    return f"((({block}) * _extra + _offset) div _blocks)"


def _before(at: str) -> str:
    """SQL for the chosen words before word `at` of the shard."""
    b = f"({at} div _block)"
    return f"_block * ({_chosen(b)} - {_chosen('0L')}) + ({_chosen(b + ' + 1')} - {_chosen(b)}) * ({at} % _block)"


def mix_documents(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: a document once for each whole pass, and once more with the words that the chosen blocks hold of it.

    The columns of docs; n_chars, where there is one, follows the new text.
    Options as for mix_plan. A document of which no word is taken has no row.
    """
    docs = without(docs, *[f"_of_{c}" for c in docs.columns])
    plan = mix_plan(docs, source_col, id_col, text_col, carry=docs.columns, **options)
    part = F.expr("_passes * size < taken")
    words = F.regexp_extract_all(f"_of_{text_col}", F.lit(PIECE), 0)
    at = lambda i: (F.col("_start") + i - (F.col("_start") + i) % F.col("_block")) / F.col("_block")
    count = lambda b: F.floor((b * F.col("_extra") + F.col("_offset")) / F.col("_blocks"))
    piece = F.array_join(F.filter(words, lambda w, i: count(at(i) + 1) > count(at(i))), "")
    whole = F.array_repeat(F.col(f"_of_{text_col}"), F.col("_passes").cast("int"))
    texts = F.when(part, F.concat(whole, F.array(piece))).otherwise(whole)
    out = plan.where("taken > 0").withColumn("_text", F.explode(texts))
    return out.select(*[F.col("_text").alias(c) if c == text_col else F.length("_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`_of_{c}`").alias(c) for c in docs.columns])
