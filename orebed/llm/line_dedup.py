"""Removal of repeated runs of lines, found by winnowing over line hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash128, stored, text_of, without

WORD = r"[^\x20\x09-\x0D]+"


def fingerprints(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """The winnowed selection: a row for each selected line, _id, _t1, _t2 (hashes of the text), _fp (the line's hash) and _windows.

    Lines without words do not count. The window of a line is the shortest run
    of lines, from it on, that holds min_words words; each full window selects
    the first of its lines with the least hash. _windows lists those that
    select the line, in order: first line, last line, and two hashes of all
    lines in the window. They reach as far to both sides of the line as it
    stays the least, so every repetition of min_words words holds a selected
    line with equal windows around it.
    """
    t1, t2 = hash128(text_of(text_col))
    lines = (
        docs.select(F.col(id_col).alias("_id"), t1.alias("_t1"), t2.alias("_t2"), F.posexplode(F.split(text_of(text_col), "\n", -1)).alias("_pos", "_line"))
        .withColumn("_nw", F.regexp_count("_line", F.lit(WORD)).cast("long"))
        .where("_nw > 0")
    )
    h1, h2 = hash128(F.col("_line"))
    lines = lines.select("_id", "_t1", "_t2", "_pos", "_nw", h1.alias("_h1"), h2.alias("_h2"))
    # Rows that repeat id and text are one document here: their lines meet in one task and become one.
    doc = ["_id", "_t1", "_t2"]
    lines = lines.repartition(*doc).groupBy(*doc, "_pos").agg(*(F.min(c).alias(c) for c in ("_nw", "_h1", "_h2")))
    in_order = Window.partitionBy(*doc).orderBy("_pos")
    lines = lines.withColumn("_before", F.sum("_nw").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_nw"))
    ahead = Window.partitionBy(*doc).orderBy("_before").rangeBetween(0, min_words - 1)
    windows = (
        lines.withColumn("_l1", F.collect_list("_h1").over(ahead))
        .withColumn("_l2", F.collect_list("_h2").over(ahead))
        .withColumn("_words", F.sum("_nw").over(ahead))
        .withColumn("_end", F.max("_pos").over(ahead))
        .withColumn("_fp", F.array_min("_l1"))
        .withColumn("_at", F.row_number().over(in_order) + F.array_position("_l1", F.col("_fp")))
    )
    window = F.struct("_pos", "_end", F.xxhash64("_l1").alias("_w1"), F.xxhash64("_l2").alias("_w2"))
    full = windows.where(F.col("_words") >= min_words).select(*doc, "_at", "_fp", window.alias("_window"))
    # The rows of a document are in one task already, so this grouping does not shuffle.
    return full.groupBy(*doc, "_at").agg(F.first("_fp").alias("_fp"), F.sort_array(F.collect_list("_window")).alias("_windows")).drop("_at")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """The runs to delete: _id, _t1, _t2 (hashes of the text), first and last line, and the id of the document that has the run first.

    Positions of the selected lines are joined by their hash; a hash that is
    selected once in the corpus leaves at once. Around a joined position the
    match is extended both ways by comparing the lines of its windows, without
    laying out pairs of positions: those whose windows are all equal follow
    their first one as a whole, in the order (id, line), and among these first
    ones each window follows the first equal one. Matched windows that touch
    grow into one run.
    """
    selected = stored(fingerprints(docs, id_col, text_col, min_words), "line-fingerprints")
    often = selected.groupBy("_fp").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_fp")
    joined = selected.join(often, "_fp", "left_semi")
    around = F.transform("_windows", lambda w: F.struct(w["_w1"], w["_w2"]))
    s1, s2 = hash128(around)
    doc = ["_id", "_t1", "_t2"]
    place = F.struct(*doc, F.col("_windows")[0]["_pos"].alias("_pos"))
    joined = joined.select("_fp", *doc, "_windows", s1.alias("_s1"), s2.alias("_s2"), place.alias("_place"))
    same = ["_fp", "_s1", "_s2"]
    firsts = joined.groupBy(*same).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    firsts = stored(firsts, "line-firsts")

    whole = joined.join(firsts.where("_n > 1").drop("_n"), same).where(F.col("_place") > F.col("_first"))
    whole = whole.select(*doc, F.col("_windows")[0]["_pos"].alias("_pos"), F.array_max("_windows._end").alias("_end"), F.col("_first._id").alias("_origin"))
    # A hash with one kind of surroundings has nothing else in common.
    kinds = firsts.groupBy("_fp").agg(F.count(F.lit(1)).alias("_kinds")).where("_kinds > 1").select("_fp")
    single = joined.join(firsts.join(kinds, "_fp", "left_semi").drop("_n"), same).where(F.col("_place") == F.col("_first"))
    single = single.select(*doc, F.explode("_windows").alias("_w")).select(*doc, "_w.*")
    place = F.struct(*doc, "_pos")
    origins = single.groupBy("_w1", "_w2").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    parts = single.join(origins, ["_w1", "_w2"]).where(place > F.col("_first")).select(*doc, "_pos", "_end", F.col("_first._id").alias("_origin"))

    in_order = Window.partitionBy(*doc).orderBy("_pos")
    reach = F.max("_end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    runs = whole.unionAll(parts).withColumn("_starts", F.coalesce((F.col("_pos") > reach + 1).cast("int"), F.lit(1)))
    runs = runs.withColumn("_run", F.sum("_starts").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*doc, "_run").agg(F.min("_pos").alias("_from"), F.max("_end").alias("_to"), F.min("_origin").alias("_origin"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """docs with later repeated runs of lines deleted, plus removed_lines and removed_runs.

    A run is deleted when it holds at least min_words words and the same lines
    stand together earlier, in the order (id, line). The first occurrence of
    every line stays in the corpus. Lines are compared without change; lines
    without words never start a match, and go with a run that encloses them.
    A null text stays null and an empty one empty. Rows that repeat id and
    text are one document and come out alike; null ids sort first. A text
    whose lines all go becomes empty; its row stays. Columns of the input that
    are named like a result column are replaced.
    """
    docs = without(docs, "removed_lines", "removed_runs", "_t1", "_t2", "_runs", "_cut_id", "_c1", "_c2")
    doc = ["_id", "_t1", "_t2"]
    cuts = repeated_runs(docs, id_col, text_col, min_words).groupBy(*doc).agg(F.sort_array(F.collect_list(F.struct("_from", "_to"))).alias("_runs"))
    t1, t2 = hash128(text_of(text_col))
    rows = docs.withColumns({"_t1": t1, "_t2": t2})
    joined = rows.join(
        cuts.withColumnsRenamed({"_id": "_cut_id", "_t1": "_c1", "_t2": "_c2"}),
        F.col(id_col).eqNullSafe(F.col("_cut_id")) & (F.col("_t1") == F.col("_c1")) & (F.col("_t2") == F.col("_c2")),
        "left",
    )
    lines = F.split(text_of(text_col), "\n", -1)
    kept = F.filter(lines, lambda line, i: ~F.exists("_runs", lambda r: (i >= r["_from"]) & (i <= r["_to"])))
    removed = F.when(F.col("_runs").isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("long")
    return joined.select(
        *[F.when(F.col("_runs").isNull(), F.col(c)).otherwise(F.array_join(kept, "\n")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
        removed.alias("removed_lines"),
        F.when(F.col("_runs").isNull(), 0).otherwise(F.size("_runs")).cast("long").alias("removed_runs"),
    )
