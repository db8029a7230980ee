"""N-gram Jaccard self-join: MinHash banding for candidates, exact verification on whole n-gram sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, slices, stored, text_of
from .components import connected_components
from .shingles import MinHash, bands_for, shingle_hashes, shingle_set

#: A block holds at most about so many texts and bytes.
BLOCK_TEXTS, BLOCK_BYTES = 256, 16 << 20


def signatures(texts: DataFrame, n: int, bands: int, rows: int, seed: int) -> DataFrame:
    """(id, node, bytes, bands) of (id, node, text); bands is null for a text without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(bands, rows, seed)
        for batch in slices(batches):
            signed = []
            for text in batch.column(2).to_pylist():
                h = shingle_hashes(text, n)
                signed.append(minhash.band_hashes(h) if len(h) else None)
            out = pa.array(signed, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pc.binary_length(batch.column(2)).cast(pa.int64()), out], ["id", "node", "bytes", "bands"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(sign, f"id {kind}, node string, bytes bigint, bands array<bigint>")


def intersections(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections of the sets left x right, by products of 0/1 matrices over `width` shingles at a time."""
    sets = left + right
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(column, minlength=len(values)) > 1
    place = np.cumsum(shared) - 1
    use = shared[column]
    owner, column = owner[use], place[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    top = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, top, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs have |A n B| >= threshold |A u B|, in whole numbers but for the threshold."""
    inter = intersections(left, right).astype(np.float64)
    a, b = np.array([len(s) for s in left], float)[:, None], np.array([len(s) for s in right], float)[None, :]
    return (inter >= threshold * (a + b - inter) - 1e-9) & (inter > 0)


def _roots(links: np.ndarray) -> np.ndarray:
    """The least member of each node's component, of a symmetric matrix of links."""
    root = np.arange(len(links))
    reach = links | np.eye(len(links), dtype=bool)
    while True:
        least = np.where(reach, root[None, :], len(links)).min(axis=1)
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _compare(table: pa.Table, n: int, threshold: float) -> pa.Table:
    """Links within one block or between two: (node, other, links); other is the node's least one in its component here."""
    table = table.sort_by("node")
    i, j = table["bi"][0].as_py(), table["bj"][0].as_py()
    nodes = table["node"].to_pylist()
    sets = [shingle_set(t, n) for t in table["text"].to_pylist()]
    if i == j:
        m = linked(sets, sets, threshold)
        np.fill_diagonal(m, False)
    else:
        block = np.array(table["block"].to_pylist())
        l, r = np.flatnonzero(block == i), np.flatnonzero(block == j)
        m = np.zeros((len(nodes), len(nodes)), bool)
        if len(l) and len(r):
            part = linked([sets[k] for k in l], [sets[k] for k in r], threshold)
            m[np.ix_(l, r)] = part
            m[np.ix_(r, l)] = part.T
    root = _roots(m)
    count = m.sum(axis=1)
    has = np.flatnonzero(count)
    return pa.table({"node": pa.array([nodes[k] for k in has], pa.string()), "other": pa.array([nodes[root[k]] for k in has], pa.string()), "links": pa.array(count[has], pa.int64())})


def _near_leader(rows: DataFrame, n: int, threshold: float) -> DataFrame:
    """Of (node, text, lead_text): the nodes within half the allowed distance of the leader.

    Jaccard distance is a metric, so any two of these are linked.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, lead = None, None
        for batch in batches:
            close = []
            for text, lead_text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if lead_text != last:
                    last, lead = lead_text, shingle_set(lead_text, n)
                s = shingle_set(text, n)
                inter = len(np.intersect1d(s, lead, assume_unique=True))
                union = len(s) + len(lead) - inter
                close.append(2 * (union - inter) <= (1 - threshold) * union)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(close, pa.bool_())], ["node", "close"])

    return rows.mapInArrow(near, "node string, close boolean")


def narrowed(members: DataFrame, close: DataFrame, n: int, threshold: float) -> DataFrame:
    """(node, sub): the parts into which a component (component, node, text) falls when texts must share a prefix shingle.

    With the shingles of a component in one order, rarest first, two texts of
    the similarity t share one of the first size - ceil(t size) + 1 of the
    larger text, which is one of the first size - ceil(2 t / (1 + t) size) + 1
    of the smaller one. Texts that have a shingle in their longer beginning
    meet by way of the least one that has it in its shorter beginning, if any
    has, as in a band; the close ones are in one part anyway.
    Texts that only have frequent words in common, such as a long form around
    contents of their own, fall apart and are compared with none; a text
    that is left alone has no row.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t, n) for t in batch.column(2).to_pylist()]
            sizes = np.array([len(s) for s in sets], np.int64)
            at = pa.array(np.repeat(np.arange(len(sets)), sizes))
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.repeat(sizes, sizes)), pa.array(flat.view(np.int64))], ["component", "node", "size", "shingle"])

    tokens = stored(members.select("component", "node", "text").mapInArrow(explode, "component string, node string, size bigint, shingle bigint"), "shingles")
    # A shingle of one text takes a place in its prefix, but nobody meets there.
    often = tokens.groupBy("component", "shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = Window.partitionBy("node")
    ranked = tokens.join(often, ["component", "shingle"]).withColumn("rank", F.row_number().over(own.orderBy("n", "shingle"))).withColumn("shared", F.count(F.lit(1)).over(own))
    place = F.col("rank") + F.col("size") - F.col("shared")
    first = lambda share: place <= F.col("size") - F.ceil(share * F.col("size") - 1e-9) + 1
    heads = stored(ranked.where(first(threshold)).select("component", "shingle", "node", first(2 * threshold / (1 + threshold)).alias("short")), "prefixes")
    stars = heads.where("short").groupBy("component", "shingle").agg(F.min("node").alias("first"))
    edges = heads.join(stars, ["component", "shingle"]).where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    near = members.join(close, "node").where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return connected_components(edges.unionAll(near)).withColumnRenamed("component", "sub")


def blocks_of(sized: DataFrame, component: str) -> DataFrame:
    """(component, blocks) of rows (component, node, bytes): how many blocks of about BLOCK_TEXTS and BLOCK_BYTES they fill."""
    sized = sized.groupBy(component).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("total"))
    return sized.select(component, F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("total") / BLOCK_BYTES)).cast("int").alias("blocks"))


def ngram_jaccard_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    threshold: float = 0.8,
    recall: float = 0.9995,
    most_hashes: int = 160,
    seed: int = 1,
) -> DataFrame:
    """One row per input row: id, class_id, n_links, n_copies, text_md5, class_md5.

    Two texts are linked when the Jaccard similarity of their sets of n-word
    shingles (\\w+, lower case) is at least `threshold`. class_id is the least
    id of all rows whose texts are connected by links; n_links counts the
    other texts (not their copies) linked to the row's text; n_copies counts
    the rows with the same text; class_md5 is the least text of the class, and
    tells classes apart whose ids repeat. A text of fewer than n words is one shingle.
    A null text counts as empty, and empty texts link to nothing but are
    copies of each other. Null ids count as the largest; a class whose ids
    are all null has a null class_id. Repeated rows are copies. An empty table
    gives no rows. Other columns of the input are ignored.

    Equal texts become one node first. Nodes that share a band of MinHash
    values meet by way of the least node of that band, never as pairs of all
    members; the components of these stars are the candidates. Inside one,
    every pair of texts is compared on whole shingle sets, in blocks of
    bounded size: a task sees two blocks and returns a row for each text, not
    for each pair. In components of more than one block, texts within half
    the allowed distance of the component's first text are linked to each
    other by the triangle inequality without comparison, so a great group of
    close copies costs one comparison each; and the component falls into
    parts whose texts share a rare shingle (see `narrowed`), so that texts
    which a band has put together by frequent words are not compared.
    """
    spark = docs.sparkSession
    ship(spark)
    bands, rows = bands_for(threshold, recall, most_hashes)
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).select("id", F.md5("text").alias("node"), "text")
    signed = stored(signatures(texts, n, bands, rows, seed), "signatures")
    nodes = signed.groupBy("node").agg(F.max("bytes").alias("bytes"))

    banded = signed.where("bands is not null").select("node", F.explode("bands").alias("band"))
    stars = banded.groupBy("band").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last").select("band", "first")
    edges = banded.join(stars, "band").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    candidates = connected_components(edges)

    members = candidates.join(blocks_of(nodes.join(candidates, "node"), "component"), "component")
    members = stored(texts.join(members, "node").groupBy("node", "component", "blocks", "text").agg(F.count(F.lit(1)).alias("copies")), "members")

    leaders = members.where("blocks > 1 and node = component").select("component", F.col("text").alias("lead_text"))
    close = stored(_near_leader(members.where("blocks > 1").join(leaders, "component").select("node", "text", "lead_text"), n, threshold).where("close").select("node"), "close")
    large = members.where("blocks > 1")
    if large.limit(1).count():
        parts = narrowed(large, close, n, threshold).withColumnRenamed("sub", "component")
        parts = stored(parts.join(blocks_of(parts.join(nodes, "node"), "component"), "component"), "parts")
        members = members.where("blocks = 1").unionByName(members.drop("component", "blocks").join(parts, "node"))
    split = members.join(close.withColumn("close", F.lit(True)), "node", "left").withColumn("close", F.coalesce("close", F.lit(False)))
    counts = split.groupBy("component").agg(F.count_if("close").alias("n_close"), F.count_if(~F.col("close")).alias("n_far"))
    split = split.join(counts, "component")

    # Far texts have blocks 0..far-1, close ones stand behind them; compared are far with far and far with close.
    far = F.when(F.col("n_far") == 0, 0).when(F.col("n_close") == 0, F.col("blocks")).otherwise(F.least("blocks", F.greatest(F.ceil(F.col("n_far") / BLOCK_TEXTS), F.ceil(F.col("blocks") * F.col("n_far") / (F.col("n_far") + F.col("n_close")))))).cast("int")
    split = split.withColumn("far", far).withColumn("all", F.when(F.col("n_close") > 0, F.col("far") + F.col("blocks")).otherwise(F.col("far")))
    hashed = F.pmod(F.xxhash64("node"), F.when(F.col("close"), F.col("blocks")).otherwise(F.greatest("far", F.lit(1)))).cast("int")
    split = split.where("far > 0").withColumn("block", F.when(F.col("close"), F.col("far") + hashed).otherwise(hashed))
    others = F.when(F.col("close"), F.sequence(F.lit(0), F.col("far") - 1)).otherwise(F.sequence(F.lit(0), F.col("all") - 1))
    pairs = split.withColumn("other", F.explode(others)).select(
        "component", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "node", "text"
    )
    # Asked for by number, since AQE merges partitions by bytes and a few bytes of texts are much work here.
    dealt = pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "component", "bi", "bj")
    compared = dealt.groupBy("component", "bi", "bj").applyInArrow(lambda t: _compare(t, n, threshold), "node string, other string, links bigint")
    compared = stored(compared, "links")

    among = split_close(close, members)
    links = compared.select("node", "links").unionAll(among.select("node", "links")).groupBy("node").agg(F.sum("links").alias("n_links"))
    edges = compared.select(F.col("node").alias("a"), F.col("other").alias("b")).unionAll(among.select(F.col("node").alias("a"), F.col("component").alias("b")))
    classes = connected_components(edges.where("a <> b"))

    copies = signed.groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n_copies"))
    named = copies.join(classes, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = named.groupBy("component").agg(F.min("least").alias("class_id"))
    named = named.join(ids, "component").select("node", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies", F.col("component").alias("class_md5"))
    return signed.select("id", "node").join(named, "node").select(F.col("id").alias(id_col), "class_id", "n_links", "n_copies", F.col("node").alias("text_md5"), "class_md5")


def split_close(close: DataFrame, members: DataFrame) -> DataFrame:
    """(node, component, links): the texts close to their component's first one are linked to all others of this kind."""
    own = members.select("node", "component").join(close, "node")
    return own.join(own.groupBy("component").agg((F.count(F.lit(1)) - 1).alias("links")), "component").where("links > 0")


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row for each class of near duplicates: the one with the least id (of equal ids, the least text).

    Columns stay as they are. Rows that repeat the kept id and text come out once.
    """
    classes = ngram_jaccard_join(docs, id_col, text_col, **options)
    first = F.min_by(F.struct(F.col(id_col).alias("__kept_id"), F.col("text_md5").alias("__kept_md5")), F.struct(F.col(id_col).isNull(), id_col, "text_md5"))
    best = classes.groupBy("class_md5").agg(first.alias("__best")).select("__best.*")
    keyed = docs.withColumn("__md5", F.md5(text_of(text_col)))
    kept = keyed.join(best, F.col(id_col).eqNullSafe(F.col("__kept_id")) & (F.col("__md5") == F.col("__kept_md5")), "left_semi")
    return kept.dropDuplicates([id_col, "__md5"]).select(*[F.col(f"`{c}`") for c in docs.columns])
