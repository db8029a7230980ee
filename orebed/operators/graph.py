"""Reference graphs, neighbourhoods, hierarchies and components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mentions(df: DataFrame, source: str, values, kind: str) -> DataFrame:
    """(source, target, kind, weight) of what each row mentions."""
    return df.select(F.col(source).alias("source"), F.explode(values).alias("target")).groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight")).withColumn("kind", F.lit(kind))


def reference_edges(mentioned: DataFrame, owners: DataFrame) -> DataFrame:
    """Mentions of a number become edges to the number's first owner; no edge leads to itself."""
    own = owners.groupBy("target").agg(F.min("source").alias("owner"))
    return mentioned.join(own, "target").where("source <> owner").groupBy("source", F.col("owner").alias("destination")).agg(F.sum("weight").alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """Outgoing and incoming edges and weights of each node, from one pass over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), "weight"), F.struct(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), "weight"))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.o").alias("n_out"), F.sum("e.i").alias("n_in"), F.sum("e.weight").alias("weight"))


def components(edges: DataFrame, a: str, b: str, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) by spreading the least label, doubling steps through the label's own label.

    `cut` writes a round out and reads it back (a checkpoint or a table in
    shared storage), so that the plan does not grow. Labels only fall, so the
    rounds end; their number grows with the logarithm of the longest chain.
    """
    ends = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    both = cut(edges.select(F.inline(F.array(ends(a, b), ends(b, a)))).distinct())
    label = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l")))
    while True:
        near = both.join(label.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        spread = label.join(near, "u").select("u", F.least("l", "m").alias("l"), F.col("l").alias("was"))
        jumped = spread.join(spread.select(F.col("u").alias("l"), F.col("l").alias("ll")), "l", "left").select("u", F.least("l", F.coalesce("ll", "l")).alias("l"), "was")
        after = cut(jumped)
        label = after.select("u", "l")
        if not after.where("l <> was").limit(1).count():
            break
    return label.select(F.col("u").alias("node"), F.col("l").alias("component"))


def contracted(edges: DataFrame, a: str, b: str, at_once: int = 200_000) -> DataFrame:
    """(a, b) of other edges, not more, with the same components; nodes are longs without nulls, and edges of a node to itself are left out.

    Each task turns some `at_once` of its edges at a time into stars around
    the least nodes. Where edges of a component lie together, as those of a
    sheet's boxes do, `components` then has hardly a chain left to follow.
    """

    def star(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, flat = np.unique(ends, return_inverse=True)
        (u, v), root = flat.reshape(ends.shape), np.arange(len(ids))
        while (root[u] != root[v]).any():
            low = np.minimum(root[u], root[v])
            for old in (root[u], root[v]):
                np.minimum.at(root, old, low)
            while (root != root[root]).any():
                root = root[root]
        leaf = root != np.arange(len(ids))
        return ids[leaf], ids[root[leaf]]

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            held += [] if batch is None else [batch]
            if held and (batch is None or sum(x.num_rows for x in held) >= at_once):
                leaves, roots = star(np.stack([np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1)]))
                held = []
                yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), pa.array(roots, pa.int64())], ["a", "b"])

    return edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).mapInArrow(stars, "a long, b long")


def touching(boxes: DataFrame, node: str, sheet: str, tolerance: float, cell: float, few: int = 64) -> DataFrame:
    """(a, b), a < b, of the boxes (x0, y0, x1, y1) of one sheet that touch each other within the tolerance.

    The boxes of a sheet that has at most `few` of them meet as they are. Those
    of larger sheets, wider by the tolerance at their far sides, meet in the
    cells of a grid, and a pair is taken in the first cell that both cover, so
    that it comes once. `cell` should be about the size of a box: a larger box
    has a row in every cell it covers, and boxes of one cell are compared in
    pairs. A box with an unknown side touches none.
    """
    known = ["n", "sheet", "x0", "y0", "x1", "y1"]
    boxes = boxes.select(F.col(node).alias("n"), F.col(sheet).alias("sheet"), *known[2:]).where(" and ".join(f"{c} is not null" for c in known))
    many = boxes.groupBy("sheet").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > few)
    at = lambda c, more=0.0: F.when(F.col("many").isNull(), F.lit(0).cast("long")).otherwise(F.floor((F.col(c) + more) / cell))
    wide = boxes.join(many, "sheet", "left").select(*known, at("x0").alias("i0"), at("y0").alias("j0"), at("x1", tolerance).alias("i1"), at("y1", tolerance).alias("j1"))
    cells = wide.withColumn("i", F.explode(F.sequence("i0", "i1"))).withColumn("j", F.explode(F.sequence("j0", "j1"))).drop("i1", "j1")
    a, b = cells.alias("a"), cells.alias("b")
    met = a.join(b, F.expr("a.sheet = b.sheet and a.i = b.i and a.j = b.j and a.n < b.n"))
    first = met.where("a.i = greatest(a.i0, b.i0) and a.j = greatest(a.j0, b.j0)")
    t = float(tolerance)
    return first.where(f"a.x0 <= b.x1 + {t}D and b.x0 <= a.x1 + {t}D and a.y0 <= b.y1 + {t}D and b.y0 <= a.y1 + {t}D").select(F.col("a.n").alias("a"), F.col("b.n").alias("b"))


#: Which states of a document may follow which.
LIFECYCLE = {"WIP": ["WIP", "Shared", "Archived"], "Shared": ["Shared", "WIP", "Published", "Archived"], "Published": ["Published", "WIP", "Archived"], "Archived": ["Archived"]}


def allowed_transition(before, after):
    """Whether a document may go from one state to another; a first state is always allowed."""
    out = before.isNull()
    for state, following in LIFECYCLE.items():
        out = out | ((before == state) & after.isin(*following))
    return out


def membership(docs: DataFrame, levels: list[tuple[str, str]], size: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, label, parent, children, size) and edges (source, target, kind, weight) of nested groups.

    levels are (kind, column) from the outermost group to the document; a
    node's id is its kind and the labels down to it, its size the sum over
    what it holds, its children how many nodes stand directly below.
    """
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    nodes, edges = None, None
    for i, (kind, column) in enumerate(levels):
        ids = [F.concat_ws(":", F.lit(k), *[label(c) for _, c in levels[: j + 1]]) for j, (k, _) in enumerate(levels)]
        parent = ids[i - 1] if i else F.lit(None).cast("string")
        below = F.countDistinct(ids[i + 1]) if i + 1 < len(levels) else F.lit(0).cast("long")
        part = docs.groupBy(ids[i].alias("id"), label(column).alias("label"), parent.alias("parent")).agg(below.alias("children"), F.sum(size).alias("size"))
        part = part.select("id", F.lit(kind).alias("kind"), "label", "parent", "children", "size")
        nodes = part if nodes is None else nodes.unionByName(part)
        if i:
            link = part.select(F.col("parent").alias("source"), F.col("id").alias("target"), F.lit("member").alias("kind"), F.lit(1).cast("long").alias("weight"))
            edges = link if edges is None else edges.unionByName(link)
    return nodes, edges


def number_edges(mentioned: DataFrame, owners: DataFrame, per_number: int = 200, most: int = 4000) -> DataFrame:
    """(source, target, kind, weight): documents that mention a number point to its owner; weight is how many numbers do.

    mentioned are rows (number, source), owners (number, target), one a
    number. The caps are the feature: of each number the first sources, and
    of all edges the heaviest. Both are ranked in the tasks before they meet.
    """
    first = F.row_number().over(Window.partitionBy("number").orderBy("source"))
    near = mentioned.select("number", "source").distinct().withColumn("nth", first).where(F.col("nth") <= per_number)
    met = near.join(owners, "number").where("source <> target")
    weighed = met.groupBy("source", "target").agg(F.lit("reference").alias("kind"), F.count(F.lit(1)).alias("weight"))
    return weighed.orderBy(F.desc("weight"), "source", "target").limit(most)
