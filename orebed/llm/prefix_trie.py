"""The prefix trie of conversations: one row a distinct sequence of first turns, with what stands below it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stored, text_of

#: Members that a shard's subtrees have at most, as powers of this: a level's group holds at most so many nodes of one depth.
FAN = 4096
#: A counted table of this many rows may be broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Nodes that a task holds before it works on whole subtrees.
BLOCK_ROWS = 65_536
ROOT = bytes(16)

CHAINED = "conv_id long, depth long, a long, b long, pa long, pb long, chars long, last boolean"
SUMMED = "a long, b long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, pa long, pb long, top boolean"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, nth, digest, chars): the turns of each conversation in order, by digests of role and text instead of these.

    Ordered by turn (null first), then role, then digest. Null role or text is
    empty; rows with a null conv_id belong to no conversation and are left out.
    Repeated rows are turns of their own.
    """
    role, text = text_of("role"), text_of("text")
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        role.alias("role"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.length(text).cast("long").alias("chars"),
    )
    w = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    return rows.select("conv_id", F.row_number().over(w).cast("long").alias("nth"), "digest", "chars")


def rebuilt(turns: DataFrame, family: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, part, nth, digest, chars): the first h turns of the family's first conversation, then a conversation's own turns after its first h.

    h is the CRC-32 of the decimal conv_id modulo `most`. part is -1 for the
    one row that every conversation has, 0 for lent turns and 1 for its own.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % most
    ids = turns.where("nth = 1").select("conv_id", h.cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    lent = turns.where((F.col("nth") < most) & (F.col("conv_id") % family == 0))  # at most `most` turns a family
    lent = lent.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("nth", "digest", "chars"))).alias("l"))
    heads = ids.join(lent, "base").select("conv_id", F.lit(0).alias("part"), F.explode(F.slice("l", F.lit(1), F.col("h"))).alias("x")).select("conv_id", "part", "x.*")
    marks = ids.select("conv_id", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("nth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars"))
    own = turns.where(F.col("nth") > h).select("conv_id", F.lit(1).alias("part"), "nth", "digest", "chars")
    return marks.unionByName(heads).unionByName(own)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each prefix of each conversation: its digest is that of the prefix before and the turn. Only the last prefix is kept between batches."""
    held, node, depth = None, ROOT, 0
    names = [f.split()[0] for f in CHAINED.split(", ")]

    def rows(found: list[tuple], last: list[bool]) -> pa.RecordBatch:
        conv, depths, nodes, parents, chars = zip(*found, strict=True)
        at, up = (np.frombuffer(b"".join(x), "<i8").reshape(-1, 2) for x in (nodes, parents))
        columns = [pa.array(conv, pa.int64()), pa.array(depths, pa.int64()), *(pa.array(np.ascontiguousarray(x[:, i])) for x in (at, up) for i in (0, 1)), pa.array(chars, pa.int64()), pa.array(last, pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        found, last = [], []
        for conv, part, digest, chars in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "digest", "chars")), strict=True):
            if held is not None:
                found.append(held)
                last.append(part < 0)
            if part < 0:
                parent, node, depth = b"\xff" * 16, ROOT, 0
            else:
                parent, node, depth = node, hashlib.blake2b(node + digest, digest_size=16).digest(), depth + 1
            held = (conv, depth, node, parent, chars)
        if found:
            yield rows(found, last)
    if held is not None:
        yield rows([held], [True])


class SlotTable:
    """A minimal perfect hash of 128-bit keys, given as two arrays of 64 bits.

    On each level, a key whose place no other key has takes it; the rest go on
    to the next level. A key's slot is the number of places taken before its
    own. A slot holds its key, so that a key that is not in the table is told.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        left, base = np.arange(len(a)), 0
        while len(left):
            if len(self.levels) == 64:
                raise ValueError("two nodes have one digest")
            size = 2 * len(left) + 1
            at = self._place(a[left], b[left], len(self.levels), size)
            taken = np.bincount(at, minlength=size) == 1
            self.levels.append((size, taken, base + np.cumsum(taken) - 1))
            base += int(taken.sum())
            left = left[~taken[at]]
        self.a, self.b = np.empty_like(a), np.empty_like(b)
        slots = self._slots(a, b)
        self.a[slots], self.b[slots] = a, b

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        x = (a.astype("<u8") ^ (b.astype("<u8") * np.uint64(2 * level + 1))) * np.uint64(0x9E3779B97F4A7C15)
        return ((x >> np.uint64(24)) % np.uint64(size)).astype(np.int64)

    def _slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        slots, left = np.full(len(a), -1), np.arange(len(a))
        for level, (size, taken, rank) in enumerate(self.levels):
            at = self._place(a[left], b[left], level, size)
            hit = taken[at]
            slots[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return slots

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The keys' slots, -1 for keys that the table does not hold."""
        s = self._slots(a, b)
        return np.where((s >= 0) & (self.a[s] == a) & (self.b[s] == b), s, -1) if len(self.a) else s


def _whole_subtrees(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of at least so many rows, cut only where the shard key (ka, kb) changes."""
    held, n, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        ka, kb = (batch.column(c).to_numpy() for c in ("ka", "kb"))
        new = np.flatnonzero((ka[1:] != ka[:-1]) | (kb[1:] != kb[:-1])) + 1
        cuts = new.tolist() if last in (None, (ka[0], kb[0])) else [0, *new.tolist()]
        last = ka[-1], kb[-1]
        if cuts and n + cuts[-1] >= rows:
            yield pa.Table.from_batches([*held, batch.slice(0, cuts[-1])])
            held, n, batch = [], 0, batch.slice(cuts[-1])
        held.append(batch)
        n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums up each shard's subtrees: flat arrays by slot, and the slots of the parents, from the deepest nodes upwards."""
    names = [f.split()[0] for f in SUMMED.split(", ")]
    for t in _whole_subtrees(batches, BLOCK_ROWS):
        c = {n: t.column(n).to_numpy() for n in t.column_names}
        if not c["same"].all():
            raise ValueError("two nodes have one digest")
        slots = SlotTable(c["a"], c["b"])
        at = slots.find(c["a"], c["b"])
        flat = {}
        for n in ("pa", "pb", "conv_id", "depth", "n_convs", "chars", "children", "leaves", "saved"):
            flat[n] = np.empty(len(at), np.int64)
            flat[n][at] = c[n]
        parent = np.where(flat["depth"] > 0, slots.find(flat["pa"], flat["pb"]), -1)
        children, leaves, saved = flat["children"], flat["leaves"], flat["saved"]
        saved += (flat["n_convs"] - 1) * flat["chars"]
        order = np.argsort(-flat["depth"], kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(flat["depth"][order])) + 1):
            leaves[own] += children[own] == 0
            own = own[parent[own] >= 0]
            for sums, more in ((children, 1), (leaves, leaves[own]), (saved, saved[own])):
                np.add.at(sums, parent[own], more)
        above = pa.array(flat["conv_id"][parent], mask=parent < 0)
        columns = [slots.a, slots.b, flat["conv_id"], flat["depth"], above, flat["n_convs"], children, leaves, saved, flat["pa"], flat["pb"], parent < 0]
        yield from pa.Table.from_arrays([pa.array(x) for x in columns], names).to_batches(max_chunksize=BLOCK_ROWS)


def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces of text in their order, joined by commas; pieces are read one after the other."""
    key, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"a": [key[0]], "b": [key[1]], "ends_sha256": [state.hexdigest()]}, schema=schema)

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])
    for batch in batches:
        done = []
        for a, b, piece in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "piece")), strict=True):
            if (a, b) == key:
                state.update(b",")
            else:
                if key:
                    done.append((*key, state.hexdigest()))
                key, state = (a, b), hashlib.sha256()
            state.update(piece.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
    if key:
        yield row()


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def prefix_trie(turns: DataFrame, fan: int = FAN) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node.

    `turns` are rows (conv_id, part, nth, digest, chars), in each conversation
    in the order of part and nth, after one row with part -1. A node is a
    distinct digest of a prefix; the turnless one is the root. A conversation
    without turns is a member of the root. No conversation gives no node.
    Copies and common first turns only raise counts, which are summed before
    they travel.

    Shards hold whole subtrees: on level k those with at most fan^(k+1)
    members, without what the level below holds, so at most `fan` nodes of a
    depth. What a subtree sums up to is added to its parent on a later level.
    Levels grow with the logarithm of the number of conversations. A
    conversation's own chain and the ids that end in one node are read in
    order by one task, which keeps one prefix or one running hash.
    """
    spark = turns.sparkSession
    ship(spark)
    dealt = turns.select("conv_id", "part", "nth", "digest", "chars").repartition("conv_id").sortWithinPartitions("conv_id", "part", "nth")
    chains = stored(dealt.mapInArrow(_chain, CHAINED), "trie_chains")
    n_convs = chains.where("depth = 0").count()
    if not n_convs:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    bounds = [fan]
    while bounds[-1] < n_convs:
        bounds.append(bounds[-1] * fan)
    level = sum([(F.col("n_convs") > t).cast("int") for t in bounds[:-1]], F.lit(0))
    same = [F.min(c) == F.max(c) for c in ("depth", "pa", "pb", "chars")]
    nodes = chains.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n_convs"), *[F.min(c).alias(c) for c in ("conv_id", "depth", "pa", "pb", "chars")], (same[0] & same[1] & same[2] & same[3]).alias("same")
    )
    nodes = stored(nodes.withColumn("level", level), "trie_nodes")
    heavy = _maybe_broadcast(nodes.where("level > 0").select("a", "b", "level"))
    # A conversation's first prefix of a level is the top of the subtree that holds all its prefixes of this level.
    leveled = chains.join(heavy, ["a", "b"], "left").withColumn("level", F.coalesce("level", F.lit(0)))
    tops = leveled.groupBy("conv_id", "level").agg(F.min(F.struct("depth", "a", "b")).alias("top"))
    placed = stored(nodes.join(tops, ["conv_id", "level"]).select(nodes["*"], F.col("top.a").alias("ka"), F.col("top.b").alias("kb")), "trie_placed")
    every, gains = None, None
    for k in range(len(bounds)):
        own = placed.where(F.col("level") == k)
        if gains is None:
            own = own.select("*", *[F.lit(0).cast("long").alias(c) for c in ("children", "leaves", "saved")])
        else:
            given = gains.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            own = own.join(given, ["a", "b"], "left").fillna(0, ["children", "leaves", "saved"])
        summed = stored(own.drop("level").repartition("ka", "kb").sortWithinPartitions("ka", "kb").mapInArrow(_accumulate, SUMMED), f"trie_level{k}")
        up = summed.where("top and depth > 0").select("pa", "pb", "n_leaves", "saved_tokens")
        every, gains = (summed, up) if every is None else (every.unionAll(summed), gains.unionAll(up))
    parents = _maybe_broadcast(nodes.where("level > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("above")))
    lifted = every.where("top").join(parents, ["pa", "pb"], "left").withColumn("parent_conv_id", F.col("above")).select(*every.columns)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = chains.where("last").groupBy("a", "b", F.shiftright("conv_id", 16).alias("piece_no")).agg(ids.alias("piece"))  # at most 65,536 ids a piece
    ends = pieces.repartition("a", "b").sortWithinPartitions("a", "b", "piece_no").select("a", "b", "piece").mapInArrow(_hashed_ends, "a long, b long, ends_sha256 string")
    whole = every.where("not top").unionAll(lifted).join(ends, ["a", "b"], "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, fan: int = FAN) -> DataFrame:
    """The prefix trie of conversations whose first turns are replaced by those of their family (see `rebuilt`)."""
    return prefix_trie(rebuilt(stored(ordered_turns(conversations), "trie_turns")), fan)
