"""The trie of conversation prefixes: one node per distinct sequence of first turns, with counts over members and subtrees.

A prefix has a digest of two 64-bit numbers: the xor over its turns of hashes of (role, text, place). Xor is an aggregate
that Spark merges in any order, so prefixes of a conversation of any length come from sums of its parts.

Node table: conversations are dealt to shards by hash, and a long one is cut into segments of ``segment`` turns, each with
the node above it as its top. A shard enumerates its distinct digests, gives each a slot by a minimal perfect hash (levels
of bits; a key takes the first place that it has alone), verifies every lookup against the digest stored in the slot, and
scatters member counts and smallest members into flat NumPy arrays. Shards' nodes are then merged by digest: a node has a row
per shard at most, so a turn that all conversations share is no hot key. Merged counts go back to the shards, which add
up leaves and savings through their parent slots, deepest first. The shard that holds a node's smallest member is the one
that counts it; what a conversation owns in later segments is added at the end of each earlier one. Shards' sums are merged by
digest again.

Turns are ordered by number (null first), then role, then a digest of the text, so repeated rows are turns of their own.
Null roles and texts are empty. Rows without a conversation id are one conversation, which is never the smallest member
where others are; its id is written as the empty text, and comes first, in ``ends_sha256``. A conversation that is named
without turns is a member of the root. An empty table gives no node. Two prefixes that share a digest but differ in length,
last turn or parent raise an error. Further columns are ignored.

``ends_sha256`` is a chain over all ids that end at a node: ids are joined in tasks dealt by ranges of (node, id), a row per
batch of ids, and the pieces are then streamed through one running digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from wayfield.llm.order import numbered, run_starts
from wayfield.llm.store import written
from wayfield.llm.text import mix

EMPTY = hashlib.sha256(b"").hexdigest()


class NodeTable:
    """Slots 0 to n - 1 for the distinct keys (pairs of 64-bit numbers) that it is built from."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        key, first = np.unique(self._key(a, b), return_index=True)
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        left, base = key, 0
        while len(left):
            seed, size = len(self.levels) + 1, 2 * len(left)
            at = self._place(left, seed, size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((seed, alone, np.cumsum(alone) - 1 + base))
            base += int(alone.sum())
            left = left[~alone[at]]
        self.size = base
        self.a, self.b = np.zeros(base, dtype=np.int64), np.zeros(base, dtype=np.int64)
        slots = self._slots(key)
        self.a[slots], self.b[slots] = a[first], b[first]

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(a.view(np.uint64)) ^ mix(b.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))

    @staticmethod
    def _place(key: np.ndarray, seed: int, size: int) -> np.ndarray:
        return (mix(key + np.uint64(seed * 0xD6E8FEB86659FD93 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    def _slots(self, key: np.ndarray) -> np.ndarray:
        slots, open_ = np.full(len(key), -1, dtype=np.int64), np.arange(len(key))
        for seed, alone, rank in self.levels:
            at = self._place(key[open_], seed, len(alone))
            found = alone[at]
            slots[open_[found]] = rank[at[found]]
            open_ = open_[~found]
        return slots

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each key; a key that the table was not built from raises an error."""
        slots = self._slots(self._key(a, b))
        if len(slots) and (slots.min() < 0 or (self.a[slots] != a).any() or (self.b[slots] != b).any()):
            raise ValueError("a prefix digest is not in the node table, or two share a key")
        return slots


def _long(table: pa.Table, name: str) -> np.ndarray:
    return pc.fill_null(table.column(name), 0).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def _ranked(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Rank of each value among the distinct ones, null last, and the values by rank."""
    values = column.unique()
    values = values.take(pc.sort_indices(values, null_placement="at_end"))
    return pc.index_in(column, value_set=values).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64), values


def _local_nodes(schema: pa.Schema):
    """A shard's turns and tops as node rows: counts scattered by slot."""

    def run(table: pa.Table) -> pa.Table:
        rank, ids = _ranked(table.column("c"))
        depth, size = _long(table, "depth"), _long(table, "size")
        order = np.lexsort((depth, rank))
        rank, depth, size = rank[order], depth[order], size[order]
        new = np.flatnonzero(np.append(True, rank[1:] != rank[:-1]))
        runs = np.diff(np.append(new, len(rank)))

        def prefix(name: str) -> np.ndarray:
            total = np.bitwise_xor.accumulate(_long(table, name)[order])
            return total ^ np.repeat(np.append(0, total[new[1:] - 1]), runs)

        a, b = prefix("a"), prefix("b")
        top = np.zeros(len(rank), dtype=bool)
        top[new] = True
        nodes = NodeTable(a, b)
        slot = nodes.slots(a, b)
        above = np.append(0, np.arange(len(rank) - 1))
        facts = {}
        for name, values in (("depth", depth), ("size", size), ("pa", np.where(top, 0, a[above])), ("pb", np.where(top, 0, b[above]))):
            facts[name] = np.zeros(nodes.size, dtype=np.int64)
            facts[name][slot] = values
            if (facts[name][slot] != values).any():
                raise ValueError("two prefixes share a digest")
        first = np.full(nodes.size, len(ids), dtype=np.int64)
        np.minimum.at(first, slot, rank)
        is_top = np.zeros(nodes.size, dtype=bool)
        is_top[slot] = top
        facts |= {"a": nodes.a, "b": nodes.b, "n": np.bincount(slot, minlength=nodes.size), "top": is_top}
        facts |= {name: np.full(nodes.size, table.column(name)[0].as_py()) for name in ("shard", "seg")}
        return pa.Table.from_arrays([ids.take(pa.array(first)) if f.name == "first" else pa.array(facts[f.name], type=f.type) for f in schema], schema=schema)

    return run


def _subtree_sums(schema: pa.Schema):
    """A shard's nodes with merged counts, and carried sums: added up through parent slots, deepest first."""

    def run(table: pa.Table) -> pa.Table:
        carried = table.column("carried").combine_chunks().to_numpy(zero_copy_only=False)
        a, b, leaves, saved = (_long(table, name) for name in ("a", "b", "leaves", "saved"))
        at = np.flatnonzero(~carried)
        nodes = NodeTable(a[at], b[at])
        row = np.zeros(nodes.size, dtype=np.int64)
        row[nodes.slots(a[at], b[at])] = at
        counted = _long(table, "counted")[row]
        sums = {"leaves": leaves[row] * counted, "saved": saved[row] * counted}
        extra = np.flatnonzero(carried)
        to = nodes.slots(a[extra], b[extra])
        np.add.at(sums["leaves"], to, leaves[extra])
        np.add.at(sums["saved"], to, saved[extra])
        depth, top = _long(table, "depth")[row], table.column("top").combine_chunks().to_numpy(zero_copy_only=False)[row].astype(bool)
        parent = np.full(nodes.size, -1, dtype=np.int64)
        parent[~top] = nodes.slots(_long(table, "pa")[row[~top]], _long(table, "pb")[row[~top]])
        deepest = np.argsort(-depth, kind="stable")
        deepest = deepest[~top[deepest]]
        for level in np.split(deepest, np.flatnonzero(np.diff(depth[deepest])) + 1):
            for total in sums.values():
                np.add.at(total, parent[level], total[level])
        conv = table.column("conv").combine_chunks()
        own = np.flatnonzero(~top | (depth == 0))
        take = pa.array(row[own])
        above = pa.array(np.where(parent[own] < 0, 0, row[parent[own]]), mask=parent[own] < 0)
        found = {"parent": conv.take(above)}
        found |= {name: pa.array(total[own]) for name, total in sums.items()}
        return pa.Table.from_arrays([found[f.name] if f.name in found else table.column(f.name).combine_chunks().take(take) for f in schema], schema=schema)

    return run


def turn_digests(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """c, n (0, 1, ...), a and b (two hashes of role and text), size (code points of the text); texts are not shuffled."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    rows = turns.select(
        F.col(conv).alias("c"), F.col(turn).alias("t"), said[0].alias("r"),
        F.xxhash64(F.lit(1), *said).alias("a"), F.xxhash64(F.lit(2), *said).alias("b"), F.length(said[1]).cast("long").alias("size"),
    )
    return numbered(rows, "c", ["t", "r", "a", "b"], "turns").select("c", "n", "a", "b", "size")


def shared_heads(rows: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Numbered turns of conversations rebuilt on common beginnings, and all conversation ids.

    Conversation c gets the first h turns of conversation c - c % every (all if there are fewer, none if it is absent), then
    its own from the h-th on; h is crc32 of c in decimal, modulo ``most``. A row without an id keeps its turns.
    """
    crc = F.crc32(F.coalesce(F.col("c").cast("string"), F.lit("")).cast("binary")) % most
    head = F.when(F.col("c").isNull(), 0).otherwise(crc).alias("h")
    convs = written(rows.groupBy("c").agg(F.count(F.lit(1)).alias("len")), "conversations")
    bases = convs.filter(F.col("c") % every == 0).select(F.col("c").alias("base_c"), F.col("len").alias("base_len"))
    named = convs.select("c", head, (F.col("c") - F.col("c") % every).alias("base")).join(bases, F.expr("base = base_c"), "left")
    named = named.select("c", "h", "base", F.least("h", F.coalesce("base_len", F.lit(0))).alias("got"))
    heads = rows.filter((F.col("c") % every == 0) & (F.col("n") < most - 1)).withColumnRenamed("c", "from_c")
    taken = named.join(heads, F.expr("base = from_c and n < h")).select("c", "n", "a", "b", "size")
    short = named.filter("got < h").select(F.col("c").alias("short_c"), (F.col("h") - F.col("got")).alias("less"))
    own = rows.select("*", head).filter("n >= h").join(written(short, "short"), F.expr("c = short_c"), "left")
    own = own.select("c", (F.col("n") - F.coalesce("less", F.lit(0))).alias("n"), "a", "b", "size")
    return taken.unionByName(own), convs.select("c")


def _one(name: str) -> Column:
    """The value that all rows of a digest must share."""
    low, high = F.min(name), F.max(name)
    return F.when(low == high, low).otherwise(F.raise_error(F.lit("two prefixes share a digest"))).alias(name)


def _end_digests(ends: DataFrame) -> DataFrame:
    """a, b and the digest of the ids c of each (a, b), ascending, comma-joined."""
    kind = ends.schema["c"].dataType.simpleString()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                starts = run_starts([batch.column(0), batch.column(1)])
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, batch.num_rows), type=pa.int32()), batch.column(3))
                at = pa.array(starts)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(3)), pc.binary_join(lists, ",")], names=["a", "b", "c", "piece"])

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, out = None, None, []

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], type=t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["a", "b", "ends_sha256"])

        for batch in batches:
            for a, b, piece in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if (a, b) == key:
                    sha.update(b",")
                else:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (a, b), hashlib.sha256()
                sha.update(piece.encode())
            if len(out) > 1000:
                yield packed()
                out = []
        if key is not None:
            out.append((*key, sha.hexdigest()))
            yield packed()

    sort = ["a", "b", F.col("c").asc_nulls_first()]
    ids = ends.select("a", "b", "c", F.coalesce(F.col("c").cast("string"), F.lit("")).alias("id"))
    pieces = ids.repartitionByRange(*sort).sortWithinPartitions(*sort).mapInArrow(joined, f"a long, b long, c {kind}, piece string")
    return pieces.repartition("a", "b").sortWithinPartitions(*sort).mapInArrow(chained, "a long, b long, ends_sha256 string")


def prefix_trie(rows: DataFrame, convs: DataFrame, segment: int = 1024, rows_per_shard: int = 1 << 14) -> DataFrame:
    """The trie of numbered turns (``turn_digests``) and of all conversation ids ``c``: one row per node.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    spark = rows.sparkSession
    kind = rows.schema["c"].dataType
    arrow = spark.createDataFrame([], rows.select("c").schema).toArrow().schema.field(0).type
    place = F.floor(F.col("n") / segment)
    rows = written(rows.select("c", place.alias("seg"), (F.col("n") + 1).alias("depth"), F.xxhash64("a", "n").alias("a"), F.xxhash64("b", "n").alias("b"), "size"), "places")
    zero = F.lit(0).cast("long")
    parts = rows.select("c", "seg", "a", "b").unionByName(convs.select("c", zero.alias("seg"), zero.alias("a"), zero.alias("b")))
    parts = parts.groupBy("c", "seg").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    # a row per segment: the digest of all that stands before it
    before = Window.partitionBy("c").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    parts = written(parts.withColumns({"top_a": F.coalesce(F.bit_xor("a").over(before), zero), "top_b": F.coalesce(F.bit_xor("b").over(before), zero)}), "segments")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // rows_per_shard))
    shard = F.pmod(F.xxhash64("c"), F.lit(shards)).alias("shard")
    tops = parts.select(shard, "seg", "c", (F.col("seg") * segment).alias("depth"), F.col("top_a").alias("a"), F.col("top_b").alias("b"), zero.alias("size"))
    dealt = rows.select(shard, "seg", "c", "depth", "a", "b", "size").unionByName(tops)

    names = ["shard", "seg", "a", "b", "pa", "pb", "depth", "size", "n", "first", "top"]
    types = {"first": (kind.simpleString(), arrow), "top": ("boolean", pa.bool_())}
    schema = pa.schema([(x, types.get(x, ("long", pa.int64()))[1]) for x in names])
    local = written(dealt.groupBy("shard", "seg").applyInArrow(_local_nodes(schema), ", ".join(f"{x} {types.get(x, ('long',))[0]}" for x in names)), "local-nodes")

    merged = local.filter("not top or depth = 0").groupBy("a", "b").agg(F.sum("n").alias("n_convs"), F.min("first").alias("conv"), *map(_one, ("depth", "size", "pa", "pb")))
    merged = written(merged, "nodes")
    kids = merged.filter("depth > 0").groupBy("pa", "pb").agg(F.count(F.lit(1)).alias("n_children")).withColumnsRenamed({"pa": "kids_a", "pb": "kids_b"})
    facts = merged.join(kids, F.expr("a = kids_a and b = kids_b"), "left")
    facts = facts.select(
        F.col("a").alias("node_a"), F.col("b").alias("node_b"), F.col("depth").alias("d"), "conv", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"),
    )
    facts = written(facts, "facts")
    # what a conversation owns in a segment and after it is added where the segment before ends
    owned = facts.filter(F.col("d") > segment).groupBy(F.col("conv").alias("own_c"), F.floor((F.col("d") - 1) / segment).alias("own_seg")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    onward = Window.partitionBy("c").orderBy(F.col("seg").desc()).rowsBetween(Window.unboundedPreceding, 0)
    carry = parts.filter("seg > 0").join(owned, F.expr("c <=> own_c and seg = own_seg"), "left")
    carry = carry.select(shard, (F.col("seg") - 1).alias("seg"), F.col("top_a").alias("a"), F.col("top_b").alias("b"), *(F.coalesce(F.sum(x).over(onward), zero).alias(x) for x in ("leaves", "saved")), F.lit(True).alias("carried"))
    known = local.join(facts, F.expr("a = node_a and b = node_b"))
    counted = (F.col("first").eqNullSafe(F.col("conv")) & (~F.col("top") | (F.col("depth") == 0))).cast("long").alias("counted")
    known = known.select("shard", "seg", "a", "b", "pa", "pb", "depth", "top", counted, "conv", "n_convs", "n_children", "leaves", "saved", F.lit(False).alias("carried"))

    names = ["a", "b", "depth", "conv", "parent", "n_convs", "n_children", "leaves", "saved"]
    types = {"conv": (kind.simpleString(), arrow), "parent": (kind.simpleString(), arrow)}
    schema = pa.schema([(x, types.get(x, ("long", pa.int64()))[1]) for x in names])
    sums = known.unionByName(carry, allowMissingColumns=True).groupBy("shard", "seg").applyInArrow(_subtree_sums(schema), ", ".join(f"{x} {types.get(x, ('long',))[0]}" for x in names))
    same = ["depth", "conv", "parent", "n_convs", "n_children"]
    sums = sums.groupBy("a", "b").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), *(F.max(x).alias(x) for x in same))

    ends = parts.groupBy("c").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    ends = _end_digests(ends).withColumnsRenamed({"a": "end_a", "b": "end_b"})
    out = sums.join(ends, F.expr("a = end_a and b = end_b"), "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
