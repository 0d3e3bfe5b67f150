"""Prefix trie of rebuilt conversations with totals of every subtree.

A conversation's turns are ranked; those of family members are rebuilt from the first turns of
the family's first conversation and their own later ones.  The node of a prefix is named by its
depth and the sums, over its turns, of 128 hashed bits of place, role and text; the sums are
running sums, so a long conversation is cut anywhere and its parts are added up.

Totals go up by time-forward processing.  Nodes are dealt out by range of (smallest member, depth), in
which every parent stands before its children, into shards.  In a shard they are sorted in
reverse level order; each adds what a priority queue holds for it to its own value and sends the sum to
its parent through that queue, which writes sorted runs to a scratch file when it grows.  What
is left over is for parents in other shards.  Nodes that get such messages (ports), with the next node
outside above each (its exit), make a smaller tree of the same kind, which is handled the same
way, in fewer shards, until one shard holds it.  Its totals then go up within the shards once more.

Defined results: rows without conv_id belong to no conversation and are left out; null roles and texts
are empty; turns are ordered with null first, ties by role and text; repeated rows are turns
of their own; a conversation that is left without turns is a member of the root; other columns are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from testlog.operators.durable import any_row, store

FAMILY = 5  # conversations with ids up to the next multiple share the first one's turns
HEADS = 9  # first turns taken over: crc32 of the id modulo this
QUEUE = 1 << 18  # messages a queue holds in memory
FEWER = 16  # shards of a tree per shard of the tree of its ports
BLOCK = 12  # ids with equal higher bits are joined to one string first
ROWS = 1 << 14
LIMBS = ("s1", "s2", "s3", "s4")
NODE = ("k1", "k2")

_MESSAGE = struct.Struct("<6q")


def running(rows: DataFrame, key: str, order: list[Column], spread: list[Column], sums: list[str]) -> DataFrame:
    """Replace ``sums`` by their running sums, with the row itself, over the rows of a key.

    Rows are dealt out by range of key and ``spread`` (short forms of ``order``), so that a key with
    very many rows lies in several partitions; those get the sums of the partitions before.
    ``order`` is dropped.
    """
    kept = [c for c in rows.columns if not c.startswith("order_")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, [0] * len(sums)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            new = np.append(True, keys[1:] != keys[:-1])
            begin = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
            columns = {name: batch.column(name) for name in batch.schema.names}
            for at, name in enumerate(sums):
                values = columns[name].to_numpy()
                total = np.cumsum(values)
                total = total - (total - values)[begin]
                if keys[0] == last:
                    total[begin == 0] += carry[at]
                columns[name] = pa.array(total, pa.int64())
                carry[at] = int(total[-1])
            last = keys[-1]
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    dealt = rows.repartitionByRange(F.col(key), *spread).sortWithinPartitions(F.col(key), *order)
    dealt = dealt.select(*kept, F.spark_partition_id().alias("part"))
    done = store(dealt.mapInArrow(run, dealt.schema))
    ends = done.groupBy(key, "part").agg(*[F.max(c).alias(f"{c}_before") for c in sums])
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(key, "part", *[F.sum(f"{c}_before").over(before).alias(f"{c}_before") for c in sums])
    ends = store(ends.filter(F.col(f"{sums[0]}_before").isNotNull()))  # at most one row per partition
    return (
        done.join(ends, [key, "part"], "left")
        .withColumns({c: F.col(c) + F.coalesce(f"{c}_before", F.lit(0)) for c in sums})
        .select(*kept)
    )


def _ranked(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, place, said, n_bytes): turns by their place in the conversation, from 1."""
    rows = conversations.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).alias("order_turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("order_role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("order_text"),
    )
    size = F.octet_length("order_role").cast("string")
    rows = rows.withColumns(
        {
            "said": F.md5(F.concat(size, F.lit(":"), F.col("order_role"), F.col("order_text"))),
            "n_bytes": F.octet_length("order_text").cast("long"),
            "place": F.lit(1).cast("long"),
        }
    )
    order = [F.col("order_turn").asc_nulls_first(), F.col("order_role"), F.col("order_text")]
    spread = [F.col("order_turn").asc_nulls_first(), F.left("order_role", F.lit(16)), F.left("order_text", F.lit(32))]
    return running(rows, "conv_id", order, spread, ["place"])


def rebuilt(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: (conv_id, size) of each, and (conv_id, size, pos, said, n_bytes) of their turns."""
    turns = store(_ranked(conversations, conv, turn, role, text))
    sizes = turns.groupBy("conv_id").agg(F.max("place").alias("n_own"))
    convs = sizes.select(
        "conv_id",
        "n_own",
        (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"),
        (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("h"),
    )
    first = sizes.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    taken = F.when(F.col("conv_id") == F.col("base"), F.lit(0)).otherwise(F.least("h", F.coalesce("n_base", F.lit(0))))
    skipped = F.when(F.col("conv_id") == F.col("base"), F.lit(0)).otherwise(F.col("h"))
    convs = convs.join(first, "base", "left").withColumns({"taken": taken.cast("long"), "skipped": skipped.cast("long")})
    size = F.col("taken") + F.greatest(F.col("n_own") - F.col("skipped"), F.lit(0))
    convs = store(convs.select("conv_id", "base", "taken", "skipped", size.alias("size")))
    columns = ["conv_id", "size", "pos", "said", "n_bytes"]
    own = (
        turns.join(convs, "conv_id")
        .filter("place > skipped")
        .withColumn("pos", F.col("place") - F.col("skipped") + F.col("taken"))
    )
    heads = turns.filter((F.col("place") < HEADS) & (F.col("conv_id") % FAMILY == 0))
    heads = heads.withColumnsRenamed({"conv_id": "base", "place": "pos"}).join(convs, "base").filter("pos <= taken")
    return convs.select("conv_id", "size"), own.select(*columns).unionByName(heads.select(*columns))


def _members(turns: DataFrame) -> DataFrame:
    """Add the node of every turn (k1, k2, depth) and the node above it (p1, p2)."""
    spot = F.md5(F.concat_ws(":", "pos", "said"))
    bits = {c: F.conv(F.substring(spot, 8 * i + 1, 8), 16, 10).cast("long") for i, c in enumerate(LIMBS)}
    rows = turns.withColumns(bits).withColumns({f"own_{c}": F.col(c) for c in LIMBS}).drop("said")
    rows = rows.withColumn("order_pos", F.col("pos"))
    order = [F.col("order_pos")]
    summed = running(rows, "conv_id", order, order, list(LIMBS))
    above = [F.col(c) - F.col(f"own_{c}") for c in LIMBS]
    return summed.select(
        "conv_id", "size", F.col("pos").alias("depth"), "n_bytes", *_named(F.col("pos"), [F.col(c) for c in LIMBS], NODE),
        *_named(F.col("pos") - 1, above, ("p1", "p2")),
    )


def _named(depth: Column, sums: list[Column], names: tuple[str, str]) -> list[Column]:
    return [
        F.xxhash64(depth, *sums).alias(names[0]),
        F.xxhash64(F.lit(1), *reversed(sums), depth).alias(names[1]),
    ]


class MessageQueue:
    """A priority queue of tuples of six whole numbers that writes sorted runs when it grows."""

    def __init__(self, limit: int = QUEUE):
        self.limit, self.heap, self.runs, self.made = limit, [], [], 0

    def push(self, message: tuple[int, ...]) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.limit:
            scratch = tempfile.TemporaryFile()  # has no name, so it is gone with the task
            for m in sorted(self.heap):
                scratch.write(_MESSAGE.pack(*m))
            scratch.seek(0)
            run = iter(lambda: scratch.read(_MESSAGE.size), b"")
            self.made += 1
            heapq.heappush(self.runs, (_MESSAGE.unpack(next(run)), self.made, run))
            self.heap = []

    def first(self) -> tuple[int, ...] | None:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple[int, ...]:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            message, number, run = self.runs[0]
            after = next(run, None)
            if after is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (_MESSAGE.unpack(after), number, run))
            return message
        return heapq.heappop(self.heap)


_TREE = "k1 long, k2 long, depth long, conv_id long, p1 long, p2 long, above long, leaves long, saved long, part long"
_NAMES = [c.split()[0] for c in _TREE.split(", ")]


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(name).to_pylist() for name in batch.schema.names))


def _upward(send: bool):
    """Totals of the nodes of a shard in reverse level order; with ``send`` the nodes themselves with their
    own values and, as rows without conv_id, the messages to nodes of other shards."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, shard, out = MessageQueue(), None, []

        def leave(upto: tuple | None) -> None:
            # no node of this shard claimed these
            while (m := queue.first()) is not None and (upto is None or m[:3] < upto):
                queue.pop()
                if send:
                    out.append((m[1], m[2], -m[0], None, None, None, None, m[3], m[4], shard))

        for row in _rows(batches):
            k1, k2, depth, conv, p1, p2, above, leaves, saved, part = row
            if part != shard:
                leave(None)
                shard = part
            me = (-depth, k1, k2)
            leave(me)
            all_leaves, all_saved = leaves, saved
            while (m := queue.first()) is not None and m[:3] == me:
                queue.pop()
                all_leaves, all_saved = all_leaves + m[3], all_saved + m[4]
            out.append(row if send else (k1, k2, all_leaves, all_saved))
            if p1 is not None:
                queue.push((-above, p1, p2, all_leaves, all_saved, 0))
            if len(out) >= ROWS:
                yield _batch(out, _NAMES if send else _NAMES[:2] + ["leaves", "saved"])
                out.clear()
        leave(None)
        yield _batch(out, _NAMES if send else _NAMES[:2] + ["leaves", "saved"])

    return run


def _exits(all_levels: bool):
    """The ports of a shard with their exits in place of their parents; nodes come in level order.

    Where parents are one level above, as in the trie itself, only that level is held.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, level, out = None, None, []
        upper: dict[tuple, tuple] = {}
        lower: dict[tuple, tuple] = {}
        for k1, k2, depth, conv, p1, p2, above, leaves, saved, part, port in _rows(batches):
            if part != shard:
                shard, upper, lower, level = part, {}, {}, None
            if depth != level:
                upper, lower, level = upper | lower if all_levels else lower, {}, depth
            at = upper.get((p1, p2), (p1, p2, above))
            lower[k1, k2] = at
            if port:
                out.append((k1, k2, depth, conv, *at, leaves, saved, part))
                if len(out) >= ROWS:
                    yield _batch(out, _NAMES)
                    out.clear()
        yield _batch(out, _NAMES)

    return run


def subtree_totals(tree: DataFrame, shards: int | None = None) -> DataFrame:
    """(k1, k2, leaves, saved) summed over the subtree of every node of a tree with (k1, k2, depth, conv_id), its
    parent (p1, p2, depth above) and its own values; conv_id never falls from a node to its child."""
    by = [F.col("conv_id"), F.col("depth")]
    dealt = tree.repartitionByRange(shards, *by) if shards else tree.repartitionByRange(*by)
    dealt = dealt.sortWithinPartitions(F.desc("depth"), *NODE).withColumn("part", F.spark_partition_id().cast("long"))
    passed = store(dealt.select(*_NAMES).mapInArrow(_upward(True), _TREE))
    nodes = passed.filter("conv_id IS NOT NULL")
    sent = passed.filter("conv_id IS NULL").groupBy(*NODE).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    sent = store(sent)
    if any_row(sent):
        ports = nodes.join(sent, list(NODE), "left")
        value = [F.coalesce("more_leaves", F.lit(0)).alias("leaves"), F.coalesce("more_saved", F.lit(0)).alias("saved")]
        port = F.col("more_leaves").isNotNull().cast("long").alias("port")
        ports = ports.select(*[c for c in _NAMES if c not in ("leaves", "saved", "part")], *value, "part", port)
        ports = ports.repartitionByRange("part").sortWithinPartitions("part", "depth").mapInArrow(_exits(shards is not None), _TREE)
        fewer = -(-passed.select("part").distinct().count() // FEWER)
        outer = subtree_totals(store(ports), fewer)
        outer = outer.withColumnsRenamed({"leaves": "more_leaves", "saved": "more_saved"})
        nodes = nodes.join(outer, list(NODE), "left").withColumns(
            {c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")}
        )
    nodes = nodes.select(*_NAMES).repartitionByRange("part").sortWithinPartitions("part", F.desc("depth"), *NODE)
    return store(nodes.mapInArrow(_upward(False), "k1 long, k2 long, leaves long, saved long"))


def _digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of (k1, k2, conv_id): the ids in order, joined by commas."""
    block = F.shiftright("conv_id", BLOCK).alias("block")
    joined = ends.groupBy(*NODE, block).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, out = None, None, []

        def emit() -> pa.RecordBatch:
            rows, out[:] = list(out), []
            keys = _batch([r[:2] for r in rows], list(NODE))
            return pa.RecordBatch.from_arrays([*keys.columns, pa.array([r[2] for r in rows], pa.string())], names=[*NODE, "ends_sha256"])

        for k1, k2, ids in _rows(batches):
            if (k1, k2) != node:
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = (k1, k2), hashlib.sha256(ids.encode())
                if len(out) >= ROWS:
                    yield emit()
            else:
                digest.update(b"," + ids.encode())
        if node is not None:
            out.append((*node, digest.hexdigest()))
        yield emit()

    dealt = joined.repartition(*NODE).sortWithinPartitions(*NODE, "block").select(*NODE, "ids")
    return dealt.mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, turns = rebuilt(conversations, conv, turn, role, text)
    members = store(_members(turns))
    zero = [F.lit(0).cast("long")] * len(LIMBS)
    root = _named(F.lit(0).cast("long"), zero, NODE)
    nodes = members.groupBy(*NODE).agg(
        F.min("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"),
        F.min("p1").alias("p1"),
        F.min("p2").alias("p2"),
        F.count("*").alias("n_convs"),
        F.min("n_bytes").alias("n_bytes"),
    )
    whole = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    none = F.lit(None).cast("long")
    top = whole.select(
        *root, F.lit(0).cast("long").alias("depth"), "conv_id", none.alias("p1"), none.alias("p2"), "n_convs",
        F.lit(0).cast("long").alias("n_bytes"),
    )
    nodes = store(nodes.unionByName(top))
    children = nodes.filter("p1 IS NOT NULL").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    nodes = nodes.join(children.agg(F.count("*").alias("n_children")), list(NODE), "left").fillna(0, ["n_children"])
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    nodes = store(nodes.join(parents, ["p1", "p2"], "left"))
    tree = nodes.select(
        *NODE, "depth", "conv_id", "p1", "p2", (F.col("depth") - 1).alias("above"),
        (F.col("n_children") == 0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"),
    )
    ends = members.filter("depth = size").select(*NODE, "conv_id")
    ends = ends.unionByName(convs.filter("size = 0").select(*root, "conv_id"))
    return (
        nodes.join(subtree_totals(tree), list(NODE))
        .join(_digests(ends), list(NODE), "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            F.col("leaves").alias("n_leaves"),
            F.col("saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
    )
