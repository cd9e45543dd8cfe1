"""Conversations as a trie of their turns, in succinct level-order tries by prefix.

1. *Turns.* A turn is a digest of its role and text, and its text's bytes. Tasks hold whole blocks of
   five conversations, sorted, and pass over them once: a rebuilt conversation needs no more than the
   first turns of its block's first one. A node's key is the digest of its parent's key and its turn.
2. *Heavy nodes*, those of more conversations than a limit, are counted in a first pass. The limit
   grows with the table so that they are at most ``MOST_HEAVY``, whatever the table; their keys go to
   all tasks of the second pass.
3. *Shards.* The first node that is not heavy on a conversation's path is the top of a shard; a path
   gets a new top every ``BAND`` turns, so that a shard has few nodes even if conversations are long.
   Nodes are aggregated by key and dealt by top; a task lays its shards out in level order (LOUDS bits
   and arrays of labels, numbers of conversations and bytes), which is what is stored.
4. *Rollups* go through a stored trie's levels in reverse: ``np.add.at`` gives leaves and saved bytes to
   the parents, which are ranks in the bits. Deeper bands come first and hand their tops' sums on.
5. *Heavy levels* are one trie of their own, which takes the sums of all tops below it.

Conversations that end in a node are hashed in a stream sorted by node and number, so that no list of
them is ever held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.louds import Louds, level_order
from siltstone.llm.scratch import Scratch

if TYPE_CHECKING:
    import pyarrow as pa

#: Conversations whose first turns the others of their block begin with.
FAMILY = 5
#: Most turns that are taken over from them, plus 1.
SHARED = 9
MOST_HEAVY = 400_000
LEAST_HEAVY = 256
BAND = 256
#: Nodes of a task's shards together, about.
SHARD_NODES = 100_000

ROOT = bytes(16)
NOTHING = hashlib.sha256().digest()

TURNS = "key binary, parent binary, depth long, conv_id long, bytes long, end boolean, top binary"
TRIES = "shard long, n int, bits binary, labels binary, parents binary, depths binary, conv_ids binary, n_convs binary, bytes binary, ends binary, below binary"
ROLLED = "key binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def turn_labels(conversations: DataFrame) -> DataFrame:
    """(family, conv_id, turn, label, bytes) of the rows that have a conversation."""
    conv, role, text = F.col("conv_id").cast("long"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    below_zero = F.when((conv < 0) & (conv % FAMILY != 0), 1).otherwise(0)
    return conversations.filter("conv_id IS NOT NULL").select(
        (F.expr(f"CAST(conv_id AS LONG) div {FAMILY}") - below_zero).alias("family"),
        conv.alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("label"),
        F.octet_length(text).cast("long").alias("bytes"),
    )


def _rebuilt(heavy: frozenset[bytes]):
    """A row for each turn of each rebuilt conversation, and one for its start; rows come sorted by family, conversation and turn."""

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        import pyarrow as pa
        from xxhash import xxh3_128_digest as digest

        out: list[list] = [[] for _ in range(7)]
        add = [c.append for c in out]
        family = conv = None
        base: list[tuple[bytes, int]] = []
        key, parent, top, depth, nbytes, skip = ROOT, None, None, 0, 0, 0

        def emit(end: bool) -> None:
            for put, x in zip(add, (key, parent, depth, conv, nbytes, end, top), strict=True):
                put(x)

        def step(label: bytes, size: int) -> None:
            nonlocal key, parent, top, depth, nbytes
            emit(False)
            parent, key, nbytes = key, digest(key + label), size
            if key in heavy:
                top = None
            elif top is None or depth % BAND == 0:
                top = key
            depth += 1

        def batch() -> pa.RecordBatch:
            types = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=_names(TURNS))
            for c in out:
                c.clear()
            return made

        for rows in batches:
            for fam, c, label, size in zip(*(rows.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True):
                if c != conv:
                    if conv is not None:
                        emit(True)
                    if fam != family:
                        family, base = fam, []
                    conv, key, parent, top, depth, nbytes = c, ROOT, None, None, 0, 0
                    skip = 0
                    if c != FAMILY * fam:
                        skip = crc32(str(c).encode()) % SHARED
                        for one in base[:skip]:
                            step(*one)
                if c == FAMILY * fam and len(base) < SHARED - 1:
                    base.append((label, size))
                if skip:
                    skip -= 1
                else:
                    step(label, size)
            if len(out[0]) >= 10_000:
                yield batch()
        if conv is not None:
            emit(True)
        yield batch()

    return rebuilt


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends): the digest of the numbers of each node, from rows sorted by node and number."""
    import pyarrow as pa

    key = state = None
    for batch in batches:
        keys, ends = [], []
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k == key:
                state.update(b",%d" % c)
                continue
            if key is not None:
                keys.append(key)
                ends.append(state.digest())
            key, state = k, hashlib.sha256(b"%d" % c)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ends, pa.binary())], names=["key", "ends"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.digest()])], names=["key", "ends"])


def _laid_out(key, nodes):
    """One stored trie of all nodes of a group. A node whose parent is not among them is a top."""
    import numpy as np
    import pyarrow as pa

    n = nodes.num_rows
    nodes = nodes.sort_by("key")  # labels of siblings in order
    keys = np.frombuffer(b"".join(nodes.column("key").to_pylist()), dtype=">u8").reshape(n, 2)
    up = np.frombuffer(b"".join(x or ROOT for x in nodes.column("parent").to_pylist()), dtype=">u8").reshape(n, 2)
    number = np.unique(np.concatenate([keys, up]), axis=0, return_inverse=True)[1].ravel()
    place = np.full(number.max() + 1, -1)
    place[number[:n]] = np.arange(n)
    parents = place[number[n:]]
    parents[parents == np.arange(n)] = -1  # the root has no parent, and its own key stands there
    order = level_order(parents)
    at = np.empty(n, dtype=np.int64)
    at[order] = np.arange(n)
    above = parents[order]
    above = np.where(above < 0, -1, at[above])
    tops = order[above < 0]
    column = lambda c: np.asarray(nodes.column(c).to_numpy(), dtype="<i8")[order].tobytes()
    some = lambda c, which: b"".join(nodes.column(c).take(pa.array(which)).to_pylist())
    below = np.stack([np.asarray(nodes.column(c).to_numpy(), dtype="<i8") for c in ("b_children", "b_leaves", "b_saved")], axis=1)[order]
    row = {
        "shard": key[0].as_py(),
        "n": n,
        "bits": Louds.of_parents(above).packed(),
        "labels": some("key", order),
        "parents": up[tops].tobytes(),
        "depths": np.asarray(nodes.column("depth").to_numpy(), dtype="<i8")[tops].tobytes(),
        "conv_ids": column("conv_id"),
        "n_convs": column("n_convs"),
        "bytes": column("bytes"),
        "ends": some("ends", order),
        "below": below.tobytes() if below.any() else b"",
    }
    types = [pa.int64(), pa.int32(), *[pa.binary()] * 9]
    return pa.Table.from_arrays([pa.array([row[c]], t) for c, t in zip(_names(TRIES), types, strict=True)], names=_names(TRIES))


def _rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of stored tries with the sums of their subtrees; tops have their parent's key, and no parent's number."""
    import numpy as np
    import pyarrow as pa

    empty = NOTHING.hex()
    for batch in batches:
        for t in batch.to_pylist():
            n = t["n"]
            trie = Louds.unpacked(t["bits"], n)
            parents, levels = trie.parents(), trie.levels()
            conv, convs, size = (np.frombuffer(t[c], dtype="<i8") for c in ("conv_ids", "n_convs", "bytes"))
            below = np.frombuffer(t["below"], dtype="<i8").reshape(n, 3) if t["below"] else np.zeros((n, 3), dtype=np.int64)
            children = trie.degrees() + below[:, 0]
            leaves = (children == 0) + below[:, 1]
            saved = (convs - 1) * size + below[:, 2]
            depth = np.zeros(n, dtype=np.int64)
            tops = len(trie.children(-1))
            depth[:tops] = np.frombuffer(t["depths"], dtype="<i8")
            for a, b in levels[1:]:
                depth[a:b] = depth[parents[a:b]] + 1
            for a, b in reversed(levels[1:]):
                np.add.at(leaves, parents[a:b], leaves[a:b])
                np.add.at(saved, parents[a:b], saved[a:b])
            labels, ends, above = t["labels"], t["ends"], t["parents"]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([labels[16 * i : 16 * i + 16] for i in range(n)], pa.binary()),
                    pa.array([above[16 * i : 16 * i + 16] if i < tops else None for i in range(n)], pa.binary()),
                    pa.array(depth),
                    pa.array(conv),
                    pa.array(np.where(parents < 0, 0, conv[parents]), mask=parents < 0),
                    pa.array(convs),
                    pa.array(children),
                    pa.array(leaves),
                    pa.array(saved),
                    pa.array([empty if (e := ends[32 * i : 32 * i + 32]) == NOTHING else e.hex() for i in range(n)]),
                ],
                names=_names(ROLLED),
            )


class PrefixTrie:
    """Stored tries of a table of conversations, and the nodes with their sums."""

    def __init__(self, conversations: DataFrame):
        """``conversations`` have conv_id, turn, role and text; see :func:`conversation_nodes`."""
        self.spark = conversations.sparkSession
        self.scratch = Scratch(self.spark, "trie")
        labels = self.scratch.table(turn_labels(conversations), "labels")
        in_order = labels.repartition("family").sortWithinPartitions("family", "conv_id", F.col("turn").asc_nulls_first(), "label")
        # at most 8 turns more than its own and a start for each conversation
        limit = max(LEAST_HEAVY, -(-10 * labels.count() // MOST_HEAVY))
        counts = in_order.mapInArrow(_rebuilt(frozenset()), TURNS).groupBy("key").count()
        heavy = frozenset({ROOT, *(bytes(r.key) for r in counts.filter(F.col("count") > limit).select("key").collect())})
        turns = self.scratch.table(in_order.mapInArrow(_rebuilt(heavy), TURNS), "turns")
        ends = turns.filter("end").select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
        same = {c: F.first(c).alias(c) for c in ("parent", "depth", "bytes", "top")}
        nodes = turns.groupBy("key").agg(*same.values(), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
        nodes = nodes.join(ends.mapInArrow(_ended, "key binary, ends binary"), "key", "left")
        band = F.expr(f"(depth - 1) div {BAND}")
        self.table = self.scratch.table(nodes.withColumns({"ends": F.coalesce("ends", F.lit(bytearray(NOTHING))), "band": band}), "nodes")
        self.heavy = self.table.filter("top IS NULL" if heavy else "false")
        sizes = self.table.agg(F.count("top"), F.max(F.when(F.col("top").isNotNull(), F.col("band")))).first()
        self.shards, self.bands = max(1, -(-sizes[0] // SHARD_NODES)), 0 if sizes[1] is None else sizes[1] + 1
        self._n = count()

    @staticmethod
    def _with(nodes: DataFrame, below: DataFrame | None) -> DataFrame:
        """Nodes with what the tops below them hand on."""
        names = ("b_children", "b_leaves", "b_saved")
        if below is None:
            return nodes.withColumns({c: F.lit(0).cast("long") for c in names})
        sums = below.groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)), F.sum("n_leaves"), F.sum("saved_tokens")).toDF("key", *names)
        return nodes.join(sums, "key", "left").fillna(0, list(names))

    def _tries(self, nodes: DataFrame, shard, below: DataFrame | None) -> DataFrame:
        dealt = self._with(nodes, below).withColumn("shard", shard).drop("top", "band")
        return self.scratch.table(dealt.groupBy("shard").applyInArrow(_laid_out, TRIES), f"tries-{next(self._n)}")

    def _rolled(self, tries: DataFrame) -> DataFrame:
        return self.scratch.table(tries.mapInArrow(_rolled, ROLLED), f"rolled-{next(self._n)}")

    def nodes(self) -> tuple[DataFrame, DataFrame]:
        """(all nodes, all stored tries)."""
        handed: DataFrame | None = None
        rolled, tries = [], []
        for b in reversed(range(self.bands)):
            shard = F.pmod(F.xxhash64("top"), F.lit(self.shards))
            here = self._tries(self.table.filter((F.col("band") == b) & F.col("top").isNotNull()), shard, handed)
            made = self._rolled(here)
            tops = made.filter("parent IS NOT NULL")
            # the parent of a top is heavy, or the last of the band before
            above = F.broadcast(self.heavy) if b == 0 else self.table.filter((F.col("band") == b - 1) | F.col("top").isNull())
            known = above.select(F.col("key").alias("parent"), F.col("conv_id").alias("up"))
            rolled.append(tops.join(known, "parent", "left").withColumn("parent_conv_id", F.col("up")).select(*made.columns))
            rolled.append(made.filter("parent IS NULL"))
            handed = tops if handed is None else handed.unionByName(tops)
            tries.append(here)
        tries.append(self._tries(self.heavy, F.lit(-1).cast("long"), handed))
        rolled.append(self._rolled(tries[-1]))
        for k, parts in enumerate((rolled, tries)):
            whole = parts[0]
            for more in parts[1:]:
                whole = whole.unionByName(more)
            (rolled, tries)[k][:] = [whole]
        return rolled[0], tries[0]


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row for each node.

    Each conversation c starts with the first h turns of conversation c - c % 5, h = crc32(c) % 9, and
    goes on with its own turns after the first h. Turns are ordered by ``turn``, null first; equal ones
    by the md5 of their role's bytes, ":", role and text. A null role or text is an empty one; rows
    without a conversation are left out; repeated rows are turns each; c % 5 is never negative. A
    conversation without turns belongs to the root. Other columns are left out; an empty table has no
    nodes.
    """
    nodes, _ = PrefixTrie(conversations.select("conv_id", "turn", "role", "text")).nodes()
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
