"""Merkle manifest of a table: a digest tree per group, a tree over the groups,
and for every row the sibling digests that prove it.

The trees are built by time-forward processing. A node's label is (last leaf
under it, level), so a node comes after all that feed it. Every leaf is a message
to its parent's label; messages are taken in label order, and a node whose
messages are all there sends its own digest on to its parent. Spark's sorted
shuffle is the external part of the queue: leaves are dealt out in label order
as aligned blocks of ``2 ** BLOCK_BITS``, a block's messages pass through a heap
inside one task, and what leaves a block (one node) is a leaf of the next round.
Then the sweep runs the other way: rounds from the last to the first, labels from
the root down, and every node sends its proof suffix (the siblings from there to
the root), with the sibling's digest in front, to its children. Leaves receive
whole proofs.

A run of children that is not full (the last one of a level) becomes a digest
too: one child alone is hashed alone. A group of one leaf is that leaf.

Cases: null values of a field are written as ``-``; rows with a null group are a
group, first in order; within a group rows go by the order column (nulls first),
equal ones by their digest, so exact copies may change places; an empty table
gives no row and no root; long texts are hashed where they are read and never
shuffled; extra columns of the table take no part.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.operators.ranking import placed

from .frames import drop_written, written

#: leaves of a block: 2 ** this; a block's digests and proofs live in one task
BLOCK_BITS = 12
#: steps of a proof: the sibling is left or right of the path, or there is none
LEFT, RIGHT, ALONE = "L", "R", "-"


def field(c: Column) -> Column:
    """A value as ``<UTF-8 bytes>:<value>``, a null as ``-``."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def digest(*fields: Column) -> Column:
    """Lowercase hex sha256 of the fields' encodings, one after the other."""
    return F.sha2(F.concat(*[field(c) for c in fields]).cast("binary"), 256)


def _join(digests: Sequence[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def _levels(n: int) -> int:
    """Levels above ``n`` nodes: halvings (rounded up) until one is left."""
    return (n - 1).bit_length()


def forward(leaves: list[str], height: int) -> dict[tuple[int, int], list[str]]:
    """Digests that each node of a block received from its children.

    ``leaves``: digests of the block's leaves, ``height``: levels to build. The key of a node is its label (last leaf under
    it, level); the block's top is the only node of level ``height``."""
    last = len(leaves) - 1
    inbox: dict[tuple[int, int], list[str]] = {}

    def parent(leaf: int, level: int) -> tuple[int, int]:
        return min(leaf | ((1 << level + 1) - 1), last), level + 1

    # the queue holds (receiver's label, sender's label, digest): at most two messages a level
    queue: list[tuple[tuple[int, int], tuple[int, int], str]] = []
    for leaf, value in enumerate(leaves):
        if height:
            heapq.heappush(queue, (parent(leaf, 0), (leaf, 0), value))
        # a label that ends with this leaf has all its messages now
        while queue and queue[0][0][0] <= leaf:
            label = queue[0][0]
            got = []
            while queue and queue[0][0] == label:
                got.append(heapq.heappop(queue)[2])
            inbox[label] = got
            if label[1] < height:
                heapq.heappush(queue, (parent(label[0], label[1]), label, _join(got)))
    return inbox


def top(leaves: list[str], height: int) -> str:
    """Digest of the block's node of level ``height``."""
    if not height:
        return leaves[0]
    return _join(forward(leaves, height)[len(leaves) - 1, height])


def backward(leaves: list[str], height: int, suffix: list[str]) -> list[list[str]]:
    """Proofs of the block's leaves: every node, from the top label down, sends
    its suffix with the other child's digest in front to its children."""
    last = len(leaves) - 1
    inbox = forward(leaves, height)
    out: list[list[str]] = [[]] * len(leaves)
    queue = [(-last, -height, suffix)]
    while queue:
        end, level, proof = heapq.heappop(queue)
        end, level = -end, -level
        if level == 0:
            out[end] = proof
            continue
        got = inbox[end, level]
        # the left child's last leaf: the end of the node's first half
        half = 1 << level - 1
        first = end >> level << level
        if len(got) == 1:
            heapq.heappush(queue, (-end, 1 - level, [ALONE, *proof]))
        else:
            heapq.heappush(queue, (-(first + half - 1), 1 - level, [RIGHT + got[1], *proof]))
            heapq.heappush(queue, (-end, 1 - level, [LEFT + got[0], *proof]))
    return out


def _block_height(n: int, bits: int) -> int:
    """Levels of a block of a group that has ``n`` nodes in this round."""
    return min(bits, _levels(n))


def _by_block(df: DataFrame, schema: str, one: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """Apply ``one`` to the rows of each (grp, block) in the order of pos. A task
    holds one block at a time, whatever the Arrow batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for b in batches:
            grp, block = b["grp"].to_numpy(), b["block"].to_numpy()
            starts = np.flatnonzero((grp[1:] != grp[:-1]) | (block[1:] != block[:-1])) + 1
            for i, j in itertools.pairwise([0, *starts.tolist(), b.num_rows]):
                if j > i:
                    if held and key != (grp[i], block[i]):
                        yield one(pa.concat_batches(held))
                        held = []
                    key = grp[i], block[i]
                    held.append(b.slice(i, j - i))
        if held:
            yield one(pa.concat_batches(held))

    return df.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos").mapInArrow(run, schema)


def _up(nodes: DataFrame, bits: int) -> DataFrame:
    """One round: the blocks' top nodes as (grp, pos, n, digest)."""
    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        n = b["n"][0].as_py()
        row = {"grp": b["grp"][0].as_py(), "pos": b["block"][0].as_py(), "n": -(-n // (1 << bits)),
               "digest": top(b["digest"].to_pylist(), _block_height(n, bits))}
        return pa.RecordBatch.from_pylist([row])
    return _by_block(nodes.select("grp", "pos", "n", "digest", F.shiftright("pos", bits).alias("block")),
                     "grp long, pos long, n long, digest string", one)


def _down(nodes: DataFrame, messages: DataFrame, bits: int) -> DataFrame:
    """``nodes`` of a round with their proofs and the other columns of
    ``messages`` (grp, pos, proof and more): what the blocks were sent. A message
    travels with its block's rows, in front of them."""
    carried = [c for c in messages.columns if c not in ("grp", "pos", "proof")]
    kept = nodes.columns

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = b.slice(1)
        proofs = backward(rows["digest"].to_pylist(), _block_height(rows["n"][0].as_py(), bits), b["proof"][0].as_py())
        sent = [pa.array([b[c][0].as_py()] * rows.num_rows, b[c].type) for c in carried]
        return pa.RecordBatch.from_arrays([*[rows[c] for c in kept], pa.array(proofs, b["proof"].type), *sent],
                                          [*kept, "proof", *carried])

    sent = messages.withColumns({"block": F.col("pos"), "pos": F.lit(-1).cast("bigint")})
    both = nodes.withColumn("block", F.shiftright("pos", bits)).unionByName(sent, allowMissingColumns=True)
    schema = both.select(*kept, "proof", *carried).schema
    return _by_block(both, schema, one)


def trees(leaves: DataFrame, bits: int = BLOCK_BITS) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Trees over ``leaves`` (grp, pos, n, digest and more): the tops (grp,
    digest) and a function that takes messages for the tops (grp, pos 0, proof
    and more) down to the leaves. Rounds go on until every group is one node; a
    group that is one already stays as it is."""
    rounds = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        rounds.append(written(_up(rounds[-1], bits), "merkle-level"))
        most = -(-most // (1 << bits))

    def down(messages: DataFrame) -> DataFrame:
        names = [c for c in messages.columns if c not in ("grp", "pos", "proof")]
        # at least one round, so that the leaves' own columns come back with the proof
        for nodes in reversed(rounds[:-1] or rounds):
            messages = _down(nodes, messages.select("grp", "pos", "proof", *names), bits)
        return messages
    return rounds[-1].select("grp", "digest"), down


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf digest and a proof lead to."""
    def step(acc: Column, s: Column) -> Column:
        side, sibling = F.substring(s, 1, 1), F.substring(s, 2, 64)
        both = F.when(side == LEFT, F.concat(sibling, acc)).when(side == RIGHT, F.concat(acc, sibling)).otherwise(acc)
        return F.sha2(both.cast("binary"), 256)
    return F.aggregate(proof, leaf, step)


def siblings_digest(proof: Column) -> Column:
    """sha256 of the siblings of a proof, one after the other."""
    return F.sha2(F.concat_ws("", F.transform(proof, lambda s: F.substring(s, 2, 64))).cast("binary"), 256)


def manifest(docs: DataFrame, fields: Sequence[Column], group: Column, order: Column,
             keep: dict[str, Column] | None = None, bits: int = BLOCK_BITS) -> DataFrame:
    """One row a document: the ``keep`` columns, ``grp_value``, ``leaf`` (digest
    of ``fields``), ``subroot`` (of its group), ``root`` and ``proof`` (the steps
    from the leaf to the root). Groups are ordered by UTF-8 bytes, null first."""
    keep = keep or {}
    table = written(docs.select(*[c.alias(f"k_{k}") for k, c in keep.items()], group.cast("string").alias("g"),
                               order.alias("o"), digest(*fields).alias("digest")), "merkle-leaves")
    made = table.withColumn("tie", F.xxhash64("digest", *[f"k_{k}" for k in keep]))
    # numbers for the groups, in their order: one row a group
    groups = written(placed(made.select("g").distinct(), ["g"], rank="grp", count="groups"), "merkle-groups")
    at = placed(made, ["o", "digest", "tie"], by=["g"], rank="rank", count="n")
    at = at.withColumnRenamed("g", "gv").join(groups, F.col("gv").eqNullSafe(F.col("g")))
    leaves = written(at.select("grp", (F.col("rank") - 1).alias("pos"), "n", "digest", "gv", *[f"k_{k}" for k in keep]), "merkle-order")
    subroots, down = trees(leaves, bits)
    over = written(groups.join(subroots, "grp").select(F.lit(0).cast("bigint").alias("grp"), (F.col("grp") - 1).alias("pos"),
                                                       F.col("groups").alias("n"), "digest"), "merkle-subroots")
    root, fan = trees(over, bits)
    start = root.select("grp", F.lit(0).cast("bigint").alias("pos"), F.array().cast("array<string>").alias("proof"),
                        F.col("digest").alias("root"))
    ends = written(fan(start).select((F.col("pos") + 1).alias("grp"), F.lit(0).cast("bigint").alias("pos"), "proof",
                                     F.col("digest").alias("subroot"), "root"), "merkle-ends")
    drop_written(table)
    return down(ends).select(*[F.col(f"k_{k}").alias(k) for k in keep], F.col("gv").alias("grp_value"),
                             F.col("digest").alias("leaf"), "subroot", "root", "proof")
