"""A Merkle manifest of a dataset by time-forward processing.

Each row is a leaf; the leaves of a group (a language), in the order of their ids, make a
tree, and the trees' roots, in the order of their groups, make the tree of the dataset. In
a tree ``arity`` consecutive nodes at a time become one, the last run of a level with fewer,
until one node remains.

Time-forward processing visits the nodes of such a tree in the order of labels in which
children come before parents (by the last leaf under a node, then by level) and hands each
digest on as a message to the parent's label. A priority queue ordered by label gives a node
its messages when its time comes. The queue is external: leaves are placed by a range sort
and cut into blocks of ``arity ** levels`` consecutive ones; within a block the messages go through a
heap that holds no more than a path's, and a block's top digest is a message to the next
tier, which Spark's sort-based shuffle delivers in the order of labels. With blocks of 4,096
nodes three tiers hold 68 thousand million leaves; a group of any size is many blocks.

A second sweep runs the other way, from the root down: a node gets the proof suffix that
belongs to it (the siblings from its own level to the root) and hands each child that
suffix with the child's own siblings in front. Leaves end up with whole proofs.

Digests are SHA-256 over the inputs as text, one behind the other, digests as lowercase hex.

Defined results: null fields are written ``-``; rows with a null id come before all others of
their group, rows with equal ids in the order of their leaves; a null group comes before all
others; a lone leaf is its group's root and has no siblings there; an empty table gives an
empty table; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

ARITY = 2
#: Levels of a block; with two children a node, a block has 4,096 nodes at its foot.
LEVELS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Sibling = tuple[int, tuple[bytes, ...]]  # a node's place in its run, and the digests of the others


def digest(parts: list[bytes] | tuple[bytes, ...]) -> bytes:
    return sha256("".join(p.hex() for p in parts).encode()).digest()


def fold(leaf: bytes, siblings: list[Sibling]) -> bytes:
    """The root that a leaf and its siblings, level by level, lead to."""
    for place, others in siblings:
        leaf = digest((*others[:place], leaf, *others[place:]))
    return leaf


def packed(siblings: list[Sibling]) -> bytes:
    return b"".join(bytes((place, len(others))) + b"".join(others) for place, others in siblings)


def unpacked(data: bytes) -> list[Sibling]:
    found, at = [], 0
    while at < len(data):
        place, n = data[at], data[at + 1]
        found.append((place, tuple(data[at + 2 + 32 * k : at + 34 + 32 * k] for k in range(n))))
        at += 2 + 32 * n
    return found


def rise(nodes: list[bytes], levels: int, arity: int, to_one: bool = False) -> list[list[bytes]]:
    """The digests of a block, level by level: time-forward, with a heap of messages (label of the parent, place, digest).

    The label of a node is (last node at the foot under it, level). ``to_one``: the block is a
    whole tree and ends as soon as one node remains; other blocks have all their levels.
    """
    widths = [len(nodes)]
    while len(widths) <= levels and not (to_one and widths[-1] == 1):
        widths.append(-(-widths[-1] // arity))
    made: list[list[bytes]] = [[] for _ in widths]
    queue: list[tuple[int, int, int, bytes]] = []

    def send(level: int, place: int, value: bytes) -> None:
        made[level].append(value)
        if level + 1 < len(widths):
            span = arity ** (level + 1)
            heapq.heappush(queue, (min((place // arity + 1) * span, len(nodes)), level + 1, place, value))

    for k, leaf in enumerate(nodes):
        send(0, k, leaf)
        while queue and queue[0][0] <= k + 1:
            last, level = queue[0][:2]
            inbox = []
            while queue and queue[0][:2] == (last, level):
                inbox.append(heapq.heappop(queue))
            send(level, inbox[0][2] // arity, digest([m[3] for m in inbox]))
    return made


def sink(made: list[list[bytes]], suffix: list[Sibling], arity: int) -> Iterator[list[Sibling]]:
    """The proof of each node at the foot, last one first: the sweep in the reverse order of labels."""
    foot = len(made[0])
    top = len(made) - 1
    queue: list[tuple[int, int, int, list[Sibling]]] = []

    def send(level: int, place: int, proof: list[Sibling]) -> None:
        last = min((place + 1) * arity**level, foot)
        heapq.heappush(queue, (-last, -level, place, proof))

    for place in range(len(made[top])):
        send(top, place, suffix)
    while queue:
        _, level, place, proof = heapq.heappop(queue)
        if not level:
            yield proof
            continue
        run = made[-level - 1][place * arity : (place + 1) * arity]
        for k in range(len(run)):
            send(-level - 1, place * arity + k, [(k, (*run[:k], *run[k + 1 :])), *proof])


def field(value: Column) -> Column:
    """A field of a leaf: ``-`` if null, else its length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _leaf(columns: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, columns)), 256))


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` (tree, ...) with ``at``: the place in the tree by ``order``, and ``n``: the tree's number of nodes.

    The nodes of a tree spread over many tasks: they are sorted by ranges, counted in each
    range, and numbered from the counts of the ranges before.
    """
    ranged = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    rows = written(ranged.withColumn("_row", F.monotonically_increasing_id()), "placed").withColumn("_part", F.shiftright("_row", 33))
    counts = rows.groupBy("tree", "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_count"))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("tree", "_part", "_first", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before"), F.sum("_count").over(Window.partitionBy("tree")).alias("n"))
    return rows.join(counts, ["tree", "_part"]).withColumn("at", F.col("_before") + F.col("_row") - F.col("_first")).drop("_row", "_part", "_first", "_before")


UP = "tree string, at long, n long, digest binary"


def _groups(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Runs of rows with equal first two values."""
    run: list[tuple] = []
    for row in rows:
        if run and run[0][:2] != row[:2]:
            yield run
            run = []
        run.append(row)
    if run:
        yield run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _out(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema)


def _up(batches: Iterator[pa.RecordBatch], arity: int, levels: int) -> Iterator[pa.RecordBatch]:
    """Rows (tree, block, at, n, digest) in order; a block's top node each."""
    schema = pa.schema([("tree", pa.string()), ("at", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])
    size, found = arity**levels, []
    for run in _groups(_rows(batches)):
        tree, block, _, n = run[0][:4]
        top = rise([r[4] for r in run], levels, arity, n <= size)[-1][0]
        found.append((tree, block, -(-n // size), top))
    yield _out(found, schema)


def _blocks(nodes: DataFrame, size: int, *more: str) -> DataFrame:
    """Delivers a tier's nodes to their blocks, in the order of their labels."""
    block = F.floor(F.col("at") / size).cast("long")
    return nodes.select("tree", block.alias("block"), "at", "n", "digest", *more).repartition("tree", "block").sortWithinPartitions("tree", "block", "at")


def tiers(nodes: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> list[DataFrame]:
    """The nodes (tree, at, n, digest) at the foot of each tier; the last has the trees' roots, one each."""
    size = arity**levels
    most = nodes.agg(F.max("n")).first()[0] or 0
    found = [nodes]
    while most > 1:
        risen = _blocks(found[-1], size).mapInArrow(lambda batches: _up(batches, arity, levels), UP)
        found.append(written(risen, "tier"))
        most = -(-most // size)
    return found


def _down(batches: Iterator[pa.RecordBatch], arity: int, levels: int) -> Iterator[pa.RecordBatch]:
    """Rows (tree, block, at, n, digest, suffix); the first of each block (at -1) brings the block's suffix. (tree, at, suffix) of each node."""
    schema = pa.schema([("tree", pa.string()), ("at", pa.int64()), ("suffix", pa.binary())])
    for run in _groups(_rows(batches)):
        tree, block = run[0][:2]
        suffix, nodes = unpacked(run[0][5]), run[1:]
        made = rise([r[4] for r in nodes], levels, arity, nodes[0][3] <= arity**levels)
        yield _out([(tree, r[2], packed(p)) for r, p in zip(reversed(nodes), sink(made, suffix, arity))], schema)


def _with_suffixes(nodes: DataFrame, suffixes: DataFrame, size: int, *more: str) -> DataFrame:
    """The blocks of a tier, each with its suffix (tree, at: the block, suffix) in front."""
    here = nodes.select("tree", "at", "n", "digest", F.lit(None).cast("binary").alias("suffix"), *(c for c in more if c in nodes.columns))
    block = F.when(F.col("suffix").isNull(), F.floor(F.col("at") / size).cast("long")).otherwise(F.col("at"))
    return (
        here.unionByName(suffixes, allowMissingColumns=True)
        .select("tree", block.alias("block"), F.when(F.col("suffix").isNull(), F.col("at")).otherwise(F.lit(-1)).alias("at"), "n", "digest", "suffix", *more)
        .repartition("tree", "block").sortWithinPartitions("tree", "block", "at")
    )


def suffixes(found: list[DataFrame], roots: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """(tree, at, suffix) for the blocks at the foot: the reversed sweep over the tiers above. ``roots`` has it for the trees' roots."""
    told = roots
    for nodes in reversed(found[1:-1]):
        told = _with_suffixes(nodes, told, arity**levels).mapInArrow(lambda batches: _down(batches, arity, levels), "tree string, at long, suffix binary")
    return told


def _proofs(batches: Iterator[pa.RecordBatch], arity: int, levels: int) -> Iterator[pa.RecordBatch]:
    """Rows of leaves as in ``_down``, with their ids, tampered leaves, and the roots in a block's first row."""
    first = next(batches, None)
    if first is None:
        return
    text = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    schema = pa.schema([("doc_id", first.schema.field("id").type), *((c, pa.string()) for c in text), ("verified", pa.bool_()), ("proof", pa.binary())])
    for run in _groups(_rows(chain([first], batches))):
        head, nodes = run[0], run[1:]
        suffix, subroot, root = unpacked(head[5]), head[8], head[9]
        leaves = [r[4] for r in nodes]
        made = rise(leaves, levels, arity, nodes[0][3] <= arity**levels)
        found = []
        for r, proof in zip(reversed(nodes), sink(made, suffix, arity)):
            siblings = "".join(s.hex() for _, others in proof for s in others)
            folded = fold(r[7] or r[4], proof)
            found.append((r[6], r[4].hex(), subroot.hex(), root.hex(), sha256(siblings.encode()).hexdigest(), folded.hex(), folded == root, packed(proof)))
        yield _out(found, schema)


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, proof) of each row.

    ``tampered`` has columns that stand for those of ``fields`` when the proofs are checked:
    ``folded_root`` is what the leaf made of them and the proof lead to, ``verified`` whether
    that is the root. ``proof`` holds for each level the place in the run, the number of
    siblings and their digests (``unpacked`` reads it).
    """
    here = [F.col(c) for c in fields]
    leaf, other = _leaf(here), _leaf([(tampered or {}).get(c, F.col(c)) for c in fields])
    tree = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("-"))  # null before all others
    leaves = docs.select(tree.alias("tree"), F.col(id_col).alias("id"), leaf.alias("digest"), (F.when(other != leaf, other) if tampered else F.lit(None).cast("binary")).alias("other"))
    foot = written(placed(written(leaves, "leaves"), ["id", "digest"]), "foot")
    found = tiers(foot.select("tree", "at", "n", "digest"), arity, levels)
    tops = found[-1] if len(found) > 1 else foot  # one node a tree
    groups = written(placed(tops.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest"), ["group"]), "groups")
    above = tiers(groups.select("tree", "at", "n", "digest"), arity, levels)
    root = above[-1].select(F.lit("").alias("tree"), F.lit(0).cast("long").alias("at"), F.lit(b"").alias("suffix"))
    size = arity**levels
    # the root's suffix is empty; the groups' follow from it, and from theirs those of the blocks of leaves
    if len(above) > 1:
        down = _with_suffixes(groups.select("tree", "at", "n", "digest"), suffixes(above, root, arity, levels), size)
        root = down.mapInArrow(lambda batches: _down(batches, arity, levels), "tree string, at long, suffix binary")
    named = written(groups.select("tree", "at", "group").join(root, ["tree", "at"]).select(F.col("group").alias("tree"), F.lit(0).cast("long").alias("at"), "suffix"), "suffixes")
    blocks = suffixes(found, named, arity, levels)
    top = above[-1].first()  # the only row
    both = tops.select("tree", F.col("digest").alias("subroot"), F.lit(bytes(top.digest) if top else None).cast("binary").alias("root"))
    told = written(blocks.join(both, "tree"), "block-suffixes")
    id_type = docs.schema[id_col].dataType.simpleString()
    out = f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, proof binary"
    whole = _with_suffixes(foot, told, size, "id", "other", "subroot", "root")
    return whole.mapInArrow(lambda batches: _proofs(batches, arity, levels), out)
