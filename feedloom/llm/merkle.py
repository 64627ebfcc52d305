"""Operator 13, Merkle manifest of a data set in van Emde Boas layout.

Every row is a leaf: the SHA-256 of its fields, each as its UTF-8 byte count, a colon and its value, or ``-`` if null.
Leaves of a source ascend by doc_id; every three consecutive nodes (fewer in a level's last run) become the hash
of their digests' hexadecimal text, up to the source's root, and sources, in their order, likewise make the root of all.

A source's tree is cut into aligned subtrees of ``HEIGHT`` levels of edges, 6,561 leaves each, so no task holds
more of a source than that, however large it is. The roots of these blocks are the leaves of the next layer, cut
the same way, until a source has one block left. A block keeps its digests in van Emde Boas order: the upper half of its levels first, then
each subtree hanging from it, every one of them laid out so itself. ``address`` computes a node's place from its
depth and its number there; building a block and finding a leaf's siblings both go by it. The path from
a leaf to its root thus lies in few runs of bytes at any size of cache or page, which no parameter names.

A proof is a list of steps from the leaf to the root of all: the digests left and right of the path in its run.
Proofs are made block by block: steps inside the block, then those of its root in the next layer, which are the
same for all its leaves.

Shuffles: one by range to place the leaves (id, source and digests only, no text), one to the blocks when built and one when proofs are made.

Defined cases: null fields as above; a null source is a source of its own and comes first; rows with equal doc_id in a source
stand in the order of their digests, equal rows in any; null ids come first; a lone leaf is its source's root, a lone source's root
the root of all, and their proof is the hash of nothing if both hold; an empty table gives no rows; other columns don't count.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.llm.common import by_size, small_batches
from feedloom.session import durable

ARITY = 3
#: Levels of edges in a stored subtree: 3 ** 8 leaves, 9,841 digests, 315 kB.
HEIGHT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left: string, right: string>>"
#: Bits of ``monotonically_increasing_id`` that number the rows of a partition.
ROW_BITS = 33


def n_nodes(levels: int) -> int:
    """Nodes of a full tree of so many levels."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes number ``index`` (from the left) of a depth in a full tree of ``levels`` levels."""
    if levels == 1:
        return np.zeros_like(index)
    upper = levels // 2
    if depth < upper:
        return address(upper, depth, index)
    lower, width = levels - upper, ARITY ** (depth - upper)
    return n_nodes(upper) + index // width * n_nodes(lower) + address(lower, depth - upper, index % width)


@functools.lru_cache(256)
def _addresses(levels: int, depth: int) -> np.ndarray:
    return address(levels, depth, np.arange(ARITY**depth))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Subtree:
    """An aligned subtree: ``n`` leaves of a full tree of ``levels`` levels, digests in van Emde Boas order.

    Places without a node hold zeros; they exist in the last block of a source only.
    """

    def __init__(self, levels: int, n: int, nodes: bytes | bytearray):
        self.levels, self.n = levels, n
        self.nodes = np.frombuffer(nodes, np.uint8).reshape(-1, 32)

    @classmethod
    def build(cls, leaves: list[str], levels: int) -> Subtree:
        tree = cls(levels, len(leaves), bytearray(32 * n_nodes(levels)))
        below = "".join(leaves)
        for depth in range(levels - 1, -1, -1):
            own = np.frombuffer(bytes.fromhex(below), np.uint8).reshape(-1, 32)
            tree.nodes[_addresses(levels, depth)[: len(own)]] = own
            run = 64 * ARITY
            below = "".join([digest(below[at : at + run]) for at in range(0, len(below), run)])
        return tree

    def width(self, depth: int) -> int:
        """Nodes of a depth."""
        return -(-self.n // ARITY ** (self.levels - 1 - depth))

    def level(self, depth: int) -> str:
        """The digests of a depth from left to right, as hexadecimal text."""
        return self.nodes[_addresses(self.levels, depth)[: self.width(depth)]].tobytes().hex()

    @property
    def root(self) -> str:
        return self.nodes[0].tobytes().hex()

    def steps(self, leaf: int) -> list[tuple[str, str]]:
        """Siblings left and right of the path from one leaf up; only their digests are read."""
        out, index = [], leaf
        for depth in range(self.levels - 1, 0, -1):
            first = index // ARITY * ARITY
            run = np.arange(first, min(first + ARITY, self.width(depth)))
            text = self.nodes[address(self.levels, depth, run)].tobytes().hex()
            own = (index - first) * 64
            out.append((text[:own], text[own + 64 :]))
            index //= ARITY
        return out

    def all_steps(self) -> tuple[list[list[str]], list[list[str]]]:
        """Left and right siblings of all paths: for each level from the leaves up, those of each leaf."""
        left, right = [], []
        for up, depth in enumerate(range(self.levels - 1, 0, -1)):
            text, width = self.level(depth), self.width(depth)
            lefts, rights = [], []
            for i in range(width):
                first = i - i % ARITY
                lefts.append(text[first * 64 : i * 64])
                rights.append(text[(i + 1) * 64 : (first + ARITY) * 64])
            span = ARITY**up
            left.append([lefts[i // span] for i in range(self.n)])
            right.append([rights[i // span] for i in range(self.n)])
        return left, right


def fold(leaf: str, steps: list[tuple[str, str]]) -> str:
    """The root that a leaf and the steps of its proof give."""
    for left, right in steps:
        leaf = digest(left + leaf + right)
    return leaf


def leaf_of(fields: dict[str, Column]) -> Column:
    """The leaf of a row with these fields."""

    def framed(value: Column) -> Column:
        text = value.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*[framed(fields[name]) for name in FIELDS]), 256)


def place(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (tree, ...) with ``pos``, their place in their tree in this order (from 0), and ``size``, the tree's rows.

    One shuffle by range, so a tree of any size spreads over all partitions; then one count for
    each tree and partition. Equal rows are dealt by their place in the input.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["tree", *order, "__spread"]
    ranged = durable(
        rows.withColumn("__spread", F.monotonically_increasing_id())
        .repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("__spread")
        .withColumn("__at", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftright("__at", ROW_BITS))
    )
    counts = ranged.groupBy("tree", "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "tree", "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"),
        F.sum("__n").over(tree).alias("size"),
    )
    return ranged.join(by_size(counts), ["tree", "__part"]).withColumn("pos", F.col("__at") + F.col("__shift")).select(
        *rows.columns, "pos", "size"
    )


def _levels(size: int, height: int) -> int:
    """Levels of a block of a tree of ``size`` leaves: full height if it isn't the only one."""
    levels = 1
    while levels <= height and ARITY ** (levels - 1) < size:
        levels += 1
    return levels


BLOCKS = "tree string, block long, size long, n int, levels int, root string, nodes binary"


def _blocks(leaves: DataFrame, height: int) -> DataFrame:
    """The subtrees over ``leaves`` (tree, pos, size, digest)."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        size = table.column("size")[0].as_py()
        tree = Subtree.build(table.column("digest").to_pylist(), _levels(size, height))
        return pa.table({
            "tree": table.column("tree").slice(0, 1), "block": table.column("block").slice(0, 1), "size": pa.array([size]),
            "n": pa.array([tree.n], pa.int32()), "levels": pa.array([tree.levels], pa.int32()),
            "root": pa.array([tree.root]), "nodes": pa.array([tree.nodes.tobytes()], pa.binary()),
        })

    return (
        leaves.select("tree", F.floor(F.col("pos") / ARITY**height).alias("block"), "pos", "size", "digest")
        .groupBy("tree", "block").applyInArrow(build, BLOCKS)
    )


@dataclass
class Layers:
    """A forest: the ``leaves`` (tree, pos, size, digest and what came with them) and the blocks of each layer."""

    leaves: DataFrame
    blocks: list[DataFrame]
    height: int

    def roots(self) -> DataFrame:
        """tree and root: of each tree the root of the only block of its last layer."""
        last = [b.where(F.col("size") <= ARITY**self.height).select("tree", "root") for b in self.blocks]
        return functools.reduce(DataFrame.unionAll, last)


def layers(leaves: DataFrame, height: int, folder: str | None = None) -> Layers:
    """Build all layers of the trees over ``leaves``; tables are written under ``folder`` or as scratch."""
    spark = leaves.sparkSession

    def keep(df: DataFrame, name: str) -> DataFrame:
        if folder is None:
            return durable(df)
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    leaves = keep(leaves, "leaves")
    blocks, own = [], leaves
    while True:
        blocks.append(keep(_blocks(own, height), f"layer{len(blocks)}"))
        # One row a block: each layer has 3 ** height times fewer of them.
        more = blocks[-1].where(F.col("size") > ARITY**height)
        if more.isEmpty():
            return Layers(leaves, blocks, height)
        own = more.select(
            "tree", F.col("block").alias("pos"), F.ceil(F.col("size") / ARITY**height).alias("size"), F.col("root").alias("digest")
        )


def _with_steps(nodes: DataFrame, blocks: DataFrame, height: int) -> DataFrame:
    """``nodes`` (tree, pos, ...) with ``steps``: those in their block, then the block's ``above``."""
    fields = [f for f in nodes.schema.fields if f.name != "__block"]
    names = [f.name for f in fields]

    def prove(rows: pa.Table, block: pa.Table) -> pa.Table:
        tree = Subtree(block.column("levels")[0].as_py(), block.column("n")[0].as_py(), block.column("nodes")[0].as_py())
        above = block.column("above")[0].as_py()
        first = block.column("__block")[0].as_py() * ARITY**height
        at = [p - first for p in rows.column("pos").to_pylist()]
        left, right = tree.all_steps()
        left += [[s["left"]] * tree.n for s in above]
        right += [[s["right"]] * tree.n for s in above]
        pairs = pa.StructArray.from_arrays(
            [pa.array([level[i] for i in at for level in side], pa.string()) for side in (left, right)], ["left", "right"]
        )
        ends = np.arange(len(at) + 1, dtype=np.int32) * np.int32(len(left))
        return pa.table([*[rows.column(n) for n in names], pa.ListArray.from_arrays(ends, pairs)], [*names, "steps"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", steps {STEPS}"
    nodes = nodes.withColumn("__block", F.floor(F.col("pos") / ARITY**height))
    blocks = blocks.select("tree", F.col("block").alias("__block"), "n", "levels", "nodes", "above")
    return nodes.groupBy("tree", "__block").cogroup(blocks.groupBy("tree", "__block")).applyInArrow(prove, schema)


def paths(forest: Layers, above: DataFrame | None = None) -> DataFrame:
    """The leaves with ``steps`` to their tree's root and on: ``above`` has (tree, above), the steps behind each root."""
    if above is None:
        above = forest.roots().select("tree", F.lit(None).cast(STEPS).alias("above"))
    none = F.array().cast(STEPS)
    upper: DataFrame | None = None
    for k in range(len(forest.blocks) - 1, -1, -1):
        only = F.col("size") <= ARITY**forest.height
        held = forest.blocks[k].where(only).join(by_size(above), "tree").withColumn("above", F.coalesce("above", none))
        if upper is not None:
            held = held.unionByName(forest.blocks[k].where(~only).join(by_size(upper), ["tree", "block"]))
        if not k:
            break
        roots = forest.blocks[k - 1].where(~only).select("tree", F.col("block").alias("pos"))
        upper = _with_steps(roots, held, forest.height).select("tree", F.col("pos").alias("block"), F.col("steps").alias("above"))
    return _with_steps(forest.leaves, held, forest.height)


@dataclass
class Manifest:
    """Trees of the sources, and the tree of their roots (its leaves: tree, pos, digest are one a source)."""

    sources: Layers
    top: Layers


def build(docs: DataFrame, folder: str | None = None, height: int = HEIGHT, claimed: Column | None = None) -> Manifest:
    """The manifest of ``docs``. Leaves carry doc_id and ``claimed``, a digest that a copy of the row claims (the leaf by default)."""
    leaf = leaf_of({c: F.col(c) for c in FIELDS})
    tree = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source").cast("string")))
    rows = docs.select(tree.alias("tree"), "doc_id", leaf.alias("digest"), (leaf if claimed is None else claimed).alias("claimed"))
    sources = layers(place(rows, "doc_id", "digest"), height, folder and f"{folder}/sources")
    roots = sources.roots().select(F.lit("").alias("tree"), F.col("tree").alias("source_tree"), F.col("root").alias("digest"))
    return Manifest(sources, layers(place(roots, "source_tree"), height, folder and f"{folder}/top"))


def proofs(manifest: Manifest) -> DataFrame:
    """doc_id, claimed, leaf, subroot, root and the ``steps`` from the leaf to the root of all."""
    top = durable(paths(manifest.top).join(by_size(manifest.top.roots()), "tree").select(
        F.col("source_tree").alias("tree"), F.col("digest").alias("subroot"), "root", F.col("steps").alias("above")
    ))
    found = paths(manifest.sources, top.select("tree", "above"))
    return found.join(by_size(top.select("tree", "subroot", "root")), "tree").select(
        "doc_id", "claimed", F.col("digest").alias("leaf"), "subroot", "root", "steps"
    )


def verify(proved: DataFrame) -> DataFrame:
    """Proofs with ``proof_sha256``, ``folded_root`` (from the claimed digest and the steps) and ``verified`` instead of the steps."""
    small_batches(proved.sparkSession)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = batch.column(5)
            ends = steps.offsets.to_pylist()
            left, right = (steps.values.field(i).to_pylist() for i in range(2))
            sums, folded = [], []
            for claimed, a, b in zip(batch.column(4).to_pylist(), ends, ends[1:], strict=False):
                sides = list(zip(left[a:b], right[a:b], strict=True))
                sums.append(digest("".join([x + y for x, y in sides])))
                folded.append(fold(claimed, sides))
            same = pa.array([x == y for x, y in zip(folded, batch.column(3).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(sums, pa.string()), pa.array(folded, pa.string()), same], names
            )

    return proved.select("doc_id", "leaf", "subroot", "root", "claimed", "steps").mapInArrow(
        run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )


def tampered() -> Column:
    """The leaf of a copy of the row that lost its line ends, where the checksum of the id is even; else the leaf."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    fields = {c: F.col(c) for c in FIELDS}
    return F.when(even, leaf_of({**fields, "text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))})).otherwise(leaf_of(fields))


def manifest_check(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Build the manifest, tamper with every other row, and verify all of them."""
    return verify(proofs(build(docs, folder, claimed=tampered())))


def open_manifest(spark: SparkSession, folder: str, height: int = HEIGHT) -> Manifest:
    """A manifest written by ``build``."""

    def forest(name: str) -> Layers:
        blocks = []
        while True:
            blocks.append(spark.read.schema(BLOCKS).parquet(f"{folder}/{name}/layer{len(blocks)}"))
            if blocks[-1].where(F.col("size") > ARITY**height).isEmpty():
                return Layers(spark.read.parquet(f"{folder}/{name}/leaves"), blocks, height)

    return Manifest(forest("sources"), forest("top"))
