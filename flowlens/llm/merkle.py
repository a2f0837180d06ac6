"""Merkle manifest of a table: a hash tree a group, a tree of the groups' roots, proofs and their check.

Rows of a group are leaves in the order of their ids. ``2**height`` consecutive leaves are an aligned block; one task
builds the block's subtree and stores its digests in van Emde Boas order: the tree is split at half its height, the upper
part comes first, then the lower parts one after the other, each laid out in the same way, so a path from leaf to root
touches few stretches of memory of any size. ``Layout`` gives the place of a node; the same addresses serve the building
and the reading of siblings. Block roots are the leaves of the next level's blocks, until each group has one root; the
groups' roots, in the order of the groups, are leaves again.

Nulls and odd rows: null values are hashed as ``-``; the null group comes first, null ids come first in their group. Rows
with one id are ordered by their digest, so repeated rows are leaves next to each other. A null text and an empty text
differ. An empty table gives an empty result. Only the five named columns are read, so other columns change nothing.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlens.session import materialize

HEIGHT = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


class Layout:
    """Van Emde Boas places of the nodes of a full tree with ``levels`` levels of nodes."""

    def __init__(self, levels: int):
        self.levels, self.size = levels, (1 << levels) - 1

    def place(self, depth: int, index: np.ndarray) -> np.ndarray:
        """Places of the nodes ``index`` (counted from the left) at ``depth`` (0: the root)."""
        index, levels = np.asarray(index, np.int64), self.levels
        place = np.zeros_like(index)
        while levels > 1:
            upper = levels // 2
            if depth < upper:
                levels = upper
                continue
            # skip the upper part and the lower parts to the left, go on inside the own one
            below = depth - upper
            levels -= upper
            place += (1 << upper) - 1 + (index >> below) * ((1 << levels) - 1)
            index, depth = index & ((1 << below) - 1), below
        return place


class Subtree:
    """Digests of an aligned block: ``count`` leaves below a root ``height`` levels up, in a van Emde Boas array.

    Two neighbours become their hash; a node without a right neighbour becomes the hash of itself alone.
    """

    def __init__(self, cells: np.ndarray, count: int, height: int):
        self.cells, self.count, self.height = cells, count, height
        self.layout = Layout(height + 1)

    @classmethod
    def build(cls, leaves: list[str], height: int) -> Subtree:
        tree = cls(np.zeros(Layout(height + 1).size, "V32"), len(leaves), height)
        row = leaves
        for level in range(height + 1):
            places = tree.layout.place(height - level, np.arange(len(row)))
            tree.cells[places] = np.frombuffer(bytes.fromhex("".join(row)), "V32")
            row = [h("".join(row[i:i + 2])) for i in range(0, len(row), 2)]
        return tree

    def node(self, level: int, index: int) -> str:
        return self.cells[int(self.layout.place(self.height - level, index))].tobytes().hex()

    def leaf(self, index: int) -> str:
        return self.node(0, index)

    def paths(self, leaves: list[int]) -> list[str]:
        """The way up from each leaf: for each level ``L`` or ``R``, the sibling's side, and its digest; ``-`` without one."""
        leaves = np.asarray(leaves, np.int64)
        steps = []
        for level in range(self.height):
            other = (leaves >> level) ^ 1
            there = other < (self.count + (1 << level) - 1) >> level
            found = self.cells[self.layout.place(self.height - level, np.where(there, other, 0))]
            sides = np.where(there, np.where(other & 1, "R", "L"), "-").tolist()
            steps.append([s if s == "-" else s + c.tobytes().hex() for s, c in zip(sides, found, strict=True)])
        return ["".join(x) for x in zip(*steps, strict=True)] if steps else [""] * len(leaves)


def steps_of(path: str):
    """(side, digest) for each level of a path."""
    at = 0
    while at < len(path):
        alone = path[at] == "-"
        yield path[at], "" if alone else path[at + 1:at + 65]
        at += 1 if alone else 65


def fold(leaf: str, path: str) -> str:
    for side, sibling in steps_of(path):
        leaf = h(sibling + leaf if side == "L" else leaf + sibling)
    return leaf


def siblings(path: str) -> str:
    return "".join(sibling for _, sibling in steps_of(path))


def field_text(column):
    """Byte count, colon, value; a null is ``-``."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**changed):
    """SHA-256 of a row's five fields, with some of them replaced."""
    return F.sha2(F.concat(*[field_text(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def place_leaves(leaves):
    """Adds ``pos``, the place within the group, and ``total``, the group's rows; written to the shared folder.

    Rows are range partitioned by group, id and digest, so no group, id or repeated row must fit one task.
    """
    order = [F.col("g"), F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("deal")]
    dealt = materialize(leaves.withColumn("deal", F.xxhash64(F.monotonically_increasing_id())), "leaves")
    ranged = dealt.repartitionByRange(*order).sortWithinPartitions(*order).drop("deal")
    rows = materialize(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "sorted-leaves")
    parts = rows.groupBy("g", "part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    earlier = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "g", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("g")).alias("total"),
    )
    return rows.join(parts, ["g", "part"]).select(
        "g", "doc_id", "digest", "claim", (F.col("row") - F.col("first") + F.col("before")).alias("pos"), "total"
    )


BLOCK_TYPES = "g string, block long, count int, height int, cells binary, root string, total long"


def build_blocks(nodes, height: int, name: str):
    """One written row for each block of (g, pos, digest, total): its subtree and its root."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        g, block, total = (table.column(c)[0].as_py() for c in ("g", "block", "total"))
        own = height if total > 1 << height else (total - 1).bit_length()
        tree = Subtree.build(table.column("digest").to_pylist(), own)
        return pa.table({
            "g": [g], "block": [block], "count": pa.array([tree.count], pa.int32()), "height": pa.array([own], pa.int32()),
            "cells": [tree.cells.tobytes()], "root": [tree.node(own, 0)], "total": [(total + (1 << height) - 1) >> height],
        })

    dealt = nodes.select("g", F.shiftright("pos", height).alias("block"), "pos", "digest", "total")
    return materialize(dealt.groupBy("g", "block").applyInArrow(build, BLOCK_TYPES), name)


def climb(nodes, height: int):
    """Blocks of every level, the lowest first; the last level has one block a group. None for no nodes."""
    levels = []
    while True:
        blocks = build_blocks(nodes, height, f"subtrees-{len(levels)}")
        most = blocks.agg(F.max("total")).first()[0]
        levels.append(blocks)
        if most is None or most == 1:
            return levels
        nodes = blocks.select("g", F.col("block").alias("pos"), F.col("root").alias("digest"), "total")


def tree_of(cells: bytes, count: int, height: int) -> Subtree:
    return Subtree(np.frombuffer(cells, "V32"), count, height)


PATH_TYPES = "g string, block long, path string, subroot string, root string"


def with_paths(blocks, above):
    """Blocks beside the path and the roots above them."""
    return blocks.select("g", "block", "count", "height", "cells").join(above, ["g", "block"])


def descend(blocks, above, height: int):
    """Path and roots of every member of ``blocks``, given those of the blocks (g, block, path, subroot, root)."""

    def serve(parts):
        for part in parts:
            for at in range(part.num_rows):
                r = part.slice(at, 1).to_pylist()[0]
                first, n = r["block"] << height, r["count"]
                paths = tree_of(r["cells"], n, r["height"]).paths(range(n))
                yield pa.RecordBatch.from_pydict({
                    "g": [r["g"]] * n, "block": list(range(first, first + n)), "path": [p + r["path"] for p in paths],
                    "subroot": [r["subroot"]] * n, "root": [r["root"]] * n,
                })

    return materialize(with_paths(blocks, above).mapInArrow(serve, PATH_TYPES), "paths")


PROOF_TYPES = ("doc_id long, leaf string, claim string, subroot string, root string, proof string, folded_root string, "
               "verified boolean")


def check_claims(placed, blocks, above, height: int):
    """A row for each leaf: its stored digest, siblings and roots, and the root that its claimed digest folds to."""

    def prove(leaves: pa.Table, found: pa.Table) -> pa.Table:
        r = found.to_pylist()[0]
        tree = tree_of(r["cells"], r["count"], r["height"])
        out = {c: [] for c in ("doc_id", "leaf", "claim", "subroot", "root", "proof", "folded_root", "verified")}
        ids, places, claims = (leaves.column(c).to_pylist() for c in ("doc_id", "pos", "claim"))
        places = [p & ((1 << height) - 1) for p in places]
        for doc_id, inside, path, claim in zip(ids, places, tree.paths(places), claims, strict=True):
            leaf, path = tree.leaf(inside), path + r["path"]
            folded = fold(claim or leaf, path)
            values = doc_id, leaf, claim or leaf, r["subroot"], r["root"], siblings(path), folded, folded == r["root"]
            for column, value in zip(out.values(), values, strict=True):
                column.append(value)
        return pa.table({**out, "doc_id": pa.array(out["doc_id"], pa.int64())})

    left = placed.select("g", F.shiftright("pos", height).alias("block"), "doc_id", "pos", "claim")
    right = with_paths(blocks, above)
    return left.groupBy("g", "block").cogroup(right.groupBy("g", "block")).applyInArrow(prove, PROOF_TYPES)


def manifest(docs, group: str = "lang", height: int = HEIGHT, **changed):
    """A row for each row of ``docs``: doc_id, leaf, claim, subroot, root, proof (siblings joined), folded_root, verified.

    ``changed`` gives columns in place of those of ``FIELDS``, as a reader claims them; without, rows claim themselves.
    """
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    digest, claim = leaf_digest(), leaf_digest(**changed) if changed else F.lit(None).cast("string")
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), g.alias("g"), digest.alias("digest"), claim.alias("claim"))
    placed = place_leaves(leaves.withColumn("claim", F.when(F.col("claim") != F.col("digest"), F.col("claim"))))
    levels = climb(placed, height)
    subroots = levels[-1].select(F.lit("").alias("g"), F.col("g").alias("doc_id"), F.col("root").alias("digest"), F.lit(None).cast("string").alias("claim"))
    tops = place_leaves(subroots)
    upper = climb(tops, height)
    root = upper[-1].agg(F.max("root")).first()[0]
    above = upper[-1].select("g", "block", F.lit("").alias("path"), F.lit("").alias("subroot"), F.lit(root).cast("string").alias("root"))
    for blocks in reversed(upper):
        above = descend(blocks, above, height)
    # the members of the upper tree are the groups
    groups = tops.select(F.col("doc_id").alias("name"), F.col("pos").alias("block"), F.col("digest").alias("own"))
    above = above.drop("g").join(groups, "block").select(
        F.col("name").alias("g"), F.lit(0).cast("long").alias("block"), "path", F.col("own").alias("subroot"), "root"
    )
    for blocks in reversed(levels[1:]):
        above = descend(blocks, above, height)
    return check_claims(placed, levels[0], above, height)
