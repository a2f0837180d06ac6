"""Softmax gradient boosting for many classes: one tree a class and round, grown level by level from histograms.

The features and label of the training rows are written once; weights, limits and bins come from that table. Values are put
into quantile bins once, one byte a feature, and rows lie in blocks of some kilobytes, feature by feature and class by class,
so that a table row, an Arrow cell and a step of array work are for many rows. In each level every task adds up gradients
and curvatures of its rows by (class, node, bins), so what is shuffled is one histogram a task, not rows; the summed
histograms give the best split of every node of every class at once. Features whose bins have few combinations share one
histogram, which is taken apart when the task ends. Margins are stored with the rows and written anew once a round, so a
round never replays earlier trees. Only splits, a few numbers a node, reach the driver.

A task holds ``classes * 2**(depth - 1) * features * bins`` pairs of doubles at the deepest level (5 MB for 15 classes,
10 features, 64 bins and depth 6; 137 MB for 70 features and depth 8), and up to ``SHARED_BYTES`` where features share
histograms. Bad and absent values count as 0.0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators.models import _safe, class_weights, model_input
from flowlens.session import Scratch

#: features of one histogram row
FEATURE_BLOCK = 8
#: bytes of a block of rows
BLOCK_BYTES = 4096
#: rows that a step of array work takes
STEP_ROWS = 1 << 16
SCORED_ROWS = 1 << 14
#: cells, over a level's nodes, and bytes, over all classes, of histograms that features share
SHARED_CELLS, SHARED_BYTES = 1 << 16, 64 << 20
#: nodes of a level up to which rows are compared node by node
FEW_NODES = 32
ROW_TYPES = "rows binary"
HISTOGRAM_TYPES = "k int, node int, block int, sums binary"
SPLIT_TYPES = "k int, node int, gain double, feature int, bin int, gl double, hl double, g double, h double"


@dataclass
class Tree:
    """A full tree in level order: node i has the children 2i+1 and 2i+2. Feature -1: everything goes left."""

    feature: np.ndarray
    bin: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        inner = (1 << depth) - 1
        return cls(np.full(inner, -1, np.int32), np.zeros(inner, np.int32), np.zeros(inner), np.zeros(inner + 1))

    def places(self, values: np.ndarray, levels: int, limits: np.ndarray) -> np.ndarray:
        """For each row its place among the nodes of ``levels``; values (feature by feature) above a node's limit go right."""
        at = np.zeros(values.shape[1], np.min_scalar_type((1 << levels) - 1))
        for level in range(levels):
            first = (1 << level) - 1
            feature, limit = self.feature[first:2 * first + 1], limits[first:2 * first + 1]
            if 1 << level <= FEW_NODES:
                right = np.zeros(len(at), bool)
                for node in np.flatnonzero(feature >= 0).tolist():
                    above = values[feature[node]] > limit[node]
                    right |= above & (at == node) if level else above
            else:
                right = (feature[at] >= 0) & (values[feature[at], np.arange(len(at))] > limit[at])
            at = at + at + right
        return at

    def values(self, rows: np.ndarray, limits: np.ndarray) -> np.ndarray:
        return self.leaf[self.places(rows, len(self.leaf).bit_length() - 1, limits)]


@dataclass
class Boosted:
    classes: list[str]
    features: list[str]
    #: by round, then class
    trees: list[list[Tree]]

    def ranked(self) -> tuple[list[np.ndarray], list[list[np.ndarray]]]:
        """The thresholds of each feature, and the rank of each node's threshold among them by round, then class."""
        if not hasattr(self, "_ranked"):
            nodes = [(t.feature, t.threshold) for grown in self.trees for t in grown]
            known = [np.unique(np.concatenate([x[f == j] for f, x in nodes] or [np.zeros(0)])) for j in range(len(self.features))]
            kind = np.min_scalar_type(max([len(x) for x in known] or [0]))

            def ranks(t: Tree) -> np.ndarray:
                return np.array([np.searchsorted(known[j], x) if j >= 0 else 0 for j, x in zip(t.feature, t.threshold, strict=True)], kind)

            self._ranked = known, [[ranks(t) for t in grown] for grown in self.trees]
        return self._ranked

    def margins(self, rows: np.ndarray) -> np.ndarray:
        # a value's rank among the thresholds of its feature tells all comparisons with them
        known, limits = self.ranked()
        out = np.zeros((len(self.classes), len(rows)))
        for at in range(0, len(rows), SCORED_ROWS):
            own = rows[at:at + SCORED_ROWS]
            ranks = np.stack([np.where(np.isnan(x), 0, np.searchsorted(v, x, side="left")) for v, x in zip(known, own.T, strict=True)])
            ranks = ranks.astype(np.min_scalar_type(max(len(v) for v in known)))
            for grown, nodes in zip(self.trees, limits, strict=True):
                for k, tree in enumerate(grown):
                    out[k, at:at + SCORED_ROWS] += tree.values(ranks, nodes[k])
        return np.ascontiguousarray(out.T)


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def bin_edges(rows: DataFrame, names: list[str], bins: int) -> list[np.ndarray]:
    """Upper limits of at most ``bins`` bins a column, from mergeable quantile summaries of all rows."""
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(c, shares, 10_000).alias(c) for c in names]).first()
    return [np.unique(np.array(found[c] or [], float)) for c in names]


@dataclass
class Blocks:
    """How rows lie in a block: bins by feature, classes, margins by class. Rows that fill a block up have the class past the last."""

    features: int
    classes: int

    @property
    def rows(self) -> int:
        return max(8, BLOCK_BYTES // (self.features + 2 + 4 * self.classes))

    def pack(self, bins: np.ndarray, y: np.ndarray, margins: np.ndarray) -> pa.RecordBatch:
        n = self.rows
        m = len(y) // n

        def cells(x: np.ndarray) -> np.ndarray:
            return np.ascontiguousarray(x.reshape(-1, m, n).transpose(1, 0, 2)).view(np.uint8).reshape(m, -1)

        raw = np.concatenate([cells(bins), cells(y.astype(np.uint16)), cells(margins.astype(np.float32))], axis=1)
        starts = np.arange(m + 1, dtype=np.int32) * raw.shape[1]
        return pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(starts), pa.py_buffer(raw)])], ["rows"])

    def unpack(self, batch: pa.RecordBatch):
        """Bins, classes and margins of a batch's blocks, ``STEP_ROWS`` rows at a time."""
        n, column = self.rows, batch.column("rows")
        if not len(column):
            return
        # all cells are as long as one another, and lie side by side
        size = n * (self.features + 2 + 4 * self.classes)
        start = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset])
        raw = np.frombuffer(column.buffers()[2], np.uint8)[start:start + len(column) * size].reshape(-1, size)
        first, second = n * self.features, n * (self.features + 2)
        for part in np.array_split(raw, -(-len(raw) * n // STEP_ROWS)):

            def arrays(cells: np.ndarray, kind, width: int) -> np.ndarray:
                cells = np.ascontiguousarray(cells).view(kind).reshape(-1, width, n)
                return np.ascontiguousarray(cells.transpose(1, 0, 2)).reshape(width, -1)

            yield (arrays(part[:, :first], np.uint8, self.features), arrays(part[:, first:second], np.uint16, 1)[0],
                   arrays(part[:, second:], np.float32, self.classes))


def binned(rows: DataFrame, names: list[str], edges: list[np.ndarray], classes: int) -> DataFrame:
    blocks = Blocks(len(names), classes)

    def put(batches):
        bins, y = np.empty((len(names), 0), np.uint8), np.empty(0, np.uint16)

        def packed(n: int) -> pa.RecordBatch:
            return blocks.pack(bins[:, :n], y[:n], np.zeros((classes, n), np.float32))

        for b in batches:
            new = np.empty((len(names), b.num_rows), np.uint8)
            for j, c in enumerate(names):
                new[j] = np.searchsorted(edges[j], b.column(c).to_numpy(zero_copy_only=False), side="left")
            bins, y = np.concatenate([bins, new], axis=1), np.concatenate([y, b.column("y").to_numpy().astype(np.uint16)])
            whole = len(y) // blocks.rows * blocks.rows
            if whole:
                yield packed(whole)
                bins, y = bins[:, whole:], y[whole:]
        if len(y):
            spare = -len(y) % blocks.rows
            bins, y = np.pad(bins, ((0, 0), (0, spare))), np.pad(y, (0, spare), constant_values=classes)
            yield packed(len(y))

    return rows.select(*names, "y").mapInArrow(put, ROW_TYPES)


def gradients(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and curvatures by class, from margins by class; ``weight`` is that of each class."""
    p = margins.astype(float)
    p -= p.max(axis=0)
    np.exp(p, out=p)
    p /= p.sum(axis=0)
    own = np.append(weight, 0.0)[y]
    h = 1 - p
    h *= p
    np.maximum(h, 1e-16, out=h)
    h *= own
    for k in range(len(p)):
        p[k] -= y == k
    p *= own
    return p, h


def shared(sizes: list[int], classes: int, nodes: int) -> list[list[int]]:
    """Features by the histogram that they share: as few as fit, features with many bins apart from one another."""
    for count in range(1, len(sizes)):
        groups, cells = [[] for _ in range(count)], [1] * count
        for j in sorted(range(len(sizes)), key=lambda j: -sizes[j]):
            at = cells.index(min(cells))
            groups[at].append(j)
            cells[at] *= sizes[j]
        if max(cells) * nodes <= SHARED_CELLS and classes * nodes * sum(cells) * 16 <= SHARED_BYTES:
            return groups
    return [[j] for j in range(len(sizes))]


def histograms(
    rows: DataFrame, trees: list[Tree], level: int, open_nodes: np.ndarray, sizes: list[int], bins: int, weight: np.ndarray, groups: list[list[int]]
) -> DataFrame:
    """Sums of gradients and curvatures of a task's rows in the open nodes of ``level``; (class, node, feature block).

    ``sizes`` are the numbers of bins in use, ``groups`` the features that share a histogram.
    """
    classes, nodes, features = len(trees), 1 << level, len(sizes)
    blocks, shapes = Blocks(features, classes), [[sizes[j] for j in group] for group in groups]
    cells = [int(np.prod(shape)) for shape in shapes]

    def add(batches):
        sums = [np.zeros((classes, 2, nodes * n)) for n in cells]
        for batch in batches:
            for values, y, margins in blocks.unpack(batch):
                steps = gradients(margins, y, weight)
                codes = [np.ravel_multi_index([values[j].astype(np.intp) for j in group], shape) for group, shape in zip(groups, shapes, strict=True)]
                for k, tree in enumerate(trees):
                    at = tree.places(values, level, tree.bin).astype(np.intp)
                    for total, code, n in zip(sums, codes, cells, strict=True):
                        cell = code + at * n if level else code
                        for i in (0, 1):
                            total[k, i] += np.bincount(cell, steps[i][k], nodes * n)
        for k in range(classes):
            own = np.zeros((features, nodes, bins, 2))
            for total, group, shape in zip(sums, groups, shapes, strict=True):
                whole = total[k].reshape(2, nodes, *shape)
                for place, j in enumerate(group):
                    others = tuple(i + 2 for i in range(len(group)) if i != place)
                    own[j, :, :sizes[j]] = whole.sum(axis=others).transpose(1, 2, 0)
            seen = np.flatnonzero(open_nodes[k] & (own[0, :, :, 1].sum(axis=1) > 0))
            for block in range(0, features, FEATURE_BLOCK):
                part = [np.ascontiguousarray(own[block:block + FEATURE_BLOCK, n]).tobytes() for n in seen]
                if part:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k] * len(seen), pa.int32()), pa.array(seen, pa.int32()), pa.array([block] * len(seen), pa.int32()),
                         pa.array(part, pa.binary())], ["k", "node", "block", "sums"])

    return rows.mapInArrow(add, HISTOGRAM_TYPES)


def best_split(sums: np.ndarray, ridge: float, least: float) -> tuple:
    """(gain, feature, bin, left sums) of the best split of (feature, bin, 2) sums; gain 0 where there is none.

    Of equal gains the first feature and lowest bin win.
    """
    left = np.cumsum(sums, axis=1)[:, :-1]
    total = sums[0].sum(axis=0)
    right = total - left

    def score(s):
        return s[..., 0] ** 2 / (s[..., 1] + ridge)

    gain = score(left) + score(right) - score(total)
    gain = np.where((left[..., 1] >= least) & (right[..., 1] >= least), gain, 0.0)
    feature, at = np.unravel_index(int(np.argmax(gain)), gain.shape) if gain.size else (0, 0)
    if not gain.size or gain[feature, at] <= 1e-12:
        return 0.0, -1, -1, 0.0, 0.0
    return float(gain[feature, at]), int(feature), int(at), float(left[feature, at, 0]), float(left[feature, at, 1])


def split_nodes(sums: DataFrame, bins: int, ridge: float, least: float) -> DataFrame:
    """One row a node: its best split over all features, and its own sums."""

    def best(table: pa.Table) -> pa.Table:
        k, node, block = (table.column(c)[0].as_py() for c in ("k", "node", "block"))
        total = sum(np.frombuffer(x, float) for x in table.column("sums").to_pylist()).reshape(-1, bins, 2)
        gain, feature, at, gl, hl = best_split(total, ridge, least)
        g, h = total[0].sum(axis=0).tolist()
        row = {"k": k, "node": node, "gain": gain, "feature": feature + block if feature >= 0 else -1, "bin": at, "gl": gl, "hl": hl, "g": g, "h": h}
        return pa.Table.from_pylist([row], schema=pa.schema([
            ("k", pa.int32()), ("node", pa.int32()), ("gain", pa.float64()), ("feature", pa.int32()), ("bin", pa.int32()),
            ("gl", pa.float64()), ("hl", pa.float64()), ("g", pa.float64()), ("h", pa.float64())]))

    found = sums.groupBy("k", "node", "block").applyInArrow(best, SPLIT_TYPES)
    order = F.struct("gain", -F.col("feature"))
    return found.groupBy("k", "node").agg(F.max_by(F.struct("gain", "feature", "bin", "gl", "hl", "g", "h"), order).alias("s")).select("k", "node", "s.*")


def grow(rows: DataFrame, weight: np.ndarray, edges: list[np.ndarray], depth: int, rate: float, bins: int, ridge: float, least: float) -> list[Tree]:
    """The trees of one round, all classes together, one job a level."""
    classes, sizes = len(weight), [len(e) + 1 for e in edges]
    groups = shared(sizes, classes, 1 << (depth - 1))
    trees = [Tree.empty(depth) for _ in range(classes)]
    open_nodes = np.ones((classes, 1), bool)

    def settle(tree: Tree, level: int, node: int, g: float, h: float) -> None:
        tree.leaf[node << (depth - level)] = -rate * g / (h + ridge)

    for level in range(depth):
        splits = split_nodes(histograms(rows, trees, level, open_nodes, sizes, bins, weight, groups), bins, ridge, least).collect()
        after = np.zeros((classes, 2 << level), bool)
        for s in splits:
            tree, at = trees[s["k"]], (1 << level) - 1 + s["node"]
            if s["feature"] < 0:
                settle(tree, level, s["node"], s["g"], s["h"])
                continue
            tree.feature[at], tree.bin[at] = s["feature"], s["bin"]
            tree.threshold[at] = edges[s["feature"]][s["bin"]]
            for side, g, h in ((0, s["gl"], s["hl"]), (1, s["g"] - s["gl"], s["h"] - s["hl"])):
                after[s["k"], 2 * s["node"] + side] = True
                if level + 1 == depth:
                    settle(tree, depth, 2 * s["node"] + side, g, h)
        open_nodes = after
        if not after.any():
            break
    return trees


def moved(rows: DataFrame, trees: list[Tree], features: int) -> DataFrame:
    """Rows with the round's leaf values added to their margins."""
    blocks = Blocks(features, len(trees))

    def step(batches):
        for batch in batches:
            for values, y, margins in blocks.unpack(batch):
                yield blocks.pack(values, y, margins + np.stack([t.values(values, t.bin) for t in trees]))

    return rows.select("rows").mapInArrow(step, ROW_TYPES)


def fit_boosted(
    df: DataFrame, features: list[str], label: str, classes: list[str], rounds: int = 100, depth: int = 6, rate: float = 0.1,
    bins: int = 64, ridge: float = 1.0, least: float = 1.0,
) -> Boosted:
    """``rounds`` of boosting with balanced class weights; rows of other labels are left out.

    ``ridge`` is added to a leaf's curvature, ``least`` is the curvature each side of a split needs.
    """
    if not 2 <= bins <= 256:
        raise ValueError("2 to 256 bins")
    xs = _safe(features)
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1
    trees = []
    with Scratch(df.sparkSession) as scratch:
        base = scratch.write(model_input(df, features).select(*xs, F.col(label).alias("label")), "boosting")
        data = df.sparkSession.table(base)
        found = {r["label"]: r["weight"] for r in class_weights(data, "label").where(F.col("label").isin(list(classes))).collect()}
        weight = np.array([found.get(c, 0.0) for c in classes])
        rows = data.withColumn("y", index.cast("int")).where("y >= 0")
        edges = bin_edges(rows, xs, bins)
        name = scratch.write(binned(rows, xs, edges, len(classes)), "boosting")
        scratch.drop(base)
        for turn in range(rounds):
            table = df.sparkSession.table(name)
            trees.append(grow(table, weight, edges, depth, rate, bins, ridge, least))
            if turn + 1 < rounds:
                new = scratch.write(moved(table, trees[-1], len(xs)), "boosting")
                scratch.drop(name)
                name = new
    return Boosted(list(classes), list(features), trees)


def boosted_probabilities(model: Boosted, df: DataFrame, name: str = "probs") -> DataFrame:
    """``df`` with the probability array in class order. The broadcast model's size is that of its parameters."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(list(softmax(sent.value.margins(np.column_stack(columns)))))

    xs = _safe(model.features)
    out = model_input(df, model.features).withColumn(name, score(*xs))
    return out.select(*[f"`{c}`" for c in df.columns if c != name], name)


def save(spark: SparkSession, model: Boosted, path: str) -> None:
    """The trees as a table, one row a tree."""
    rows = [
        (turn, k, model.classes, model.features, *[getattr(t, c).tolist() for c in ("feature", "bin", "threshold", "leaf")])
        for turn, grown in enumerate(model.trees) for k, t in enumerate(grown)
    ]
    schema = ("turn int, k int, classes array<string>, features array<string>, feature array<int>, bin array<int>, "
              "threshold array<double>, leaf array<double>")
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Boosted:
    rows = spark.read.parquet(path).orderBy("turn", "k").collect()
    trees: list[list[Tree]] = [[] for _ in range(rows[-1]["turn"] + 1)]
    for r in rows:
        trees[r["turn"]].append(Tree(np.array(r["feature"], np.int32), np.array(r["bin"], np.int32), np.array(r["threshold"]), np.array(r["leaf"])))
    return Boosted(rows[0]["classes"], rows[0]["features"], trees)
