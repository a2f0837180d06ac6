"""Isolation forest (Liu, Ting & Zhou 2008): trees grown in parallel from small samples, scored in batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.quantiles import quantile_row
from flowlens.functions.scalars import clean_double
from flowlens.operators.rules import numeric_columns
from flowlens.session import materialize

TREES, SAMPLE, SEED = 50, 256, 42
OUTLIER_SCORE, OUTLIER_SHARE = 70.0, 0.15
OFFSET = -0.5
#: beyond this share of the rows in each sample (small tables) every tree draws by a hash of its own
DENSE = 0.05
FOREST_SCHEMA = "tree int, node int, feature int, split double, left int, right int, path double"


def varying_columns(df: DataFrame, columns: list[str] | None = None, limit: int | None = None) -> list[str]:
    """The numeric columns that are not constant, the first ``limit`` of them if given."""
    names = columns or numeric_columns(df)
    if not names:
        return []
    spans = df.agg(*[
        (F.min(clean_double(F.col(f"`{c}`"))) < F.max(clean_double(F.col(f"`{c}`")))).alias(f"v{i}")
        for i, c in enumerate(names)
    ]).first()
    return [c for c, varies in zip(names, spans) if varies][:limit]


def average_path(n: float) -> float:
    """Mean length of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow(tree: int, x: np.ndarray, seed: int) -> pd.DataFrame:
    """One tree over at most ``SAMPLE`` points, as node rows."""
    rng = np.random.default_rng([seed, tree])
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: list[list] = []
    todo = [(np.arange(len(x)), 0, -1, False)]
    while todo:
        rows, depth, parent, is_right = todo.pop()
        node = len(nodes)
        if parent >= 0:
            nodes[parent][5 if is_right else 4] = node
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(open_features):
            nodes.append([tree, node, -1, 0.0, node, node, depth + average_path(len(rows))])
            continue
        f = int(rng.choice(open_features))
        split = float(rng.uniform(low[f], high[f]))
        below = x[rows, f] < split
        nodes.append([tree, node, f, split, -1, -1, 0.0])
        todo += [(rows[~below], depth + 1, node, True), (rows[below], depth + 1, node, False)]
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "split", "left", "right", "path"])


def _trees_of(u: Column, trees: int, share: float, seed: int) -> Column:
    """Different trees of a row, as many as a binomial draw at ``u`` says. One hash tells most rows that they have none."""
    mass, reached = (1 - share) ** trees, []
    total = mass
    for k in range(1, trees + 1):
        reached.append(total)
        mass *= (trees - k + 1) / k * share / (1 - share)
        total += mass
        if mass < 1e-12:
            break
    n = sum((u >= F.lit(x)).cast("int") for x in reached)
    order = F.sequence(F.lit(0), F.lit(trees - 1))
    dealt = F.array_sort(F.transform(order, lambda t: F.struct(F.xxhash64(F.lit(seed), t, F.col("id")).alias("h"), t.alias("t"))))
    return F.transform(F.slice(dealt, 1, n), lambda x: x["t"])


def fit(df: DataFrame, columns: list[str], trees: int = TREES, sample: int = SAMPLE, seed: int = SEED, key: str | None = None) -> DataFrame:
    """The forest as a table of at most ``trees * (2 * sample - 1)`` nodes.

    Every row is drawn for every tree by itself, from hashes of its place in the table, so equal rows weigh as often as
    they occur; of a large table few rows are in any tree, and one hash a row says which; with the name of a unique ``key`` column the draw does not depend on partitions. A few more rows than wanted are drawn; each tree then keeps the ``sample`` with the lowest hashes.
    """
    values = [clean_double(F.col(f"`{c}`")).alias(f"x{i}") for i, c in enumerate(columns)]
    rows = df.select(*values, (F.monotonically_increasing_id() if key is None else F.xxhash64(key)).alias("id"))
    names = rows.columns[:-1]
    share = min(1.0, (sample + 6 * np.sqrt(sample)) / max(rows.count(), 1))
    unit = 1 << 30
    if share > DENSE:
        drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64(F.lit(seed), t, F.col("id")), F.lit(unit)) < F.lit(int(share * unit)))
        placed = rows.withColumn("tree", F.explode(drawn))
    else:
        placed = rows.withColumn("u", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(unit))).where(F.col("u") >= int(unit * (1 - share) ** trees))
        placed = placed.withColumn("tree", F.explode(_trees_of(F.col("u") / unit, trees, share, seed))).drop("u")
    per_tree = Window.partitionBy("tree").orderBy(F.pmod(F.xxhash64(F.lit(seed), "tree", "id"), F.lit(unit)), "id")
    placed = placed.withColumn("place", F.row_number().over(per_tree)).where(F.col("place") <= sample)

    def one_tree(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        points = part.sort_values(names)[names].to_numpy(dtype=float)
        return grow(int(key[0]), points, seed)

    return placed.select("tree", *names).groupBy("tree").applyInPandas(one_tree, FOREST_SCHEMA)


def load(forest: DataFrame) -> list[dict[str, np.ndarray]]:
    """The node table as arrays; its size is fixed by the number of trees and the sample."""
    nodes = forest.toPandas().sort_values(["tree", "node"])
    return [
        {c: part[c].to_numpy() for c in ("feature", "split", "left", "right", "path")} for _t, part in nodes.groupby("tree")
    ]


def score_column(trees: list[dict[str, np.ndarray]], columns: list[str], sample: int = SAMPLE) -> Column:
    """Anomaly score in (-1, 0): the closer to -1 the more isolated."""
    norm = average_path(sample)
    depth = int(np.ceil(np.log2(sample))) + 1

    @F.pandas_udf(T.DoubleType())
    def score(*values: pd.Series) -> pd.Series:
        x = np.column_stack([v.to_numpy(dtype=float) for v in values])
        rows = np.arange(len(x))
        total = np.zeros(len(x))
        for t in trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                f = t["feature"][at]
                goes_left = x[rows, np.maximum(f, 0)] < t["split"][at]
                at = np.where(f < 0, at, np.where(goes_left, t["left"][at], t["right"][at]))
            total += t["path"][at]
        return pd.Series(-np.exp2(-total / len(trees) / norm))

    return score(*[clean_double(F.col(f"`{c}`")) for c in columns])


def with_decision(df: DataFrame, trees, columns: list[str], threshold: float) -> DataFrame:
    """``anomaly_score`` (decision function) and ``is_anomaly``."""
    return df.withColumn("anomaly_score", score_column(trees, columns) - OFFSET).withColumn(
        "is_anomaly", F.col("anomaly_score") < threshold
    )


def outliers(df: DataFrame, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """``outlier_raw``, ``outlier_index`` (0 to 100) and ``is_outlier`` for an unknown table.

    All rows are scored, on all numeric columns that vary (or the first ``limit``); only the fit samples. With fewer than
    two such columns nothing is an outlier: the raw score is null and the index 0.
    """
    names = varying_columns(df, columns, limit)
    if len(names) < 2:
        return df.withColumns({
            "outlier_raw": F.lit(None).cast("double"), "is_outlier": F.lit(False), "outlier_index": F.lit(0.0),
        })
    trees = load(fit(df, names))
    # scored once: ends, the quantile and the result read the stored scores
    rows = materialize(df.withColumn("outlier_raw", score_column(trees, names)), "outlier-scores")
    ends = rows.agg(F.min("outlier_raw").alias("low"), F.max("outlier_raw").alias("high")).first()
    edge = quantile_row(rows, ["outlier_raw"], [OUTLIER_SHARE])["outlier_raw"][0]
    index = (F.lit(ends["high"]) - F.col("outlier_raw")) / (ends["high"] - ends["low"] + 1e-9) * 100.0
    return rows.withColumns({
        "is_outlier": (index >= OUTLIER_SCORE) | (F.col("outlier_raw") <= edge), "outlier_index": F.round(index, 2),
    })
