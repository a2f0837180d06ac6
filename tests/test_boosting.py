import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import boosting as BO
from flowlens.operators import models as M
from flowlens.plans import jobs
from flowlens.plans import views as V

CLASSES = ["a", "b", "c", "never"]
NAMES = ["u", "v", "odd name.x"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = []
    for i in range(400):
        u, v, x = (round(float(z), 2) for z in rng.normal(size=3))
        y = "a" if u + v > 0.5 else "b" if x > 0 else "c"
        data.append((u, v if i % 17 else None, x if i % 23 else float("nan"), y if i % 31 else None))
    return spark.createDataFrame(data + [(0.0, 0.0, 0.0, "other")] * 5, "u double, v double, `odd name.x` double, label string").repartition(5)


def plain_boosting(x, y, w, classes, edges, rounds, depth, rate, ridge, least):
    """Margins of every row: the same boosting, node by node, with plain loops over rows and limits."""
    margins = np.zeros((len(x), classes))
    for _ in range(rounds):
        p = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
        step = np.zeros_like(margins)
        for k in range(classes):
            g, h = (p[:, k] - (y == k)) * w, np.maximum(p[:, k] * (1 - p[:, k]), 1e-16) * w

            def split(own, level):
                def score(s):
                    return g[s].sum() ** 2 / (h[s].sum() + ridge)

                best = (1e-12, None, None)
                for f in range(x.shape[1]):
                    for limit in edges[f]:
                        left, right = own[x[own, f] <= limit], own[x[own, f] > limit]
                        if h[left].sum() >= least and h[right].sum() >= least:
                            gain = score(left) + score(right) - score(own)
                            if gain > best[0] + 1e-9:
                                best = (gain, left, right)
                if level == depth or best[1] is None:
                    step[own, k] = -rate * g[own].sum() / (h[own].sum() + ridge)
                else:
                    split(best[1], level + 1)
                    split(best[2], level + 1)

            split(np.arange(len(x)), 0)
        margins = margins + step
    return margins


def test_boosting_equals_plain_boosting(spark, rows):
    options = {"rounds": 3, "depth": 3, "rate": 0.4, "ridge": 0.5, "least": 0.5}
    model = BO.fit_boosted(rows, NAMES, "label", CLASSES, bins=8, **options)
    data = M.with_class_weights(rows, "label").where(F.col("label").isin(CLASSES)).toPandas()
    x = np.nan_to_num(data[NAMES].to_numpy(dtype=float), nan=0.0)
    y = np.array([CLASSES.index(c) for c in data["label"]])
    xs = M._safe(NAMES)
    edges = BO.bin_edges(M.model_input(rows.where(F.col("label").isin(CLASSES)), NAMES), xs, 8)
    assert all(1 < len(e) <= 7 for e in edges)
    want = plain_boosting(x, y, data["weight"].to_numpy(), len(CLASSES), edges, **options)
    assert model.margins(x) == pytest.approx(want, abs=1e-4)
    probs = BO.boosted_probabilities(model, rows).select("u", "label", "probs").collect()
    assert len(probs) == rows.count() and all(sum(r.probs) == pytest.approx(1.0) for r in probs)
    right = sum(CLASSES[int(np.argmax(r.probs))] == r.label for r in probs if r.label in CLASSES)
    assert right / len(y) > 0.85


def test_boosted_model_is_kept(spark, rows, tmp_path):
    model = BO.fit_boosted(rows, NAMES, "label", CLASSES, rounds=2, depth=2, bins=4)
    BO.save(spark, model, str(tmp_path / "m"))
    again = BO.load(spark, str(tmp_path / "m"))
    x = np.random.default_rng(1).normal(size=(50, 3))
    assert again.classes == CLASSES and again.features == NAMES and (again.margins(x) == model.margins(x)).all()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("scratch_")]


def test_boosting_of_rows_alike(spark):
    """Nothing to split on: every row gets the same margins, and one class alone is certain."""
    df = spark.range(30).select(F.lit(1.0).alias("u"), F.when(F.col("id") < 20, "a").otherwise("b").alias("label"))
    model = BO.fit_boosted(df, ["u"], "label", ["a", "b"], rounds=2, depth=3)
    assert all((t.feature == -1).all() for grown in model.trees for t in grown)
    # balanced weights: both classes weigh the same
    assert model.margins(np.ones((1, 1)))[0] == pytest.approx([0.0, 0.0], abs=1e-6)
    one = BO.fit_boosted(df.where("label = 'a'"), ["u"], "label", ["a", "b"], rounds=2, depth=2)
    assert one.margins(np.ones((1, 1)))[0].argmax() == 0
    none = BO.fit_boosted(df.limit(0), ["u"], "label", ["a", "b"], rounds=1, depth=2)
    assert (none.margins(np.ones((1, 1))) == 0).all()


def macro_f1(rows):
    pairs = rows.groupBy("actual", "prediction").count().collect()
    out = []
    for c in V.ACTUAL:
        hit = sum(r["count"] for r in pairs if r.actual == c == r.prediction)
        both = sum(r["count"] * ((r.actual == c) + (r.prediction == c)) for r in pairs)
        out.append(2 * hit / both if both else 0.0)
    return sum(out) / len(out)


def test_boosting_beats_the_forest_on_rows_not_seen(spark, sf):
    got = jobs.q_model_boosted(spark, sf)
    rows = jobs.class_rows(spark, sf)
    assert got.count() == rows.where("held_out").count()
    forest = M.fit_multiclass(rows.where("not held_out"), jobs.CLASS_FEATURES, "actual", V.ACTUAL, trees=12, depth=4)
    probs = M.class_probabilities(forest, rows.where("held_out"), jobs.CLASS_FEATURES, V.ACTUAL)
    best = F.array_position("probs", F.array_max("probs")).cast("int") - 1
    plain = probs.withColumn("prediction", F.get(F.array(*[F.lit(c) for c in V.ACTUAL]), best))
    assert macro_f1(got) > macro_f1(plain) + 0.05


def test_rows_are_read_once_and_stored_in_blocks(spark, rows, monkeypatch):
    """The training rows are made once, however many passes follow, and a stored row holds a block of them."""
    made, stored, write = spark.sparkContext.accumulator(0), [], BO.Scratch.write

    def watched(self, df, name):
        full = write(self, df, name)
        stored.append(spark.table(full).count())
        return full

    def counted(parts):
        for part in parts:
            made.add(len(part))
            yield part

    monkeypatch.setattr(BO.Scratch, "write", watched)
    plain = rows.withColumnRenamed("odd name.x", "x").coalesce(1)
    BO.fit_boosted(plain.mapInPandas(counted, plain.schema), ["u", "v", "x"], "label", CLASSES, rounds=2, depth=2, bins=8)
    assert made.value == 405
    assert stored[0] == 405 and len(stored) == 3 and max(stored[1:]) < 10


def test_blocks_give_back_their_rows(monkeypatch):
    rng = np.random.default_rng(5)
    blocks = BO.Blocks(3, 4)
    n = 7 * blocks.rows
    bins, y, margins = rng.integers(0, 256, (3, n), np.uint8), rng.integers(0, 5, n, np.uint16), rng.normal(size=(4, n)).astype(np.float32)
    batch = blocks.pack(bins, y, margins)
    monkeypatch.setattr(BO, "STEP_ROWS", 2 * blocks.rows)
    for start in (0, 2):
        parts = list(blocks.unpack(batch.slice(start)))
        assert len(parts) > 1
        for i, want in enumerate((bins, y, margins)):
            assert (np.concatenate([p[i] for p in parts], axis=-1) == want[..., start * blocks.rows:]).all()


def test_shared_histograms_equal_those_of_each_feature(spark):
    rng = np.random.default_rng(6)
    sizes, weight, blocks = [4, 7, 2, 9], np.array([1.0, 0.5, 2.0]), BO.Blocks(4, 3)
    n = 3 * blocks.rows
    bins = np.stack([rng.integers(0, s, n, np.uint8) for s in sizes])
    batch = blocks.pack(bins, rng.integers(0, 4, n, np.uint16), rng.normal(size=(3, n)).astype(np.float32))
    rows = spark.createDataFrame([(x.as_py(),) for x in batch.column("rows")], BO.ROW_TYPES)
    trees = [BO.Tree.empty(3) for _ in weight]
    for tree in trees:
        tree.feature[:], tree.bin[:] = rng.integers(-1, 4, 7), rng.integers(0, 2, 7)
    groups = BO.shared(sizes, 3, 4)
    assert sorted(j for g in groups for j in g) == [0, 1, 2, 3] and len(groups) < 4
    opened = np.array([[True, True, False, True]] * 3)

    def summed(groups):
        out = {}
        for r in BO.histograms(rows, trees, 2, opened, sizes, 9, weight, groups).collect():
            out[r.k, r.node] = out.get((r.k, r.node), 0) + np.frombuffer(r.sums)
        return out

    got, want = summed(groups), summed([[j] for j in range(4)])
    assert got.keys() == want.keys() and not any(node == 2 for _, node in got)
    assert all(got[x] == pytest.approx(want[x], abs=1e-9) for x in want)


def test_margins_equal_a_walk_down_the_trees():
    rng = np.random.default_rng(7)
    trees = [[BO.Tree.empty(7) for _ in range(2)] for _ in range(3)]
    for tree in (t for grown in trees for t in grown):
        tree.feature[:], tree.threshold[:], tree.leaf[:] = rng.integers(-1, 3, 127), rng.integers(-2, 3, 127), rng.normal(size=128)
    x = rng.integers(-3, 4, (300, 3)).astype(float)
    x[::7, 1], x[::11, 0], x[::13, 2] = np.nan, np.inf, -np.inf
    want = np.zeros((300, 2))
    for i, row in enumerate(x):
        for k in range(2):
            for tree in (grown[k] for grown in trees):
                node = 0
                while node < 127:
                    node = 2 * node + 1 + bool(tree.feature[node] >= 0 and row[tree.feature[node]] > tree.threshold[node])
                want[i, k] += tree.leaf[node - 127]
    assert BO.Boosted(["a", "b"], ["u", "v", "w"], trees).margins(x) == pytest.approx(want, abs=1e-12)
