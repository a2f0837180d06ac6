import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens import schemas as SC
from flowlens.operators import forest as FO
from flowlens.operators import models as M


@pytest.fixture(scope="module")
def train(spark):
    n = F.col("id")
    bad = n % 4 == 0
    values = {f: (n % (7 + i)).cast("double") + F.when(bad, 50.0 * (i % 2)).otherwise(0.0) for i, f in enumerate(SC.GENERALIZED_FEATURES)}
    names = F.when(bad & (n % 8 == 0), "DDoS").when(bad, "Bot").otherwise("BENIGN")
    return spark.range(800).select(n, bad.alias("bad"), names.alias("label"), *[v.alias(k) for k, v in values.items()]).cache()


def test_generalized_with_imputer_and_reload(spark, train, tmp_path):
    model = M.fit_generalized(train, "bad", iterations=3, depth=3)
    M.save(model, str(tmp_path / "m"))
    loaded = M.load(str(tmp_path / "m"))
    gaps = train.withColumn("duration_seconds", F.when(F.col("id") % 10 != 0, F.col("duration_seconds")))
    scored = M.score_binary(loaded, gaps, "generalized", missing="null")
    right = scored.where((F.col("prediction") == "Attack") == F.col("bad")).count()
    assert right > 780 and scored.where("attack_probability is null").count() == 0
    trees = FO.load(FO.fit(train, SC.GENERALIZED_FEATURES, trees=5))
    out = M.with_telemetry(scored, loaded, trees)
    assert out.where("generalized_prob is null or anomaly_score is null").count() == 0
    bare = M.with_telemetry(scored.drop("total_bytes"), loaded, trees).first()
    assert bare.anomaly_score is None and bare.generalized_prediction is None


def test_multiclass(spark, train):
    model = M.fit_multiclass(train, SC.GENERALIZED_FEATURES, "label", SC.CICIDS_CLASSES, trees=5, depth=5)
    probs = M.class_probabilities(model, train, SC.GENERALIZED_FEATURES, SC.CICIDS_CLASSES).first().probs
    assert len(probs) == 15 and sum(probs) == pytest.approx(1.0)
    scored = M.score_multiclass(model, train, "cicids2017", SC.GENERALIZED_FEATURES)
    assert scored.where(F.col("is_attack") == F.col("bad")).count() > 760


def test_single_row(spark, train):
    model = M.fit_binary(train, SC.GENERALIZED_FEATURES, "bad", iterations=2, depth=3)
    row = M.single_row(spark, {"Forward_Packets": 60, "total_bytes": "x"}, SC.GENERALIZED_FEATURES)
    assert row.first().forward_packets == 60.0 and row.first().total_bytes == 0.0
    assert 0.0 <= M.score_binary(model, row, "generalized").first().attack_probability <= 1.0


def test_forest_scores_in_range(spark, train):
    names = FO.varying_columns(train.select(*SC.GENERALIZED_FEATURES))
    assert len(names) == 10
    trees = FO.load(FO.fit(train, names, trees=10, sample=64))
    s = train.select(FO.score_column(trees, names, 64).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert -1 < s[0] < s[1] < 0


def test_exact_key_before_the_last_one_alike(spark):
    row = M.single_row(spark, {"Total_Bytes": 1, "total_bytes": 2, " TOTAL_BYTES": 3, "Forward_Packets": 4, "FORWARD_PACKETS": 5}, SC.GENERALIZED_FEATURES)
    assert (row.first().total_bytes, row.first().forward_packets) == (2.0, 5.0)


def test_forest_sample_follows_the_rows(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 7.0).otherwise(F.rand(1)).alias("x"), F.when(F.col("id") % 2 == 0, 7.0).otherwise(F.rand(2)).alias("y"))
    # the repeated row is half of each sample, so it is never isolated
    trees = FO.load(FO.fit(df, ["x", "y"], trees=20, sample=128))
    assert len(trees) == 20
    s = df.select("x", FO.score_column(trees, ["x", "y"], 128).alias("s")).groupBy((F.col("x") == 7).alias("hot")).agg(F.avg("s").alias("s")).collect()
    scores = {r.hot: r.s for r in s}
    assert scores[True] > scores[False]


def test_outliers_without_columns_that_vary(spark):
    got = FO.outliers(spark.range(3).select(F.lit(1.0).alias("a"), F.lit("t").alias("b"))).collect()
    assert len(got) == 3 and not any(r.is_outlier for r in got)


def plain_score(trees, x, sample):
    """Score of one row by walking down each tree."""
    total = 0.0
    for t in trees:
        at = 0
        while t["feature"][at] >= 0:
            at = int(t["left"][at] if x[t["feature"][at]] < t["split"][at] else t["right"][at])
        total += t["path"][at]
    return -(2.0 ** (-total / len(trees) / FO.average_path(sample)))


def test_forest_scores_equal_a_walk_down_the_trees(spark, train):
    names = SC.GENERALIZED_FEATURES[:4]
    trees = FO.load(FO.fit(train, names, trees=7, sample=32, key="id"))
    rows = train.select(*names, FO.score_column(trees, names, 32).alias("s")).collect()
    assert [r.s for r in rows] == pytest.approx([plain_score(trees, [r[c] for c in names], 32) for r in rows])
    # the decision shifts the score; the index runs from 0 to 100 over the table's own scores
    told = FO.with_decision(train, trees, names, 0.0).select("anomaly_score", "is_anomaly").collect()
    assert all(r.is_anomaly == (r.anomaly_score < 0.0) for r in told)
    out = FO.outliers(train.select(*names), names).collect()
    low, high = min(r.outlier_raw for r in out), max(r.outlier_raw for r in out)
    cut = float(np.quantile([r.outlier_raw for r in out], 0.15))
    for r in out:
        index = (high - r.outlier_raw) / (high - low + 1e-9) * 100
        assert r.outlier_index == pytest.approx(index, abs=0.006)
        assert r.is_outlier == (index >= 70.0 or r.outlier_raw <= cut + 1e-12)


def test_one_hash_draws_as_many_rows_as_a_hash_a_tree(spark):
    df = spark.range(60_000).select((F.col("id") * 1.0).alias("x"))
    trees = 20
    forest = FO.fit(df, ["x"], trees=trees, sample=64)
    assert forest.select("tree").distinct().count() == trees
    # a full sample has 2 * 64 - 1 nodes or fewer, and roots split the whole range, not a part of it
    sizes = [r["count"] for r in forest.groupBy("tree").count().collect()]
    assert max(sizes) <= 127 and min(sizes) > 40
    picks = df.withColumn("id", F.col("x").cast("long")).withColumn("u", F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(1 << 30)) / (1 << 30))
    picks = picks.select("id", F.explode(FO._trees_of(F.col("u"), trees, 0.01, 9)).alias("tree"))
    counts = [r["count"] for r in picks.groupBy("tree").count().collect()]
    # 600 rows a tree are expected, each at most once
    assert len(counts) == trees and all(480 < c < 720 for c in counts) and picks.count() == picks.distinct().count()


def test_no_task_gets_all_rows_of_a_class(spark):
    df = spark.range(50).selectExpr("id", "IF(id < 45, 'a', 'b') AS c")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = M.with_class_weights(df, "c")
        assert "BroadcastHashJoin" in rows._jdf.queryExecution().executedPlan().toString()
        assert rows.count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_training_partitions_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(M, "PART_ROWS", 10)
    rows = M.in_parts(spark.range(0, 200, 1, 1))
    sizes = [len(p) for p in rows.rdd.glom().collect()]
    assert sum(sizes) == 200 and max(sizes) <= 20
    monkeypatch.setattr(M, "PART_ROWS", 1000)
    assert M.in_parts(spark.range(0, 200, 1, 1)).rdd.getNumPartitions() == 1
