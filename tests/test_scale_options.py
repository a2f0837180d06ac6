"""Sketches, sums in order, metrics at any scale, deep pages and folders of unlike CSV files against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from flowlens.functions import sketches as SKE
from flowlens.functions.ranks import sums_before
from flowlens.operators import evaluate as E
from flowlens.operators import reports as R
from flowlens.session import Scratch, scratch_path, shared_dir
from flowlens.sources.tables import read_csv_folder


@pytest.fixture(scope="module")
def scans(spark):
    n = F.col("id")
    source = F.when(n % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (n % 40).cast("string")))
    port = F.when(n % 3 == 0, n % 30_000).when(n % 50 == 1, F.lit(None)).otherwise(n % 17).cast("double")
    return spark.range(90_000).select((n % 5).alias("d"), source.alias("src"), port.alias("port"), (F.rand(7) * 1000).alias("x"), F.lit(float("nan")).alias("bad"))


def test_merged_port_sketches(spark, scans):
    path = scratch_path(spark, "sketches")
    by_day = SKE.source_sketches(scans, F.col("d"), F.col("src"), F.col("port"))
    SKE.write_periods(by_day.where("period < 3"), path)
    SKE.write_periods(by_day.where("period >= 3"), path)
    SKE.write_periods(by_day.where("period = 4"), path)
    merged = {r["source"]: r["ports"] for r in SKE.distinct_ports(spark.read.parquet(path)).collect()}
    once = {r["source"]: r["ports"] for r in SKE.distinct_ports(SKE.source_sketches(scans, F.lit(0), F.col("src"), F.col("port"))).collect()}
    exact = {r["src"]: r["n"] for r in scans.groupBy("src").agg(F.countDistinct("port").alias("n")).collect()}
    assert merged.keys() == exact.keys() == once.keys()
    assert all(abs(merged[s] - n) <= 0.03 * n and abs(merged[s] - once[s]) <= 0.01 * n for s, n in exact.items())
    assert exact["hot"] == 10_000 and all(merged[s] == n for s, n in exact.items() if s != "hot")
    assert {r["source"] for r in SKE.distinct_ports(spark.read.parquet(path), 100).collect()} == {"hot"}


def test_merged_quantile_sketches(spark, scans):
    made = SKE.measure_sketches(scans, F.col("d"), {"x": F.col("x"), "bad": F.col("bad"), "p": F.col("port")})
    got = {r["measure"]: r for r in SKE.quantiles(made, [0.1, 0.5, 0.9]).collect()}
    assert set(got) == {"x", "p"} and got["x"]["n"] == scans.count()
    for p, q in zip([0.1, 0.5, 0.9], got["x"]["q"], strict=True):
        assert abs(scans.where(F.col("x") <= q).count() / got["x"]["n"] - p) < 0.01


def test_sums_in_order(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1e-9, 1.0]) * rng.randrange(-10**9, 10**9), rng.randrange(9)) for _ in range(500)]
    df = spark.createDataFrame(rows, "s double, v long").repartition(7)
    got = sums_before(df, [F.col("s").desc()], ["v"])
    want = sum_so_far = 0
    for r in sorted(got.collect(), key=lambda r: -r["s"]):
        want = sum_so_far
        assert r["v_before"] == want
        sum_so_far += r["v"]
    assert sums_before(df.limit(0), [F.col("s")], ["v"]).count() == 0


@pytest.mark.parametrize("scale", ["log odds", "isolation", "large"])
def test_auc_and_sweep_at_any_scale(spark, scale):
    rng = random.Random(scale)
    draw = {"log odds": lambda: rng.gauss(0, 4), "isolation": lambda: -rng.random(), "large": lambda: rng.randrange(-10**12, 10**12, 10**11) * 1.0}[scale]
    rows = [(draw(), rng.random() < 0.4) for _ in range(150)]
    df = spark.createDataFrame([*rows, (None, True)], "s double, pos boolean")
    pos, neg = [s for s, p in rows if p], [s for s, p in rows if not p]
    wins = sum((a > b) + (a == b) / 2 for a in pos for b in neg)
    assert E.roc_auc(df, F.col("pos"), "s").first().roc_auc == pytest.approx(wins / len(pos) / len(neg), abs=1e-6)
    limits = [rows[0][0], rows[1][0], 0.0, rows[0][0]]
    got = {r.threshold: (r.tp, r.fp, r.tn, r.fn) for r in E.sweep_at(df, F.col("pos"), "s", limits).collect()}
    assert got == {t: (sum(s >= t for s in pos), sum(s >= t for s in neg), sum(s < t for s in neg), sum(s < t for s in pos)) for t in set(limits)}


def test_deep_pages_read_one_range(spark):
    rows = spark.range(1000).select(
        F.concat(F.lit("p"), "id").alias("prediction_id"), F.timestamp_seconds(F.floor(F.col("id") / 7)).alias("timestamp"), F.lit("High").alias("risk_level"))
    path = scratch_path(spark, "pages")
    R.page_index(rows, path, 100)
    for number, size in ((1, 10), (7, 13), (50, 20), (51, 20), (3, 333), (4, 333), (9, 400)):
        want = [(r.prediction_id, r.record_id) for r in R.page(rows, number, size).collect()]
        found = R.deep_page(spark, path, number, size)
        assert sorted((r.prediction_id, r.record_id) for r in found.collect()) == sorted(want)
    assert spark.read.parquet(f"{path}/ranges").count() == 10
    R.page_index(rows.limit(0), path)
    assert R.deep_page(spark, path, 1, 10).count() == 0


def test_folder_of_files_with_other_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y,name\n1,2,"one, two"\n3,,b\n')
    (tmp_path / "b.csv").write_text("name,x,x\nc,5,6\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.csv").write_text("y,x,name\n7,8,d\n")
    (tmp_path / "d.csv").write_text("x,y,name\n9,10,e\n")
    got = read_csv_folder(spark, str(tmp_path))
    assert dict(got.dtypes) == {"x": "double", "y": "double", "name": "string", "x.1": "double"}
    rows = {(r["name"], r["x"], r["y"], r["x.1"]) for r in got.collect()}
    assert rows == {("one, two", 1.0, 2.0, None), ("b", 3.0, None, None), ("c", 5.0, None, 6.0), ("d", 8.0, 7.0, None), ("e", 9.0, 10.0, None)}
    from pyspark.sql import types as T

    given = read_csv_folder(spark, str(tmp_path), T.StructType([T.StructField("y", T.LongType()), T.StructField("z", T.StringType())]))
    assert sorted((r["y"] or 0) for r in given.collect()) == [0, 0, 2, 7, 10] and given.columns == ["y", "z"]


def test_scratch_tables_go(spark):
    assert shared_dir(spark)
    with Scratch(spark) as scratch:
        one, two = scratch.write(spark.range(3), "one"), scratch.write(spark.range(4), "two")
        scratch.drop(one)
        assert spark.table(two).count() == 4 and not spark.catalog.tableExists(one)
    assert not spark.catalog.tableExists(two)
