import random

import pytest
from pyspark.sql import functions as F

from flowlens import schemas as SC
from flowlens.functions.quantiles import exact_quantiles
from flowlens.functions.ranks import hashed_rank
from flowlens.operators import forest as FO
from flowlens.operators import profile as P
from flowlens.operators import rules as RU


def mixed(spark):
    rows = [(f"10.0.0.{i % 5}", "10.1.1.1", 80, 15.0, 2400.0, 2.5) for i in range(20)]
    rows += [("10.0.0.9", "10.1.1.1", 80, 50_000.0, 32_000_000.0, 0.5)] * 5
    rows += [("10.0.0.66", "10.1.1.1", 1000 + i, 1.0, 60.0, 0.1) for i in range(15)]
    df = spark.createDataFrame(rows, "src_ip string, dst_ip string, dst_port int, packets double, bytes double, duration double")
    return df.withColumn("row_id", F.monotonically_increasing_id())


def test_mixed_traffic(spark):
    flagged = RU.flag_rows(mixed(spark))
    summary = {r.indicator_id: r for r in RU.indicator_summary(flagged).collect()}
    assert len(summary) == 4
    assert summary["IND-DOS-VOLUMETRIC"].affected_records_count == 5 and summary["IND-DOS-VOLUMETRIC"].peak == 100_000.0
    assert summary["IND-RECON-PORTSCAN"].affected_records_count == 15
    assert summary["IND-DATA-EXFIL"].affected_records_count == 5 and summary["IND-DATA-EXFIL"].peak == pytest.approx(30.52)
    assert not summary["IND-ASYM-UNRESPONSIVE"].detected
    top = RU.top_evidence(RU.with_evidence(flagged), "row_id").collect()
    assert len(top) == 20 and top[0].n_flags == 2
    assert top[0].evidence == "Packet Rate: 100,000.0 pkts/s; Payload Bytes: 32,000,000"


def test_evidence_falls_back_to_first_rows(spark):
    df = mixed(spark).where("packets = 15")
    top = RU.top_evidence(RU.with_evidence(RU.flag_rows(df)), "row_id")
    assert top.count() == 10 and top.first().indicators == [SC.NO_FLAG] and top.first().evidence == SC.NO_EVIDENCE


def test_tables_without_the_columns(spark):
    df = spark.createDataFrame([(i, 20.0 + i, 0.5) for i in range(30)], "sensor_id int, temperature double, humidity double")
    assert not any(r.detected for r in RU.indicator_summary(RU.flag_rows(df)).collect())


@pytest.mark.parametrize("probes,hits", [(5, 0), (6, 6)])
def test_scan_without_source(spark, probes, hits):
    rows = [(1000 + i, 0.0) for i in range(probes)] + [(80, 3.0), (0, 0.0)]
    df = spark.createDataFrame(rows, "dst_port int, bwd_pkts double")
    assert RU.flag_rows(df).where("scan").count() == hits


def test_scan_needs_fifteen_ports(spark):
    rows = [("a", p) for p in range(14)] * 3 + [("b", p) for p in range(15)] + [(None, p) for p in range(15)]
    df = spark.createDataFrame(rows, "src_ip string, dst_port int")
    assert RU.flag_rows(df).where("scan").count() == 30


def test_export_and_search(spark):
    df = mixed(spark).withColumn("label", F.when(F.col("packets") > 100, "DoS"))
    rows = RU.with_evidence(RU.flag_rows(df))
    top = RU.top_evidence(rows.withColumn("key_features", RU.key_features(df.drop("row_id"))), "row_id")
    export = RU.export_evidence(top, "row_id", "label", ["packets", "bytes"])
    assert export.columns == ["row_index", "actual_dataset_label", "potential_threat_indicators", "statistical_outlier_score",
                              "evidence_details", "feature_packets", "feature_bytes"]
    assert export.where("actual_dataset_label = 'N/A'").count() == 15
    assert RU.search_evidence(top, "PROBE", "label").count() == 15


def test_profile(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, 2.0, "tcp", "a"), (1, 2.0, "tcp", "a"), (2, nan, None, "a"), (2, None, None, "b"), (3, inf, "udp", "a"), (3, 5.0, "udp", "a")]
    df = spark.createDataFrame(rows, "id int, value double, proto string, label string")
    assert {r.column: r.missing for r in P.missing_cells(df).collect()} == {"id": 0, "value": 2, "proto": 2, "label": 0}
    assert P.infinite_cells(df).first().infinite == 1
    assert P.duplicates(df.drop("label")).first().duplicate_records == 2  # NaN and null are alike
    assert [(r.value, r.n) for r in P.protocol_distribution(df).collect()] == [("nan", 2), ("tcp", 2), ("udp", 2)]
    assert P.imbalance_ratio(P.label_distribution(df)).first().class_imbalance_ratio == 5.0
    assert P.imbalance_ratio(P.value_counts(df.where("label = 'a'"), "label")).first().class_imbalance_ratio is None
    assert P.column_split(df) == (["id", "value"], ["proto", "label"])
    totals = P.quality_totals(df).first()
    assert (totals.missing_cells, totals.infinite_cells) == (4, 1)
    warnings = [r.warning for r in P.quality_warnings(P.quality_totals(df)).collect()]
    assert len(warnings) == 3 and warnings[0].startswith("High missingness: 16.67%")


def test_time_coverage_of_text(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05",), ("bad",), (None,), ("2024-01-01 00:00:00",)], "Timestamp string")
    row = P.time_coverage(df).first()
    assert row.valid_timestamps_count == 2 and row.earliest.day == 1 and row.latest.day == 2


def test_numeric_summary(spark):
    df = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4)], "x double")
    r = P.numeric_summary(df).first()
    assert (r.mean, r["std"], r["min"], r.p25, r.median, r.p75, r["max"]) == (2.5, 1.291, 1.0, 1.75, 2.5, 3.25, 4.0)


@pytest.mark.parametrize("kind", ["uniform", "skewed", "wide", "infinite"])
def test_quantiles_by_brackets(spark, kind):
    rnd = random.Random(3)
    make = {
        "uniform": lambda: rnd.random(), "skewed": lambda: rnd.choice([7.0, 7.0, 7.0, rnd.random() * 100]),
        "wide": lambda: rnd.choice([-1, 1]) * 10 ** rnd.uniform(-200, 200), "infinite": lambda: rnd.choice([float("inf"), 1.0, rnd.random(), 2.0]),
    }[kind]
    df = spark.createDataFrame([(rnd.choice("ab"), make()) for _ in range(600)], "g string, x double")
    probs = [0.0, 0.15, 0.25, 0.5, 0.7]
    fast = {r.grp: list(r.q) for r in exact_quantiles(df, ["x"], probs, group="g").collect()}
    slow = {r.grp: list(r.q) for r in exact_quantiles(df, ["x"], probs, group="g", exact_rows=1, sort_rows=5).collect()}
    for g in fast:
        assert slow[g] == pytest.approx(fast[g], rel=1e-12)


def test_hashed_rank(spark):
    df = spark.range(500).withColumn("g", F.when(F.col("id") % 3 == 0, "x").otherwise("y")).withColumn("k", F.col("id").cast("string"))
    rows = hashed_rank(df, "g", "k", slices=7).withColumn("h", F.md5("k")).collect()
    for g in ("x", "y"):
        part = sorted((r for r in rows if r.g == g), key=lambda r: r.h)
        assert [r["rank"] for r in part] == list(range(1, len(part) + 1)) and part[0].group_rows == len(part)


def test_outliers_stand_out(spark):
    df = mixed(spark).withColumn("constant", F.lit(1.0))
    assert "constant" not in FO.varying_columns(df)
    out = FO.outliers(df, ["packets", "bytes", "duration"])
    got = {r.packets: r.outlier_index for r in out.collect()}
    assert got[50_000.0] == pytest.approx(100.0, abs=0.1) and got[15.0] < 60
    assert out.where("is_outlier").count() > 0
    assert FO.outliers(df.limit(5), ["packets", "bytes"]).count() == 5


def test_forest_does_not_depend_on_partitions(spark):
    df = spark.range(2000).select("id", (F.sin("id") * 100).alias("a"), (F.col("id") % 17).cast("double").alias("b"))
    results = []
    for n in (1, 6):
        trees = FO.fit(df.repartition(n), ["a", "b"], key="id", trees=5, sample=64)
        results.append(trees.orderBy("tree", "node").toPandas())
    assert results[0].equals(results[1])
    assert results[0].groupby("tree").size().max() <= 2 * 64 - 1


def test_quantiles_read_their_table_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(parts):
        for part in parts:
            seen.add(len(part))
            yield part

    df = spark.range(500).selectExpr("double(id % 97) AS x", "double(id) AS y").mapInPandas(counted, "x double, y double")
    got = {r.name: list(r.q) for r in exact_quantiles(df, ["x", "y"], [0.25, 0.5], exact_rows=1, sort_rows=5).collect()}
    assert got["y"] == [124.75, 249.5] and seen.value == 500


def test_summaries_and_thresholds_read_their_table_once(spark):
    """What makes the rows runs once for all figures of a summary, and once for the thresholds and the count."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(100).select(F.col("id").cast("double").alias("flow_packets_per_sec"), F.lit(2.0).alias("total_bytes"))
    rows = rows.mapInArrow(count, rows.schema)
    found = P.numeric_summary(rows, ["flow_packets_per_sec"]).first()
    assert (found["mean"], found["p25"], found["max"]) == (49.5, 24.75, 99.0) and made.value == 100
    inputs = RU.RuleInputs(rate=F.col("flow_packets_per_sec"), port=None, source=None, forward=None, backward=None, volume=F.col("total_bytes"))
    written = RU.measured(rows, inputs)
    limits = RU.thresholds(rows, inputs, written)
    assert limits == {"dos": RU.RATE_FLOOR, "exfil": RU.BYTES_FLOOR} and written.count() == 100 and made.value == 200
    assert RU.thresholds(rows, inputs) == limits
