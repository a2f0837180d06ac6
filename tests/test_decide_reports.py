import datetime as dt

import pytest
from pyspark.sql import functions as F

from flowlens import schemas as SC
from flowlens.functions import scalars as S
from flowlens.operators import decide as D
from flowlens.operators import explain as X
from flowlens.operators import incidents as I
from flowlens.operators import reports as R
from flowlens.sources import sinks as SK


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_risk(spark):
    df = spark.createDataFrame([(0.05,)], "benign double").withColumn("p", S.attack_probability(F.col("benign")))
    r = df.select(F.round("p", 4).alias("p"), S.risk_score(F.col("p")).alias("s"), S.risk_level(S.risk_score(F.col("p"))).alias("l")).first()
    assert (r.p, r.s, r.l) == (0.95, 95.0, "Critical")


@pytest.mark.parametrize("score,level", [(29.99, "Low"), (30.0, "Moderate"), (59.99, "Moderate"), (60.0, "High"), (79.99, "High"), (80.0, "Critical")])
def test_bands(spark, score, level):
    assert one(spark, S.risk_level(F.lit(score))) == level


def test_isolation_decision(spark):
    t = SC.THRESHOLDS["isolation_forest"]
    df = spark.createDataFrame([(t - 0.1,), (t,), (t + 0.1,), (None,)], "s double")
    rows = {r.s: r for r in D.decide_isolation(df, "s").collect()}
    assert rows[t - 0.1].prediction == "Anomaly" and rows[t - 0.1].attack_probability == pytest.approx(0.7)
    assert rows[t].prediction == "Normal" and rows[t].attack_probability == 0.49 and rows[t].confidence == 0.5
    assert rows[t + 0.1].attack_probability == pytest.approx(0.3)
    assert rows[None].prediction == "Unclassifiable" and rows[None].risk_level == "Low" and not rows[None].is_attack


def test_multiclass_and_fallback(spark):
    df = spark.createDataFrame([(0.2,), (0.95,)], "p double").withColumn("probs", S.spread_binary(F.col("p"), SC.UNSW_CLASSES, "Normal"))
    rows = {r.p: r for r in D.decide_multiclass(df, "probs", "unsw").collect()}
    assert rows[0.2].prediction == "Normal" and rows[0.2].attack_probability == pytest.approx(0.2)
    assert rows[0.95].prediction == "Analysis" and rows[0.95].is_attack and sum(rows[0.95].probs) == pytest.approx(1)
    assert rows[0.2].prediction_margin == pytest.approx(0.8 - 0.2 / 9, abs=1e-4)


def test_early_warning_is_not_is_attack(spark):
    df = spark.createDataFrame([("CICIDS2017", 0.9, True), ("UNSW-NB15", 0.5, True), ("Other", 0.99, True)], "dataset string, attack_probability double, is_attack boolean")
    assert {r.dataset: r.early_warning for r in D.early_warning(df).collect()} == {"CICIDS2017": False, "UNSW-NB15": True, "Other": False}


def flows(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [
        (1, "a", "x", True, False, "DDoS", 95.0, "Critical", t), (2, "a", "y", True, False, "DDoS", 70.0, "High", t + dt.timedelta(hours=1)),
        (3, "a", "z", False, True, "BENIGN", 10.0, "Low", t), (4, "b", "x", True, True, "Bot", 65.0, "High", t), (5, "c", "x", False, False, "BENIGN", 1.0, "Low", t),
    ]
    return spark.createDataFrame(rows, "flow_seq int, src_ip string, dst_ip string, is_attack boolean, is_anomaly boolean, prediction string, risk_score double, risk_level string, timestamp timestamp").withColumns(
        {"source_type": F.lit("csv"), "dataset": F.lit("CICIDS2017"), "flow_id": F.concat(F.lit("f"), "flow_seq"), "protocol": F.lit("TCP"),
         "src_port": F.lit(1234), "dst_port": F.lit(80), "session_id": F.lit("s"), "confidence": F.lit(0.9)})


def test_incidents(spark):
    got = {(r.src_ip, r.attack_category): r for r in I.correlate(flows(spark)).collect()}
    assert set(got) == {("a", "DDoS"), ("a", "Anomaly"), ("b", "Bot")}
    r = got["a", "DDoS"]
    assert (r.flow_count, r.risk_score, r.severity, r.dst_ip, r.title) == (2, 95.0, "Critical", "x", "Potential DDoS attack from a")
    assert got["a", "Anomaly"].severity == "Medium" and r.notes == "Correlated from csv flow analysis (CICIDS2017)."


def test_upsert_and_triage(spark):
    first = I.correlate(flows(spark))
    again = I.correlate(flows(spark).where("src_ip = 'a' and is_attack").withColumn("risk_score", F.col("risk_score") - 50))
    merged = {(r.src_ip, r.attack_category): r for r in I.upsert(first, again).collect()}
    assert merged["a", "DDoS"].flow_count == 4 and merged["a", "DDoS"].risk_score == 95.0 and merged["a", "DDoS"].severity == "Critical"
    resolved = first.withColumn("status", F.lit("Resolved"))
    assert I.upsert(resolved, again).where("attack_category = 'DDoS'").count() == 2
    ident = first.where("attack_category = 'Bot'").first().incident_id
    t = dt.datetime(2024, 1, 2)
    updates = spark.createDataFrame([(ident, t, "Investigating", "n1", None), (ident, t + dt.timedelta(hours=1), None, "", "ana")],
                                    "incident_id string, updated_at timestamp, status string, notes string, analyst string")
    r = I.get_incident(I.triage(first, updates), ident).first()
    assert (r.status, r.notes, r.analyst) == ("Investigating", "", "ana")
    assert I.list_incidents(first, severity="Critical").count() == 1


def test_reports(spark):
    df = flows(spark)
    s = R.batch_summary(df).first()
    assert (s.total_records, s.attack_count, s.attack_percentage, s.average_risk_score, s.high_risk_count) == (5, 3, 60.0, 48.2, 2)
    assert R.batch_summary(df.where("false")).first().attack_percentage == 0.0
    assert [r.n for r in R.risk_distribution(df).orderBy("band").collect()] == [2, 0, 2, 1]
    m = R.summary_with_maps(df).first()
    assert m.category_distribution == {"BENIGN": 2, "Bot": 1, "DDoS": 2}
    assert R.search_flows(df, "ddos", "attacks").count() == 2 and R.search_flows(df, "80", "udp").count() == 0
    assert R.tab_counts(df).first().tcp_count == 5
    assert [r.flow_seq for r in R.last_flows(df, 2).collect()][-1] == 2
    counters = R.session_counters(df).first()
    assert counters.anomaly_count == 2 and counters.flows_per_second == pytest.approx(5 / 3600, abs=1e-6)
    rows = X.recommend(df).orderBy("flow_seq").collect()
    assert rows[0].recommendations == SC.RECOMMENDATIONS["DDoS"] and rows[4].recommendations is None


def test_pages_do_not_overlap(spark):
    df = spark.range(25).select(F.concat(F.lit("p"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("prediction_id"),
                                F.lit(dt.datetime(2024, 1, 1)).alias("timestamp"), F.lit("High").alias("risk_level"))
    pages = [[(r.record_id, r.prediction_id) for r in R.page(df, n, 10).orderBy("record_id").collect()] for n in (1, 2, 3)]
    assert [len(p) for p in pages] == [10, 10, 5] and pages[1][0] == (11, "p10")


def test_explanations(spark):
    df = spark.createDataFrame([(1, *[float(i) for i in range(10)])], ["id", *SC.GENERALIZED_FEATURES])
    rows = X.explain_rows(df, "generalized", "id").collect()
    assert len(rows) == 10 and [r.importance for r in rows] == sorted((r.importance for r in rows), reverse=True)
    assert rows[0].feature == "packets_per_second" and rows[0].importance == pytest.approx(0.892)
    top = df.select(F.inline(X.top_features("generalized"))).collect()
    assert top[0].direction == "negative" and top[9].importance == pytest.approx(0.19)


def test_sinks_and_logs(spark, tmp_path):
    df = flows(spark).drop("source_type", "confidence").withColumn("prediction", F.lit(None).cast("string"))
    SK.write_flows(df, str(tmp_path / "flows"))
    r = spark.read.parquet(str(tmp_path / "flows")).first()
    assert (r.source_type, r.prediction, r.confidence) == ("csv", "BENIGN", 0.0)
    jobs = str(tmp_path / "jobs")
    t = dt.datetime(2024, 1, 1)
    SK.log_job(spark, jobs, "job-1", status="processing", filename="a.csv", event_ts=t)
    SK.log_job(spark, jobs, "job-1", status="completed", total_records=5, event_ts=t + dt.timedelta(minutes=1))
    job = SK.current_jobs(spark.read.parquet(jobs)).first()
    assert (job.status, job.filename, job.total_records) == ("completed", "a.csv", 5)
    watched, watch = SK.observed(flows(spark))
    watched.write.format("noop").mode("overwrite").save()
    assert watch.get["attack_records"] == 3
    log = str(tmp_path / "sessions")
    SK.log_session(spark, log, "s1", "start", interface="eth0", event_ts=t)
    SK.log_session(spark, log, "s2", "start", interface="eth1", event_ts=t + dt.timedelta(hours=1))
    state = SK.sessions(spark.read.parquet(log))
    assert {r.session_id: r.status for r in state.collect()} == {"s1": "Stopped", "s2": "Running"}
    assert SK.active_session(state).first().session_id == "s2" and SK.session_history(state, 1).first().session_id == "s2"
    SK.export(flows(spark).withColumns({"duration": F.lit(1.0), "packet_count": F.lit(1), "byte_count": F.lit(1)}), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == SC.EXPORT_COLUMNS


def test_one_of_two_open_incidents_takes_what_is_new(spark):
    rows = [("inc-1", "t", "New", "High", "a", "b", "DDoS", 5, 60.0, "2024-01-02", "2024-01-02", "n", None),
            ("inc-2", "t", "Investigating", "High", "a", "b", "DDoS", 5, 60.0, "2024-01-01", "2024-01-02", "n", None)]
    table = spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'flow_count' else 'double' if c == 'risk_score' else 'string'}" for c in I.INCIDENT_COLUMNS))
    got = {r.incident_id: r.flow_count for r in I.upsert(table, table.where("incident_id = 'inc-1'")).collect()}
    assert got == {"inc-1": 5, "inc-2": 10}


def test_risk_stays_between_0_and_100(spark):
    rows = spark.createDataFrame([(-0.5,), (0.25,), (1.5,)], "p double")
    assert [r.r for r in rows.select(S.risk_score(F.col("p")).alias("r")).collect()] == [0.0, 25.0, 100.0]


def test_results_are_handed_on_whole(spark):
    rows = spark.range(120).withColumnRenamed("id", "flow_seq")
    assert R.result_sample(rows).count() == 120
    assert sorted(r.flow_seq for r in R.result_sample(rows, 7).collect()) == list(range(7))


def test_an_index_has_a_bounded_number_of_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "MAX_RANGES", 4)
    rows = spark.range(300).selectExpr("concat('p', id) AS prediction_id", "timestamp_seconds(id * 7 % 100) AS timestamp", "'High' AS risk_level")
    R.page_index(rows, str(tmp_path), 5)
    assert spark.read.parquet(f"{tmp_path}/ranges").where("range >= 0").count() <= 4
    want = [r.prediction_id for r in R.page(rows, 13, 20).collect()]
    assert [r.prediction_id for r in R.deep_page(spark, str(tmp_path), 13, 20).collect()] == want
