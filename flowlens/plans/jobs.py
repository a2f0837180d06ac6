"""Registered jobs that SQL cannot express: trained models, forests, streams and sinks (row checks only)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens import schemas as SC
from flowlens.functions import scalars as S
from flowlens.operators import adapt as A
from flowlens.operators import boosting as BO
from flowlens.operators import flows as FL
from flowlens.operators import forest as FO
from flowlens.operators import models as M
from flowlens.operators import reports as R
from flowlens.operators import rules as RU
from flowlens.plans import views as V
from flowlens.session import scratch_path, spread
from flowlens.sources import sinks as SK
from flowlens.sources.tables import packet_stream, read_csv_folder
from flowlens.streaming import flow_state as ST
from flowlens.streaming.monitor import Monitor

QUERIES = {}
RULE_FEATURES = ["fwd_pkts", "bwd_pkts", "fwd_bytes", "duration", "dst_port"]


def job(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _generalized(spark, sf):
    """``lineitem`` adapted to the ten features, with a label."""
    raw = V.labelled(spark, sf).select(
        "row_key", "actual", F.col("duration").alias("dur"), F.col("fwd_pkts").alias("spkts"),
        F.col("bwd_pkts").alias("dpkts"), F.col("fwd_bytes").alias("sbytes"),
        (F.col("bwd_pkts") * 100 + F.col("attack_prob") * 1000).alias("dbytes"),
    )
    return A.adapt(raw, "generalized", keep=["row_key", "actual"]).withColumn("is_bad", F.col("actual") != "BENIGN")


def _forest_rows(spark, sf):
    return spread(V.table(spark, sf, "lineitem")).select(*V.flow_columns())


@job
def q_iforest_outliers(spark, sf):
    rows = FO.outliers(_forest_rows(spark, sf), RULE_FEATURES)
    return rows.select("row_key", "outlier_index", "is_outlier")


@job
def q_iforest_evidence(spark, sf):
    """Rule flags and the statistical outlier flag together, most suspicious rows first."""
    scored = FO.outliers(V.flow_table(spark, sf), RULE_FEATURES)
    rows = RU.with_evidence(RU.flag_rows(scored), "is_outlier", "outlier_index")
    return RU.top_evidence(rows, "row_key").select("row_key", "n_flags", "outlier_score", "evidence")


@job
def q_model_binary(spark, sf):
    rows = _generalized(spark, sf)
    model = M.fit_binary(rows, SC.GENERALIZED_FEATURES, "is_bad", iterations=5, depth=4)
    return M.score_binary(model, rows, "unsw-nb15", SC.GENERALIZED_FEATURES).select("row_key", "prediction", "attack_probability", "risk_level")


@job
def q_model_multiclass(spark, sf):
    rows = _generalized(spark, sf)
    model = M.fit_multiclass(rows, SC.GENERALIZED_FEATURES, "actual", SC.CICIDS_CLASSES, trees=10, depth=5)
    return M.score_multiclass(model, rows, "cicids2017", SC.GENERALIZED_FEATURES).select("row_key", "prediction", "confidence", "risk_level")


def class_rows(spark, sf):
    """``lineitem`` as flows whose class follows from steps of two features, one row in nine mislabelled."""
    line, names = V.table(spark, sf, "lineitem"), F.array(*[F.lit(c) for c in V.ACTUAL])
    steps = F.floor(F.col("l_quantity") / 10) + F.floor(F.col("l_discount") * 50) + 2 * (F.col("l_returnflag") == "R").cast("int")
    wrong = ((F.col("l_orderkey") * 3 + F.col("l_linenumber")) % 9 == 0).cast("int")
    held_out = F.crc32(F.encode(F.col("row_key"), "UTF-8")) % 4 == 0
    rows = line.select(*V.flow_columns(), (F.col("l_discount") * 100).alias("loss"), F.get(names, ((steps + wrong) % 5).cast("int")).alias("actual"))
    return rows.withColumn("held_out", held_out)


CLASS_FEATURES = ["fwd_pkts", "bwd_pkts", "fwd_bytes", "duration", "dst_port", "loss"]


@job
def q_model_boosted(spark, sf):
    """Held-out flows scored by boosted trees that learned from the others, saved and loaded again."""
    rows = class_rows(spark, sf)
    model = BO.fit_boosted(rows.where("not held_out"), CLASS_FEATURES, "actual", V.ACTUAL, rounds=12, depth=4, rate=0.3)
    path = scratch_path(spark, "boosted-model")
    BO.save(spark, model, path)
    probs = BO.boosted_probabilities(BO.load(spark, path), rows.where("held_out"))
    best = F.array_position("probs", F.array_max("probs")).cast("int") - 1
    return probs.select(
        "row_key", "actual", F.get(F.array(*[F.lit(c) for c in V.ACTUAL]), best).alias("prediction"),
        F.round(F.array_max("probs"), 4).alias("confidence"),
    )


@job
def q_model_telemetry(spark, sf):
    """Flows scored by the generalized model (saved and loaded again) with anomaly telemetry."""
    train = _generalized(spark, sf)
    path = scratch_path(spark, "generalized-model")
    M.save(M.fit_generalized(train, "is_bad", iterations=5, depth=4), path)
    model = M.load(path)
    flows = V.flows(spark, sf).select("flow_seq", *FL.header_columns(), *FL.generalized_columns())
    trees = FO.load(FO.fit(flows, SC.GENERALIZED_FEATURES))
    scored = M.score_binary(model, flows, "generalized", missing="null")
    return M.with_telemetry(scored, model, trees).select(
        "flow_seq", "prediction", "risk_score", "anomaly_score", "is_anomaly", "generalized_prob", "generalized_prediction"
    )


def _stream_source(spark, sf) -> str:
    """The packets as files of a stream, in arrival order, then the drain row."""
    packets = V.packets(spark, sf)
    path = scratch_path(spark, "packet-stream")
    packets.write.mode("append").parquet(path)
    ST.drain_packet(spark).write.mode("append").parquet(path)
    return path


@job
def q_stream_flows(spark, sf):
    """Flows of the packet stream (idle timeout and drain), read from the sink."""
    source = _stream_source(spark, sf)
    out = scratch_path(spark, "stream-flows")
    # everything is read in one micro-batch
    buckets = ST.buckets_for(spark.read.parquet(source).count())
    flows = ST.stream_flows(packet_stream(spark, source), V.IDLE_SECONDS, "1 day", buckets=buckets)
    writer = flows.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "stream-check"))
    with ST.state_partitions(spark):
        query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).select("flow_seq", *FL.header_columns(), *FL.generalized_columns())


@job
def q_stream_split(spark, sf):
    """The stream's idle splits in the columns of the batch query."""
    rows = q_stream_flows(spark, sf)
    return rows.select(
        "flow_seq", "src_ip", "src_port", F.col("packet_count").alias("packets"), F.col("byte_count").alias("bytes"),
        F.round("duration", 6).alias("seconds"), "termination_reason",
    )


def _parts(spark, sf, view, parts: int = 3):
    """Packets in arrival order, in parts, then the drain row: what a stream is fed step by step."""
    packets = view(spark, sf)
    end = packets.agg((F.max("packet_seq") + 1).alias("n")).scalar()
    for i in range(parts):
        yield packets.where(F.floor(F.col("packet_seq") * parts / end) == i)
    yield ST.drain_packet(spark)


def fed_monitor(spark, sf, score, session_id: str = "mon-1", lateness: str = "1 day", view=V.packets) -> Monitor:
    """A monitor after a stream that was stopped and went on between the parts of its packets."""
    monitor = Monitor(spark, scratch_path(spark, "monitor"), score, session_id)
    source = scratch_path(spark, "packet-stream")
    for part in _parts(spark, sf, view):
        part.write.mode("append").parquet(source)
        flows = ST.stream_flows(packet_stream(spark, source), V.IDLE_SECONDS, lateness, with_late=True)
        query = monitor.start(flows, available_now=True)
        query.awaitTermination()
    monitor.stop(query)
    return monitor


@job
def q_stream_incidents(spark, sf):
    """Micro-batches scored, stored and merged into the incident store, as the store is after the last one."""
    found = fed_monitor(spark, sf, V.score_flows).incidents()
    return found.select("title", "src_ip", "attack_category", "flow_count", "severity", "risk_score", S.iso_time(F.col("first_seen")).alias("first_seen"),
                        S.iso_time(F.col("last_seen")).alias("last_seen"))


@job
def q_stream_counters(spark, sf):
    """Counters of a session as its micro-batches wrote them."""
    return fed_monitor(spark, sf, V.score_flows).live_counters()


@job
def q_stream_recent(spark, sf):
    """The newest flows that a running monitor keeps at hand."""
    return fed_monitor(spark, sf, V.score_flows).recent(50).select("flow_seq", "src_ip", "prediction", S.iso_time(F.col("timestamp")).alias("timestamp"))


@job
def q_stream_scores(spark, sf):
    """A stream scored by the generalized model and the isolation forest, both read from their files once."""
    train, root = _generalized(spark, sf), scratch_path(spark, "models")
    M.save(M.fit_generalized(train, "is_bad", iterations=5, depth=4), f"{root}/model")
    FO.fit(train, SC.GENERALIZED_FEATURES, key="row_key").write.parquet(f"{root}/forest")
    stored = fed_monitor(spark, sf, M.stream_scorer(spark, f"{root}/model", f"{root}/forest")).flows()
    return stored.select("flow_seq", "prediction", "risk_score", "anomaly_score", "is_anomaly", "generalized_prob", "generalized_prediction")


def delayed_packets(spark, sf):
    """Packets that arrive out of order: one in five 37 places late, one in 101 far later."""
    seq = F.col("packet_seq")
    delay = F.when(seq % 101 == 0, 1500).when(seq % 5 == 0, 37).otherwise(0)
    return V.packets(spark, sf).withColumn("packet_seq", (seq + delay) * 4096 + seq % 4096)


@job
def q_stream_gaps(spark, sf):
    """Gap statistics of a stream whose packets arrive out of order over several micro-batches, and its late packets."""
    source, out, check = (scratch_path(spark, x) for x in ("packet-stream", "stream-flows", "stream-check"))
    for part in _parts(spark, sf, delayed_packets, 4):
        part.write.mode("append").parquet(source)
        flows = ST.stream_flows(packet_stream(spark, source), 3650 * 86_400.0, "1 day", with_late=True)
        writer = flows.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True)
        with ST.state_partitions(spark):
            query = writer.start()
        query.awaitTermination()
    names = [f"{side}gap_{m}" for side in ("", "fwd_", "bwd_") for m in ("min", "max", "mean", "total")] + ["first_fwd_gap"]
    return spark.read.parquet(out).select(
        "flow_seq", "termination_reason", "packets", "bytes", *[F.round(F.col(n) / 1e6, 2).alias(n) for n in names]
    )


@job
def q_stored_flows(spark, sf):
    """Scored flows written with defaults, partitioned by source, and read back for one source."""
    path = scratch_path(spark, "flow-table")
    SK.write_flows(V.scored(spark, sf), path)
    return R.recent_flows(spark.read.parquet(path), "pcap", 50).select("flow_id", "src_ip", "prediction")


@job
def q_exported_flows(spark, sf):
    path = scratch_path(spark, "export")
    SK.export(V.scored(spark, sf), path, "json")
    return spark.read.json(path)


@job
def q_result_sample(spark, sf):
    """Every scored row, as the result of a run is handed on."""
    return R.result_sample(V.scored(spark, sf)).select("flow_id", "prediction", "risk_score")


@job
def q_csv_scan(spark, sf):
    """Rows from a folder of CSV files whose columns stand in different orders."""
    path, key = scratch_path(spark, "csv"), V.flow_columns()[0]
    line = V.table(spark, sf, "lineitem").select(key, "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag", F.concat("l_linestatus", F.lit(', "x"')).alias("note"))
    line.where("l_returnflag = 'R'").write.option("header", True).csv(f"{path}/a")
    line.where("l_returnflag <> 'R'").select("note", "l_returnflag", "l_extendedprice", "row_key", "l_quantity").write.option("header", True).csv(f"{path}/b")
    rows = read_csv_folder(spark, path)
    return rows.select("row_key", "l_quantity", "l_extendedprice", "l_returnflag", "note", F.col("l_shipdate").isNotNull().alias("dated"))


@job
def q_prediction_log(spark, sf):
    path = scratch_path(spark, "prediction-log")
    SK.write_predictions(V.predictions(spark, sf), path, "batch")
    return spark.read.parquet(path).select(
        "prediction_id", S.iso_time(F.col("timestamp")).alias("timestamp"), "dataset", "prediction", "is_attack", "attack_probability", "confidence",
        "risk_score", "risk_level", "input_source")


@job
def q_job_log(spark, sf):
    """Jobs as their latest events tell them: each was queued with its size and ended, or failed, later."""
    jobs = V.scored(spark, sf).groupBy("job_id").agg(
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.count(F.lit(1)).alias("n"), F.count_if("is_attack").alias("hits"))
    none = {f.split()[0]: F.lit(None).cast(f.split()[1]) for f in SK.JOB_SCHEMA.split(", ")}
    queued = {"job_id": F.col("job_id"), "event_ts": F.col("first"), "filename": F.concat("job_id", F.lit(".csv")), "file_type": F.lit("csv"),
              "status": F.lit("Processing"), "total_records": F.col("n")}
    bad = F.col("hits") * 2 > F.col("n")
    ended = {"job_id": F.col("job_id"), "event_ts": F.col("last") + F.expr("INTERVAL 1 SECOND"), "status": F.when(bad, "Failed").otherwise("Completed"),
             "processed_records": F.when(~bad, F.col("n")), "attack_records": F.when(~bad, F.col("hits")), "error": F.when(bad, "too many attacks")}
    path = scratch_path(spark, "job-log")
    for event in (queued, ended):
        jobs.select(*[c.alias(name) for name, c in {**none, **event}.items()]).write.mode("append").parquet(path)
    found = SK.current_jobs(spark.read.schema(SK.JOB_SCHEMA).parquet(path))
    return found.select("job_id", "filename", "status", "total_records", "processed_records", "attack_records", "error",
                        S.iso_time(F.col("created_at")).alias("created_at"), S.iso_time(F.col("updated_at")).alias("updated_at"))


@job
def q_session_log(spark, sf):
    """Monitoring sessions from their start and stop events; one that a later start overtakes ends there."""
    per = V.scored(spark, sf).groupBy("session_id").agg(
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.sum("packet_count").alias("p"), F.count(F.lit(1)).alias("n"), F.count_if("is_attack").alias("a"))
    none = F.lit(None).cast("long")
    start = per.select("session_id", F.col("first").alias("event_ts"), F.lit("start").alias("event"), F.lit("stream").alias("interface"),
                       none.alias("packet_count"), none.alias("flow_count"), none.alias("alert_count"))
    stop = per.where("session_id <> 'mon-4'").select(
        "session_id", F.col("last").alias("event_ts"), F.lit("stop").alias("event"), F.lit(None).cast("string").alias("interface"),
        F.col("p").alias("packet_count"), F.col("n").alias("flow_count"), F.col("a").alias("alert_count"))
    path = scratch_path(spark, "session-log")
    for events in (start, stop):
        events.write.mode("append").parquet(path)
    found = SK.session_history(SK.sessions(spark.read.schema(SK.SESSION_SCHEMA).parquet(path)))
    return found.select("session_id", "interface", "status", "packet_count", "flow_count", "alert_count",
                        S.iso_time(F.col("started_at")).alias("started_at"), S.iso_time(F.col("stopped_at")).alias("stopped_at"))


@job
def q_adapt_validate(spark, sf):
    """Flows held against the feature schema by exact names: other columns go, the order is the schema's."""
    flows = V.flows(spark, sf).select("flow_id", *reversed(FL.generalized_columns()))
    rows = A.validate(flows, "generalized")
    return rows.select(*[F.round(c, 3).alias(c) for c in rows.columns])
