"""Sinks and run logs: append-only Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from flowlens import schemas as SC
from flowlens.functions import scalars as S


def with_defaults(scored: DataFrame) -> DataFrame:
    """Absent or null scored-flow columns take their stored default."""
    columns = {}
    for name, value in SC.SCORED_DEFAULTS.items():
        columns[name] = F.coalesce(F.col(name), F.lit(value)) if name in scored.columns else F.lit(value)
    return scored.withColumns(columns)


def write_flows(scored: DataFrame, path: str) -> None:
    with_defaults(scored).write.mode("append").partitionBy("source_type").parquet(path)


def prediction_records(scored: DataFrame, input_source: str = "manual") -> DataFrame:
    """Scored rows as prediction-log rows: probabilities 4 decimals, scores 2, nested values native."""
    return scored.select(
        "prediction_id", "timestamp", "dataset", "prediction", "is_attack",
        F.round("attack_probability", 4).alias("attack_probability"), F.round("confidence", 4).alias("confidence"),
        F.round("risk_score", 2).alias("risk_score"), "risk_level", F.lit(input_source).alias("input_source"),
        *[F.col(c) for c in ("top_features", "features") if c in scored.columns],
    )


def write_predictions(scored: DataFrame, path: str, input_source: str = "manual") -> None:
    prediction_records(scored, input_source).write.mode("append").parquet(path)


def export(flows: DataFrame, path: str, form: str = "csv", limit: int | None = None) -> None:
    """The result export as CSV or JSON files."""
    from flowlens.operators.reports import export_results

    rows = export_results(flows, limit)
    writer = rows.write.mode("errorifexists")
    writer.json(path) if form.lower() == "json" else writer.option("header", True).csv(path)


# --- jobs ------------------------------------------------------------------
JOB_SCHEMA = (
    "job_id string, event_ts timestamp, filename string, file_type string, dataset string, status string, "
    "total_records long, processed_records long, attack_records long, error string"
)


def log_job(spark: SparkSession, path: str, job_id: str, **event) -> None:
    """Appends one job event; fields not given stay null and keep their earlier value."""
    fields = [f.split()[0] for f in JOB_SCHEMA.split(", ")]
    row = spark.createDataFrame([tuple(event.get(f) if f != "job_id" else job_id for f in fields)], JOB_SCHEMA)
    row.withColumn("event_ts", F.coalesce("event_ts", F.current_timestamp())).write.mode("append").parquet(path)


def current_jobs(events: DataFrame, limit: int | None = None) -> DataFrame:
    """Latest value of every field per job, newest job first."""
    fields = [c for c in events.columns if c not in ("job_id", "event_ts")]
    jobs = events.groupBy("job_id").agg(
        F.min("event_ts").alias("created_at"), F.max("event_ts").alias("updated_at"),
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("event_ts"))).alias(c) for c in fields],
    )
    rows = jobs.orderBy(F.col("created_at").desc(), "job_id")
    return rows if limit is None else rows.limit(limit)


def observed(scored: DataFrame, name: str = "job") -> tuple[DataFrame, Observation]:
    """``scored`` with counters that fill while it is written: no second pass for the job summary."""
    watch = Observation(name)
    counted = scored.observe(
        watch, F.count(F.lit(1)).alias("processed_records"), F.count_if("is_attack").alias("attack_records"),
        F.count_if(S.is_high_risk(F.col("risk_level"))).alias("high_risk_records"),
    )
    return counted, watch


# --- monitoring sessions ---------------------------------------------------
SESSION_SCHEMA = (
    "session_id string, event_ts timestamp, event string, interface string, packet_count long, flow_count long, "
    "alert_count long"
)


def log_session(spark: SparkSession, path: str, session_id: str, event: str, **fields) -> None:
    names = [f.split()[0] for f in SESSION_SCHEMA.split(", ")]
    values = {"session_id": session_id, "event": event, **fields}
    row = spark.createDataFrame([tuple(values.get(n) for n in names)], SESSION_SCHEMA)
    row.withColumn("event_ts", F.coalesce("event_ts", F.current_timestamp())).write.mode("append").parquet(path)


def sessions(events: DataFrame) -> DataFrame:
    """State per session. Starting a session closes any running one, so a session ends at its own stop or at the
    next start, whichever comes first. There is one row per session in the ordered step."""
    per = events.groupBy("session_id").agg(
        F.min(F.when(F.col("event") == "start", F.col("event_ts"))).alias("started_at"),
        F.max(F.when(F.col("event") == "stop", F.col("event_ts"))).alias("own_stop"),
        F.max("interface").alias("interface"),
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("packet_count", "flow_count", "alert_count")],
    )
    following = F.lead("started_at").over(Window.orderBy("started_at", "session_id"))
    ended = F.least("own_stop", following)
    return per.withColumn("stopped_at", ended).drop("own_stop").withColumn(
        "status", F.when(F.col("stopped_at").isNull(), "Running").otherwise("Stopped")
    )


def active_session(state: DataFrame) -> DataFrame:
    return state.where(F.col("status") == "Running").orderBy(F.col("started_at").desc()).limit(1)


def session_history(state: DataFrame, limit: int | None = None) -> DataFrame:
    rows = state.orderBy(F.col("started_at").desc(), "session_id")
    return rows if limit is None else rows.limit(limit)
