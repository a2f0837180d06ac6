"""Summaries, lists and searches over scored flows and the prediction log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens import schemas as SC
from flowlens.functions import scalars as S
from flowlens.operators.decide import alert_columns

ALERT_COLUMNS = [
    "record_id", "timestamp", "dataset", "prediction", "is_attack", "risk_score", "risk_level", "confidence",
    "input_source",
]
# Name fragments that select a dataset's rows
DATASET_MARKS = {
    "isolation_forest": ["iso", "iforest"], "generalized": ["gen"], "unsw-nb15": ["unsw"], "cicids2017": ["cicids"],
}



def _risk_sum() -> Column:
    """Scores have two decimals: added up as whole hundredths, so that a mean does not depend on the order of rows."""
    return F.sum(F.round(F.coalesce("risk_score", F.lit(0.0)) * 100).cast("long")) / 100.0


def _counts() -> list[Column]:
    attack = F.col("is_attack")
    total = F.count(F.lit(1))
    return [
        total.alias("total_records"), F.count_if(~attack).alias("benign_count"), F.count_if(attack).alias("attack_count"),
        S.percent(F.count_if(attack), total).alias("attack_percentage"),
        F.coalesce(F.round(_risk_sum() / total, 2), F.lit(0.0)).alias("average_risk_score"),
        F.count_if(F.col("risk_level") == "High").alias("high_risk_count"),
        F.count_if(F.col("risk_level") == "Critical").alias("critical_risk_count"),
    ]


def batch_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(*_counts())


def job_summaries(scored: DataFrame) -> DataFrame:
    return scored.groupBy("job_id").agg(*_counts())


def category_distribution(scored: DataFrame, normal: str = "BENIGN") -> DataFrame:
    category = F.coalesce("prediction", F.lit(normal))
    return scored.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "category")


def risk_distribution(scored: DataFrame) -> DataFrame:
    """Rows per risk band, every band present, an unknown level counted as Low."""
    level = F.coalesce("risk_level", F.lit("Low"))
    found = scored.groupBy(level.alias("risk_level")).agg(F.count(F.lit(1)).alias("n"))
    bands = scored.sparkSession.createDataFrame(list(enumerate(SC.RISK_BANDS)), "band int, risk_level string")
    return bands.join(found, "risk_level", "left").select("band", "risk_level", F.coalesce("n", F.lit(0)).alias("n"))


def summary_with_maps(scored: DataFrame) -> DataFrame:
    """The batch summary with category and risk maps (sizes bounded by the vocabularies)."""
    per_class = scored.groupBy("prediction", "risk_level").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_attack").alias("attacks"), _risk_sum().alias("risk")
    )

    # the few rows per class and band are summed by class, by band and overall in one step
    sums = per_class.groupingSets(
        [[F.col("prediction")], [F.col("risk_level")], []], "prediction", "risk_level"
    ).agg(F.grouping_id().alias("level"), *[F.sum(c).alias(c) for c in ("n", "attacks", "risk")])

    def as_map(column: str, level: int) -> Column:
        pairs = F.collect_list(F.when(F.col("level") == level, F.struct(column, "n")))
        return F.map_from_entries(F.array_sort(pairs))

    def overall(column: str) -> Column:
        return F.max(F.when(F.col("level") == 3, F.col(column)))

    total = overall("n")
    return sums.agg(
        F.coalesce(total, F.lit(0)).alias("total_records"), F.coalesce(overall("attacks"), F.lit(0)).alias("attack_count"),
        S.percent(overall("attacks"), total).alias("attack_percentage"),
        F.coalesce(F.round(overall("risk") / total, 2), F.lit(0.0)).alias("average_risk_score"),
        as_map("prediction", 1).alias("category_distribution"), as_map("risk_level", 2).alias("risk_distribution"),
    )


def alert_rows(predictions: DataFrame, flows: DataFrame) -> DataFrame:
    """Prediction log and flow table under one schema."""
    log = predictions.withColumns({
        "record_id": F.col("prediction_id"), "input_source": F.coalesce("input_source", F.lit("manual")),
    })
    table = flows.withColumns({"record_id": F.col("flow_id"), "input_source": F.coalesce("source_type", F.lit("flow"))})
    return log.select(*ALERT_COLUMNS).unionByName(table.select(*ALERT_COLUMNS))


def of_dataset(rows: DataFrame, dataset: str) -> DataFrame:
    marks = DATASET_MARKS[SC.resolve_dataset(dataset)]
    test = F.lit(False)
    for mark in marks:
        test = test | F.col("dataset").ilike(f"%{mark}%")
    return rows.where(test)


def dashboard(alerts: DataFrame, dataset: str) -> DataFrame:
    """Totals and risk bands of one dataset in one aggregate."""
    rows = of_dataset(alerts, dataset)
    total, attacks = F.count(F.lit(1)), F.count_if(F.coalesce("is_attack", F.lit(False)))
    level = F.coalesce("risk_level", F.lit("Low"))
    return rows.agg(
        total.alias("total_analyzed"), attacks.alias("attacks_detected"),
        S.percent(attacks, total).alias("attack_percentage"),
        F.when(total > 0, F.round(_risk_sum() / total, 2)).otherwise(0.0).alias("average_risk_score"),
        *[F.count_if(level == band).alias(f"{band.lower()}_risk_count") for band in SC.RISK_BANDS],
    )


def recent(rows: DataFrame, time: str, key: str, limit: int | None) -> DataFrame:
    ordered = rows.orderBy(F.col(time).desc(), key)
    return ordered if limit is None else ordered.limit(limit)


def history(predictions: DataFrame, dataset: str | None = None, risk_level: str | None = None, limit: int | None = None) -> DataFrame:
    rows = predictions
    if dataset:
        rows = rows.where(F.col("dataset").ilike(f"%{dataset}%"))
    if risk_level:
        rows = rows.where(F.col("risk_level") == risk_level)
    return recent(rows, "timestamp", "prediction_id", limit)


def page(predictions: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of the history with running record ids; only the page itself is numbered."""
    skip = (number - 1) * size
    rows = predictions.orderBy(F.col("timestamp").desc(), "prediction_id").offset(skip).limit(size)
    place = F.row_number().over(Window.orderBy(F.col("timestamp").desc(), "prediction_id"))
    return rows.withColumns({"record_id": place + skip, "warning": S.is_high_risk(F.col("risk_level"))})


#: ranges of an index at most: each is a task and a folder
MAX_RANGES = 1000


def page_index(predictions: DataFrame, path: str, rows_per_range: int = 100_000) -> None:
    """Writes the history in page order, newest first, for ``deep_page``: ``rows/range=<n>`` and a small table ``ranges``
    with the number of rows before each range. Ranges are cut at sampled times, of ``rows_per_range`` rows or as many more
    as keep their number to ``MAX_RANGES``."""
    order = [F.col("timestamp").desc(), F.col("prediction_id")]
    ranges = min(MAX_RANGES, max(1, -(-predictions.count() // rows_per_range)))
    ranged = predictions.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id())
    ranged.sortWithinPartitions(*order).write.mode("overwrite").partitionBy("range").parquet(f"{path}/rows")
    # an empty history has columns, too
    predictions.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/rows/range=-1")
    counts = predictions.sparkSession.read.parquet(f"{path}/rows").groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    counts.withColumn("before", F.coalesce(before, F.lit(0))).coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")


def deep_page(spark: SparkSession, path: str, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of an indexed history: reads the ranges that hold the page, in most cases one,
    whatever the page's number."""
    skip = (number - 1) * size
    hit = (F.col("before") < skip + size) & (F.col("before") + F.col("n") > skip)
    held = spark.read.parquet(f"{path}/ranges").where(hit).orderBy("range").collect()
    rows = spark.read.parquet(f"{path}/rows").where(F.col("range").isin([r["range"] for r in held]))
    order = [F.col("timestamp").desc(), F.col("prediction_id")]
    first = held[0]["before"] if held else 0
    rows = rows.orderBy(*order).offset(max(0, skip - first)).limit(size)
    place = F.row_number().over(Window.orderBy(*order)) + skip
    return rows.drop("range").withColumns({"record_id": place, "warning": S.is_high_risk(F.col("risk_level"))})


def analysis_summary(predictions: DataFrame, limit: int | None = None) -> DataFrame:
    """Counts over all predictions, or over the newest ``limit``."""
    rows = predictions if limit is None else recent(predictions, "timestamp", "prediction_id", limit)
    return rows.agg(
        F.count(F.lit(1)).alias("total_records"), F.count_if(~F.col("is_attack")).alias("normal_records"),
        F.count_if("is_attack").alias("attack_records"),
        F.count_if(S.is_high_risk(F.col("risk_level"))).alias("high_risk_records"),
    )


def warnings(predictions: DataFrame, limit: int | None = None) -> DataFrame:
    """High and critical rows as warnings with the alert's texts."""
    rows = predictions if limit is None else recent(predictions, "timestamp", "prediction_id", limit)
    alert = alert_columns()
    return rows.where(S.is_high_risk(F.col("risk_level"))).select(
        F.concat(F.lit("warn-"), "prediction_id").alias("warning_id"), F.col("prediction_id").alias("record_id"),
        "dataset", F.col("prediction").alias("predicted_category"), "risk_level", "risk_score",
        alert["title"].alias("reason"), alert["description"].alias("recommendation"),
    )


def flows_of_job(flows: DataFrame, job_id: str, order: str = "flow_seq", limit: int | None = None) -> DataFrame:
    rows = flows.where(F.col("job_id") == job_id).orderBy(order)
    return rows if limit is None else rows.limit(limit)


def recent_flows(flows: DataFrame, source_type: str | None = None, limit: int | None = None) -> DataFrame:
    rows = flows if source_type is None else flows.where(F.col("source_type") == source_type)
    return recent(rows, "timestamp", "flow_id", limit)


def last_flows(flows: DataFrame, limit: int | None = None) -> DataFrame:
    """The newest flows, oldest of them first."""
    return recent_flows(flows, None, limit).orderBy("timestamp", F.col("flow_id").desc())


TABS = {
    "all": lambda: F.lit(True),
    "attacks": lambda: F.col("is_attack"),
    "anomalies": lambda: F.col("is_anomaly"),
    "high_risk": lambda: S.is_high_risk(F.col("risk_level")),
    "tcp": lambda: F.upper("protocol") == "TCP",
    "udp": lambda: F.upper("protocol") == "UDP",
}


def search_flows(flows: DataFrame, text: str = "", tab: str = "all") -> DataFrame:
    rows = flows.where(TABS[tab]())
    q = text.lower().strip()
    if not q:
        return rows
    fields = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol", "prediction"]
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))).contains(q)
    return rows.where(hit)


def search_alerts(predictions: DataFrame, text: str) -> DataFrame:
    q = text.lower()
    return predictions.where(
        F.lower("prediction").contains(q) | F.lower("prediction_id").contains(q) | F.lower("dataset").contains(q)
    )


def tab_counts(flows: DataFrame) -> DataFrame:
    return flows.agg(*[F.count_if(test()).alias(f"{name}_count") for name, test in TABS.items()])


def session_counters(flows: DataFrame) -> DataFrame:
    """Per monitoring session: flows, attacks, anomalies, rejected rows and flows per second of event time."""
    span = F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))
    return flows.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("flow_count"), F.count_if("is_attack").alias("attack_count"),
        F.count_if("is_anomaly").alias("anomaly_count"),
        F.count_if(F.col("prediction") == "Unclassifiable").alias("rejected_count"),
        F.round(F.count(F.lit(1)) / F.greatest(F.lit(1.0), span / 1_000_000.0), 6).alias("flows_per_second"),
    )


def result_sample(flows: DataFrame, rows: int | None = None, order: str = "flow_seq") -> DataFrame:
    """The results of a run; with ``rows`` the first of them, each task hands on no more than that."""
    return flows if rows is None else flows.orderBy(order).limit(rows)


def export_results(flows: DataFrame, limit: int | None = None) -> DataFrame:
    """The exported columns, time as ISO text; a cap only when asked for."""
    rows = flows if limit is None else flows.limit(limit)
    return rows.withColumn("timestamp", S.iso_time(F.col("timestamp"))).select(*SC.EXPORT_COLUMNS)
