"""Live monitoring: completed flows are scored, stored, counted and correlated per micro-batch.

Every write is named by its batch id, so a batch that runs again replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowlens.operators import incidents as I
from flowlens.operators.reports import last_flows, session_counters
from flowlens.sources.sinks import log_session, with_defaults
from flowlens.streaming.flow_state import late_packets, on_time, state_partitions
from flowlens.streaming.incident_store import IncidentStore

COUNTERS = "packets long, flows long, attacks long, anomalies long, high_risk long, late long"


class Monitor:
    """Paths and steps of one monitored stream below ``root`` (a folder all executors share).

    ``recent_rows`` flows, the newest by event time, are kept at hand; with ``recent_seconds`` only those that are not
    older than that, seen from the newest.
    """

    def __init__(self, spark: SparkSession, root: str, score: Callable[[DataFrame], DataFrame], session_id: str,
                 recent_rows: int = 1000, recent_seconds: float | None = None):
        self.spark, self.root, self.score, self.session_id = spark, root.rstrip("/"), score, session_id
        self.recent_rows, self.recent_seconds = recent_rows, recent_seconds
        self.store_of_incidents = IncidentStore(spark, f"{self.root}/incidents")

    def incidents(self, before: int | None = None) -> DataFrame:
        return self.store_of_incidents.current(before)

    def flows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/flows")

    def late(self) -> DataFrame:
        """Packets that came too late to join a flow."""
        return late_packets(self.spark.read.parquet(f"{self.root}/closed"))

    def store(self, batch: DataFrame, batch_id: int) -> None:
        # written first: the stateful operator does not run again for what is derived from its rows
        closed = f"{self.root}/closed/batch={batch_id}"
        seen = Observation(f"closed-{batch_id}")
        batch.observe(
            seen, F.count_if(F.col("termination_reason") == "late").alias("late"),
            F.coalesce(F.sum(F.when(F.col("termination_reason") != "late", F.col("packets"))), F.lit(0)).alias("packets"),
        ).write.mode("overwrite").parquet(closed)
        path = f"{self.root}/flows/batch={batch_id}"
        rows = self.score(on_time(self.spark.read.parquet(closed)))
        rows = with_defaults(rows.withColumns({"session_id": F.lit(self.session_id), "source_type": F.lit("live")}))
        counted = Observation(f"flows-{batch_id}")
        rows.observe(
            counted, F.count(F.lit(1)).alias("flows"), F.count_if("is_attack").alias("attacks"), F.count_if("is_anomaly").alias("anomalies"),
            F.count_if(F.col("risk_level").isin("High", "Critical")).alias("high_risk"),
        ).write.mode("overwrite").parquet(path)
        stored = self.spark.read.parquet(path)
        self._count({**seen.get, **counted.get}, batch_id)
        self._keep_recent(stored, batch_id)
        fresh = f"{self.root}/fresh/batch={batch_id}"
        I.correlate(stored).write.mode("overwrite").parquet(fresh)
        self.store_of_incidents.merge(self.spark.read.parquet(fresh), batch_id)

    def _count(self, values: dict, batch_id: int) -> None:
        """The batch's counters, taken from its writes as they ran."""
        row = [tuple(int(values[c.split()[0]] or 0) for c in COUNTERS.split(", "))]
        self.spark.createDataFrame(row, COUNTERS).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/counters/batch={batch_id}")

    def _keep_recent(self, stored: DataFrame, batch_id: int) -> None:
        """The newest flows so far: those kept before this batch and its own, cut to size."""
        before = self._recent(batch_id, stored) if batch_id > 0 else stored.limit(0)
        newest = last_flows(before.unionByName(stored), self.recent_rows)
        if self.recent_seconds is not None:
            edge = newest.agg(F.max("timestamp").alias("t")).scalar()
            newest = newest.where(F.unix_micros(edge) - F.unix_micros("timestamp") <= int(self.recent_seconds * 1_000_000))
        newest.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/recent/batch={batch_id}")

    def _recent(self, before: int, like: DataFrame) -> DataFrame:
        kept = self.spark.read.schema(like.schema.add("batch", "long")).parquet(f"{self.root}/recent").where(F.col("batch") < before)
        last = kept.agg(F.max("batch")).first()[0]
        return kept.where(F.col("batch") == (-1 if last is None else last)).drop("batch")

    def start(self, flows: DataFrame, available_now: bool = False, interface: str = "stream") -> StreamingQuery:
        """``flows``: of ``flow_state.stream_flows``, with the late packets or without."""
        log_session(self.spark, f"{self.root}/sessions", self.session_id, "start", interface=interface)
        writer = flows.writeStream.foreachBatch(self.store).option("checkpointLocation", f"{self.root}/checkpoint")
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")
        with state_partitions(self.spark):
            return writer.start()

    def stop(self, query: StreamingQuery) -> None:
        """Stops the query and writes the session's counters."""
        query.stop()
        now = self.live_counters().first()
        log_session(
            self.spark, f"{self.root}/sessions", self.session_id, "stop",
            packet_count=now["packets"] or 0, flow_count=now["flows"] or 0, alert_count=now["attacks"] or 0,
        )

    def live_counters(self) -> DataFrame:
        """Totals over the micro-batches so far: one small row a batch, no scan of the stored flows."""
        rows = self.spark.read.schema(f"{COUNTERS}, batch long").parquet(f"{self.root}/counters")
        return rows.agg(*[F.sum(c.split()[0]).alias(c.split()[0]) for c in COUNTERS.split(", ")])

    def counters(self) -> DataFrame:
        return session_counters(self.flows().where(F.col("session_id") == self.session_id))

    def recent(self, limit: int | None = None) -> DataFrame:
        """The newest of the flows at hand, at most ``recent_rows``; the store is not read."""
        kept = self.spark.read.parquet(f"{self.root}/recent")
        last = kept.agg(F.max("batch")).first()[0]
        return last_flows(kept.where(F.col("batch") == last).drop("batch"), limit)
