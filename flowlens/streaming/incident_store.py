"""Incidents kept as changes: a micro-batch writes the incidents that it changes or adds, and nothing else.

``changes/batch=<id>/bucket=<b>`` holds the new state of each incident that the batch touched; an incident's latest change
is its state. Buckets are hashes of (source, category), so a batch reads the history of the buckets it touches only. Every
``compact_every`` batches the states are written together under ``states/batch=<id>`` and reading starts from there, so
the history to be read has a bound. Paths are named by batch, so a batch that runs again replaces its own output and never
sees it: it reads what was there before its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators import incidents as I

INCIDENT_SCHEMA = (
    "incident_id string, title string, status string, severity string, src_ip string, dst_ip string, "
    "attack_category string, flow_count long, risk_score double, first_seen timestamp, last_seen timestamp, "
    "notes string, analyst string"
)
STORED = f"{INCIDENT_SCHEMA}, batch long, bucket int"
#: the batch id of an empty store
START = -1


class IncidentStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 16, compact_every: int = 50):
        self.spark, self.buckets, self.compact_every = spark, buckets, compact_every
        self.folders = {kind: f"{root.rstrip('/')}/{kind}" for kind in ("changes", "states")}
        empty = spark.createDataFrame([], f"{INCIDENT_SCHEMA}, bucket int")
        for folder in self.folders.values():
            empty.coalesce(1).write.mode("ignore").parquet(f"{folder}/batch={START}/bucket=0")

    def _read(self, kind: str) -> DataFrame:
        return self.spark.read.schema(STORED).parquet(self.folders[kind])

    def _bucket(self):
        return F.pmod(F.xxhash64(*I.KEYS), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, kind: str, batch_id: int) -> None:
        # buckets lie side by side in a task, so a folder gets few files
        dealt = rows.withColumn("bucket", self._bucket()).repartition("bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folders[kind]}/batch={batch_id}")

    def current(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The state of every incident (of some buckets), from the batches before ``before``."""
        states, changes = self._read("states"), self._read("changes")
        if before is not None:
            states, changes = states.where(F.col("batch") < before), changes.where(F.col("batch") < before)
        if buckets is not None:
            states, changes = states.where(F.col("bucket").isin(buckets)), changes.where(F.col("bucket").isin(buckets))
        # one number: which states to start from
        base = self._read("states").where(F.lit(True) if before is None else F.col("batch") < before).agg(F.max("batch")).first()[0]
        base = START if base is None else base
        rows = states.where(F.col("batch") == base).unionByName(changes.where(F.col("batch") > base))
        names = [c.split()[0] for c in INCIDENT_SCHEMA.split(", ")]
        latest = rows.groupBy("incident_id").agg(F.max_by(F.struct(*names), "batch").alias("row"))
        return latest.select("row.*")

    def merge(self, fresh: DataFrame, batch_id: int) -> None:
        """Merges a written table of a batch's new incidents; what is written grows with ``fresh`` alone."""
        touched = [r[0] for r in fresh.select(self._bucket().alias("bucket")).distinct().collect()]
        old = self.current(batch_id, touched)
        own = old.alias("o").join(fresh.select(*I.KEYS).distinct().alias("n"), I.same_key("o", "n"), "left_semi")
        self._write(I.changed(own, fresh), "changes", batch_id)
        if batch_id > 0 and batch_id % self.compact_every == 0:
            self.compact(batch_id)

    def compact(self, batch_id: int) -> None:
        """Writes all states as of ``batch_id`` together."""
        self._write(self.current(before=batch_id + 1), "states", batch_id)
