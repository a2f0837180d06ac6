"""Incidents: attack or anomaly flows correlated by (source, category), merged into the open ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens import schemas as SC
from flowlens.functions import scalars as S

INCIDENT_COLUMNS = [
    "incident_id", "title", "status", "severity", "src_ip", "dst_ip", "attack_category", "flow_count", "risk_score",
    "first_seen", "last_seen", "notes", "analyst",
]


def correlate(scored: DataFrame, order: str = "flow_seq") -> DataFrame:
    """New incidents of a batch of scored flows. All aggregates combine map-side, so a source with most of the
    flows still sends one row per task."""
    category = F.when(F.col("is_attack"), F.col("prediction")).otherwise("Anomaly")
    hits = scored.where(F.col("is_attack") | F.col("is_anomaly")).withColumn("attack_category", category)
    seq = F.col(order)
    grouped = hits.groupBy("src_ip", "attack_category").agg(
        F.count(F.lit(1)).alias("flow_count"),
        F.max("risk_score").alias("risk_score"),
        F.min_by("dst_ip", seq).alias("dst_ip"),
        F.min_by("source_type", seq).alias("source_type"),
        F.min_by("dataset", seq).alias("dataset"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
    )
    return grouped.select(
        S.hashed_id("inc", F.col("src_ip"), F.col("attack_category"), F.col("first_seen")).alias("incident_id"),
        F.concat(F.lit("Potential "), "attack_category", F.lit(" attack from "), "src_ip").alias("title"),
        F.lit("New").alias("status"),
        # severity is a function of risk, so the severity of the highest risk is that of the maximum
        S.incident_severity(S.risk_level(F.col("risk_score"))).alias("severity"),
        "src_ip", "dst_ip", "attack_category", "flow_count", "risk_score", "first_seen", "last_seen",
        F.concat(F.lit("Correlated from "), "source_type", F.lit(" flow analysis ("), "dataset", F.lit(").")).alias("notes"),
        F.lit(None).cast("string").alias("analyst"),
    )


KEYS = ["src_ip", "attack_category"]


def same_key(left: str, right: str) -> Column:
    """Equal sources and categories; null sources are equal too."""
    return F.col(f"{left}.src_ip").eqNullSafe(F.col(f"{right}.src_ip")) & F.col(f"{left}.attack_category").eqNullSafe(F.col(f"{right}.attack_category"))


def _split_takers(incidents: DataFrame) -> DataFrame:
    """``incidents`` with ``takes``: is it the one that takes new flows of its (source, category)?"""
    is_open = F.coalesce(F.col("status").isin(*SC.OPEN_STATUSES), F.lit(False))
    takers = incidents.where(is_open).groupBy(*KEYS).agg(F.min_by("incident_id", F.struct("first_seen", "incident_id")).alias("incident_id"))
    rows = incidents.join(takers.select("incident_id", F.lit(True).alias("takes")), "incident_id", "left")
    return rows.withColumn("takes", is_open & F.coalesce("takes", F.lit(False)))


def _merged(takers: DataFrame, fresh: DataFrame, how: str) -> DataFrame:
    both = takers.alias("o").join(fresh.alias("n"), same_key("o", "n"), how)

    def old(c: str) -> Column:
        return F.col(f"o.{c}")

    def new(c: str) -> Column:
        return F.col(f"n.{c}")

    known = old("incident_id").isNotNull()
    worse = new("risk_score") > F.coalesce(old("risk_score"), F.lit(-1.0))
    merged = {c: F.coalesce(old(c), new(c)) for c in INCIDENT_COLUMNS}
    merged["flow_count"] = F.coalesce(old("flow_count"), F.lit(0)) + F.coalesce(new("flow_count"), F.lit(0))
    merged["risk_score"] = F.when(worse, new("risk_score")).otherwise(old("risk_score"))
    merged["severity"] = F.when(worse, new("severity")).otherwise(old("severity"))
    merged["last_seen"] = F.greatest(old("last_seen"), new("last_seen"))
    merged["first_seen"] = F.least(old("first_seen"), new("first_seen"))
    # a new incident's notes may be null; an existing one keeps its own
    merged["notes"] = F.when(known, old("notes")).otherwise(new("notes"))
    return both.select(*[merged[c].alias(c) for c in INCIDENT_COLUMNS])


def upsert(incidents: DataFrame, fresh: DataFrame) -> DataFrame:
    """``fresh`` merged into ``incidents``: an open incident of the same (source, category) takes the counts, the
    higher risk with its severity and the later time; everything else is kept, or added as new. Where several are open
    for one (source, category), the first of them (by time, then id) takes it."""
    rows = _split_takers(incidents)
    merged = _merged(rows.where("takes"), fresh, "full_outer")
    return merged.unionByName(rows.where("not takes").select(*INCIDENT_COLUMNS))


def changed(incidents: DataFrame, fresh: DataFrame) -> DataFrame:
    """Of ``upsert`` only the incidents that ``fresh`` changes or adds."""
    return _merged(_split_takers(incidents).where("takes"), fresh, "right_outer")


def triage(incidents: DataFrame, updates: DataFrame) -> DataFrame:
    """Analyst updates ``(incident_id, updated_at, status, notes, analyst)`` applied in time order: an empty
    status or analyst and a null note keep the value before."""
    def latest(column: str, empty_counts: bool) -> Column:
        value = F.col(column)
        given = value.isNotNull() if empty_counts else value.isNotNull() & (value != "")
        return F.max_by(F.when(given, value), F.when(given, F.col("updated_at")))

    changes = updates.groupBy("incident_id").agg(
        latest("status", False).alias("new_status"), latest("notes", True).alias("new_notes"),
        latest("analyst", False).alias("new_analyst"),
    )
    return incidents.join(changes, "incident_id", "left").withColumns(
        {c: F.coalesce(F.col(f"new_{c}"), F.col(c)) for c in ("status", "notes", "analyst")}
    ).drop("new_status", "new_notes", "new_analyst")


def list_incidents(incidents: DataFrame, status: str | None = None, severity: str | None = None, limit: int | None = None) -> DataFrame:
    rows = incidents
    if status:
        rows = rows.where(F.col("status") == status)
    if severity:
        rows = rows.where(F.col("severity") == severity)
    rows = rows.orderBy(F.col("last_seen").desc(), "incident_id")
    return rows if limit is None else rows.limit(limit)


def get_incident(incidents: DataFrame, incident_id: str) -> DataFrame:
    return incidents.where(F.col("incident_id") == incident_id)
