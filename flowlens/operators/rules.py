"""Explainable behaviour rules over an arbitrary flow table: volumetric, scanning, asymmetric, exfiltration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens import schemas as SC
from flowlens.functions.quantiles import quantile_row
from flowlens.plans.mapping import pick
from flowlens.session import materialize

RATE_FLOOR, RATE_SPREAD = 5_000.0, 3.0
BYTES_FLOOR, BYTES_SPREAD = 10_000_000.0, 4.0
SCAN_PORTS = 15
PROBE_ROWS = 5
ASYMMETRIC_PACKETS = 20


def number(column: Column) -> Column:
    """A double; null, NaN and text that is no number count as 0.0, infinities stay."""
    return F.coalesce(F.nanvl(column.try_cast("double"), F.lit(0.0)), F.lit(0.0))


def rule_seconds(duration: Column) -> Column:
    """Duration in seconds, read as microseconds when it is large."""
    return F.when(duration > 500.0, duration / 1e6).otherwise(F.greatest(duration, F.lit(1e-6)))


def dispersion_threshold(q1: float, q3: float, floor: float, spread: float) -> float:
    return max(floor, q3 + spread * (q3 - q1)) if q3 > q1 else floor


@dataclass(frozen=True)
class RuleInputs:
    """The columns the rules read, as expressions; None where the table has no such column."""

    rate: Column | None
    port: Column | None
    source: Column | None
    forward: Column | None
    backward: Column | None
    volume: Column | None


def rule_inputs(columns: list[str]) -> RuleInputs:
    def col(role: str) -> Column | None:
        name = pick(columns, SC.RULE_COLUMNS[role])
        return None if name is None else F.col(f"`{name}`")

    def num(role: str) -> Column | None:
        return None if col(role) is None else number(col(role))

    rate = num("rate")
    if rate is None and num("packets") is not None and num("duration") is not None:
        rate = num("packets") / rule_seconds(num("duration"))
    source = col("source")
    return RuleInputs(
        rate=rate, port=num("port"), forward=num("forward"), backward=num("backward"), volume=num("bytes"),
        source=None if source is None else F.coalesce(source.cast("string"), F.lit("nan")),
    )


def measured(df: DataFrame, inputs: RuleInputs) -> DataFrame:
    """The measures ``dos`` and ``exfil`` of every row, as far as the table has them, written once."""
    measures = {"dos": inputs.rate, "exfil": inputs.volume}
    return materialize(df.select(*[v.alias(k) for k, v in measures.items() if v is not None]), "rule-measures")


def thresholds(df: DataFrame, inputs: RuleInputs, written: DataFrame | None = None) -> dict[str, float]:
    """Rate and volume thresholds from the table's quartiles; ``written``: the table's measures, if they are at hand."""
    limits = {"dos": (RATE_FLOOR, RATE_SPREAD), "exfil": (BYTES_FLOOR, BYTES_SPREAD)}
    if inputs.rate is None and inputs.volume is None:
        return {}
    written = measured(df, inputs) if written is None else written
    quartiles = quantile_row(written, written.columns, [0.25, 0.75], stored=True)
    return {k: dispersion_threshold(q[0], q[1], *limits[k]) for k, q in quartiles.items()}


def probing_sources(df: DataFrame, source: Column, port: Column) -> DataFrame:
    """Sources that tried at least ``SCAN_PORTS`` different ports. Distinct pairs come first, combined map-side, so a
    source with most of the rows costs no more than its number of ports."""
    pairs = df.select(source.alias("probing_source"), port.alias("port")).distinct()
    return pairs.groupBy("probing_source").agg(F.count(F.lit(1)).alias("ports")).where(F.col("ports") >= SCAN_PORTS)


def flag_rows(df: DataFrame) -> DataFrame:
    """``df`` with ``rate`` and ``volume`` measures and the boolean rule columns ``dos, scan, asym, exfil``."""
    inputs = rule_inputs(df.columns)
    limits = thresholds(df, inputs)
    no = F.lit(False)
    missing = F.lit(None).cast("double")
    measures = {
        "rule_rate": missing if inputs.rate is None else inputs.rate,
        "rule_volume": missing if inputs.volume is None else inputs.volume,
        "rule_port": missing if inputs.port is None else inputs.port,
        "rule_forward": missing if inputs.forward is None else inputs.forward,
    }
    asym = no
    if inputs.forward is not None and inputs.backward is not None:
        asym = (inputs.forward >= ASYMMETRIC_PACKETS) & (inputs.backward == 0)
    flags = {
        "dos": no if inputs.rate is None else inputs.rate > limits["dos"],
        "asym": asym,
        "exfil": no if inputs.volume is None else inputs.volume > limits["exfil"],
    }
    if inputs.port is None or (inputs.source is None and inputs.backward is None):
        flags["scan"] = no
        return df.withColumns({**measures, **flags})
    if inputs.source is None:
        probe = (inputs.backward == 0) & (inputs.port > 0)
        probes = df.agg(F.count_if(probe).alias("n")).scalar()
        flags["scan"] = probe & (probes > PROBE_ROWS)
        return df.withColumns({**measures, **flags})
    probing = probing_sources(df, inputs.source, inputs.port).select("probing_source")
    joined = df.withColumns({**measures, **flags}).join(probing, inputs.source == F.col("probing_source"), "left")
    return joined.withColumn("scan", F.col("probing_source").isNotNull()).drop("probing_source")


def indicator_summary(flagged: DataFrame) -> DataFrame:
    """One row per indicator: rows hit, share of all rows, peak measure, whether detected."""
    peaks = {
        "dos": F.round(F.max("rule_rate"), 2), "scan": F.lit(None).cast("double"), "asym": F.lit(None).cast("double"),
        "exfil": F.round(F.max("rule_volume") / 1048576, 2),
    }
    total = F.count(F.lit(1))
    counted = flagged.agg(
        total.alias("total"), *[F.count_if(F.col(k)).alias(k) for k in SC.INDICATORS],
        *[peaks[k].alias(f"{k}_peak") for k in SC.INDICATORS],
    )
    rows = []
    for key, (ident, name, category, severity, _flag) in SC.INDICATORS.items():
        n = F.col(key)
        rows.append(F.struct(
            F.lit(ident).alias("indicator_id"), F.lit(name).alias("name"), F.lit(category).alias("category"),
            F.lit(severity).alias("severity"), (n > 0).alias("detected"), n.alias("affected_records_count"),
            F.when(F.col("total") > 0, F.round(n * 100.0 / F.col("total"), 2)).otherwise(0.0).alias("affected_percentage"),
            F.when(n > 0, F.col(f"{key}_peak")).alias("peak"),
        ))
    return counted.select(F.inline(F.array(*rows)))


def with_evidence(flagged: DataFrame, outlier: str | None = None, score: str | None = None) -> DataFrame:
    """``indicators`` (flag names), ``n_flags``, ``evidence`` text and ``outlier_score`` per row."""
    def when(key: str, text: Column) -> Column:
        return F.when(F.col(key), text)

    names = [when(k, F.lit(v[4])) for k, v in SC.INDICATORS.items()]
    details = [
        when("dos", F.concat(F.lit("Packet Rate: "), F.format_number("rule_rate", 1), F.lit(" pkts/s"))),
        when("scan", F.concat(F.lit("Dst Port: "), F.col("rule_port").cast("string"))),
        when("asym", F.concat(F.lit("Fwd Pkts: "), F.col("rule_forward").cast("string"), F.lit(", Bwd Pkts: 0"))),
        when("exfil", F.concat(F.lit("Payload Bytes: "), F.format_number("rule_volume", 0))),
    ]
    value = F.lit(0.0) if score is None else F.coalesce(F.col(score), F.lit(0.0))
    if outlier is not None:
        names.append(when(outlier, F.lit(SC.OUTLIER_FLAG)))
        details.append(when(outlier, F.concat(F.lit("Outlier Index: "), F.col(score).cast("string"), F.lit("/100"))))
    hits = F.array_compact(F.array(*names))
    return flagged.withColumns({
        "n_flags": F.size(hits),
        "indicators": F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(SC.NO_FLAG))),
        "evidence": F.when(
            F.size(hits) > 0, F.array_join(F.array_compact(F.array(*details)), "; ")
        ).otherwise(SC.NO_EVIDENCE),
        "outlier_score": value,
    })


def top_evidence(rows: DataFrame, row_key: str, limit: int = 50, fallback: int = 10) -> DataFrame:
    """The rows with most flags (then highest outlier score); the first few rows when nothing is flagged."""
    hit = F.col("n_flags") > 0
    top = rows.orderBy(
        F.col("n_flags").desc(), F.when(hit, F.col("outlier_score")).otherwise(0.0).desc(), F.col(row_key)
    ).limit(limit)
    # the windows below see at most ``limit`` rows
    everything = Window.partitionBy(F.lit(1))
    ranked = top.withColumns({
        "_any": F.max("n_flags").over(everything) > 0, "_at": F.row_number().over(everything.orderBy(row_key)),
    })
    return ranked.where(hit | (~F.col("_any") & (F.col("_at") <= fallback))).drop("_any", "_at")


def flagged_evidence(rows: DataFrame) -> DataFrame:
    """All rows with a flag, for search and export."""
    return rows.where(F.col("n_flags") > 0)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def key_features(df: DataFrame, columns: list[str] | None = None, limit: int | None = None) -> Column:
    """Map of the numeric columns (the first ``limit`` if given), two decimals, null kept."""
    names = (columns or numeric_columns(df))[:limit]
    return F.map_from_arrays(
        F.array(*[F.lit(n) for n in names]), F.array(*[F.round(F.col(f"`{n}`").cast("double"), 2) for n in names])
    )


def export_evidence(evidence: DataFrame, row_key: str, label: str | None, features: list[str]) -> DataFrame:
    """Evidence as flat rows: comma-joined indicators, ``feature_*`` columns, ``N/A`` for a missing label."""
    actual = F.lit("N/A") if label is None else F.coalesce(F.col(label).cast("string"), F.lit("N/A"))
    return evidence.select(
        F.col(row_key).alias("row_index"), actual.alias("actual_dataset_label"),
        F.array_join("indicators", ", ").alias("potential_threat_indicators"),
        F.col("outlier_score").alias("statistical_outlier_score"), F.col("evidence").alias("evidence_details"),
        *[F.try_element_at("key_features", F.lit(n)).alias(f"feature_{n}") for n in features],
    )


def search_evidence(evidence: DataFrame, text: str, label: str) -> DataFrame:
    """Evidence rows whose label, evidence text or an indicator contains ``text``."""
    q = text.lower()
    return evidence.where(
        F.lower(F.coalesce(F.col(label), F.lit(""))).contains(q) | F.lower("evidence").contains(q)
        | F.exists("indicators", lambda i: F.lower(i).contains(q))
    )
