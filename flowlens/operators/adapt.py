"""Arbitrary flow tables to a fixed feature schema: one projection, decided by column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens import schemas as SC
from flowlens.functions import scalars as S
from flowlens.plans.mapping import MappingPlan, resolve, unique_names

MICRO = 1_000_000.0
NO_TIME = 1e-6


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Columns renamed by position, so that names differing in case only, or holding dots, can be told apart."""
    names = unique_names(df.columns)
    renamed = df.toDF(*[f"in_{i}" for i in range(len(names))])
    return renamed, {name: F.col(f"in_{i}") for i, name in enumerate(names)}


def duration_factor(model: str, source: str) -> float | None:
    """Factor the source's name tells, or None when the data has to decide."""
    name = source.lower()
    micros = "us" in name or "micro" in name
    if model == "cicids":
        if micros:
            return 1.0
        return MICRO if "sec" in name or name.endswith("_s") or name == "dur" else None
    if model == "generalized":
        return 1.0 / MICRO if micros or name in ("flow duration", "flow_duration") else None
    return 1.0


def _duration(df: DataFrame, model: str, source: str, value: Column, unit: str | None) -> Column:
    clean = S.clean_double(value)
    if unit is not None:
        to_micros = {"us": 1.0, "ms": 1000.0, "s": MICRO}[unit]
        return clean * (to_micros if model == "cicids" else to_micros / MICRO)
    factor = duration_factor(model, source)
    if factor is None:
        # one number decides the unit of the whole table: a scalar subquery, not a join
        raw = value.try_cast("double")
        top = df.agg(F.max(F.when(F.isnan(raw) | raw.isNull(), 0.0).otherwise(raw)).alias("top")).scalar()
        if model == "cicids":
            return F.when((top > 0) & (top < 500.0), clean * MICRO).otherwise(clean)
        return F.when(top > 50_000.0, clean / MICRO).otherwise(clean)
    if factor == 1.0 / MICRO:
        return clean / MICRO
    return clean * factor


def _formulas(model: str, v) -> dict:
    """Derived features; ``v`` gives a feature that is already there."""
    def per(total: Column, count: Column) -> Column:
        return total / S.instead_of_zero(count, 1.0)

    def over_time(total: Column, seconds: Column) -> Column:
        return total / S.instead_of_zero(seconds, NO_TIME)

    if model == "generalized":
        return {
            "total_packets": lambda: v("forward_packets") + v("backward_packets"),
            "total_bytes": lambda: v("forward_bytes") + v("backward_bytes"),
            "packets_per_second": lambda: over_time(v("total_packets"), v("duration_seconds")),
            "bytes_per_second": lambda: over_time(v("total_bytes"), v("duration_seconds")),
            "average_packet_size": lambda: per(v("total_bytes"), v("total_packets")),
        }
    if model == "unsw":
        return {
            "smean": lambda: per(v("sbytes"), v("spkts")),
            "dmean": lambda: per(v("dbytes"), v("dpkts")),
            "rate": lambda: over_time(v("spkts") + v("dpkts"), v("dur")),
            "sload": lambda: over_time(v("sbytes") * 8.0, v("dur")),
            "dload": lambda: over_time(v("dbytes") * 8.0, v("dur")),
        }
    fwd_n, bwd_n = (lambda: v("Total Fwd Packets")), (lambda: v("Total Backward Packets"))
    fwd_b, bwd_b = (lambda: v("Total Length of Fwd Packets")), (lambda: v("Total Length of Bwd Packets"))
    seconds = lambda: v("Flow Duration") / MICRO
    return {
        "Fwd Header Length.1": lambda: v("Fwd Header Length"),
        "Average Packet Size": lambda: per(fwd_b() + bwd_b(), fwd_n() + bwd_n()),
        "Avg Fwd Segment Size": lambda: per(fwd_b(), fwd_n()),
        "Avg Bwd Segment Size": lambda: per(bwd_b(), bwd_n()),
        "Down/Up Ratio": lambda: per(bwd_n(), fwd_n()),
        "Subflow Fwd Packets": fwd_n,
        "Subflow Fwd Bytes": fwd_b,
        "Subflow Bwd Packets": bwd_n,
        "Subflow Bwd Bytes": bwd_b,
        "Flow Bytes/s": lambda: over_time(fwd_b() + bwd_b(), seconds()),
        "Flow Packets/s": lambda: over_time(fwd_n() + bwd_n(), seconds()),
        "Fwd Packets/s": lambda: over_time(fwd_n(), seconds()),
        "Bwd Packets/s": lambda: over_time(bwd_n(), seconds()),
    }


def adapt(
    df: DataFrame,
    dataset: str,
    keep: list[str] | None = None,
    duration_unit: str | None = None,
    partial: bool = False,
) -> DataFrame:
    """``df`` as the dataset's feature schema: strictly ordered doubles, every cell finite.

    ``keep`` carries identity columns through; ``duration_unit`` (us, ms, s) overrides the unit heuristic;
    ``partial`` projects the features that can be had instead of raising when some are missing.
    """
    model = SC.model_of(dataset)
    rows, by_name = positional(df)
    plan = resolve(list(by_name), model)
    if plan.missing and not partial:
        raise ValueError(f"{len(plan.missing)} features cannot be had from the input: {plan.missing[:5]}")

    wanted = [f for f in SC.FEATURES[model] if f not in plan.missing]
    base = {}
    for target, (source, _how) in plan.sources.items():
        if target in ("Flow Duration", "duration_seconds"):
            base[target] = _duration(rows, model, source, by_name[source], duration_unit)
        else:
            base[target] = S.clean_double(by_name[source])
    cleaned = rows.select(
        *[by_name[k].alias(f"keep_{i}") for i, k in enumerate(keep or [])],
        *[base[t].alias(f"f_{SC.FEATURES[model].index(t)}") for t in base],
    )

    def value(name: str) -> Column:
        if name in base:
            return F.col(f"f_{SC.FEATURES[model].index(name)}")
        return formulas[name]()

    formulas = _formulas(model, value)
    return cleaned.select(
        *[F.col(f"keep_{i}").alias(k) for i, k in enumerate(keep or [])],
        *[S.clean_double(value(t)).alias(t) for t in wanted],
    )


def mapping_report(df: DataFrame, dataset: str) -> DataFrame:
    """The plan for ``df`` as rows: target, source, transform type, status."""
    plan: MappingPlan = resolve(unique_names(df.columns), SC.model_of(dataset))
    return df.sparkSession.createDataFrame(
        plan.report(), "target_feature string, source_feature string, transform_type string, status string"
    )


def validate(df: DataFrame, dataset: str) -> DataFrame:
    """The schema's columns in order as finite doubles; raises when one is absent. No aliasing."""
    required = SC.FEATURES[SC.model_of(dataset)]
    absent = [f for f in required if f not in df.columns]
    if absent:
        raise ValueError(f"missing required features: {absent[:5]}")
    return df.select(*[S.clean_double(F.col(f"`{f}`")).alias(f) for f in required])


def lenient_features(features: Column, required: list[str]) -> list[Column]:
    """Required features out of a map column; whatever is absent or not a number is 0.0.

    The exact key counts, or else the last one that is the same without case and outer spaces.
    """
    def value(f: str) -> Column:
        alike = F.filter(F.map_entries(features), lambda e: F.lower(F.trim(e["key"])) == f.lower())
        last = F.try_element_at(alike, F.lit(-1))["value"]
        return F.when(F.map_contains_key(features, F.lit(f)), F.try_element_at(features, F.lit(f))).otherwise(last)

    return [S.clean_double(value(f)).alias(f) for f in required]


def absent_count(features: Column, required: list[str]) -> Column:
    present = F.transform(F.map_keys(features), lambda k: F.lower(F.trim(k)))
    return F.size(F.array_except(F.array(*[F.lit(f.lower()) for f in required]), present))


def lacks_too_many(features: Column, required: list[str]) -> Column:
    """Whether more than a fifth of the required features is absent."""
    return absent_count(features, required) > 0.2 * len(required)


def split_incomplete(df: DataFrame, required: list[str], features: str = "features") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows. Use ``lacks_too_many`` as a column where one pass shall serve both."""
    too_few = lacks_too_many(F.col(features), required)
    return df.where(~too_few), df.where(too_few)
