"""Column expressions shared by all operators. Everything here stays inside JVM code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIN, SYN, RST, PSH, ACK, URG, ECE, CWE = 1, 2, 4, 8, 16, 32, 64, 128
FLAG_BITS = {"fin": FIN, "syn": SYN, "rst": RST, "psh": PSH, "ack": ACK, "urg": URG, "ece": ECE, "cwe": CWE}


# --- names and numbers -----------------------------------------------------
def normalize_token(name: Column) -> Column:
    """Lower-cased name with runs of ``. _ - /`` and blanks folded to one space."""
    return F.trim(F.regexp_replace(F.lower(F.trim(name)), r"[._\-/\s]+", " "))


def finite(value: Column) -> Column:
    """A double; null, NaN and infinities become null."""
    v = value.try_cast("double")
    return F.when(F.abs(v) < F.lit(float("inf")), v)


def clean_double(value: Column) -> Column:
    """A double; anything that is not a finite number becomes 0.0."""
    return F.coalesce(finite(value), F.lit(0.0))


def instead_of_zero(value: Column, replacement: float) -> Column:
    return F.when(value == 0, F.lit(replacement)).otherwise(value)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def percent(part: Column, total: Column, digits: int = 2) -> Column:
    return F.when(total > 0, F.round(part * F.lit(100.0) / total, digits)).otherwise(F.lit(0.0))


def ratio(part: Column, total: Column) -> Column:
    return F.when(total != 0, part.cast("double") / total).otherwise(F.lit(0.0))


# --- packets ---------------------------------------------------------------
def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def protocol_code(proto: Column) -> Column:
    return F.when(proto == "TCP", 6.0).when(proto == "UDP", 17.0).otherwise(1.0)


def protocol_name(ip_protocol: Column) -> Column:
    """Name of an IP protocol number; 1 and 58 are the two ICMP numbers but only version 4's counts."""
    return (
        F.when(ip_protocol == 6, "TCP").when(ip_protocol == 17, "UDP").when(ip_protocol == 1, "ICMP").otherwise("OTHER")
    )


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def hashed_id(prefix: str, *parts: Column) -> Column:
    """A prefixed id of 256 bits that depends on content only, so a re-run task makes the same one."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.concat(F.lit(f"{prefix}-"), F.sha2(text, 256))


# --- decisions -------------------------------------------------------------
def attack_probability(benign: Column) -> Column:
    return clamp(F.lit(1.0) - benign, 0.0, 1.0)


def risk_score(attack: Column) -> Column:
    return F.round(clamp(attack, 0.0, 1.0) * 100.0, 2)


def risk_level(score: Column) -> Column:
    return F.when(score < 30.0, "Low").when(score < 60.0, "Moderate").when(score < 80.0, "High").otherwise("Critical")


def is_high_risk(level: Column) -> Column:
    return level.isin("High", "Critical")


def incident_severity(level: Column) -> Column:
    return F.when(is_high_risk(level), level).otherwise("Medium")


def alert_severity(level: Column) -> Column:
    return (
        F.when(level == "Critical", "critical")
        .when(level == "High", "high")
        .when(level == "Moderate", "warning")
        .otherwise("info")
    )


def alert_title(level: Column, prediction: Column) -> Column:
    return F.concat(F.lit("Security Alert: "), level, F.lit(" Risk Traffic Detected ("), prediction, F.lit(")"))


def alert_description(score: Column, prediction: Column) -> Column:
    return F.concat(
        F.lit("Network flow evaluated with a risk score of "), score.cast("string"),
        F.lit("/100. Classified as "), prediction, F.lit("."),
    )


def top_class(probs: Column, classes: list[str]) -> Column:
    """First class with the greatest probability."""
    names = F.array(*[F.lit(c) for c in classes])
    return F.element_at(names, F.array_position(probs, F.array_max(probs)).cast("int"))


def top_margin(probs: Column) -> Column:
    ranked = F.sort_array(probs, asc=False)
    return ranked[0] - ranked[1]


def isolation_probability(score: Column, threshold: float) -> Column:
    """Pseudo-probability of an isolation score; lower scores are more anomalous."""
    distance = F.lit(threshold) - score
    return F.round(
        F.when(score < threshold, clamp(distance * 2.0 + 0.5, 0.0, 1.0)).otherwise(
            clamp(distance * 2.0 + 0.5, 0.01, 0.49)
        ),
        4,
    )


def isolation_confidence(score: Column, threshold: float) -> Column:
    return F.round(F.least(F.lit(1.0), F.abs(score - threshold) * 5.0 + 0.5), 4)


def spread_binary(p: Column, classes: list[str], normal: str) -> Column:
    """Class distribution from one attack probability: the rest shares it evenly."""
    others = len(classes) - 1
    return F.array(*[(F.lit(1.0) - p) if c == normal else p / float(others) for c in classes])


def importance(value: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.abs(value) * 0.01 + 0.1), 4)


def direction(value: Column) -> Column:
    return F.when(value > 0, "positive").otherwise("negative")
