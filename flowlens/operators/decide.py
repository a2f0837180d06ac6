"""Decisions on top of probabilities: class, confidence, risk, alert. Which model made them does not matter here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens import schemas as SC
from flowlens.functions import scalars as S


def _decided(df: DataFrame, dataset: str, prediction: Column, attack: Column, is_attack: Column,
             confidence: Column, margin: Column) -> DataFrame:
    """Decision columns with the stored precision; a row that could not be scored is ``Unclassifiable``.

    What the decisions share is computed first, as columns, so that it is computed once a row.
    """
    shared = {"_prediction": prediction, "_attack": attack, "_is_attack": is_attack, "_confidence": confidence, "_margin": margin}
    prediction, attack, is_attack, confidence, margin = map(F.col, shared)
    failed = prediction.isNull() | attack.isNull()
    score = F.col("_score")
    return df.withColumns(shared).withColumn("_score", F.when(failed, 0.0).otherwise(S.risk_score(attack))).withColumns({
        "dataset": F.lit(SC.DISPLAY_NAME[SC.resolve_dataset(dataset)]),
        "prediction": F.when(failed, "Unclassifiable").otherwise(prediction),
        "is_attack": F.when(failed, False).otherwise(is_attack),
        "confidence": F.when(failed, 0.0).otherwise(F.round(confidence, 4)),
        "attack_probability": F.when(failed, 0.0).otherwise(F.round(attack, 4)),
        "risk_score": score,
        "risk_level": S.risk_level(score),
        "prediction_margin": F.when(failed, 0.0).otherwise(F.round(margin, 4)),
    }).drop(*shared, "_score")


def decide_multiclass(df: DataFrame, probs: str, dataset: str) -> DataFrame:
    """``probs`` is an array in class order; a row is an attack when its top class is not the normal one."""
    dataset = SC.resolve_dataset(dataset)
    classes, normal = SC.classes_of(dataset), SC.NORMAL_LABEL[dataset]
    p = F.col(probs)
    top = S.top_class(p, classes)
    attack = S.attack_probability(F.get(p, F.lit(classes.index(normal))))
    return _decided(df, dataset, top, attack, top != normal, F.array_max(p), S.top_margin(p))


def decide_binary(df: DataFrame, attack: str, dataset: str, threshold: float | None = None) -> DataFrame:
    dataset = SC.resolve_dataset(dataset)
    threshold = SC.THRESHOLDS[dataset] if threshold is None else threshold
    p = F.col(attack)
    hit = p >= threshold
    name = F.when(p.isNotNull(), F.when(hit, "Attack").otherwise(SC.NORMAL_LABEL[dataset]))
    return _decided(df, dataset, name, p, hit, F.greatest(p, 1.0 - p), F.abs(p * 2.0 - 1.0))


def decide_isolation(df: DataFrame, score: str, threshold: float | None = None) -> DataFrame:
    threshold = SC.THRESHOLDS["isolation_forest"] if threshold is None else threshold
    s = F.col(score)
    hit = s < threshold
    confidence = S.isolation_confidence(s, threshold)
    name = F.when(s.isNotNull(), F.when(hit, "Anomaly").otherwise("Normal"))
    return _decided(
        df, "isolation_forest", name, S.isolation_probability(s, threshold), hit, confidence, F.abs(confidence - 0.5)
    )


def threshold_table(spark: SparkSession) -> DataFrame:
    """One row per dataset (four): display name and decision threshold."""
    rows = [(SC.DISPLAY_NAME[d], t) for d, t in SC.THRESHOLDS.items()]
    return spark.createDataFrame(rows, "dataset string, decision_threshold double")


def early_warning(scored: DataFrame, probability: str = "attack_probability") -> DataFrame:
    """Adds the dataset's threshold and whether the attack probability reaches it; ``is_attack`` stays as it is."""
    limits = F.broadcast(threshold_table(scored.sparkSession))
    return scored.join(limits, "dataset", "left").withColumn(
        "early_warning", F.coalesce(F.col(probability) >= F.col("decision_threshold"), F.lit(False))
    )


def alert_columns() -> dict[str, Column]:
    level, prediction = F.col("risk_level"), F.col("prediction")
    return {
        "alert_triggered": S.is_high_risk(level),
        "severity": S.alert_severity(level),
        "title": S.alert_title(level, prediction),
        "description": S.alert_description(F.col("risk_score"), prediction),
    }


# ---------------------------------------------------------------------------
# Fixed values of the deterministic scorer: a logistic model over log(1 + feature), kept so that every decision
# operator can be checked against SQL. name: (weight, mean of the log feature)
# ---------------------------------------------------------------------------
LOGISTIC_BIAS = -0.4
LOGISTIC = {
    "duration_seconds": (-0.12, 5.0),
    "forward_packets": (0.9, 1.0),
    "backward_packets": (-0.7, 0.8),
    "forward_bytes": (0.35, 4.5),
    "backward_bytes": (-0.25, 3.0),
    "total_packets": (0.2, 1.2),
    "total_bytes": (0.15, 5.2),
    "packets_per_second": (0.08, 6.0),
    "bytes_per_second": (0.04, 8.0),
    "average_packet_size": (-0.3, 4.6),
}


def logistic_attributions() -> dict[str, Column]:
    """Exact contribution of each generalized feature to the logit."""
    return {f: F.lit(w) * (F.log1p(F.col(f)) - F.lit(m)) for f, (w, m) in LOGISTIC.items()}


def logistic_probability() -> Column:
    z = sum(logistic_attributions().values(), F.lit(LOGISTIC_BIAS))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
