"""Attributions, feature importances and recommendations per row. Lookup tables are fixed and tiny."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens import schemas as SC
from flowlens.functions import scalars as S

# The ten features shown per model
SHOWN_FEATURES = {
    "cicids": [
        "Destination Port", "Init_Win_bytes_backward", "Init_Win_bytes_forward", "min_seg_size_forward",
        "Fwd IAT Min", "Flow IAT Min", "Bwd Packets/s", "Flow Duration", "Avg Bwd Segment Size", "Flow IAT Mean",
    ],
    "unsw": [
        "sttl", "ct_state_ttl", "sbytes", "dbytes", "rate", "dur", "sload", "dload", "ct_srv_src", "ct_dst_src_ltm",
    ],
    "generalized": SC.GENERALIZED_FEATURES,
}


def top_features(model: str) -> Column:
    """Array of (feature, value, importance, direction) for the model's ten shown features."""
    cells = []
    for name in SHOWN_FEATURES[model]:
        v = S.clean_double(F.col(f"`{name}`"))
        cells.append(F.struct(
            F.lit(name).alias("feature"), F.round(v, 2).alias("value"), S.importance(v).alias("importance"),
            S.direction(v).alias("direction"),
        ))
    return F.array(*cells)


def attribution_table(spark: SparkSession, dataset: str | None = None) -> DataFrame:
    """Global attribution bases (ten per dataset): dataset, feature, base, description."""
    wanted = SC.ATTRIBUTION_BASES if dataset is None else {SC.resolve_dataset(dataset): SC.ATTRIBUTION_BASES[SC.resolve_dataset(dataset)]}
    rows = [(d, *row) for d, table in wanted.items() for row in table]
    return spark.createDataFrame(rows, "attribution_dataset string, feature string, base double, description string")


def explain_rows(df: DataFrame, dataset: str, row_key: str, keep: int = 10) -> DataFrame:
    """One row per (row, feature): importance from the value and the feature's base, the ``keep`` highest per row.

    Ranking happens inside the row's own array of at most ten cells, so nothing is shuffled.
    """
    bases = SC.ATTRIBUTION_BASES[SC.resolve_dataset(dataset)]
    cells = []
    for name, base, description in bases:
        v = S.clean_double(F.col(f"`{name}`"))
        cells.append(F.struct(
            F.round(F.abs(v) * 0.05 + base, 4).alias("importance"), F.lit(-len(cells)).alias("tie"),
            F.lit(name).alias("feature"), F.round(v, 2).alias("value"), S.direction(v).alias("direction"),
            F.lit(description).alias("description"),
        ))
    best = F.slice(F.sort_array(F.array(*cells), asc=False), 1, keep)
    return df.select(F.col(row_key), F.inline(best)).drop("tie")


def unpivot_features(df: DataFrame, row_key: str, features: list[str]) -> DataFrame:
    cells = F.array(*[
        F.struct(F.lit(n).alias("feature"), S.clean_double(F.col(f"`{n}`")).alias("value")) for n in features
    ])
    return df.select(F.col(row_key), F.inline(cells))


def attribution_lookup(values: DataFrame, dataset: str) -> DataFrame:
    """Join form of ``explain_rows`` for data already in (row, feature, value) shape."""
    bases = F.broadcast(attribution_table(values.sparkSession, dataset).drop("attribution_dataset"))
    return values.join(bases, "feature").withColumn("importance", F.round(F.abs("value") * 0.05 + F.col("base"), 4))


def recommendation_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SC.RECOMMENDATIONS.items()), "prediction string, recommendations array<string>")


def recommend(scored: DataFrame) -> DataFrame:
    """Recommendations for attack rows: those of the class, else the default list; none for normal rows."""
    table = F.broadcast(recommendation_table(scored.sparkSession))
    default = F.array(*[F.lit(t) for t in SC.DEFAULT_RECOMMENDATIONS])
    return scored.join(table, "prediction", "left").withColumn(
        "recommendations", F.when(F.col("is_attack"), F.coalesce("recommendations", default))
    )


def incident_attributions(incidents: DataFrame, dataset: str | None = None) -> DataFrame:
    """Each incident with the global attributions of its dataset (``dataset`` column, else the given one).

    The ten bases per dataset are part of the plan, so the lookup is a map access in the row, not a join.
    """
    if dataset is not None:
        wanted = F.lit(SC.resolve_dataset(dataset))
    else:
        names = [x for d, shown in SC.DISPLAY_NAME.items() for x in (F.lit(shown), F.lit(d))]
        wanted = F.try_element_at(F.create_map(*names), F.col("dataset"))
    tables = []
    for name, bases in SC.ATTRIBUTION_BASES.items():
        cells = [
            F.struct(F.lit(f).alias("feature"), F.lit(b).alias("base"), F.lit(text).alias("description")) for f, b, text in bases
        ]
        tables += [F.lit(name), F.array(*cells)]
    found = F.try_element_at(F.create_map(*tables), wanted)
    return incidents.select("*", wanted.alias("attribution_dataset"), F.inline_outer(found))


def global_ranking(attributions: DataFrame) -> DataFrame:
    """(rank, feature, mean |attribution|) over (feature, attribution) rows; one row per feature is ranked."""
    means = attributions.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_abs"))
    return means.select(
        F.rank().over(Window.orderBy(F.round("mean_abs", 6).desc())).alias("rank"), "feature",
        F.round("mean_abs", 4).alias("mean_abs"),
    )


def search_attributions(attributions: DataFrame, text: str) -> DataFrame:
    return attributions.where(F.lower("feature").contains(text.lower()))
