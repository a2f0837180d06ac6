"""Spark ML models behind the decisions: binary and multiclass trees, the generalized model with its imputer."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens import schemas as SC
from flowlens.functions import scalars as S
from flowlens.operators import decide as D
from flowlens.operators import forest as FO
from flowlens.operators.evaluate import WEIGHT_CAP

SEED = 42
#: rows of a training partition, which the tree learners keep in memory whole
PART_ROWS = 1 << 19


def _named(classifier):
    """Output columns under names no input table has."""
    return classifier.setPredictionCol("_prediction").setRawPredictionCol("_raw").setProbabilityCol("_probability")


def _safe(features: list[str]) -> list[str]:
    """Column names without the characters ML's column lookup cannot take."""
    return [f"x{i}" for i in range(len(features))]


def model_input(df: DataFrame, features: list[str], missing: str = "zero") -> DataFrame:
    """Feature columns as ``x0 … xn``: bad values 0.0, or null where an imputer fills them."""
    clean = S.clean_double if missing == "zero" else S.finite
    return df.withColumns({x: clean(F.col(f"`{f}`")) for x, f in zip(_safe(features), features)})


def class_weights(df: DataFrame, label: str, cap: float = WEIGHT_CAP) -> DataFrame:
    """Balanced class weights, one row a class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.agg(F.struct(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    return counts.select(label, F.least(F.lit(cap), totals["n"] / (totals["k"] * F.col("_n"))).alias("weight"))


def with_class_weights(df: DataFrame, label: str, cap: float = WEIGHT_CAP) -> DataFrame:
    """Balanced class weights as a column; the join side has one row per class and is sent to the rows, so that no task
    gets all rows of a class."""
    return df.join(F.broadcast(class_weights(df, label, cap)), label)


def in_parts(rows: DataFrame) -> DataFrame:
    """``rows`` of a large table in partitions of about ``PART_ROWS``, whatever the files' splits hold."""
    parts = -(-rows.count() // PART_ROWS)
    return rows.repartition(max(parts, rows.sparkSession.sparkContext.defaultParallelism)) if parts > 1 else rows


def fit_binary(df: DataFrame, features: list[str], label: str, iterations: int = 100, depth: int = 5) -> PipelineModel:
    xs = _safe(features)
    rows = model_input(df, features).withColumn("y", F.col(label).cast("double"))
    gbt = GBTClassifier(labelCol="y", featuresCol="v", maxIter=iterations, maxDepth=depth, seed=SEED)
    return Pipeline(stages=[VectorAssembler(inputCols=xs, outputCol="v"), _named(gbt)]).fit(in_parts(rows.select(*xs, "y")))


def fit_generalized(df: DataFrame, label: str, iterations: int = 100, depth: int = 5) -> PipelineModel:
    """The 10-feature model; absent values take the training median."""
    xs = _safe(SC.GENERALIZED_FEATURES)
    rows = model_input(df, SC.GENERALIZED_FEATURES, missing="null").withColumn("y", F.col(label).cast("double"))
    filled = [f"{x}_f" for x in xs]
    gbt = GBTClassifier(labelCol="y", featuresCol="v", maxIter=iterations, maxDepth=depth, seed=SEED)
    stages = [Imputer(inputCols=xs, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="v"), _named(gbt)]
    return Pipeline(stages=stages).fit(in_parts(rows.select(*xs, "y")))


def fit_multiclass(df: DataFrame, features: list[str], label: str, classes: list[str], trees: int = 100, depth: int = 8) -> PipelineModel:
    """A weighted random forest over many classes; ``boosting.fit_boosted`` is the boosted form."""
    xs = _safe(features)
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    rows = with_class_weights(model_input(df, features), label).withColumn("y", index.cast("double")).where("y >= 0")
    forest = RandomForestClassifier(
        labelCol="y", featuresCol="v", weightCol="weight", numTrees=trees, maxDepth=depth, seed=SEED
    )
    return Pipeline(stages=[VectorAssembler(inputCols=xs, outputCol="v"), _named(forest)]).fit(in_parts(rows.select(*xs, "y", "weight")))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def _scored(model: PipelineModel, df: DataFrame, features: list[str], missing: str = "zero") -> DataFrame:
    out = model.transform(model_input(df, features, missing)).withColumn("_p", vector_to_array("_probability"))
    return out.select(*[f"`{c}`" for c in df.columns], "_p")


def attack_probabilities(model: PipelineModel, df: DataFrame, features: list[str], name: str = "p", missing: str = "zero") -> DataFrame:
    return _scored(model, df, features, missing).withColumn(name, F.get("_p", F.lit(1))).drop("_p")


def class_probabilities(model: PipelineModel, df: DataFrame, features: list[str], classes: list[str], name: str = "probs") -> DataFrame:
    """Probability array in class order, 0.0 for classes the training data did not hold."""
    full = F.array(*[F.coalesce(F.get("_p", F.lit(i)), F.lit(0.0)) for i in range(len(classes))])
    return _scored(model, df, features).withColumn(name, full).drop("_p")


def score_binary(model: PipelineModel, df: DataFrame, dataset: str, features: list[str] | None = None, missing: str = "zero") -> DataFrame:
    names = features or SC.FEATURES[SC.model_of(dataset)]
    return D.decide_binary(attack_probabilities(model, df, names, "p", missing), "p", dataset).drop("p")


def score_multiclass(model: PipelineModel, df: DataFrame, dataset: str, features: list[str] | None = None) -> DataFrame:
    names = features or SC.FEATURES[SC.model_of(dataset)]
    probs = class_probabilities(model, df, names, SC.classes_of(dataset))
    return D.decide_multiclass(probs, "probs", dataset).drop("probs")


def score_boosted(model, df: DataFrame, dataset: str) -> DataFrame:
    """Decisions of a boosted multiclass model (``boosting.fit_boosted``) over the dataset's classes."""
    from flowlens.operators.boosting import boosted_probabilities

    return D.decide_multiclass(boosted_probabilities(model, df, "probs"), "probs", dataset).drop("probs")


def with_telemetry(scored: DataFrame, generalized: PipelineModel, trees) -> DataFrame:
    """Adds anomaly score and flag and the generalized model's opinion to every scored flow, in the same pass.

    Where the generalized columns are absent both are null, not a score of an all-zero row.
    """
    if any(f not in scored.columns for f in SC.GENERALIZED_FEATURES):
        nothing = {"anomaly_score": "double", "is_anomaly": "boolean", "generalized_prob": "double", "generalized_prediction": "string"}
        return scored.withColumns({c: F.lit(None).cast(t) for c, t in nothing.items()})
    rows = attack_probabilities(generalized, scored, SC.GENERALIZED_FEATURES, "_g", missing="null")
    rows = FO.with_decision(rows, trees, SC.GENERALIZED_FEATURES, SC.THRESHOLDS["isolation_forest"])
    name = F.when(F.col("_g") >= SC.THRESHOLDS["generalized"], "Attack").otherwise("Normal")
    return rows.withColumns({
        "anomaly_score": F.round("anomaly_score", 4), "generalized_prob": F.round("_g", 4), "generalized_prediction": name,
    }).drop("_g")


def stream_scorer(spark: SparkSession, model_path: str, forest_path: str):
    """The scoring step of a stream: model and forest are read once, when the stream starts, and applied to each batch."""
    from flowlens.operators.flows import generalized_columns, header_columns

    model, trees = load(model_path), FO.load(spark.read.parquet(forest_path))

    def score(closed: DataFrame) -> DataFrame:
        rows = closed.select("flow_seq", *header_columns(), *generalized_columns())
        return with_telemetry(score_binary(model, rows, "generalized", missing="null"), model, trees)

    return score


def single_row(spark: SparkSession, features: dict, required: list[str]) -> DataFrame:
    """One flow given as a dict, absent or bad features 0.0: input of the same operators as a whole table."""
    from flowlens.operators.adapt import lenient_features

    row = spark.createDataFrame([({k: str(v) for k, v in features.items()},)], "features map<string,string>")
    return row.select(*lenient_features(F.col("features"), required))
