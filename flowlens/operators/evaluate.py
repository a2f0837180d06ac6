"""Evaluation of scored rows: confusion matrices, reports, threshold sweeps, calibration, splits.

Class vocabularies are small and given or found by a group count, so everything after the first aggregate of each
operator works on rows that do not grow with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.functions import scalars as S
from flowlens.functions.quantiles import exact_quantiles, quantile_row
from flowlens.functions.ranks import hashed_rank, sums_before

WEIGHT_CAP = 20.0
HUNDREDTHS = 100
#: Ranges of scores (between 0 and 1) that are ordered apart.


def _n() -> Column:
    return F.count(F.lit(1))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(F.col(label).alias("class")).agg(_n().alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("percentage", F.round(F.col("n") * 100.0 / total, 4))


def class_weights(df: DataFrame, label: str, cap: float = WEIGHT_CAP) -> DataFrame:
    """Balanced weight N / (K * n) per class and the same cut at ``cap``."""
    counts = df.groupBy(F.col(label).alias("class")).agg(_n().alias("n"))
    every = Window.partitionBy(F.lit(1))
    weight = F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))
    return counts.withColumns({
        "balanced_weight": F.round(weight, 4), "final_weight": F.round(F.least(F.lit(cap), weight), 4),
    })


def pair_counts(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(_n().alias("n"))


def confusion_matrix(df: DataFrame, classes: list[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    wide = df.groupBy(F.col(actual).alias("actual")).agg(*[
        F.count_if(F.col(predicted) == c).alias(f"predicted_{c}") for c in classes
    ])
    return wide


def normalized_confusion(df: DataFrame, classes: list[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    matrix = confusion_matrix(df, classes, actual, predicted)
    names = [f"predicted_{c}" for c in classes]
    total = sum((F.col(f"`{n}`") for n in names), F.lit(0))
    return matrix.select("actual", *[F.round(S.ratio(F.col(f"`{n}`"), total), 6).alias(n) for n in names])


def _f1(precision: Column, recall: Column) -> Column:
    return S.ratio(precision * recall * 2.0, precision + recall)


def classification_report(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Per class precision, recall, F1 and support, then accuracy, macro and weighted averages (6 decimals)."""
    pairs = pair_counts(df, actual, predicted)
    right = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    # each pair counts once for its true and once for its predicted class
    sides = pairs.select(F.inline(F.array(
        F.struct(F.col("actual").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("claimed"), right.cast("long").alias("hit")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("claimed"), F.lit(0).cast("long").alias("hit")),
    )))
    per_class = sides.groupBy("class").agg(F.sum("support").alias("support"), F.sum("claimed").alias("claimed"), F.sum("hit").alias("hit"))
    precision, recall = S.ratio(F.col("hit"), F.col("claimed")), S.ratio(F.col("hit"), F.col("support"))
    per_class = per_class.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1", _f1(F.col("precision"), F.col("recall"))
    )
    support, total = F.col("support"), F.sum("support")
    accuracy = S.ratio(F.sum("hit"), total)

    def average(kind: str, weight: Column) -> Column:
        mean = [S.ratio(F.sum(F.col(c) * weight), F.sum(weight)).alias(c) for c in ("precision", "recall", "f1")]
        return F.struct(F.lit(kind).alias("class"), *mean, total.alias("support"))

    overall = per_class.agg(F.array(
        F.struct(F.lit("accuracy").alias("class"), *[accuracy.alias(c) for c in ("precision", "recall", "f1")], total.alias("support")),
        average("macro avg", F.lit(1.0)), average("weighted avg", support.cast("double")),
    ).alias("rows")).select(F.inline("rows"))
    rows = per_class.select("class", "precision", "recall", "f1", "support").unionByName(overall)
    return rows.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def top_confusions(df: DataFrame, limit: int | None = None, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    wrong = pair_counts(df, actual, predicted).where(F.col("actual") != F.col("predicted"))
    ranked = wrong.orderBy(F.col("n").desc(), "actual", "predicted")
    return ranked if limit is None else ranked.limit(limit)


def _rates() -> dict[str, Column]:
    tp, fp, tn, fn = F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn")
    precision, recall = S.ratio(tp, tp + fp), S.ratio(tp, tp + fn)
    return {
        "accuracy": S.ratio(tp + tn, tp + tn + fp + fn), "precision": precision, "recall": recall,
        "f1": _f1(precision, recall), "fpr": S.ratio(fp, fp + tn), "fnr": S.ratio(fn, fn + tp),
    }


def with_rates(cells: DataFrame, digits: int = 6) -> DataFrame:
    """Ratios of the four confusion cells ``tp, fp, tn, fn``."""
    return cells.withColumns({k: F.round(v, digits) for k, v in _rates().items()})


def binary_metrics(df: DataFrame, positive: Column, score: str, threshold: float, digits: int = 6) -> DataFrame:
    flagged = F.col(score) >= threshold
    return with_rates(df.agg(
        F.count_if(positive & flagged).alias("tp"), F.count_if(~positive & flagged).alias("fp"),
        F.count_if(~positive & ~flagged).alias("tn"), F.count_if(positive & ~flagged).alias("fn"),
    ), digits)


def cell_percentages(cells: DataFrame) -> DataFrame:
    total = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return cells.select(*[S.percent(F.col(c), total).alias(f"{c}_percent") for c in ("tp", "fp", "tn", "fn")])


def threshold_sweep(df: DataFrame, positive: Column, score: str, start: int, stop: int, step: int, digits: int = 6) -> DataFrame:
    """Metrics at each threshold ``start, start+step … stop`` (in hundredths).

    Scores are counted once per hundredth; thresholds read cumulative sums over at most 101 buckets instead of
    meeting every row.
    """
    near, value = F.floor(F.col(score) * HUNDREDTHS), F.col(score)
    # the product may round across a hundredth, so the score itself is held against it
    above, below = value >= (near + 1) / float(HUNDREDTHS), value < near / float(HUNDREDTHS)
    bucket = F.when(above, near + 1).when(below, near - 1).otherwise(near).cast("int")
    counts = df.select(bucket.alias("bucket"), positive.alias("p")).groupBy("bucket").agg(
        F.count_if("p").alias("pos"), F.count_if(~F.col("p")).alias("neg")
    )
    grid = df.sparkSession.range(start, stop + 1, step).select(
        F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"),
        F.lit(True).alias("wanted"),
    )
    merged = counts.withColumn("wanted", F.lit(False)).unionByName(grid).groupBy("bucket").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max("wanted").alias("wanted")
    )
    every = Window.partitionBy(F.lit(1))
    down = every.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cells = merged.select(
        "bucket", "wanted", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"),
        F.sum("pos").over(every).alias("all_pos"), F.sum("neg").over(every).alias("all_neg"),
    ).where("wanted")
    cells = cells.select(
        (F.col("bucket") / F.lit(float(HUNDREDTHS))).alias("threshold"), "tp", "fp",
        (F.col("all_neg") - F.col("fp")).alias("tn"), (F.col("all_pos") - F.col("tp")).alias("fn"),
    )
    return with_rates(cells, digits)


def sweep_at(df: DataFrame, positive: Column, score: str, thresholds: list[float], digits: int = 6) -> DataFrame:
    """Metrics at given thresholds on scores of any scale. Rows are counted once, by the thresholds that they reach."""
    limits = sorted(set(thresholds))
    reached = sum((F.col(score) >= t).cast("int") for t in limits)
    counts = df.where(F.col(score).isNotNull()).groupBy(reached.alias("reached")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    # one row a threshold meets at most one row a count of reached thresholds
    grid = df.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(limits)], "place int, threshold double")
    hit = F.col("reached") >= F.col("place")
    every = counts.agg(F.collect_list(F.struct("reached", "pos", "neg")).alias("c")).scalar()
    cells = grid.withColumn("c", F.explode(F.coalesce(every, F.array()))).select("place", "threshold", "c.*").groupBy("threshold").agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("neg")).otherwise(0)).alias("tn"), F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"),
    )
    return with_rates(cells, digits)


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The threshold of the highest F1, the highest of them on a tie."""
    best = F.max(F.struct("f1", "threshold"))
    return sweep.agg(best.alias("b")).select(F.col("b")["threshold"].alias("threshold"), F.col("b")["f1"].alias("f1"))


def detection_rates(df: DataFrame, category: str, score: str, threshold: float) -> DataFrame:
    hit = F.col(score) >= threshold
    return df.groupBy(F.col(category).alias("category")).agg(
        _n().alias("total"), F.count_if(hit).alias("detected"), F.count_if(~hit).alias("missed"),
        F.round(F.count_if(hit) / _n(), 6).alias("detection_rate"),
    )


def false_negatives(df: DataFrame, category: str, score: str, threshold: float) -> DataFrame:
    missed = df.where(F.col(score) < threshold)
    return missed.groupBy(F.col(category).alias("category")).agg(_n().alias("false_negatives"))


def classwise_risk(df: DataFrame, normal: str = "BENIGN") -> DataFrame:
    """Per predicted class: samples, correctness, confidence and margin statistics, highest error rate first."""
    right = F.col("actual") == F.col("predicted")
    per_class = df.groupBy("predicted").agg(
        _n().alias("samples"), F.count_if(right).alias("correct"), F.count_if(~right).alias("incorrect"),
        F.round(F.avg("confidence"), 4).alias("mean_confidence"), F.min("confidence").alias("min_confidence"),
        F.round(F.avg("margin"), 4).alias("mean_margin"),
    )
    medians = exact_quantiles(df, ["confidence", "margin"], [0.5], group="predicted")
    medians = medians.groupBy("grp").agg(
        F.max(F.when(F.col("name") == "confidence", F.col("q")[0])).alias("c"),
        F.max(F.when(F.col("name") == "margin", F.col("q")[0])).alias("m"),
    )
    joined = per_class.join(medians, per_class["predicted"] == medians["grp"], "left")
    return joined.select(
        "predicted", "samples", "correct", "incorrect", "mean_confidence", F.round("c", 4).alias("median_confidence"),
        "min_confidence", "mean_margin", F.round("m", 4).alias("median_margin"),
        S.percent(F.col("incorrect"), F.col("samples"), 4).alias("error_rate"),
        S.percent(F.col("correct"), F.col("samples"), 4).alias("accuracy"),
        (F.col("predicted") != normal).alias("is_attack"),
    ).orderBy(F.col("error_rate").desc(), "predicted")


def roc_auc(df: DataFrame, positive: Column, score: str) -> DataFrame:
    """Area under the ROC curve by rank sums over distinct scores, ties counted half.

    Scores may have any scale (probabilities, log odds, isolation scores): ranges are cut at sampled scores.
    """
    value = F.col(score).cast("double")
    counts = df.where(value.isNotNull()).groupBy(value.alias("s")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    ranked = sums_before(counts, [F.col("s").desc()], ["pos"], "scores")
    pairs = ranked.select("pos", "neg", (F.col("neg") * (F.col("pos_before") + F.col("pos") / 2.0)).alias("won"))
    return pairs.agg(F.round(S.ratio(F.sum("won"), F.sum("pos") * F.sum("neg")), 6).alias("roc_auc"))


def feature_means(df: DataFrame, detected: Column, features: list[str], limit: int | None = None) -> DataFrame:
    """Mean of each feature over detected and over missed rows, largest difference first."""
    flag = detected
    means = df.agg(*[
        F.struct(
            F.lit(f).alias("feature"), F.avg(F.when(flag, F.col(f"`{f}`"))).alias("d"),
            F.avg(F.when(~flag, F.col(f"`{f}`"))).alias("m"),
        ).alias(f"s{i}")
        for i, f in enumerate(features)
    ])
    rows = means.select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(features))])))
    ranked = rows.select(
        "feature", F.round("d", 4).alias("detected_mean"), F.round("m", 4).alias("missed_mean"),
        F.round(F.abs(F.col("d") - F.col("m")), 4).alias("absolute_difference"),
    ).orderBy(F.col("absolute_difference").desc(), "feature")
    return ranked if limit is None else ranked.limit(limit)


def split_distribution(df: DataFrame, category: str, split: str = "split") -> DataFrame:
    return df.groupBy(F.col(category).alias("category")).agg(*[
        F.count_if(F.col(split) == s).alias(f"{s}_samples") for s in ("train", "validation", "test")
    ])


def calibrate(df: DataFrame, positive: Column, score: str, false_positive_rates: list[float]) -> DataFrame:
    """Per target rate: the threshold at that quantile of the benign scores, with what it achieves on all rows."""
    benign = df.where(~positive).select(F.col(score).alias("s"))
    found = quantile_row(benign, ["s"], [1.0 - r for r in false_positive_rates])["s"]
    flagged = {i: F.col(score) >= t for i, t in enumerate(found)}
    cells = df.agg(*[
        F.struct(
            F.lit(rate).alias("target_fpr"), F.lit(found[i]).alias("threshold"),
            F.count_if(positive & flagged[i]).alias("tp"), F.count_if(~positive & flagged[i]).alias("fp"),
            F.count_if(~positive & ~flagged[i]).alias("tn"), F.count_if(positive & ~flagged[i]).alias("fn"),
        ).alias(f"c{i}")
        for i, rate in enumerate(false_positive_rates)
    ])
    rows = cells.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(found))])))
    return with_rates(rows).withColumn("threshold", F.round("threshold", 6))


def stratified_split(df: DataFrame, label: str, key: str, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """``split`` column with the given shares inside every class, by hash order of ``key``: same rows, same split."""
    ranked = hashed_rank(df, label, key)
    n, at = F.col("group_rows"), F.col("rank")
    split = (
        F.when(at <= F.round(n * train), "train").when(at <= F.round(n * (train + validation)), "validation").otherwise("test")
    )
    return ranked.withColumn("split", split).drop("rank", "group_rows")


def sampled_split(df: DataFrame, key: str, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """The approximate form: shares hold on average, no shuffle."""
    at = (F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("double")) / float(1 << 32)
    return df.withColumn("split", F.when(at < train, "train").when(at < train + validation, "validation").otherwise("test"))


def expand_matrix(spark: SparkSession, matrix: DataFrame, classes: list[str]) -> DataFrame:
    """A stored confusion matrix back to weighted (actual, predicted, n) rows."""
    cells = F.array(*[F.struct(F.lit(c).alias("predicted"), F.col(f"`predicted_{c}`").alias("n")) for c in classes])
    return matrix.select("actual", F.inline(cells))
