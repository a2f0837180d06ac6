"""Quality profile of an unknown table: each section is one small result of one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens import schemas as SC
from flowlens.functions.quantiles import exact_quantiles
from flowlens.operators.rules import numeric_columns
from flowlens.session import materialize


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _is_float(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))


def _blank(df: DataFrame, name: str) -> Column:
    return (_q(name).isNull() | F.isnan(_q(name))) if _is_float(df, name) else _q(name).isNull()


def column_split(df: DataFrame) -> tuple[list[str], list[str]]:
    numeric = numeric_columns(df)
    return numeric, [c for c in df.columns if c not in numeric]


def find_column(columns: list[str], names: set[str]) -> str | None:
    return next((c for c in columns if c.strip().lower() in names), None)


def _per_column(df: DataFrame, names: list[str], test) -> DataFrame:
    """(column, n, total_rows) with one pass over the table."""
    counted = df.agg(F.count(F.lit(1)).alias("total_rows"), *[F.count_if(test(c)).alias(f"n{i}") for i, c in enumerate(names)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n")) for i, c in enumerate(names)])
    return counted.select(F.inline(cells), "total_rows")


def missing_cells(df: DataFrame) -> DataFrame:
    rows = _per_column(df, df.columns, lambda c: _blank(df, c))
    share = F.when(F.col("total_rows") > 0, F.round(F.col("n") * 100.0 / F.col("total_rows"), 2)).otherwise(0.0)
    return rows.select("column", F.col("n").alias("missing"), share.alias("missing_percentage"))


def infinite_cells(df: DataFrame) -> DataFrame:
    floats = [c for c in df.columns if _is_float(df, c)]
    if not floats:
        return df.sparkSession.createDataFrame([], "column string, infinite long")
    return _per_column(df, floats, lambda c: F.abs(_q(c)) == F.lit(float("inf"))).select("column", F.col("n").alias("infinite"))


def duplicates(df: DataFrame) -> DataFrame:
    """Copies beyond the first of each row; NaN counts as null. Copies are combined map-side before the shuffle."""
    same = [F.nanvl(_q(c), F.lit(None)).alias(c) if _is_float(df, c) else _q(c) for c in df.columns]
    groups = df.select(*same).groupBy(*[_q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    totals = groups.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("total_records"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_records"),
    )
    return totals.withColumn(
        "duplicate_percentage",
        F.when(F.col("total_records") > 0, F.round(F.col("duplicate_records") * 100.0 / F.col("total_records"), 2)).otherwise(0.0),
    )


def numeric_summary(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """mean, sample deviation, min, quartiles and max per numeric column, four decimals, over all rows.

    For exact quartiles the columns are written once, and all figures come from there.
    """
    names = columns or numeric_columns(df)
    if not approximate:
        df = materialize(df.select(*map(_q, names)), "numeric-columns")
    number = {c: F.when(~F.isnan(_q(c)), _q(c)) if _is_float(df, c) else _q(c) for c in names}
    wide = df.agg(*[
        F.struct(
            F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"),
            F.min(v).cast("double").alias("min"), F.max(v).cast("double").alias("max"),
        ).alias(f"s{i}")
        for i, v in enumerate(number.values())
    ])
    basic = wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(f"s{i}").alias("s")) for i, c in enumerate(names)
    ])))
    probs = [0.25, 0.5, 0.75]
    if approximate:
        near = df.agg(*[F.percentile_approx(v.cast("double"), probs, 10_000).alias(f"q{i}") for i, v in enumerate(number.values())])
        quart = near.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("name"), F.col(f"q{i}").alias("q")) for i, c in enumerate(names)
        ])))
    else:
        quart = exact_quantiles(df, names, probs, stored=True).select("name", "q")
    # one row per column on both sides
    joined = basic.join(quart, "name", "left")
    s, q = F.col("s"), F.col("q")
    picks = {
        "mean": s["mean"], "std": s["std"], "min": s["min"], "p25": q[0], "median": q[1], "p75": q[2], "max": s["max"],
    }
    return joined.select(F.col("name").alias("column"), *[F.round(v, 4).alias(k) for k, v in picks.items()])


def value_counts(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """(value, n) by falling count; null is counted as its own value."""
    text = F.coalesce(_q(column).cast("string"), F.lit("nan"))
    counts = df.groupBy(text.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.orderBy(F.col("n").desc(), "value")
    return ranked if limit is None else ranked.limit(limit)


def protocol_distribution(df: DataFrame, limit: int | None = None) -> DataFrame | None:
    column = find_column(df.columns, SC.PROTOCOL_NAMES)
    return None if column is None else value_counts(df, column, limit)


def time_coverage(df: DataFrame, column: str | None = None) -> DataFrame | None:
    column = column or find_column(df.columns, SC.TIMESTAMP_NAMES)
    if column is None:
        return None
    ts = _q(column)
    if isinstance(df.schema[column].dataType, T.StringType):
        ts = F.try_to_timestamp(ts)
    return df.agg(
        F.lit(column).alias("column"), F.min(ts).cast("timestamp").alias("earliest"),
        F.max(ts).cast("timestamp").alias("latest"), F.count(ts).alias("valid_timestamps_count"),
    )


def label_distribution(df: DataFrame, column: str | None = None) -> DataFrame | None:
    column = column or find_column(df.columns, SC.LABEL_NAMES)
    return None if column is None else value_counts(df, column)


def imbalance_ratio(distribution: DataFrame) -> DataFrame:
    """Largest over smallest class, null with fewer than two classes."""
    ratio = F.when(F.count(F.lit(1)) >= 2, F.round(F.max("n") / F.min("n"), 2))
    return distribution.agg(F.count(F.lit(1)).alias("classes"), ratio.alias("class_imbalance_ratio"))


def quality_totals(df: DataFrame, label: str | None = None) -> DataFrame:
    """The totals the warnings look at, in one row."""
    width = len(df.columns)
    gaps = sum((F.count_if(_blank(df, c)) for c in df.columns), F.lit(0))
    floats = [c for c in df.columns if _is_float(df, c)]
    infinite = sum((F.count_if(F.abs(_q(c)) == F.lit(float("inf"))) for c in floats), F.lit(0))
    rows = F.count(F.lit(1))
    cells = df.agg(
        rows.alias("total_records"), gaps.alias("missing_cells"), infinite.alias("infinite_cells"),
        F.when(rows > 0, F.round(gaps * 100.0 / (rows * width), 2)).otherwise(0.0).alias("missing_percentage"),
    )
    label = label or find_column(df.columns, SC.LABEL_NAMES)
    copies = duplicates(df).select(F.struct("duplicate_records", "duplicate_percentage")).scalar()
    imbalance = F.lit(None).cast("double")
    if label is not None:
        imbalance = imbalance_ratio(value_counts(df, label)).select("class_imbalance_ratio").scalar()
    return cells.select(
        "*", copies["duplicate_records"].alias("duplicate_records"),
        copies["duplicate_percentage"].alias("duplicate_percentage"), imbalance.alias("class_imbalance_ratio"),
    )


def quality_warnings(totals: DataFrame) -> DataFrame:
    """One row per warning. Limits 5 %, 0, 10 % and 20 times, and the texts."""
    def text(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    missing, copies, ratio = (
        F.col("missing_percentage"), F.col("duplicate_percentage"), F.col("class_imbalance_ratio"),
    )
    infinite = F.col("infinite_cells")
    found = F.array_compact(F.array(
        F.when(missing > 5.0, text("High missingness: ", missing.cast("string"), "% of dataset cells contain NaN/null values.")),
        F.when(infinite > 0, text("Dataset contains ", infinite.cast("string"), " infinite values across numeric features.")),
        F.when(copies > 10.0, text("High duplicate rate: ", copies.cast("string"), "% of rows are exact duplicates.")),
        F.when(ratio > 20.0, text(
            "Severe class imbalance detected: Majority class is ", ratio.cast("string"), "x larger than minority class.",
        )),
    ))
    return totals.select(F.explode(found).alias("warning"))


def search_features(summary: DataFrame, text: str) -> DataFrame:
    return summary.where(F.lower("column").contains(text.lower()))
