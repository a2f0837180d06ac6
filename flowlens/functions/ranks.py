"""Row numbers inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.session import materialize

SLICE_ROWS = 1 << 20
MAX_SLICES = 1 << 20


def hashed_rank(df: DataFrame, group: str, key: str, slices: int | None = None) -> DataFrame:
    """``rank`` (1-based, by md5 of ``key``) and ``group_rows`` per ``group``, without one task per group.

    The leading hash digits cut each group into even slices of about ``SLICE_ROWS`` rows: rows are numbered inside
    slices and offset by the counts of the slices before. The number of slices follows from the table's row count.
    """
    if slices is None:
        slices = max(1, min(MAX_SLICES, df.count() // SLICE_ROWS))
    if slices == 1:
        rows = df.withColumn("_hash", F.md5(F.col(key).cast("string")))
        return rows.withColumns({
            "rank": F.row_number().over(Window.partitionBy(group).orderBy("_hash", key)),
            "group_rows": F.count(F.lit(1)).over(Window.partitionBy(group)),
        }).drop("_hash")
    digest = F.md5(F.col(key).cast("string"))
    rows = df.withColumn("_hash", digest).withColumn(
        "_slice", F.conv(F.substring("_hash", 1, 6), 16, 10).cast("long") % F.lit(1 << 24)
    )
    rows = rows.withColumn("_slice", F.floor(F.col("_slice") * slices / (1 << 24)))
    counts = rows.groupBy(group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(group).orderBy("_slice")
    counts = counts.select(
        group, "_slice",
        F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(group)).alias("group_rows"),
    )
    inside = Window.partitionBy(group, "_slice").orderBy("_hash", key)
    return (
        rows.withColumn("_at", F.row_number().over(inside))
        .join(counts, [group, "_slice"])
        .withColumn("rank", F.col("_before") + F.col("_at"))
        .drop("_hash", "_slice", "_at", "_before")
    )


def sums_before(df: DataFrame, order: list, values: list[str], name: str = "ordered") -> DataFrame:
    """Adds ``<value>_before``: the sum of each of ``values`` over all rows that come earlier in ``order``.

    Rows are range partitioned at sampled split points, so values of any scale spread evenly and no task orders them all; the
    partitions' sums are one small row each. The ordered rows are written once, so that both passes see the same ranges.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(ranged.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), name)
    parts = rows.groupBy("_part").agg(*[F.sum(v).alias(v) for v in values])
    earlier = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_{v}") for v in values])
    inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    ahead = {f"{v}_before": F.col(f"_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}
    return rows.join(parts, "_part").withColumns(ahead).drop("_part", "_row", *[f"_{v}" for v in values])
