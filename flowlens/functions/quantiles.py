"""Exact quantiles that never hold a column's values in one place.

``percentile`` keeps every distinct value of a group in one buffer, which is fine for groups of a known size. Beyond
``exact_rows`` the wanted order statistics are bracketed instead: each round counts the rows of every open bracket
in ``BUCKETS`` equal slices (a map-side combined count) and keeps the slice that holds the wanted rank, until the
bracket is one value or small enough to sort. Only brackets travel through the driver, never rows.
"""

from __future__ import annotations

import math
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.session import materialize

BUCKETS = 256
EXACT_ROWS = 1 << 20
SORT_ROWS = 1 << 16
BROADCAST_BRACKETS = 10_000
LARGEST = sys.float_info.max

_BRACKETS = T.StructType([
    T.StructField("grp", T.StringType()), T.StructField("name", T.StringType()), T.StructField("rank", T.LongType()),
    T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()), T.StructField("below", T.LongType()),
])


def numbers(df: DataFrame, columns: list[str], group: str | None = None, stored: bool = False) -> DataFrame:
    """``grp`` and the numbers of ``columns`` as doubles ``v0, v1 …``, written once unless ``stored`` says that ``df`` is a
    written table: every round reads them, and what made ``df`` (joins, text parsing) does not run again."""
    label = F.lit("") if group is None else F.coalesce(F.col(f"`{group}`").cast("string"), F.lit(""))
    values = [F.col(f"`{c}`").try_cast("double").alias(f"v{i}") for i, c in enumerate(columns)]
    made = df.select(label.alias("grp"), *values)
    return made if stored else materialize(made, "quantile-numbers")


def long_form(written: DataFrame, columns: list[str]) -> DataFrame:
    """One row (``grp``, ``name``, ``value``) per number of ``columns``; nulls and NaN are left out."""
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"v{i}").alias("value")) for i, c in enumerate(columns)])
    return written.select("grp", F.inline(cells)).where(F.col("value").isNotNull() & ~F.isnan("value"))


def _wide(written: DataFrame, columns: list[str], *make) -> DataFrame:
    """``grp, name`` and the aggregates ``make`` of each column, from one aggregate without unpivoting rows."""
    cells = []
    for i, c in enumerate(columns):
        value = F.when(~F.isnan(f"v{i}"), F.col(f"v{i}"))
        cells.append(F.struct(F.lit(c).alias("name"), *[m(value) for m in make]).alias(f"c{i}"))
    found = written.groupBy("grp").agg(*cells)
    return found.select("grp", F.inline(F.array(*[F.col(f"c{i}") for i in range(len(columns))])))


def _spans(written: DataFrame, columns: list[str]) -> list[dict]:
    spans = _wide(
        written, columns, lambda v: F.count(v).alias("n"), lambda v: F.min(v).alias("low"), lambda v: F.max(v).alias("high")
    )
    return [r.asDict() for r in spans.where("n > 0").collect()]


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probs: list[float],
    group: str | None = None,
    exact_rows: int = EXACT_ROWS,
    sort_rows: int = SORT_ROWS,
    stored: bool = False,
) -> DataFrame:
    """``grp, name, q`` where ``q`` is the array of linearly interpolated quantiles at ``probs``.

    ``group`` must be a column of few values (a class vocabulary): groups times columns brackets go to the driver.
    """
    written = numbers(df, columns, group, stored)
    known = _spans(written, columns)
    if all(s["n"] <= exact_rows for s in known):
        wanted = F.array(*[F.lit(float(p)) for p in probs])
        return _wide(written, columns, lambda v: F.percentile(v, wanted).alias("q")).where(F.col("q").isNotNull())
    rows = long_form(written, columns)
    # infinities stand at the ends of the double range while brackets are halved
    bounded = rows.withColumn("value", F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.col("value"))))
    spans = [
        {**s, "low": max(s["low"], -LARGEST), "high": min(s["high"], LARGEST)} for s in known
    ]
    found = _order_statistics(bounded, spans, probs, sort_rows)
    found = {k: math.copysign(math.inf, x) if abs(x) == LARGEST else x for k, x in found.items()}
    out = []
    for s in known:
        q = []
        for p in probs:
            h = (s["n"] - 1) * p
            a, b = found[s["grp"], s["name"], math.floor(h)], found[s["grp"], s["name"], math.ceil(h)]
            q.append(a if a == b else a + (b - a) * (h - math.floor(h)))
        out.append((s["grp"], s["name"], q))
    return df.sparkSession.createDataFrame(out, "grp string, name string, q array<double>")


def _inside(rows: DataFrame, open_brackets: list) -> DataFrame:
    """Rows with the brackets they fall into; few brackets are broadcast, many are joined as Spark sees fit."""
    brackets = rows.sparkSession.createDataFrame([b[:6] for b in open_brackets], _BRACKETS)
    if len(open_brackets) <= BROADCAST_BRACKETS:
        brackets = F.broadcast(brackets)
    return rows.join(brackets, ["grp", "name"]).where(F.col("value").between(F.col("low"), F.col("high")))


def _order_statistics(rows: DataFrame, known: list, probs: list[float], sort_rows: int) -> dict:
    found: dict = {}
    live = []
    for s in known:
        for rank in sorted({f((s["n"] - 1) * p) for p in probs for f in (math.floor, math.ceil)}):
            live.append((s["grp"], s["name"], rank, s["low"], s["high"], 0, s["n"]))
    while live:
        small, wide = [], []
        for b in live:
            if b[3] == b[4]:
                found[b[0], b[1], b[2]] = b[3]
            else:
                (small if b[6] <= sort_rows else wide).append(b)
        if small:
            inside = _inside(rows, small)
            ranked = inside.groupBy("grp", "name", "rank", "below").agg(F.sort_array(F.collect_list("value")).alias("v"))
            at = F.get("v", (F.col("rank") - F.col("below")).cast("int"))
            for r in ranked.select("grp", "name", "rank", at.alias("value")).collect():
                found[r["grp"], r["name"], r["rank"]] = r["value"]
        if not wide:
            break
        inside = _inside(rows, wide)
        # halves keep the width finite when the bracket spans most of the double range
        width = F.col("high") / 2 - F.col("low") / 2
        slot = F.least(F.lit(BUCKETS - 1), F.floor((F.col("value") / 2 - F.col("low") / 2) / width * BUCKETS))
        counts = inside.groupBy("grp", "name", "rank", slot.alias("slot")).agg(
            F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
        )
        slices: dict = {}
        for r in counts.orderBy("slot").collect():
            slices.setdefault((r["grp"], r["name"], r["rank"]), []).append(r)
        live = []
        for grp, name, rank, _low, _high, below, _n in wide:
            for r in slices[grp, name, rank]:
                if rank < below + r["n"]:
                    live.append((grp, name, rank, r["low"], r["high"], below, r["n"]))
                    break
                below += r["n"]
    return found


def quantile_row(df: DataFrame, columns: list[str], probs: list[float], **options) -> dict[str, list[float]]:
    """The quantiles of a few columns as plain numbers (one row through the driver); missing columns are left out."""
    return {r["name"]: list(r["q"]) for r in exact_quantiles(df, columns, probs, **options).collect()}
