"""Sources: CSV tables with their header rules, input guards, threshold files, packet streams."""

from __future__ import annotations

from urllib.parse import unquote

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens import schemas as SC
from flowlens.plans.mapping import choose_model, split_labels, unique_names

CAPTURE_SUFFIXES = ("pcap", "pcapng")
GUARD_SCHEMA = "path string, status string, reason string"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV table with a header row; a repeated header name becomes ``name.1``.

    Without a ``schema`` types are inferred, which reads the data once more: give one for large inputs.
    """
    if schema is not None:
        return spark.read.csv(path, header=True, schema=schema)
    # the raw first line, because the reader renames repeated names in its own way
    raw = spark.read.csv(path, header=False, inferSchema=False).first()
    inferred = spark.read.csv(path, header=True, inferSchema=True)
    if raw is None:
        return inferred
    return inferred.toDF(*unique_names([str(name or "") for name in raw]))


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names only, from the raw first line: the reader renames repeated names in its own way."""
    raw = spark.read.csv(path, header=False, inferSchema=False).first()
    return [] if raw is None else unique_names([str(name or "") for name in raw])


def read_csv_folder(spark: SparkSession, folder: str, schema: T.StructType | None = None) -> DataFrame:
    """All CSV files below ``folder`` as one table, whatever the order and choice of each file's columns.

    Only the files' starts are read for their headers. Files with one header are read together, by Spark's own reader, and the
    groups are united by name; a column that a file does not have is null. Without a ``schema`` a column whose every value
    is a number becomes a double, which reads the data once more; other columns stay text.
    """
    heads = file_headers(spark, folder).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("position", "column"))).alias("c"))
    groups = heads.groupBy(F.col("c.column").alias("names")).agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    if not groups:
        return spark.createDataFrame([], schema or T.StructType())
    parts = []
    for group in sorted(groups, key=lambda g: g["files"][0]):
        names = unique_names(list(group["names"]))
        text = T.StructType([T.StructField(n, T.StringType()) for n in names])
        parts.append(spark.read.csv(group["files"], header=True, schema=text, enforceSchema=True))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if schema is None:
        text = rows.agg(*[F.count_if(_cell(c).isNotNull() & _cell(c).try_cast("double").isNull()).alias(f"t{i}") for i, c in enumerate(rows.columns)]).first()
        types = ["string" if text[i] else "double" for i in range(len(rows.columns))]
        return rows.select(*[_cell(c).cast(t).alias(c) for c, t in zip(rows.columns, types, strict=True)])
    wanted = {f.name: f.dataType for f in schema}
    return rows.select(*[(_cell(c).try_cast(t) if c in rows.columns else F.lit(None).cast(t)).alias(c) for c, t in wanted.items()])


def _cell(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def file_headers(spark: SparkSession, folder: str) -> DataFrame:
    """``headers(file, position, column)`` of every CSV file below ``folder``, one task per file split.

    The first line of a file is the one at byte offset zero, so only file starts are read.
    """
    lines = spark.read.option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").text(folder)
    starts = lines.where(F.col("_metadata.file_block_start") == 0).select(
        F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("n")
    )
    first = starts.groupBy("file").agg(F.min_by("value", "n").alias("line"))
    cells = F.split("line", ",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)")
    named = first.select("file", F.posexplode(cells).alias("position", "column"))
    named = named.withColumn("column", F.trim(F.regexp_replace("column", '^\\s*"|"\\s*$', "")))
    # a repeated name gets .1, .2 ..., as in ``unique_names``
    again = F.row_number().over(Window.partitionBy("file", "column").orderBy("position")) - 1
    return named.withColumn("column", F.when(again > 0, F.concat_ws(".", "column", again)).otherwise(F.col("column")))


def guard_files(spark: SparkSession, folder: str) -> DataFrame:
    """One status row per file: empty files, wrong extensions and files without rows are ``INVALID_INPUT``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    # a scan skips empty files, so names come from the reader's own file listing
    named = spark.createDataFrame([(unquote(p),) for p in found.inputFiles()], "path string")
    name = F.regexp_replace("path", "^file:/+", "file:/")
    sizes = found.select(name.alias("path"), "length")
    files = named.select(name.alias("path")).join(sizes, "path", "left").select("path", F.coalesce("length", F.lit(0)).alias("length"))
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(folder)
    counts = lines.where(F.length(F.trim("value")) > 0).groupBy(
        F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/").alias("path")
    ).agg(
        F.count(F.lit(1)).alias("lines")
    )
    joined = files.withColumn("suffix", suffix).join(counts, "path", "left")
    reason = (
        F.when(~F.col("suffix").isin("csv", *CAPTURE_SUFFIXES), "Unsupported file extension.")
        .when(F.col("length") == 0, "Uploaded file is empty (0 bytes).")
        .when((F.col("suffix") == "csv") & (F.coalesce("lines", F.lit(0)) < 2), "CSV file contains no readable columns or rows.")
    )
    return joined.select("path", F.when(reason.isNull(), "OK").otherwise(SC.INVALID_INPUT).alias("status"), reason.alias("reason"))


def profile_csv(spark: SparkSession, path: str, requested: str | None = None, sample_rows: int | None = None) -> dict:
    """Schema choice for one CSV path, from its names only. ``sample_rows`` adds that many rows as a DataFrame."""
    status = guard_one(spark, path)
    if status is not None:
        return {"status": SC.INVALID_INPUT, "validation_errors": [status], "compatible_model": None}
    columns = header_of(spark, path)
    model, plan = choose_model(columns, requested)
    out = {
        "status": plan.status, "compatible_model": None if plan.missing else model, "mapping_report": plan.report(),
        "match_percentage": plan.match_percentage, "missing_features": plan.missing, "extra_features": plan.extra,
        "label_columns": split_labels(columns)[1], "validation_errors": [],
    }
    if sample_rows:
        out["sample"] = read_csv(spark, path).limit(sample_rows)
    return out


def guard_one(spark: SparkSession, path: str) -> str | None:
    """Why a CSV path cannot be used, or None."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    if not size:
        return "Uploaded file is empty (0 bytes)."
    try:
        df = spark.read.csv(path, header=True)
    except Exception as error:  # noqa: BLE001 - any parser failure is the answer
        return f"Failed to parse CSV format: {error}"
    if not df.columns or df.isEmpty():
        return "CSV file contains no readable columns or rows."
    return None


def read_thresholds(spark: SparkSession, path: str) -> dict:
    """A JSON parameter file as a dict (one row)."""
    return spark.read.json(path, multiLine=True).first().asDict(recursive=True)


def packet_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Packets arriving as Parquet files; any other streaming source with this schema does as well."""
    reader = spark.readStream.schema(SC.PACKETS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)
