"""Session set-up and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

LOCAL_SCRATCH = "/tmp/checkpoints"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("flowlens")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local master, as in tests, may leave it unset; then one fixed local folder is named.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return LOCAL_SCRATCH


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(df, name: str):
    """Write ``df`` to the shared folder and read it back: lineage ends at files that survive executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that live as long as a block: for steps that need each table only until the next one is written.

    They lie in the warehouse, which all executors share, and are dropped one by one or when the block ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.names = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for name in list(self.names):
            self.drop(name)

    def write(self, df, name: str) -> str:
        """The name of the written table."""
        full = f"scratch_{name}_{uuid.uuid4().hex[:12]}"
        df.write.saveAsTable(full)
        self.names.append(full)
        return full

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names.remove(name)


def spread(df):
    """``df`` over all cores when its files come in fewer splits than there are cores; a large table stays as it is.

    Meant for plain scans ahead of heavy per-row work.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores and df.rdd.getNumPartitions() < cores else df
