"""Line dedup: lines that many documents hold go everywhere, counted through levelled sorted runs of line hashes.

Documents are dealt over batches. A batch brings each of its lines' 128-bit hashes with the number of its documents that
hold it; a merge anti-join with the runs leaves out lines already known to be common, and the rest becomes a run of its
own, sorted by hash. When a level has ``fanout`` runs they are compacted into one of the next level, so there are never
more than ``fanout`` runs a level and a count is rewritten once a level. Every count is kept: a line is common when
its counts over all runs reach the threshold, whichever batches they came from.

Nulls and odd rows: a null or empty text is one empty line, which is never common. Every row is a document of its own, so
repeated rows count and are each put out; null ids are carried along. An empty table gives an empty result. Only id
and text are read, so other columns, whatever their names, change nothing. One text is handled whole, by one task.
"""

from __future__ import annotations

import uuid
from functools import reduce
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import functions as F

from flowlens.llm.common import keyed, text_chunks
from flowlens.session import materialize

POSTING = "batch int, key binary, doc_id long, text_key long"


def key_of(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z in lower case (``bytes`` methods know ASCII only)."""
    return line.strip().lower()


def digest(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


class LineRuns:
    """Runs of (key, n): the hash of a line and the number of documents with it, told in levels.

    Runs are tables bucketed and sorted by the key: in a join with them only the batch moves.
    """

    def __init__(self, spark, threshold: int = 10, fanout: int = 2, buckets: int | None = None):
        self.spark, self.threshold, self.fanout = spark, threshold, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_runs_{uuid.uuid4().hex[:12]}"
        self.levels: list[list[str]] = []
        self.written = 0

    def write(self, counts, level: int) -> None:
        name = f"{self.name}_{level}_{self.written}"
        self.written += 1
        counts.write.bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def merged(self, tables: list[str]):
        """Counts of several runs, by merge joins of the sorted tables: two runs meet without a shuffle.

        Not by a union: Spark 4.1.2 takes a union of bucketed scans for bucketed and leaves equal keys apart.
        """
        def merge(left, right):
            both = left.join(right.withColumnRenamed("n", "m").hint("merge"), "key", "full")
            return both.select("key", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))

        return reduce(merge, [self.spark.table(t) for t in tables])

    def add(self, counts) -> None:
        """Takes a batch of (key, n); a key may come in many rows."""
        # written first, so that a common line's rows are added up before they meet the runs
        fresh = materialize(counts.groupBy("key").agg(F.sum("n").alias("n")), "line-batch").repartition(self.buckets, "key")
        for name in sum(self.levels, []):
            known = self.spark.table(name).where(F.col("n") >= self.threshold).select("key")
            fresh = fresh.join(known.hint("merge"), "key", "left_anti")
        self.write(fresh, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full = self.levels[level]
            self.write(self.merged(full), level + 1)
            self.levels[level] = []
            self.drop(full)
            level += 1

    def common(self):
        """Keys with at least ``threshold`` documents over all runs."""
        return self.merged(sum(self.levels, [])).where(F.col("n") >= self.threshold)

    def drop(self, tables: list[str] | None = None) -> None:
        for name in sum(self.levels, []) if tables is None else tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def postings_of(docs, batches: int, min_chars: int):
    """One row for each document and each of its different lines of at least ``min_chars`` code points."""

    def read(parts):
        for part in parts:
            ids, text_keys, batch = (part.column(c).to_pylist() for c in ("doc_id", "text_key", "batch"))
            for first, texts in text_chunks(part, "text"):
                columns = [[], [], [], []]
                for at, text in enumerate(texts, first):
                    keys = {k for k in map(key_of, text.split(b"\n")) if len(k) >= min_chars}
                    if min_chars > 1:
                        keys = {k for k in keys if len(k.decode()) >= min_chars}
                    for column, value in zip(columns, (batch[at], None, ids[at], text_keys[at]), strict=True):
                        column.extend(map(digest, keys) if value is None and column is columns[1] else [value] * len(keys))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.int64(), pa.int64()), strict=True)],
                    ["batch", "key", "doc_id", "text_key"],
                )

    dealt = docs.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(batches)).cast("int"))
    return dealt.mapInArrow(read, POSTING)


def cut_lines(rows):
    """doc_id, n_lines, n_dropped and kept_text of rows with ``text`` and ``keys``, the hashes of the lines to drop."""

    def cut(parts):
        for part in parts:
            ids, keys = part.column("doc_id").to_pylist(), part.column("keys")
            for first, texts in text_chunks(part, "text"):
                counts, dropped, kept = [], [], []
                for text, gone in zip(texts, keys.slice(first, len(texts)).to_pylist(), strict=True):
                    lines = text.split(b"\n")
                    stay = lines
                    if gone:
                        gone = set(gone)
                        stay = [x for x in lines if digest(key_of(x)) not in gone]
                    counts.append(len(lines))
                    dropped.append(len(lines) - len(stay))
                    kept.append(b"\n".join(stay))
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[first:first + len(texts)], pa.int64()), pa.array(counts, pa.int64()),
                    pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()),
                ], ["doc_id", "n_lines", "n_dropped", "kept_text"])

    return rows.select("doc_id", "text", "keys").mapInArrow(cut, "doc_id long, n_lines long, n_dropped long, kept_text string")


def count_lines(postings, batches: int, threshold: int, fanout: int):
    """The written table of common keys (key, n) of ``postings``, batch by batch."""
    runs = LineRuns(postings.sparkSession, threshold, fanout)
    try:
        for batch in range(batches):
            runs.add(postings.where(F.col("batch") == batch).groupBy("key").agg(F.count("*").alias("n")))
        return materialize(runs.common(), "common-lines")
    finally:
        runs.drop()


def remove_common_lines(docs, threshold: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 2, salts: int = 8):
    """One row for each row of ``docs``: doc_id, n_lines, n_dropped, kept_text.

    A common line may stand in a third of all documents, so its documents are dealt over ``salts`` join keys; AQE splits
    what is still large. The common keys grow with the data and are joined, not broadcast by this code.
    """
    docs = keyed(docs)
    postings = materialize(postings_of(docs, batches, min_chars), "line-postings")
    common = count_lines(postings, batches, threshold, fanout)
    salted = common.select("key", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    marked = (
        postings.withColumn("salt", F.pmod("text_key", F.lit(salts)).cast("int")).join(salted, ["key", "salt"])
        .groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("tk")).agg(F.collect_set("key").alias("keys"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("tk"))
    return cut_lines(docs.join(marked, same, "left"))
