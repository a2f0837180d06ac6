"""Packing of tokenised documents into sequences by minimum bin slack.

Every document becomes ids (subwords and an end id); longer ones than a sequence are cut into pieces. Pieces are dealt
over shards of bounded size. A shard fills one bin after the other: the longest piece left is set, and a bitset holds all
sums that the other lengths can reach beside it (copies in powers of two); the fullest feasible combination is taken, as
often as its lengths are still there. Pieces of bins that are not full meet again in fewer shards, round after round.

Nulls and odd rows: a null text is empty, a document without ids is one piece that holds the end id alone; a null id is
carried along; repeated rows are packed one by one. An empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from flowlens.llm.common import subwords, text_chunks
from flowlens.session import materialize

#: Pieces packed by one task at once.
SHARD = 8192
ROUNDS = 4


def cut_documents(docs, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False):
    """A row for each piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64())] + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def cut(batches):
        coder = subwords(tokenizer)
        try:
            for batch in batches:
                doc_ids = batch.column(0).to_pylist()
                for first, texts in text_chunks(batch, "text"):
                    ids, offsets = coder.encode([t.decode() for t in texts])
                    rows = [[] for _ in schema]
                    for i in range(len(texts)):
                        own = np.append(ids[offsets[i]:offsets[i + 1]], end_id).astype("<u4")
                        for piece, start in enumerate(range(0, len(own), capacity)):
                            part = own[start:start + capacity]
                            row = [doc_ids[first + i], piece, start, len(part), zlib.crc32(part.tobytes()), part]
                            for column, value in zip(rows, row, strict=False):
                                column.append(value)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)
        finally:
            # the worker goes on to other tasks; its cache would stay beside their data
            coder.reset()

    types = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, types)


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """Lengths, at most as often as they are there, whose sum comes closest to ``room`` from below."""
    reach, steps = 1, []
    window = (1 << (room + 1)) - 1
    for length in lengths:
        left, copies = counts[length], 1
        while left and length * copies <= room:
            take = min(copies, left)
            wider = (reach | (reach << (length * take))) & window
            if wider != reach:
                steps.append((length, take, reach))
                reach = wider
            left -= take
            copies *= 2
        if reach >> room:
            break
    target, chosen = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> target & 1:
            chosen += [length] * take
            target -= length * take
    return chosen


def minimum_bin_slack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each piece its bin, its offset in the bin, and how full the bin is."""
    order = np.argsort(-lengths, kind="stable")
    values, first, number = np.unique(-lengths[order], return_index=True, return_counts=True)
    stock = {int(-v): order[f:f + n].tolist() for v, f, n in zip(values, first, number, strict=True)}
    counts = {length: len(rows) for length, rows in stock.items()}
    left = list(counts)
    bins, offsets, fills = (np.zeros(len(lengths), np.int64) for _ in range(3))
    b = 0
    while left:
        top = left[0]
        counts[top] -= 1
        chosen = [top, *fullest([x for x in left if x <= capacity - top and counts[x]], counts, capacity - top)]
        counts[top] += 1
        times = min(counts[x] // chosen.count(x) for x in set(chosen))
        for _ in range(times):
            at = 0
            for length in chosen:
                row = stock[length].pop()
                bins[row], offsets[row], fills[row] = b, at, sum(chosen)
                at += length
            b += 1
        for x in chosen:
            counts[x] -= times
        if any(counts[x] == 0 for x in set(chosen)):
            left = [x for x in left if counts[x]]
    return bins, offsets, fills


def pack_shards(lengths, capacity: int, round_no: int, shards: int):
    """Deals numbered lengths evenly over ``shards``, anew in every round, and packs each."""
    dealt = lengths.select("number", "length", F.pmod(F.xxhash64("number", F.lit(round_no)), F.lit(shards)).alias("shard"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        bins, offsets, fills = minimum_bin_slack(rows["length"].to_numpy(), capacity)
        base = (round_no << 56) + (int(rows["shard"].iloc[0]) << 16)
        return rows.drop(columns="shard").assign(sequence_id=base + bins, offset=offsets, fill=fills)

    return dealt.groupBy("shard").applyInPandas(pack, "number long, length long, sequence_id long, offset long, fill long")


def pack_lengths(lengths, capacity: int, shard: int):
    """number, sequence_id and offset of each (number, length) of a written table."""
    done, loose = [], lengths
    for round_no in range(ROUNDS):
        shards = max(1, -(-loose.count() // shard))
        placed = materialize(pack_shards(loose, capacity, round_no, shards), "packed")
        if shards == 1 or round_no + 1 == ROUNDS:
            done.append(placed)
            break
        done.append(placed.where(F.col("fill") == capacity))
        loose = placed.where(F.col("fill") < capacity)
    return reduce(lambda a, b: a.unionByName(b), done).select("number", "sequence_id", "offset")


def pack_pieces(pieces, capacity: int = 4096, shard: int | None = None):
    """Pieces with ``sequence_id`` and ``offset``. Only numbers and lengths are packed; the rest meets its place once."""
    numbered = materialize(pieces.withColumn("number", F.monotonically_increasing_id()), "pieces")
    placed = pack_lengths(numbered.select("number", "length"), capacity, shard or SHARD)
    return numbered.join(placed, "number").drop("number")


def pack_documents(docs, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False):
    return pack_pieces(cut_documents(docs, tokenizer, capacity, end_id, with_ids), capacity)
