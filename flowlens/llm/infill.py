"""Fill-in-the-middle: texts cut at two lines and told as prefix, suffix, middle, in one of two orders.

A Fenwick tree over blocks of ``BLOCK`` bytes of a text holds the number of line ends and of code points in each block.
A descent by doubling steps finds the block in which the k-th line ends and the line ends and code points before it; the
place inside the block is found by a scan of that block alone.

Nulls and odd rows: a null text is empty; an empty text, or one that contains a mark, stays plain, with null lengths. A
null id draws as an id with no digits. Repeated rows are cut alike and put out one by one; an empty table gives an empty
result. Only id and text are read, so other columns, whatever their names, change nothing. A text is handled whole.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from flowlens.llm.common import text_chunks

BLOCK = 2048
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                 ("middle_chars", pa.int64()), ("output", pa.string())])
TYPES = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Fenwick:
    """Prefix sums of rows of counts: node i holds the sum of the ``i & -i`` blocks up to block i (counted from 1)."""

    def __init__(self, counts: np.ndarray):
        self.size = len(counts)
        self.nodes = np.zeros((self.size + 1, counts.shape[1]), np.int64)
        self.nodes[1:] = counts
        step = 1
        while step < self.size:
            children = np.arange(step, self.size + 1 - step, 2 * step)
            self.nodes[children + step] += self.nodes[children]
            step *= 2
        self.top = step if step <= self.size else step // 2

    def descend(self, target: int) -> tuple[int, np.ndarray]:
        """The number of whole blocks before the one where the first count reaches ``target`` (at least 1), and their sums."""
        at, sums, step = 0, np.zeros(self.nodes.shape[1], np.int64), self.top
        while step:
            if at + step <= self.size and sums[0] + self.nodes[at + step, 0] < target:
                at += step
                sums = sums + self.nodes[at]
            step //= 2
        return at, sums


def code_points(raw: np.ndarray) -> int:
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


class Lines:
    """Lines (each with its line end; the last may lack it) of a UTF-8 text, found through the tree."""

    def __init__(self, text: bytes, block: int = BLOCK):
        self.raw, self.block = np.frombuffer(text, np.uint8), block
        counts = np.zeros((1, 2), np.int64)
        if text:
            starts = np.arange(0, len(text), block)
            marks = self.raw == 10, (self.raw & 0xC0) != 0x80
            counts = np.stack([np.add.reduceat(m, starts, dtype=np.int64) for m in marks], 1)
        self.tree = Fenwick(counts)
        self.ends, self.chars = counts.sum(axis=0).tolist()
        self.count = self.ends + bool(text and text[-1:] != b"\n")

    def cut(self, lines: int) -> tuple[int, int]:
        """Bytes and code points up to the end of the first ``lines`` lines."""
        if lines == 0:
            return 0, 0
        if lines > self.ends:
            return len(self.raw), self.chars
        blocks, (ends, chars) = self.tree.descend(lines)
        start = blocks * self.block
        inside = self.raw[start:start + self.block]
        end = int(np.flatnonzero(inside == 10)[lines - ends - 1]) + 1
        return start + end, int(chars) + code_points(inside[:end])


def draws(doc_id, seed: int) -> list[int]:
    """Four 32-bit numbers of a document."""
    found = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(found[i:i + 8], 16) for i in range(0, 32, 8)]


def infill(doc_id, text: bytes, seed: int, rate: int, spm: int) -> tuple:
    lines = Lines(text)
    first, second, use, order = draws(doc_id, seed)
    if not text or use % 100 >= rate or any(m in text for m in MARKS):
        return lines.count, "plain", None, None, text
    low, high = sorted((first % (lines.count + 1), second % (lines.count + 1)))
    (a, before), (b, until) = lines.cut(low), lines.cut(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if order % 100 < spm:
        form, out = "spm", [MARKS[1], suffix, MARKS[0], prefix, MARKS[2], middle]
    else:
        form, out = "psm", [MARKS[0], prefix, MARKS[1], suffix, MARKS[2], middle]
    return lines.count, form, before, until - before, b"".join(out)


def fill_in_middle(docs, seed: int = 7, rate: int = 100, spm: int = 50):
    """One row for each row of ``docs``: doc_id, lines n, form, prefix_chars, middle_chars and the output.

    ``rate`` in a hundred texts are cut; of those ``spm`` in a hundred begin with the suffix.
    """

    def cut(parts):
        for part in parts:
            ids = part.column("doc_id").to_pylist()
            for first, texts in text_chunks(part, "text"):
                rows = [(ids[at], *infill(ids[at], text, seed, rate, spm)) for at, text in enumerate(texts, first)]
                *plain, output = zip(*rows, strict=True)
                arrays = [pa.array(c, f.type) for c, f in zip(plain, OUT, strict=False)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(output, pa.binary()).cast(pa.string())], schema=OUT)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(cut, TYPES)


def restored(output, form):
    """The text of an output: every mark stands in it once, because a text with a mark stays plain."""
    part = F.substring_index

    def tail(c):
        return F.substring(c, len(PREFIX) + 1, 2**31 - 1)

    middle = part(output, MIDDLE, -1)
    psm = F.concat(tail(part(output, SUFFIX, 1)), middle, part(part(output, SUFFIX, -1), MIDDLE, 1))
    spm = F.concat(part(part(output, PREFIX, -1), MIDDLE, 1), middle, tail(part(output, PREFIX, 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
