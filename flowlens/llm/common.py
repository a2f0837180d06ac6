"""Helpers shared by the text operators: tables, text batches, word hashes, cached subword ids."""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task; one longer document is handled alone.
CHUNK_BYTES = 1 << 19
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id, folds: int, fold: int):
    """Is crc32 of the id, written as text, ``fold`` modulo ``folds``? A null id is held out of nothing."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds == fold, F.lit(False))


def keyed(docs):
    """doc_id, text and a hash of the text: rows of one id are told apart by it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def text_chunks(batch: pa.RecordBatch | pa.Array, column: str | None, limit: int = CHUNK_BYTES):
    """(first row, list of UTF-8 texts) of consecutive rows with about ``limit`` bytes; null texts are empty."""
    whole = batch if column is None else batch.column(column)
    start, size, texts = 0, 0, []
    # a few rows at a time, so that no second copy of the batch is held
    for at in range(0, len(whole), 128):
        for t in whole.slice(at, 128).cast(pa.large_binary()).to_pylist():
            t = t or b""
            if texts and size + len(t) > limit:
                yield start, texts
                start, size, texts = start + len(texts), 0, []
            texts.append(t)
            size += len(t)
    if texts:
        yield start, texts


def row_and_text(keep: list[str], text: str):
    """Columns to keep as struct ``row``, and ``text`` beside it unless it is one of them."""
    row = F.struct(*[F.col(c) for c in keep]).alias("row")
    return [row] if text in keep else [row, F.col(text).cast("string").alias("text")]


def text_of(batch: pa.RecordBatch, keep: list[str], text: str) -> pa.Array:
    return batch.column("row").field(keep.index(text)) if text in keep else batch.column("text")


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (splitmix finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: The longest row of powers made so far of each base: a worker keeps it, so it is no longer than its texts ask for.
POWERS: dict[int, np.ndarray] = {}


def power(base: int, n: int) -> np.ndarray:
    """At least ``n`` powers of ``base`` modulo 2**64."""
    if len(POWERS.get(base, ())) < n:
        out = np.full(1 << max(16, int(n - 1).bit_length()), base, np.uint64)
        out[0] = 1
        POWERS[base] = np.multiply.accumulate(out, out=out)
    return POWERS[base]


BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of [start, end) from prefix sums of value * BASE**position."""
    return (prefix[ends] - prefix[starts]) * power(BASE_INVERSE, len(prefix))[starts]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power(BASE, len(values) + 1)[: len(values)], out=out[1:])
    return out


class Words:
    """Words (maximal runs without ASCII white space) of a list of texts.

    ``hashes``: 64 bits a word; ``offsets[i]:offsets[i+1]``: the words of text i; ``starts``, ``ends``: byte places in
    ``data``, the texts joined by one space.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.data = b" " + b" ".join(texts) + b" "
        raw = np.frombuffer(self.data, np.uint8)
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.starts, self.ends = edge[::2], edge[1::2]
        ends = np.cumsum([1 + len(t) for t in texts])
        self.offsets = np.concatenate(([0], np.searchsorted(self.starts, ends))).astype(np.int64)
        values = BYTE_VALUE[LOWER[raw] if lower else raw]
        self.hashes = mix(span_hash(prefix_sums(values), self.starts, self.ends) + (self.ends - self.starts).astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def doc(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Subwords:
    """Ids of whole texts by a word-wise BPE file, with a bounded cache of pieces between spaces and line ends.

    The tokenizer normalises and splits at white space, so the ids of a text are those of its pieces in order. Plain
    words with trailing marks go straight to the BPE model; every other piece takes the tokenizer's whole path, which also
    finds the file's added tokens (they hold no space, so none spans two pieces).
    """

    CACHE = 600_000

    def __init__(self, path: str):
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.plain = re.compile("([A-Za-zªµºÀ-ÖØ-öø-ÿ]+)([.,;:!?|]*)")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.shown = dict(zip(shown, shown, strict=True)) | {b: 256 + i for i, b in enumerate(hidden)}
        self.reset()

    def reset(self):
        self.places: dict[str, int] = {}
        self.cores: dict[str, bytes] = {}
        self.flat = array("i")
        self.begin = array("q", [0])

    def model(self, word: str) -> bytes:
        got = self.cores.get(word)
        if got is None:
            spelled = word.encode().decode("latin-1").translate(self.shown)
            got = self.cores[word] = array("i", [t.id for t in self.tokenizer.model.tokenize(spelled)]).tobytes()
        return got

    def learn(self, piece: str) -> int:
        found = self.plain.fullmatch(piece)
        if found:
            self.flat.frombytes(self.model(found[1].lower()))
            if found[2]:
                self.flat.frombytes(self.model(found[2]))
        else:
            self.flat.extend(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        self.begin.append(len(self.flat))
        self.places[piece] = place = len(self.begin) - 2
        return place

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids begin (one more at the end)."""
        if len(self.places) > self.CACHE:
            self.reset()
        get, learn = self.places.get, self.learn
        index, counts = [], []
        for text in texts:
            before = len(index)
            for piece in text.replace("\n", " ").split(" "):
                place = get(piece)
                index.append(learn(piece) if place is None else place)
            counts.append(len(index) - before)
        # views: nothing is learned before they are gone
        flat, begin = np.frombuffer(self.flat, np.int32) if self.flat else np.zeros(0, np.int32), np.frombuffer(self.begin, np.int64)
        index = np.array(index, np.int64)
        size = begin[index + 1] - begin[index]
        ends = np.cumsum(size)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[index] - (ends - size), size)
        offsets = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        return flat[where], offsets.astype(np.int64)


@lru_cache(maxsize=2)
def subwords(path: str) -> Subwords:
    """One per worker process: the cache lives on from task to task."""
    return Subwords(path)
