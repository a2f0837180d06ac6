"""Language identification with interpolated Kneser-Ney character models.

Text is lower-cased, letters stay and every other run becomes one space. For each language a model of order four is
smoothed with interpolated Kneser-Ney; the lower orders count distinct left neighbours. The models stand side by side in
sorted arrays of hashed grams. A text gets the language with the lowest cross-entropy a symbol. On labelled texts set
apart from the counting, the usual level and spread of that figure is measured; a text far above it is rejected.

Training takes whole texts of labelled rows, drawn row by row (so that copies weigh what they weigh in the table);
``rows`` bounds the expected number for each language, which also bounds the arrays that are broadcast.

Nulls and odd rows: a null text or one without letters gets ``und``, score 0, and is rejected; rows without a label or
text are not learned from; if nothing can be learned, every row is ``und``. Repeated rows are judged one by one, ties go
to the language that sorts first, an empty table gives an empty result. Columns to keep are passed through unread.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from flowlens.llm.common import mix, row_and_text, signed, text_chunks, text_of

ORDER = 4
ROWS = 600
LANGUAGES = 1000
#: Bytes of text whose symbols, grams and costs are held at once.
CHUNK = 1 << 18
#: Spreads above the usual cross-entropy at which a text is rejected.
REJECT_AT = 8.0
#: Least spread between texts, and spread that one symbol adds to a short text, in nats.
BETWEEN, WITHIN = 0.15, 2.0


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts (0: no letter, one for each run), and where each text's begin; a text ends in a 0."""
    parts = [t.decode("utf-8", "replace").lower() for t in texts]
    sizes = np.array([len(p) + 1 for p in parts])
    codes = np.frombuffer("\n".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letter_table()[codes]
    kept = letter.copy()
    kept[0] = True
    kept[1:] |= letter[:-1]
    begins = np.cumsum(sizes) - sizes
    kept[begins] = True
    out = np.where(letter, (codes ^ (codes >> 16)) & 0xFFFF, 0)[kept].astype(np.uint64)
    before = np.concatenate(([0], np.cumsum(kept)))
    return out, before[begins]


def grams(found: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The order-four gram that ends at each symbol, 16 bits a symbol, the last one lowest; 0 before a text's start."""
    out = found.copy()
    place = np.arange(len(found)) - np.repeat(begins, np.diff(np.append(begins, len(found))))
    for back in range(1, ORDER):
        earlier = np.zeros_like(found)
        earlier[back:] = found[:-back]
        earlier[place < back] = 0
        out |= earlier << np.uint64(16 * back)
    return out


def order_mask(order: int) -> np.uint64:
    return np.uint64((1 << (16 * order)) - 1)


class KneserNey:
    """One language, from the counts of its order-four grams."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, alphabet: int):
        self.alphabet = alphabet
        self.levels = []
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(np.float64)
        for k in range(ORDER, 0, -1):
            once, twice = (counts == 1).sum(), (counts == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            contexts, first, kinds = np.unique(keys >> np.uint64(16), return_index=True, return_counts=True)
            totals = np.add.reduceat(counts, first) if len(counts) else counts
            self.levels.append((keys, counts, discount, contexts, totals, kinds))
            keys, number = np.unique(keys & order_mask(k - 1), return_counts=True) if k > 1 else (keys, counts)
            counts = number.astype(np.float64)

    @staticmethod
    def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def probability(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        if order == 0:
            return np.full(len(codes), 1.0 / self.alphabet)
        lower = self.probability(codes & order_mask(order - 1) if order > 1 else codes, order - 1)
        keys, counts, discount, contexts, totals, kinds = self.levels[ORDER - order]
        at, known = self.find(keys, codes)
        seen = np.where(known, np.maximum(counts[at] - discount, 0), 0)
        at, known = self.find(contexts, codes >> np.uint64(16))
        return np.where(known, (seen + discount * kinds[at] * lower) / totals[at], lower)


@dataclass
class Model:
    languages: list[str]
    parts: list[KneserNey]
    hashes: np.ndarray
    costs: np.ndarray
    #: for each language the usual cross-entropy, its spread between texts and its spread by one symbol
    usual: np.ndarray | None = None

    def entropies(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nats a symbol by text and language, symbols, and whether there is a letter."""
        found, begins = symbols(texts)
        codes = grams(found, begins)
        hashed = mix(codes)
        at = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
        cost = self.costs[at]
        miss = np.flatnonzero(self.hashes[at] != hashed)
        if len(miss):
            rare, back = np.unique(codes[miss], return_inverse=True)
            cost[miss] = np.stack([-np.log(p.probability(rare)) for p in self.parts], 1).astype(np.float32)[back]
        sizes = np.diff(np.append(begins, len(found)))
        lettered = np.add.reduceat((found > 0).astype(np.int64), begins) > 0
        return np.add.reduceat(cost, begins, axis=0, dtype=np.float64) / sizes[:, None], sizes, lettered

    def judge(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best language, score, cross-entropy, and rejection of each text."""
        entropy, sizes, lettered = self.entropies(texts)
        best = entropy.argmin(1)
        low = entropy[np.arange(len(best)), best]
        share = 1 / np.exp(np.maximum(-(entropy - low[:, None]) * sizes[:, None], -700)).sum(1)
        if self.usual is None:
            far = np.zeros(len(best))
        else:
            level, between, within = self.usual[best].T
            far = (low - level) / np.sqrt(between**2 + within**2 / sizes)
        score = share / (1 + np.exp(np.clip(far - REJECT_AT, -50, 50)))
        return np.where(lettered, best, -1), np.where(lettered, score, 0.0), low, ~lettered | (far > REJECT_AT)


def count_grams(rows):
    """(lang, gram, n) of whole texts; each task adds up its own before the shuffle."""

    def count(batches):
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for first, texts in text_chunks(batch, "text", CHUNK):
                found, begins = symbols(texts)
                codes, of = grams(found, begins), np.repeat(langs[first:first + len(texts)], np.diff(np.append(begins, len(found))))
                for lang in set(of):
                    keys, number = np.unique(codes[of == lang], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), signed(keys), pa.array(number)], ["lang", "gram", "n"])

    return rows.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(labelled, rows: int = ROWS, seed: int = 17) -> Model | None:
    """``labelled``: lang, text. At most about ``rows`` texts a language are drawn; a fifth of them calibrates."""
    usable = labelled.select(F.col("lang").cast("string"), F.col("text").cast("string")).where("lang is not null and text is not null")
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).limit(LANGUAGES + 1).toArrow()
    if sizes.num_rows == 0:
        return None
    if sizes.num_rows > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} labels")
    # the few labels join without moving a text
    known = F.broadcast(labelled.sparkSession.createDataFrame(sizes))
    drawn = (
        usable.withColumn("u", F.rand(seed)).join(known, "lang").where(F.col("u") * F.col("rows") < rows)
        .withColumn("calibrates", F.col("u") * F.col("rows") >= 0.8 * F.least(F.lit(rows), F.col("rows")))
    )
    counted = count_grams(drawn.where("not calibrates")).toArrow()
    if counted.num_rows == 0:
        return None
    lang = np.array(counted["lang"].to_pylist(), dtype=object)
    gram, number = counted["gram"].to_numpy().view(np.uint64), counted["n"].to_numpy()
    languages = sorted(set(lang))
    alphabet = len(np.unique(gram & order_mask(1))) + 1
    parts = [KneserNey(gram[lang == x], number[lang == x], alphabet) for x in languages]
    union = np.unique(gram)
    costs = np.stack([-np.log(p.probability(union)) for p in parts], 1).astype(np.float32)
    hashed = mix(union)
    order = np.argsort(hashed)
    model = Model(languages, parts, hashed[order], np.ascontiguousarray(costs[order]))
    model.usual = calibrate(drawn.where("calibrates"), model)
    return model


def calibrate(rows, model: Model) -> np.ndarray:
    """Level and spreads of the cross-entropy, by language, of labelled texts not counted in the model."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        known = {x: i for i, x in enumerate(shared.value.languages)}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, texts in text_chunks(batch, "text", CHUNK):
                entropy, sizes, lettered = shared.value.entropies(texts)
                own = [(known[x], i) for i, x in enumerate(langs[first:first + len(texts)]) if x in known and lettered[i]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in own], pa.int64()), pa.array([float(entropy[i, k]) for k, i in own], pa.float64()),
                     pa.array([int(sizes[i]) for _, i in own], pa.int64())], ["k", "h", "n"])

    seen = rows.select("lang", "text").mapInArrow(measure, "k long, h double, n long")
    figures = seen.groupBy("k").agg(
        F.median("h").alias("level"), F.coalesce(F.stddev_pop("h"), F.lit(0.0)).alias("between"),
    ).collect()
    usual = np.tile([[3.0, 1.0, WITHIN]], (len(model.languages), 1))
    for x in figures:
        usual[x["k"]] = (x["level"], max(x["between"], BETWEEN), WITHIN)
    return usual


def predict(docs, model: Model | None, keep: list[str], text: str = "text"):
    """The ``keep`` columns as struct ``row``, with lang_pred, score, cross_entropy and rejected, for each row."""
    given = docs.select(*row_and_text(keep, text))
    if model is None:
        return given.select(
            "row", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"),
            F.lit(True).alias("rejected"),
        )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        names = np.array([*shared.value.languages, "und"], dtype=object)
        for batch in batches:
            for first, texts in text_chunks(text_of(batch, keep, text), None, CHUNK):
                best, score, entropy, rejected = shared.value.judge(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(first, len(texts)), pa.array(names[best], pa.string()), pa.array(score),
                     pa.array(np.where(best < 0, np.nan, entropy), from_pandas=True), pa.array(rejected)],
                    ["row", "lang_pred", "score", "cross_entropy", "rejected"])

    kind = given.schema["row"].dataType.simpleString()
    return given.mapInArrow(judge, f"row {kind}, lang_pred string, score double, cross_entropy double, rejected boolean")
