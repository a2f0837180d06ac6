"""Benchmark decontamination by latent semantic retrieval.

Words of the benchmark items are weighted by how rare they are in all documents. Items are cut into passages like
documents. A randomised SVD of the items' TF-IDF passages (range finder with power iterations; the rows' products are
added up in Spark) gives a latent space. Every passage of every document is folded in; those near a passage of an item
by cosine, and with enough of its weight, are candidates for the item. So are stretches that hold the item's answer, or
as many of the rarer half of its words as no copy can do without, so that no pair that would be verified is missed,
however long the item and whichever words are replaced. A candidate is verified on the words themselves: by the longest common subsequence of the item and a stretch of the document
not much longer than the item. A share of ``COPY`` of the item's words is a copy; a paraphrase needs ``PARAPHRASE`` and
the item's answer (its last words, in one piece).

The benchmark is a stated query set. It is taken in blocks of about ``BLOCK`` item passages, which bounds what the driver and each
broadcast hold; documents are never collected.

Nulls and odd rows: null and empty texts are clean; items without words match nothing; a null item id is reported as null
but counts; repeated rows are judged one by one, ties between items go to the smaller id. An empty benchmark leaves all
documents clean, an empty table gives an empty result. Columns to keep are passed through unread.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from flowlens.llm.common import Words, text_chunks

BLOCK = 4096
#: Words of a passage and the shift to the next one.
PASSAGE, SHIFT = 48, 24
DIMENSIONS, EXTRA, POWERS = 256, 16, 2
#: Cosine, and share of the item passage's weight, from which a passage is a candidate.
COSINE, WEIGHT = 0.4, 0.3
COPY, PARAPHRASE, ANSWER = 0.8, 0.6, 5


@dataclass
class Item:
    id: int | None
    words: list[int]

    def masks(self) -> dict[int, int]:
        out: dict[int, int] = {}
        for i, w in enumerate(self.words):
            out[w] = out.get(w, 0) | 1 << i
        return out


def common_subsequence(masks: dict[int, int], size: int, other: list[int]) -> int:
    """Length of the longest common subsequence with the item of ``masks`` (bit-parallel)."""
    full = (1 << size) - 1
    row = full
    for w in other:
        hit = row & masks.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def holds(answer: list[int], stretch: list[int]) -> bool:
    return any(stretch[i:i + len(answer)] == answer for i in range(len(stretch) - len(answer) + 1))


def best_share(item: Item, words: list[int], start: int, stop: int) -> tuple[float, bool]:
    """Largest share of the item in a stretch of words[start:stop], and whether one stretch makes it a leak."""
    size = len(item.words)
    step, length = max(1, size // 4), size + size // 2
    masks, answer = item.masks(), item.words[-ANSWER:]
    best, leak = 0.0, False
    for a in range(start // step * step, max(stop - size, start) + 1, step):
        stretch = words[a:a + length]
        share = common_subsequence(masks, size, stretch) / size
        leak |= share >= COPY or share >= PARAPHRASE and holds(answer, stretch)
        best = max(best, share)
    return best, leak


@dataclass
class Space:
    """A block of items, their passages in latent space, and what no leak of them is without."""

    items: list[Item]
    #: The item of each passage.
    of: np.ndarray
    words: np.ndarray
    weights: np.ndarray
    axes: np.ndarray
    latent: np.ndarray
    least: float
    #: Items by word: (begin of each word's items, items), for the rarer words and for the last word of the answer.
    rare: tuple[np.ndarray, np.ndarray]
    last: tuple[np.ndarray, np.ndarray]
    #: How many rarer words a copy of each item has at least.
    need: np.ndarray


def cuts(n: int) -> np.ndarray:
    """Bounds of the passages of an item of n words, about equally long."""
    return np.linspace(0, n, -(-n // PASSAGE) + 1).astype(np.int64)


def by_word(pairs: list[tuple[int, int]], n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Items of each word from distinct (word, item) pairs."""
    both = np.array(sorted(set(pairs)), np.int64).reshape(-1, 2)
    return np.searchsorted(both[:, 0], np.arange(n_words + 1)), both[:, 1]


def rarer_words(at: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, int]:
    """The rarer half of an item's words, and how many of them are in every stretch that shares ``COPY`` of the item."""
    size = len(at)
    shared = next(c for c in range(size + 1) if c / size >= COPY)
    number = max(size // 2, size - shared + 1)
    return at[np.argsort(-weights[at], kind="stable")[:number]], shared - (size - number)


def read_items(rows) -> list[Item]:
    return [Item(r["item_id"], words) for r in rows if (words := Words([(r["text"] or "").encode()], lower=True).hashes.tolist())]


def document_frequency(docs, words: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents each of the sorted word hashes is, and the number of documents."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def count(batches):
        known = shared.value
        found, total = np.zeros(len(known) + 1, np.int64), 0
        for batch in batches:
            for _, texts in text_chunks(batch, "text"):
                w = Words(texts, lower=True)
                at = np.minimum(np.searchsorted(known, w.hashes), len(known) - 1)
                hit = known[at] == w.hashes
                pairs = np.unique(w.doc()[hit] * len(known) + at[hit])
                found[:-1] += np.bincount(pairs % len(known), minlength=len(known))
                total += len(texts)
        found[-1] = total
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], ["k", "n"])

    got = docs.select("text").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(words) + 1, np.int64)
    out[got["k"].to_numpy()] = got["n"].to_numpy()
    return out[:-1], int(out[-1])


def latent_axes(items, words: np.ndarray, weights: np.ndarray, dimensions: int, seed: int = 3) -> np.ndarray:
    """The leading right singular vectors of the items' TF-IDF passages: a matrix of words x dimensions."""
    context = items.sparkSession.sparkContext
    size = min(dimensions + EXTRA, len(words))
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(words), size)))[0]

    def summed(basis, gram: bool):
        """The sum over all rows a of a'(aB), or with ``gram`` of (aB)'(aB)."""
        shared = context.broadcast((words, weights, basis))

        def add(batches):
            known, weight, b = shared.value
            total = np.zeros((b.shape[1] if gram else len(known), b.shape[1]))
            for batch in batches:
                for _, texts in text_chunks(batch, "text"):
                    w = Words(texts, lower=True)
                    at = np.searchsorted(known, w.hashes)
                    bounds = [(a + f, a + t) for a, n in zip(w.offsets, w.counts(), strict=False) for f, t in itertools.pairwise(cuts(int(n)))]
                    for first, end in bounds:
                        own, tf = np.unique(at[first:end], return_counts=True)
                        x = tf * weight[own]
                        y = x @ b[own]
                        if gram:
                            total += np.outer(y, y)
                        else:
                            total[own] += np.outer(x, y)
            some = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(total[some]), pa.list_(pa.float64()))], ["k", "row"])

        parts = items.select("text").mapInArrow(add, "k long, row array<double>")
        sums = parts.select("k", F.posexplode("row").alias("j", "v")).groupBy("k", "j").agg(F.sum("v").alias("v")).toArrow()
        out = np.zeros((basis.shape[1] if gram else len(words), basis.shape[1]))
        out[sums["k"].to_numpy(), sums["j"].to_numpy()] = sums["v"].to_numpy()
        return out

    for _ in range(POWERS):
        basis = np.linalg.qr(summed(basis, False))[0]
    values, vectors = np.linalg.eigh(summed(basis, True))
    lead = np.argsort(-values)[:dimensions]
    return (basis @ vectors[:, lead[values[lead] > 1e-9 * max(values.max(), 1e-300)]]).astype(np.float32)


def build_space(docs, block, dimensions: int = DIMENSIONS) -> Space | None:
    items = read_items(block.select("item_id", "text").collect())
    if not items:
        return None
    words = np.unique(np.array([w for x in items for w in x.words], np.uint64))
    frequency, total = document_frequency(docs, words)
    weights = np.log((total + 1) / (frequency + 1)) + 1e-3
    known = block.where("text is not null")
    axes = latent_axes(known, words, weights, dimensions)
    spelled = [np.searchsorted(words, np.array(x.words, np.uint64)) for x in items]
    passages = [(i, at[f:t]) for i, at in enumerate(spelled) for f, t in itertools.pairwise(cuts(len(at)))]
    latent = np.zeros((len(passages), axes.shape[1]), np.float32)
    for k, (_, at) in enumerate(passages):
        own, tf = np.unique(at, return_counts=True)
        latent[k] = (tf * weights[own]).astype(np.float32) @ axes[own]
    least = min(float((weights[at] ** 2).sum()) for _, at in passages)
    rarer = [rarer_words(at, weights) for at in spelled]
    return Space(
        items, np.array([i for i, _ in passages]), words, weights.astype(np.float32), axes * weights[:, None].astype(np.float32), latent, least,
        by_word([(w, i) for i, (own, _) in enumerate(rarer) for w in own.tolist()], len(words)),
        by_word([(at[-1], i) for i, at in enumerate(spelled)], len(words)), np.array([n for _, n in rarer]))


def meetings(lists: tuple[np.ndarray, np.ndarray], at: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, item) for the items of the word at each place."""
    begin, items = lists
    number = begin[at[places] + 1] - begin[at[places]]
    some = number > 0
    places, number = places[some], number[some]
    ends = np.cumsum(number)
    return np.repeat(places, number), items[np.arange(number.sum()) + np.repeat(begin[at[places]] - (ends - number), number)]


def answers_and_copies(space: Space, words: Words, at: np.ndarray, hit: np.ndarray, of: np.ndarray) -> list[np.ndarray]:
    """(text, item, first word, end word) of stretches that hold an item's answer, or enough of its rarer words."""
    places = np.flatnonzero(hit)
    found = []
    # the answer in one piece: its last word is here, the others are before
    p, i = meetings(space.last, at, places)
    own = [x.words[-ANSWER:] for x in space.items]
    size = np.array([len(x) for x in own])
    spelled = np.array([[0] * (ANSWER - len(x)) + x for x in own], np.uint64)
    keep = p - size[i] + 1 >= words.offsets[of[p]]
    p, i = p[keep], i[keep]
    for back in range(1, ANSWER):
        keep = (back >= size[i]) | (words.hashes[p - np.minimum(back, p)] == spelled[i, ANSWER - 1 - back])
        p, i = p[keep], i[keep]
    found.append(np.stack([of[p], i, p - size[i] + 1 - words.offsets[of[p]], p + 1 - words.offsets[of[p]]], 1))
    # the needed number of rarer words within a stretch
    p, i = meetings(space.rare, at, places)
    order = np.lexsort((p, i))
    p, i = p[order], i[order]
    length = np.array([len(x.words) + len(x.words) // 2 for x in space.items])
    first = np.arange(len(p))
    last = first + space.need[i] - 1
    inside = last < len(p)
    first, last = first[inside], last[inside]
    fits = (i[first] == i[last]) & (of[p[first]] == of[p[last]]) & (p[last] - p[first] < length[i[first]])
    first, last = first[fits], last[fits]
    found.append(np.stack([of[p[first]], i[first], p[first] - words.offsets[of[p[first]]], p[last] + 1 - words.offsets[of[p[last]]]], 1))
    return found


def stretch_sums(space: Space, at: np.ndarray, hit: np.ndarray, start, middle, second, stop, number) -> np.ndarray:
    """Sums of the axes of the known words of [start, middle) and [second, stop); stretches of one number are the same."""
    more = second < stop
    numbers, first, back = np.unique(np.concatenate((number, number[more] + 1)), return_index=True, return_inverse=True)
    begin, end = (np.concatenate(z)[first] for z in ((start, second[more]), (middle, stop[more])))
    size = end - begin
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
    known = np.concatenate(([0], np.cumsum(hit[place])))
    bounds = known[np.concatenate(([0], np.cumsum(size)))]
    some = np.flatnonzero(np.diff(bounds))
    sums = np.zeros((len(numbers), space.axes.shape[1]), space.axes.dtype)
    if len(some):
        sums[some] = np.add.reduceat(space.axes[at[place[hit[place]]]], bounds[some], axis=0)
    out = sums[back[:len(number)]]
    out[more] += sums[back[len(number):]]
    return out


def candidates(space: Space, words: Words) -> list[tuple[int, int, int, int]]:
    """(text, item, first word, end word within the text) of stretches that may hold an item, overlapping ones joined."""
    at = np.minimum(np.searchsorted(space.words, words.hashes), len(space.words) - 1)
    hit = space.words[at] == words.hashes
    sizes = words.counts()
    number = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - PASSAGE) // SHIFT)), 0)
    doc = np.repeat(np.arange(len(sizes)), number)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)) * SHIFT + words.offsets[doc]
    stop = np.minimum(start + PASSAGE, words.offsets[doc + 1])
    # what a passage has of all items' words is at least what it has of one item's
    mass = np.concatenate(([0], np.cumsum(np.where(hit, space.weights[at].astype(np.float64) ** 2, 0))))
    rich = np.flatnonzero(mass[stop] - mass[start] >= WEIGHT * space.least)
    norms = np.linalg.norm(space.latent, axis=1)
    found = answers_and_copies(space, words, at, hit, words.doc())
    # passages overlap: a stretch of SHIFT words is added up once, and a passage is one or two of them
    steps = -(-sizes // SHIFT)
    head = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number) + (np.cumsum(steps) - steps)[doc]
    for a in range(0, len(rich), 512):
        own = rich[a:a + 512]
        vectors = stretch_sums(space, at, hit, start[own], np.minimum(start[own] + SHIFT, stop[own]), start[own] + SHIFT, stop[own], head[own])
        products = vectors @ space.latent.T
        near = (products >= COSINE * np.linalg.norm(vectors, axis=1)[:, None] * norms) & (products >= WEIGHT * norms**2) & (products > 0)
        p, i = np.nonzero(near)
        found.append(np.stack([doc[own[p]], space.of[i], start[own[p]] - words.offsets[doc[own[p]]], stop[own[p]] - words.offsets[doc[own[p]]]], 1))
    out = []
    every = np.concatenate(found)
    for d, i, s, e in every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))].tolist():
        if out and out[-1][:2] == (d, i) and s <= out[-1][3]:
            out[-1] = (d, i, out[-1][2], max(e, out[-1][3]))
        else:
            out.append((d, i, s, e))
    return out


def find_leaks(docs, benchmark, keep: list[str], text: str = "text"):
    """The ``keep`` columns as struct ``row``, with contaminated, n_items, best_item, best_share, for each row."""
    found = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col(text).cast("string").alias("text"), F.lit(0).cast("long").alias("n_items"),
                        F.lit(None).cast("long").alias("best_item"), F.lit(0.0).alias("best_share"))
    kind = found.schema["row"].dataType.simpleString()
    given = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    # some words too many for blanks at the ends
    sizes = F.ceil(F.size(F.split("text", "[ \\t-\\r]+")) / PASSAGE)
    blocks = max(1, -(-(given.where("text is not null").agg(F.sum(sizes)).first()[0] or 0) // BLOCK))
    for b in range(blocks):
        block = given if blocks == 1 else given.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        space = build_space(docs.select(F.col(text).cast("string").alias("text")), block)
        if space is not None:
            found = found.mapInArrow(judge_with(docs.sparkSession.sparkContext.broadcast(space)), f"row {kind}, text string, n_items long, best_item long, best_share double")
    return found.select("row", (F.col("n_items") > 0).alias("contaminated"), "n_items", "best_item", "best_share")


def judge_with(shared):
    def judge(batches):
        space = shared.value
        for batch in batches:
            n_items, best_item, best = (batch.column(c).to_pylist() for c in ("n_items", "best_item", "best_share"))
            for first, texts in text_chunks(batch, "text"):
                words = Words(texts, lower=True)
                leaked, spoken = {}, (None, [])
                for d, i, s, e in candidates(space, words):
                    if spoken[0] != d:
                        spoken = (d, words.hashes[words.offsets[d]:words.offsets[d + 1]].tolist())
                    item = space.items[i]
                    share, leak = best_share(item, spoken[1], max(0, s - 2 * len(item.words)), min(len(spoken[1]), e + len(item.words)))
                    if leak:
                        leaked[d, i] = max(share, leaked.get((d, i), 0.0))
                for (d, i), share in sorted(leaked.items()):
                    at, own = first + d, space.items[i].id
                    n_items[at] += 1
                    if (share, -(own if own is not None else 1 << 62)) > (best[at], -(best_item[at] if best_item[at] is not None else 1 << 62)) or n_items[at] == 1:
                        best_item[at], best[at] = own, share
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("text"), pa.array(n_items, pa.int64()), pa.array(best_item, pa.int64()), pa.array(best, pa.float64())],
                ["row", "text", "n_items", "best_item", "best_share"])

    return judge
