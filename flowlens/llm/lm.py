"""Language-model scores: a causal self-attention model over subword ids, and an add-one word model beside it.

The attention model sees windows of ``WINDOW`` subword ids, each shifted by ``STRIDE``, so that every id is scored once
with context from the window before. Every id has its own embedding. What is predicted is one of ``CLASSES`` classes of
ids of about equal frequency: the model gives a class its probability, and the counts of all training texts divide it
among the class's ids. One layer, trained in numpy: in each round every Spark task runs Adam over its share of the texts
from the same start, and the changes are averaged, those of an embedding by how often each task met its id. A text
belongs to one of the rounds, by hash, so that all of them together are one pass over all texts.

The word model needs the count of every word in all training texts. Words are packed by task and by range of their hash:
each range meets in one place, where counts are added up and each document's part of the sum is taken; the parts then
meet by the task that read the documents. Frequent words are added up before they are sent.

Nulls and odd rows: a null or empty text has the end token alone; a null id is never held out; repeated rows are scored
one by one and learned as often as they occur. Without training texts every token is unknown and classes are equally
likely. An empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from flowlens.llm.common import Words, keyed, mix, subwords, text_chunks
from flowlens.session import materialize

#: Words packed at once by a task.
PACK = 1_000_000
CLASSES, DIM, WINDOW, STRIDE = 64, 16, 16, 12
LEAD = WINDOW - STRIDE
#: Every text is trained on in one of so many rounds.
ROUNDS, BATCH, RATE = 3, 64, 0.01
SCORED = 64


# --- words -----------------------------------------------------------------------------------------------------------

PACKED = pa.schema([
    ("bucket", pa.int32()), ("flush", pa.int64()), ("words", pa.binary()), ("train", pa.binary()), ("index", pa.binary()),
    ("docs", pa.int32()), ("n", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())),
    ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64()))])
PACKED_TYPES = ("bucket int, flush long, words binary, train binary, index binary, docs int, n binary, doc_ids array<long>, "
                "keys array<long>, held array<boolean>, sizes array<long>")


def pack(hashes, sizes, held, doc_ids, keys, buckets: int, flush: int) -> pa.RecordBatch:
    """One row for each range of hashes: its distinct words, their training counts, and each document's word places."""
    doc = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
    words, place = np.unique(hashes, return_inverse=True)
    train = np.bincount(place[~held[doc]], minlength=len(words)).astype(np.uint32)
    bucket = ((words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    sides = np.searchsorted(bucket, np.arange(buckets + 1))
    of_token = bucket[place]
    order = np.argsort(of_token.astype(np.uint16) if buckets < 65536 else of_token, kind="stable")
    token_sides = np.searchsorted(of_token[order], np.arange(buckets + 1))
    local, doc = (place[order] - sides[of_token[order]]).astype(np.uint32), doc[order]
    home = int(mix(np.array([flush], np.uint64))[0] % np.uint64(buckets))
    columns = [[] for _ in PACKED]
    for b in range(buckets):
        a, z, s, t = sides[b], sides[b + 1], token_sides[b], token_sides[b + 1]
        if a == z and b != home:
            continue
        n = np.bincount(doc[s:t], minlength=len(sizes))
        index = local[s:t].astype(np.uint16) if z - a <= 65536 else local[s:t]
        meta = (doc_ids, keys, held, sizes) if b == home else (None,) * 4
        row = (b, flush, words[a:z].tobytes(), train[a:z].tobytes(), index.tobytes(), len(sizes),
               n.astype(np.uint16 if n.max(initial=0) <= 65535 else np.uint32).tobytes(), *meta)
        for column, value in zip(columns, row, strict=True):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PACKED, strict=True)], schema=PACKED)


def packed_words(rows, buckets: int):
    def emit(batches):
        task, number = TaskContext.get().partitionId(), 0
        held_back, waiting = [], 0

        def flush():
            parts = [np.concatenate(x) for x in zip(*held_back, strict=True)]
            return pack(*parts, buckets, (task << 32) + number)

        for batch in batches:
            # null ids are kept as such until the rows are unpacked
            ids = np.array(batch.column("doc_id").to_pylist(), dtype=object)
            keys, held = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("text_key", "held_out"))
            for first, texts in text_chunks(batch, "text"):
                words, own = Words(texts, lower=True), slice(first, first + len(texts))
                held_back.append((words.hashes, words.counts(), held[own], ids[own], keys[own]))
                waiting += len(words.hashes) + 8 * len(texts)
                if waiting >= PACK:
                    yield flush()
                    held_back, waiting, number = [], 0, number + 1
        if held_back:
            yield flush()

    return rows.mapInArrow(emit, PACKED_TYPES)


COUNTED = ("flush long, sums binary, known binary, doc_ids array<long>, keys array<long>, held array<boolean>, "
           "sizes array<long>, distinct_words long, train_words long")


def count_bucket(rows: pa.Table) -> pa.Table:
    """All words of one range: for each packed row the documents' sums of log10(count + 1) and their known words."""
    own = [np.frombuffer(x.as_py(), np.uint64) for x in rows["words"]]
    train = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in rows["train"]])
    words, place = np.unique(np.concatenate(own), return_inverse=True)
    count = np.bincount(place, weights=train, minlength=len(words)) if len(words) else np.zeros(0)
    cost, known = np.log10(count + 1), count > 0
    at, out = 0, [[], []]
    for words_here, index, docs, n in zip(own, rows["index"], rows["docs"], rows["n"], strict=True):
        here = place[at:at + len(words_here)]
        at += len(words_here)
        raw, number = index.as_py(), n.as_py()
        sizes = np.frombuffer(number, np.uint16 if len(number) == 2 * docs.as_py() else np.uint32).astype(np.int64)
        token = here[np.frombuffer(raw, np.uint16 if len(raw) == 2 * sizes.sum() else np.uint32)]
        some = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[some]
        sums, hits = np.zeros(len(sizes)), np.zeros(len(sizes), np.uint32)
        if len(some):
            sums[some], hits[some] = np.add.reduceat(cost[token], starts), np.add.reduceat(known[token].astype(np.uint32), starts)
        out[0].append(sums.tobytes())
        out[1].append(hits.tobytes())
    once = np.zeros(rows.num_rows, np.int64)
    once[0] = 1
    return pa.table([
        rows["flush"].combine_chunks(), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()),
        *[rows[c].combine_chunks() for c in ("doc_ids", "keys", "held", "sizes")],
        pa.array(once * int(known.sum())), pa.array(once * int(count.sum()))],
        names=["flush", "sums", "known", "doc_ids", "keys", "held", "sizes", "distinct_words", "train_words"])


def unpack(rows: pa.Table) -> pa.Table:
    """The documents of one packed task part, each with its sums over all ranges."""
    at = next(i for i in range(rows.num_rows) if rows["doc_ids"][i].is_valid)
    sizes = np.array(rows["sizes"][at].as_py(), np.int64)
    sums, known = np.zeros(len(sizes)), np.zeros(len(sizes), np.int64)
    for s, k in zip(rows["sums"], rows["known"], strict=True):
        sums += np.frombuffer(s.as_py(), np.float64)
        known += np.frombuffer(k.as_py(), np.uint32)
    return pa.table([rows["doc_ids"][at].values, rows["keys"][at].values, rows["held"][at].values, pa.array(sizes), pa.array(sums), pa.array(known)],
                    names=["doc_id", "text_key", "held_out", "n_words", "word_sum", "known_words"])


def word_scores(rows):
    """doc_id, text_key, held_out, n_tokens, n_known, train_tokens, base_score of (doc_id, text_key, text, held_out)."""
    # more ranges make smaller groups, but each document then gets its sum in more parts
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = materialize(packed_words(rows, buckets).groupBy("bucket").applyInArrow(count_bucket, COUNTED), "word-counts")
    of_rows = rows.agg(F.count_if(~F.col("held_out")).alias("ends")).first()
    of_words = counted.agg(F.sum("distinct_words").alias("v"), F.sum("train_words").alias("n")).first()
    # the end token of each training text counts as a token and as a distinct one
    ends = of_rows["ends"]
    total, distinct = (of_words["n"] or 0) + ends, (of_words["v"] or 0) + (ends > 0)
    docs = counted.drop("distinct_words", "train_words").groupBy("flush").applyInArrow(
        unpack, "doc_id long, text_key long, held_out boolean, n_words long, word_sum double, known_words long")
    n_tokens = F.col("n_words") + 1
    return docs.select(
        "doc_id", "text_key", "held_out", n_tokens.alias("n_tokens"), (F.col("known_words") + int(ends > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("word_sum") + float(np.log10(ends + 1)) - n_tokens * float(np.log10(total + distinct + 1))).alias("base_score"))


# --- the attention model ---------------------------------------------------------------------------------------------

SHAPES = {"P": (WINDOW, DIM), "Q": (DIM, DIM), "K": (DIM, DIM), "V": (DIM, DIM), "O": (DIM, DIM), "U": (DIM, CLASSES), "b": (CLASSES,),
          "E": (CLASSES + 1, DIM)}
#: All parameters lie in one table of rows of ``DIM``; the embeddings begin at this row.
FIRST = sum(int(np.prod(s)) for k, s in SHAPES.items() if k != "E") // DIM
FUTURE = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)


def start_parameters(log_share: np.ndarray, classes: np.ndarray | None = None, seed: int = 5) -> dict[str, np.ndarray]:
    """``classes``: of each id; the ids' embeddings start as those of their classes. The last row is the start of a text."""
    rng = np.random.default_rng(seed)
    out = {k: (rng.standard_normal(s) / np.sqrt(DIM)).astype(np.float32) for k, s in SHAPES.items()}
    out["U"] *= np.float32(0.1)
    out["b"] = log_share.astype(np.float32)
    if classes is not None:
        out["E"] = out["E"][np.append(classes, CLASSES)]
    return out


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].reshape(-1, DIM) for k in SHAPES])


def unflat(rows: np.ndarray) -> dict[str, np.ndarray]:
    """The parameters as views of the table."""
    out, at = {"E": rows[FIRST:]}, 0
    for k, s in SHAPES.items():
        if k != "E":
            n = int(np.prod(s)) // DIM
            out[k], at = rows[at:at + n].reshape(s), at + n
    return out


def times(x: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    return (x.reshape(-1, x.shape[-1]) @ matrix).reshape(*x.shape[:-1], -1)


def attend(p, inputs):
    """Hidden states of the scored positions, and what the gradient needs. Every position sees itself and what is before."""
    x = p["E"][inputs]
    x += p["P"]
    late = x[:, LEAD:]
    q, k, v = times(late, p["Q"]), times(x, p["K"]), times(x, p["V"])
    a = q @ k.transpose(0, 2, 1)
    a *= np.float32(1 / np.sqrt(DIM))
    a += FUTURE[LEAD:]
    a -= a.max(-1, keepdims=True)
    np.exp(a, out=a)
    a /= a.sum(-1, keepdims=True)
    z = a @ v
    return late + times(z, p["O"]), (x, q, k, v, a, z)


def log_softmax(logits):
    top = logits.max(-1, keepdims=True)
    return logits - top - np.log(np.exp(logits - top).sum(-1, keepdims=True))


def class_scores(p, inputs, targets):
    """Natural log probability of each target class (windows x STRIDE)."""
    hidden, _ = attend(p, inputs)
    # a class a row: the sums run along the positions
    logits = p["U"].T @ hidden.reshape(-1, DIM).T
    logits += p["b"][:, None]
    hit = logits[targets.ravel(), np.arange(logits.shape[1])]
    top = logits.max(0)
    logits -= top
    np.exp(logits, out=logits)
    return (hit - top - np.log(logits.sum(0))).reshape(targets.shape)


def gradients(p, inputs, targets, weight):
    """Of the mean negative log probability over positions of weight 1: by parameter, and by input for the embeddings."""
    hidden, (x, q, k, v, a, z) = attend(p, inputs)
    positions = hidden.reshape(-1, DIM)
    d = p["U"].T @ positions.T
    d += p["b"][:, None]
    d -= d.max(0)
    np.exp(d, out=d)
    d /= d.sum(0)
    d[targets.ravel(), np.arange(d.shape[1])] -= 1
    d *= weight.ravel() / max(weight.sum(), 1)
    g = {"U": positions.T @ d.T, "b": d.sum(1)}
    dh = d.T @ p["U"].T
    g["O"] = z.reshape(-1, DIM).T @ dh
    dz = (dh @ p["O"].T).reshape(z.shape)
    dv, ds = a.transpose(0, 2, 1) @ dz, dz @ v.transpose(0, 2, 1)
    ds -= (ds * a).sum(-1, keepdims=True)
    ds *= a
    ds *= np.float32(1 / np.sqrt(DIM))
    dq, dk = ds @ k, ds.transpose(0, 2, 1) @ q
    late = np.ascontiguousarray(x[:, LEAD:])
    for name, own, y in (("Q", late, dq), ("K", x, dk), ("V", x, dv)):
        g[name] = own.reshape(-1, DIM).T @ y.reshape(-1, DIM)
    dx = times(dk, p["K"].T)
    dx += times(dv, p["V"].T)
    dx[:, LEAD:] += times(dq, p["Q"].T)
    dx[:, LEAD:] += dh.reshape(hidden.shape)
    g["P"] = dx.sum(0)
    return g, dx


def by_id(inputs, dx):
    """The distinct input ids, how often each occurs, and the sum of its gradients."""
    given = inputs.ravel()
    order = np.argsort(given)
    begins = np.flatnonzero(np.diff(given[order], prepend=-1))
    return given[order[begins]], np.diff(np.append(begins, len(given))), np.add.reduceat(dx.reshape(-1, DIM)[order], begins, axis=0)


def gradient(p, inputs, targets, weight):
    """All gradients, with one row for every embedding."""
    g, dx = gradients(p, inputs, targets, weight)
    ids, _, rows = by_id(inputs, dx)
    g["E"] = np.zeros_like(p["E"])
    g["E"][ids] = rows
    return g


def windows_of(classes: np.ndarray, offsets: np.ndarray, end_class: int, ids: np.ndarray | None = None, start: int = CLASSES):
    """Inputs, targets, weights and document of all windows. ``classes``: those of all texts, ``offsets``: their begins.

    The inputs are the texts' ``ids``, if given, and ``start`` before a text.
    """
    sizes = np.diff(offsets) + 1
    number = -(-sizes // STRIDE)
    doc = np.repeat(np.arange(len(sizes)), number)
    first = (np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)) * STRIDE

    def at(values, place, fill):
        inside = (place >= 0) & (place < (sizes[doc] - 1)[:, None])
        padded = np.append(values, fill)
        return np.where(inside, padded[np.where(inside, offsets[doc][:, None] + place, 0)], fill)

    targets = first[:, None] + np.arange(STRIDE)
    weight = (targets < sizes[doc][:, None]).astype(np.float32)
    # position t is predicted from what ends at t - 1; before the text stands the start
    inputs = at(classes if ids is None else ids.astype(np.int64), first[:, None] + np.arange(WINDOW) - LEAD - 1, start)
    return inputs, at(classes, targets, end_class), weight, doc


class Vocabulary:
    """Classes of about equal frequency over ids by count, and each id's log10 share of its class."""

    def __init__(self, counts: np.ndarray):
        """``counts``: of each id in the training texts; the last one is the end id."""
        order = np.argsort(-counts, kind="stable")
        mass = np.cumsum(counts[order] + 1.0)
        self.classes = np.zeros(len(counts), np.int64)
        self.classes[order] = np.minimum((mass - (counts[order] + 1.0) / 2) / mass[-1] * CLASSES, CLASSES - 1).astype(np.int64)
        total = np.bincount(self.classes, counts + 1.0, CLASSES)
        self.share = np.log10((counts + 1.0) / total[self.classes])
        self.log_class = np.log(np.maximum(total, 1e-3) / total.sum())


def token_rows(rows, tokenizer: str):
    """doc_id, text_key, held_out and ids (little-endian 32 bits) of every text."""

    def emit(batches):
        coder = subwords(tokenizer)
        for batch in batches:
            for first, texts in text_chunks(batch, "text"):
                ids, offsets = coder.encode([t.decode() for t in texts])
                raw = ids.astype("<u2" if coder.size <= 65536 else "<u4")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(first, len(texts)) for c in ("doc_id", "text_key", "held_out")]
                    + [pa.array([raw[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())],
                    ["doc_id", "text_key", "held_out", "ids"])

    return rows.mapInArrow(emit, "doc_id long, text_key long, held_out boolean, ids binary")


def ids_of(column, size: int):
    """All ids of a binary column in parts of about a quarter of a million: (first row, ids, offsets)."""
    width = np.dtype("<u2" if size <= 65536 else "<u4")
    raw = column.to_pylist()
    first = total = 0
    for i, x in enumerate(raw):
        if i > first and total + len(x) > 250_000 * width.itemsize:
            yield first, np.frombuffer(b"".join(raw[first:i]), width), np.cumsum([0, *map(len, raw[first:i])]) // width.itemsize
            first, total = i, 0
        total += len(x)
    if raw:
        yield first, np.frombuffer(b"".join(raw[first:]), width), np.cumsum([0, *map(len, raw[first:])]) // width.itemsize


def count_ids(tokens, size: int) -> np.ndarray:
    """Counts of all ids in the training texts; the end id is the last."""

    def emit(batches):
        counts = np.zeros(size + 1, np.int64)
        for batch in batches:
            for _, ids, offsets in ids_of(batch.column("ids"), size):
                counts += np.bincount(ids, minlength=size + 1)
                counts[size] += len(offsets) - 1
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["id", "n"])

    found = tokens.where("not held_out").select("ids").mapInArrow(emit, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size + 1)
    counts[found["id"].to_numpy()] = found["n"].to_numpy()
    return counts


def adam(p, stream, uses: np.ndarray | None = None):
    """One pass over (inputs, targets, weight) batches; the parameters and the number of windows seen.

    The embeddings of a batch's inputs change with it, the others stay. ``uses`` counts the inputs by id.
    """
    table = flat(p)
    p, first, second = unflat(table), np.zeros_like(table), np.zeros_like(table)
    step = seen = 0
    for inputs, targets, weight in stream:
        step, seen = step + 1, seen + len(inputs)
        rate, one, two = float(RATE / np.sqrt(1 + step / 200)), 1 - 0.9**step, 1 - 0.99**step
        g, dx = gradients(p, inputs, targets, weight)
        ids, number, rows = by_id(inputs, dx)
        if uses is not None:
            uses[ids] += number
        own = np.concatenate((np.arange(FIRST), FIRST + ids))
        g = np.concatenate([*(g[k].reshape(-1, DIM) for k in SHAPES if k != "E"), rows])
        m, n = first[own], second[own]
        m += 0.1 * (g - m)
        n += 0.01 * (g * g - n)
        first[own], second[own] = m, n
        table[own] -= (rate / one) * m / (np.sqrt(n * (1 / two)) + 1e-8)
    return p, seen


#: One row of the parameters' table: the sum of its changes and of what they weigh.
CHANGED = ["k", "n", *(f"v{i}" for i in range(DIM))]


def train(tokens, vocabulary: Vocabulary, size: int, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Parameters after every training text was learned from in one of the rounds.

    A round's changes are averaged over the tasks: by windows, and for an embedding by how often each task met its id.
    """
    context = tokens.sparkSession.sparkContext
    shared = context.broadcast(vocabulary)
    table = flat(start_parameters(vocabulary.log_class, vocabulary.classes[:size]))
    for r in range(rounds):
        begin = context.broadcast(table)

        def learn(batches, begin=begin):
            vocab = shared.value

            def stream():
                waiting = []
                for batch in batches:
                    for _, ids, offsets in ids_of(batch.column("ids"), size):
                        waiting.append(windows_of(vocab.classes[ids], offsets, vocab.classes[size], ids, size)[:3])
                        if sum(len(w[0]) for w in waiting) >= 16 * BATCH:
                            yield from batched(waiting, BATCH)
                            waiting = []
                yield from batched(waiting, BATCH)

            uses = np.zeros(size + 1, np.int64)
            p, seen = adam(unflat(begin.value), stream(), uses)
            weight = np.concatenate((np.full(FIRST, seen), uses))
            own = np.flatnonzero(weight)
            change = (flat(p)[own].astype(np.float64) - begin.value[own]) * weight[own, None]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(weight[own].astype(np.float64)), *(pa.array(c) for c in change.T.copy())], CHANGED)

        # a text belongs to one round, so its windows are made once
        texts = tokens.where(~F.col("held_out") & (F.pmod(F.xxhash64("text_key"), F.lit(rounds)) == r)).select("ids")
        parts = texts.mapInArrow(learn, "k long, " + ", ".join(f"{c} double" for c in CHANGED[1:]))
        got = parts.groupBy("k").agg(*[F.sum(c).alias(c) for c in CHANGED[1:]]).toArrow()
        if got.num_rows:
            change = np.stack([got[c].to_numpy() for c in CHANGED[2:]], 1) / got["n"].to_numpy()[:, None]
            table = table.copy()
            table[got["k"].to_numpy()] += change.astype(np.float32)
    return unflat(table)


def batched(parts, size: int):
    if parts:
        whole = [np.concatenate(x) for x in zip(*parts, strict=True)]
        for a in range(0, len(whole[0]), size):
            yield tuple(x[a:a + size] for x in whole)


def model_scores(tokens, vocabulary: Vocabulary, parameters, size: int):
    """doc_id, text_key, score: log10 probability of each text's ids and its end."""
    shared = tokens.sparkSession.sparkContext.broadcast((vocabulary, parameters))

    def judge(batches):
        vocab, p = shared.value
        for batch in batches:
            for row, ids, offsets in ids_of(batch.column("ids"), size):
                inputs, targets, weight, doc = windows_of(vocab.classes[ids], offsets, vocab.classes[size], ids, size)
                total = np.zeros(len(doc))
                for a in range(0, len(doc), SCORED):
                    part = slice(a, a + SCORED)
                    total[part] = (class_scores(p, inputs[part], targets[part]) * weight[part]).sum(1, dtype=np.float64)
                n = len(offsets) - 1
                share = np.concatenate(([0], np.cumsum(vocab.share[ids])))
                score = np.bincount(doc, total, n) / np.log(10) + share[offsets[1:]] - share[offsets[:-1]] + vocab.share[size]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(row, n) for c in ("doc_id", "text_key")] + [pa.array(score)], ["doc_id", "text_key", "score"])

    return tokens.select("doc_id", "text_key", "ids").mapInArrow(judge, "doc_id long, text_key long, score double")


def score_texts(docs, held_out, tokenizer: str):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row; held-out rows teach nothing."""
    rows = keyed(docs).withColumn("held_out", held_out)
    size = subwords(tokenizer).size
    tokens = materialize(token_rows(rows, tokenizer), "ids")
    vocabulary = Vocabulary(count_ids(tokens, size))
    parameters = train(tokens, vocabulary, size)
    scored = model_scores(tokens, vocabulary, parameters, size).dropDuplicates(["doc_id", "text_key"])
    scored = scored.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "score")
    words = word_scores(rows)
    return words.join(scored, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k"))).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
