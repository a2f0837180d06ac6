"""Near-duplicates by SetSketch registers over sets of five-word shingles.

A sketch has ``REGISTERS`` registers. Every shingle sends points of a Poisson process to random registers; a register
keeps the earliest time, stored as an exponent of ``BASE`` (so two sketches merge by the larger exponent). Points after a
time by which all registers are almost surely filled are not made; should one be empty, the time is doubled.

1. Texts with equal sets are one class. Only classes go on.
2. Registers are cut into bands; classes that agree in a whole band share a bucket.
3. In each bucket everyone is compared with one member. Sizes, then the joint likelihood of the two sketches sort out
   what cannot reach the limit (a wide margin is left); the rest is verified on full sets. Links make components.
4. Buckets that still hold several components are compared in blocks: first sketches, each pair where it first meets, to
   find the members with a plausible partner in another component; then the full sets of those, all pairs of a block in
   one product. Only links are put out, no more than tie a block together. So no two linked texts that share a bucket
   stay apart, and groups of copies, or of texts just below the limit, never become rows for all their pairs. Two texts with a similarity of 0.85 miss every bucket with a probability below 1e-10.

Nulls and odd rows: null and empty texts have an empty set and are linked with nothing; fewer than five words are one
shingle; repeated rows are linked (similarity 1); rows of one id with different texts are judged by their own text. A
null id is a member like others, but never names a component, unless all ids in it are null; ``kept`` then is true. An
empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from flowlens.llm.common import CHUNK_BYTES, Words, keyed, mix, prefix_sums, signed, span_hash, text_chunks
from flowlens.llm.components import components
from flowlens.session import materialize

SHINGLE = 5
ROWS, BANDS = 5, 40
REGISTERS = ROWS * BANDS
RATE, BASE = 20.0, 1.001
#: Sketches whose estimate is lower than the limit by more are not verified: seven standard errors.
MARGIN = 0.2
#: Members of a bucket compared in one block.
BLOCK = 256
#: Bytes of text sketched at once: the rounds of a sketch are as many for few texts as for many.
SKETCHED = 1 << 21


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and where each text's begin (one more at the end)."""
    # texts are parsed a few at a time: parsing takes many times the room of their shingles
    ends = np.cumsum([len(t) for t in texts])
    cuts = np.flatnonzero(np.diff(ends // CHUNK_BYTES)) + 1
    parts = [parsed_sets(texts[a:b]) for a, b in zip([0, *cuts], [*cuts, len(texts)], strict=True)]
    sizes = np.concatenate([np.diff(offsets) for _, offsets in parts])
    return np.concatenate([hashes for hashes, _ in parts]), np.concatenate(([0], np.cumsum(sizes)))


def parsed_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    words = Words(texts, lower=True)
    sums, n = prefix_sums(words.hashes), len(words.hashes)
    doc, counts = words.doc(), words.counts()
    at = np.arange(max(0, n - SHINGLE + 1))
    at = at[doc[at] == doc[at + SHINGLE - 1]] if len(at) else at
    few = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    starts = np.concatenate((at, words.offsets[few]))
    ends = np.concatenate((at + SHINGLE, words.offsets[few + 1]))
    hashes, of = mix(span_hash(sums, starts, ends) + (ends - starts).astype(np.uint64)), np.concatenate((doc[at], few))
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    return hashes[new], np.searchsorted(of[new], np.arange(len(texts) + 1))


def sketch(hashes: np.ndarray, offsets: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Registers (uint16) of each set; those of an empty set are 0."""
    sizes = np.diff(offsets)
    times = np.full(len(sizes) * registers, np.inf)
    limit = (np.log(registers) + 5) / (RATE * np.maximum(sizes, 1))
    todo = sizes > 0
    doc = np.repeat(np.arange(len(sizes)), sizes)
    while todo.any():
        active = np.flatnonzero(todo[doc])
        h, d, t = hashes[active], doc[active], np.zeros(len(active))
        step = 0
        while len(h):
            step += 1
            u = mix(h + np.uint64(step * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))
            t = t - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (registers * RATE)
            inside = t <= limit[d]
            h, d, t, u = h[inside], d[inside], t[inside], u[inside]
            register = (mix(u ^ np.uint64(0xE7037ED1A0B428DB)) % np.uint64(registers)).astype(np.int64)
            np.minimum.at(times, d * registers + register, t)
        todo = (sizes > 0) & np.isinf(times.reshape(-1, registers)).any(1)
        limit[todo] *= 2
    with np.errstate(divide="ignore"):
        out = np.floor(1 - np.log(times) / np.log(BASE))
    return np.clip(np.nan_to_num(out, neginf=0), 0, 65535).astype(np.uint16).reshape(-1, registers)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each sketch."""
    parts = registers.reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    key = np.tile(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), (len(registers), 1))
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + parts[:, :, r])
    return key


def likely_similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Maximum joint likelihood estimate of the Jaccard similarity from two sketches and the set sizes."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    equal = a.shape[1] - more - less
    u = (size_a / (size_a + size_b))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)
    scale = (BASE - 1) / BASE
    p_more = -np.log1p(-scale * np.maximum(u - v * grid, 0)) / np.log(BASE)
    p_less = -np.log1p(-scale * np.maximum(v - u * grid, 0)) / np.log(BASE)
    tiny = 1e-12
    value = more * np.log(p_more + tiny) + less * np.log(p_less + tiny) + equal * np.log(np.maximum(1 - p_more - p_less, 0) + tiny)
    return grid[np.arange(len(grid)), value.argmax(1)]


def registers_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def sketch_rows(rows):
    """doc_id, text_key, n_shingles, two digests of the set, and its registers (null: empty set)."""

    def emit(batches):
        for batch in batches:
            for first, texts in text_chunks(batch, "text", SKETCHED):
                hashes, offsets = shingle_sets(texts)
                padded = np.append(hashes, np.uint64(0))
                full = offsets[:-1] < offsets[1:]
                sums = [np.where(full, np.add.reduceat(mix(padded + np.uint64(k)), offsets[:-1]), 0).astype(np.uint64) for k in (1, 2)]
                found = sketch(hashes, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(first, len(texts)) for c in ("doc_id", "text_key")]
                    + [pa.array(np.diff(offsets).astype(np.int64)), signed(sums[0]), signed(sums[1]),
                       pa.array([r.tobytes() if f else None for r, f in zip(found, full, strict=True)], pa.binary())],
                    ["doc_id", "text_key", "n_shingles", "digest", "digest2", "registers"])

    return rows.mapInArrow(emit, "doc_id long, text_key long, n_shingles long, digest long, digest2 long, registers binary")


def bucket_rows(classes):
    """(bucket, id) of every band."""

    def emit(batches):
        for batch in batches:
            keys = band_keys(registers_of(batch.column("registers")))
            yield pa.RecordBatch.from_arrays(
                [signed(keys.ravel()), pa.array(np.repeat(batch.column("id").to_numpy(), BANDS))], ["bucket", "id"])

    return classes.select("id", "registers").mapInArrow(emit, "bucket long, id long")


def plausible(pairs, sketches, limit: int):
    """Pairs (u, v) whose sizes and sketches leave room for the limit."""
    sizes = sketches.select("id", "n_shingles")
    fits = (
        pairs.join(sizes.select(F.col("id").alias("u"), F.col("n_shingles").alias("nu")), "u")
        .join(sizes.select(F.col("id").alias("v"), F.col("n_shingles").alias("nv")), "v")
        .where(100 * F.least("nu", "nv") >= limit * F.greatest("nu", "nv"))
    )
    both = fits.join(sketches.select(F.col("id").alias("u"), F.col("registers").alias("ru")), "u").join(
        sketches.select(F.col("id").alias("v"), F.col("registers").alias("rv")), "v"
    )

    def judge(batches):
        for batch in batches:
            if batch.num_rows:
                nu, nv = (batch.column(c).to_numpy().astype(np.float64) for c in ("nu", "nv"))
                near = likely_similarity(registers_of(batch.column("ru")), registers_of(batch.column("rv")), nu, nv)
                yield batch.select(["u", "v"]).filter(pa.array(near >= limit / 100 - MARGIN))

    return both.select("u", "v", "nu", "nv", "ru", "rv").mapInArrow(judge, "u long, v long")


def verified(pairs, texts, limit: int):
    """Pairs whose full sets have 100 * intersection >= limit * union."""
    both = pairs.join(texts.select(F.col("id").alias("v"), F.col("text").alias("tv")), "v").join(
        texts.select(F.col("id").alias("u"), F.col("text").alias("tu")), "u"
    )

    def judge(batches):
        for batch in batches:
            us, vs = batch.column("u").to_numpy(), batch.column("v").to_numpy()
            tu, tv = batch.column("tu"), batch.column("tv")
            keep = np.zeros(len(us), bool)
            for first in range(0, len(us), 64):
                part = range(first, min(first + 64, len(us)))
                distinct = {(0, us[i]): tu[i] for i in part} | {(1, vs[i]): tv[i] for i in part}
                hashes, offsets = shingle_sets([x.as_py().encode() for x in distinct.values()])
                at = {k: hashes[offsets[i]:offsets[i + 1]] for i, k in enumerate(distinct)}
                for i in part:
                    a, b = at[0, us[i]], at[1, vs[i]]
                    common = len(a) + len(b) - len(np.union1d(a, b))
                    keep[i] = common > 0 and 100 * common >= limit * (len(a) + len(b) - common)
            yield batch.select(["u", "v"]).filter(pa.array(keep))

    return both.select("u", "v", "tu", "tv").mapInArrow(judge, "u long, v long")


def groups(batches, keys: list[str]):
    """Runs of rows with equal keys in a sorted stream; a run may span batches."""
    held = None
    for batch in batches:
        data = pa.Table.from_batches([batch])
        data = data if held is None else pa.concat_tables([held, data])
        if not data.num_rows:
            continue
        change = np.zeros(data.num_rows - 1, bool)
        for k in keys:
            column = data.column(k).to_numpy()
            change |= column[1:] != column[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1)]
        for a, b in zip(cuts, cuts[1:]):  # noqa: B905
            yield data.slice(a, b - a)
        held = data.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held


def dealt_blocks(rows):
    """Rows of a bucket (with its size ``n``) dealt over blocks, and each pair of blocks together: bucket, i, j, own."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "n")
    keys = ["bucket", "i", "j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys)


def open_pairs(block: pa.Table, size: np.ndarray, limit: int) -> np.ndarray:
    """Which pairs of a block belong to it, lie in different components, and have sizes that allow the limit."""
    root, own = block.column("root").to_numpy(), block.column("own").to_numpy()
    i, j = block.column("i")[0].as_py(), block.column("j")[0].as_py()
    fit = (root[:, None] != root) & (100 * np.minimum(size[:, None], size) >= limit * np.maximum(size[:, None], size))
    return fit & np.triu(np.ones(fit.shape, bool), 1) if i == j else fit & (own[:, None] == i) & (own == j)


def plausible_members(rows, limit: int):
    """(bucket, id) of bucket members with a plausible partner in another component, that they first meet in this bucket."""

    def compare(batches):
        for block in groups(batches, ["bucket", "i", "j"]):
            if block.num_rows < 2:
                continue
            registers = registers_of(block.column("registers"))
            fit = open_pairs(block, block.column("n_shingles").to_numpy(), limit)
            keys = band_keys(registers)
            band = int(np.flatnonzero(keys[0].view(np.int64) == block.column("bucket")[0].as_py())[0])
            hit = np.zeros(len(registers), bool)
            for a in np.flatnonzero(fit.any(1)):
                b = np.flatnonzero(fit[a])
                b = b[(registers[b] == registers[a]).sum(1) >= (limit / 100 - MARGIN) * REGISTERS]
                b = b[(keys[b] == keys[a]).argmax(1) == band]
                hit[b] = True
                hit[a] |= len(b) > 0
            yield block.select(["bucket", "id"]).filter(pa.array(hit)).combine_chunks().to_batches()[0] if hit.any() else pa.RecordBatch.from_arrays(
                [pa.array([], pa.int64()), pa.array([], pa.int64())], ["bucket", "id"])

    return dealt_blocks(rows).select("bucket", "i", "j", "own", "id", "root", "n_shingles", "registers").mapInArrow(
        compare, "bucket long, id long").distinct()


def common_counts(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sizes of all pairwise intersections of some sets."""
    n = len(offsets) - 1
    of = np.repeat(np.arange(n), np.diff(offsets))
    _, place, times = np.unique(hashes, return_inverse=True, return_counts=True)
    often = times[place] > 1
    _, place = np.unique(place[often], return_inverse=True)
    of, width = of[often], 4096
    order = np.argsort(place, kind="stable")
    place, of = place[order], of[order]
    out = np.zeros((n, n), np.float32)
    for first in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        a, b = np.searchsorted(place, (first, first + width))
        part = np.zeros((n, width), np.float32)
        part[of[a:b], place[a:b] - first] = 1
        out += part @ part.T
    return out


def block_links(rows, limit: int):
    """Links between members of different components, verified on full sets; of each block no more than tie it together."""

    def verify(batches):
        for block in groups(batches, ["bucket", "i", "j"]):
            if block.num_rows < 2:
                continue
            ids = block.column("id").to_numpy()
            hashes, offsets = shingle_sets([x.as_py().encode() for x in block.column("text")])
            size = np.diff(offsets)
            common = common_counts(hashes, offsets)
            linked = open_pairs(block, size, limit) & (common > 0) & (100 * common >= limit * (size[:, None] + size - common))
            top = np.arange(len(ids))
            out = []
            for a, b in zip(*np.nonzero(linked), strict=True):
                if top[a] != top[b]:
                    out.append((a, b))
                    top[top == top[a]] = top[b]
            u, v = ids[[a for a, _ in out]], ids[[b for _, b in out]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v), pa.int64()), pa.array(np.minimum(u, v), pa.int64())], ["u", "v"])

    return dealt_blocks(rows).select("bucket", "i", "j", "own", "id", "root", "text").mapInArrow(verify, "u long, v long").distinct()


def rest_of_buckets(members, sketches, texts, roots, limit: int):
    """Links between bucket members in different components. Nothing is put out for a pair that is no link.

    ``members``: bucket, id, hub (already compared with all), n.
    """
    placed = members.join(roots, F.col("id") == F.col("node"), "left").select(
        "bucket", "id", "hub", "n", F.coalesce("root", "id").alias("root")
    )
    open_ = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
    rest = placed.where("id != hub").drop("hub").join(open_, "bucket")
    near = materialize(plausible_members(rest.join(sketches.select("id", "n_shingles", "registers"), "id"), limit), "plausible")
    counted = near.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    rooted = near.join(roots, F.col("id") == F.col("node"), "left").select("bucket", "id", F.coalesce("root", "id").alias("root"))
    return block_links(rooted.join(counted, "bucket").join(texts, "id"), limit)


def near_duplicates(docs, limit: int = 80):
    """doc_id, text_key, n_shingles, component_id, kept: one row for each row of ``docs``.

    ``limit``: hundredths of similarity at which two texts are linked. The registers' bands are laid out for 80 and more.
    """
    return rooted_duplicates(docs, limit).drop("root")


def rooted_duplicates(docs, limit: int):
    """``near_duplicates`` and each component's own number ``root`` (null: empty set). Ids do not tell components apart:
    several may have none, and rows of one id may lie in several."""
    rows = keyed(docs)
    made = materialize(sketch_rows(rows), "sketches")
    full = made.where("n_shingles > 0")
    same = ["digest", "digest2", "n_shingles"]
    found = full.groupBy(*same).agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.min("doc_id").alias("least_id"), F.first("registers").alias("registers"))
    classes = materialize(
        found.select(F.monotonically_increasing_id().alias("id"), *same, "least_id", F.col("rep.doc_id").alias("rep_id"),
                     F.col("rep.text_key").alias("rep_key"), "registers"), "classes")
    buckets = bucket_rows(classes)
    counted = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("hub")).where("n > 1")
    members = materialize(buckets.join(counted, "bucket"), "buckets")
    wanted = members.select("id").distinct()
    sketches = materialize(classes.join(wanted, "id").select("id", "n_shingles", "registers", "rep_id", "rep_key"), "wanted")
    texts = materialize(
        rows.join(sketches.select("id", F.col("rep_id").alias("r"), "rep_key"), F.col("doc_id").eqNullSafe(F.col("r")) & (F.col("text_key") == F.col("rep_key")))
        .dropDuplicates(["id"]).select("id", "text"), "texts")
    stars = members.where("id != hub").select(F.col("id").alias("u"), F.col("hub").alias("v")).distinct()
    links = materialize(verified(plausible(stars, sketches, limit), texts, limit), "star-links")
    roots = components(links)
    more = rest_of_buckets(members.where("n > 2"), sketches, texts, roots, limit)
    roots = components(links.union(more))
    placed = classes.join(roots, F.col("id") == F.col("node"), "left").select(*same, "least_id", F.coalesce("root", "id").alias("root"))
    least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = placed.join(least, "root").select(*same, "root", "component_id", F.lit(True).alias("linked"))
    judged = made.drop("registers").join(named, same, "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id"))
    return judged.select(
        "doc_id", "text_key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "root")


def keep_one(docs, limit: int = 80):
    """``docs`` with one row of each group of near-duplicates: that with the smallest id (then text hash).

    Rows without words are in no group and all stay.
    """
    found = materialize(rooted_duplicates(docs, limit), "near-duplicates")
    worded = found.where("n_shingles > 0")
    group = worded.groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("best"))
    best = group.select(F.col("best.doc_id").alias("d"), F.col("best.text_key").alias("k"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k"))
    gone = worded.join(best, same, "left_anti").select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"))
    # equal rows: all but one go
    twice = worded.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(best, same, "left_semi")
    twice = materialize(twice.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k")), "repeated")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"))
    kept = rows.join(gone.union(twice).distinct(), same, "left_anti")
    if not twice.isEmpty():
        kept = kept.union(rows.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text_key"]))
    return kept.select("row.*")
