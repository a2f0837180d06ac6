"""Substring dedup and near-duplicates against plain versions."""

import hashlib
import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest
from llm_fixtures import document_rows, documents

from flowlens.llm import common, neardup, substrings
from flowlens.llm.common import Words
from flowlens.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_removal(rows):
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for a in range(len(w) - 49):
            key = tuple(w[a:a + 50])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for a in range(len(w) - 49):
            if i is not None and first[tuple(w[a:a + 50])] < i:
                gone.update(range(a, a + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def plain_groups(rows, limit):
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[a:a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(len(rows)):
                both = len(sets[a] & sets[b])
                if both and 100 * both >= limit * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    members = defaultdict(list)
    for k, g in enumerate(group):
        members[g].append(rows[k][0])
    out = []
    for k, (i, _) in enumerate(rows):
        known = [x for x in members[group[k]] if x is not None]
        component = (min(known) if known else None) if sets[k] else i
        out.append((i, len(sets[k]), component, i == component))
    return sorted(out, key=repr)


def test_removed_words(spark):
    got = substrings.remove_repeats(documents(spark)).drop("kept_text").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_removal(document_rows())


def test_kept_text_is_what_was_hashed(spark):
    for r in substrings.remove_repeats(documents(spark)).where("kept_text is not null").collect():
        assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]


def test_removal_of_nothing(spark):
    assert substrings.remove_repeats(documents(spark, [])).count() == 0


def test_equal_windows_share_their_anchor():
    rng = np.random.default_rng(7)
    seen, shared = {}, 0
    passage = [b"p%d" % x for x in rng.integers(0, 30, 90)]
    texts = []
    for _ in range(40):
        texts.append(b" ".join([*(b"q%d" % x for x in rng.integers(0, 30, rng.integers(0, 70))), *passage[int(rng.integers(0, 20)):],
                                *(b"q%d" % x for x in rng.integers(0, 30, rng.integers(0, 70)))]))
    x = substrings.Stretches(Words(texts))
    for s in range(len(x.doc)):
        w = texts[x.doc[s]].split()
        for j in range(x.count[s]):
            key = tuple(w[x.first[s] + j:x.first[s] + j + 50])
            shared += key in seen
            assert seen.setdefault(key, (x.anchor[s], x.hashes[x.places[s] + j])) == (x.anchor[s], x.hashes[x.places[s] + j])
    assert shared > 500 and x.count.sum() == sum(max(0, len(t.split()) - 49) for t in texts)


@pytest.mark.parametrize("limit", [80, 85])
def test_near_duplicates(spark, limit):
    got = neardup.near_duplicates(documents(spark), limit).drop("text_key").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_groups(document_rows(), limit)


def test_no_near_duplicates(spark):
    assert neardup.near_duplicates(documents(spark, [])).count() == 0


def test_chains_that_meet_only_in_blocks(spark, monkeypatch):
    """A family in which most pairs are too far apart, blocks smaller than the family."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for i in range(30):
        own = list(base)
        for k in range(0, 3 * i, 3):
            own[k] = f"c{k}"
        rows.append((200 - i, " ".join(own)))
    got = neardup.near_duplicates(documents(spark, rows), 85).drop("text_key").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_groups(rows, 85)


def test_keep_one(spark):
    rows = document_rows()
    got = sorted(((r["doc_id"], r["text"]) for r in neardup.keep_one(documents(spark), 80).collect()), key=repr)
    worded = [(r, g) for r, g in zip(sorted(rows, key=lambda r: repr(r)), range(len(rows))) if WORD.findall(r[0 + 1] or "")]
    groups = {g[2] if g[2] is not None else ("none", k) for k, g in enumerate(plain_groups(rows, 80)) if g[1]}
    empty = [r for r in rows if not WORD.findall(r[1] or "")]
    assert len(worded) > len(groups) and len(got) == len(groups) + len(empty) and set(got) <= set(rows)


def test_keep_one_of_unrelated_texts_with_null_and_shared_ids(spark):
    rows = [(None if k < 6 else 7, " ".join(f"t{k}x{j}" for j in range(40 + k))) for k in range(12)]
    rows += [(None, rows[2][1] + " end"), (7, rows[8][1] + " end"), (None, rows[9][1]), (8, rows[3][1])]
    got = [r["text"].removesuffix(" end") for r in neardup.keep_one(documents(spark, rows), 80).collect()]
    assert sorted(got) == sorted(t for _, t in rows[:12])


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    a, b = np.unique(h[:800]), np.unique(h[50:])
    k = [neardup.sketch(x, np.array([0, len(x)]))[0] for x in (a, b, np.union1d(a, b))]
    assert (np.maximum(k[0], k[1]) == k[2]).all()
    near = neardup.likely_similarity(k[0][None], k[1][None], np.array([800.0]), np.array([850.0]))[0]
    assert abs(near - 750 / 900) < 0.1


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (20, 21)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {2: 1, 3: 1, 8: 7, 9: 7, 21: 20} | {101 + i: 100 for i in range(40)}


def test_parsing_takes_little_room_beside_the_shingles():
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(9000)}" for _ in range(rng.randrange(600))).encode() for _ in range(1500)]
    assert sum(map(len, texts)) > 2_000_000
    common.POWERS.clear()
    tracemalloc.start()
    hashes, offsets = neardup.shingle_sets(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # before: 159 MB for the same texts
    assert peak < 60_000_000 and sum(x.nbytes for x in common.POWERS.values()) < 20_000_000
    for i in (0, 1, 700, 1499):
        own, _ = neardup.parsed_sets([texts[i]])
        assert list(hashes[offsets[i]:offsets[i + 1]]) == list(own)
