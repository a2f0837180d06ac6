"""Line dedup, Merkle manifest and fill-in-the-middle against plain versions, with odd rows."""

import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from llm_fixtures import document_rows, documents
from pyspark.sql import functions as F

from flowlens.llm import infill, lines, merkle

ASCII_SPACE = " \t\n\x0b\x0c\r"


def sha(text):
    return sha256(text.encode()).hexdigest()


# --- line dedup ------------------------------------------------------------------------------------------------------

def line_rows():
    rows = [(i, f"own {i}\n All Rights reserved\t\n\nmore {i % 4}\né{i}\r\n") for i in range(24)]
    rows += [(100 + i, "ALL RIGHTS RESERVED\x0b") for i in range(4)] + [(200 + i, "Nine times\nnine times") for i in range(9)]
    rows += [(300, None), (301, ""), (302, "\n\n"), (303, "x" * 200_000 + "\nall rights reserved\n" + "y"), (None, "more 1\nnull id"),
             (None, "more 1\nnull id"), (5, "same id\nmore 1"), (304, "ALL RIGHTS RESERVEDÉ\n\x1call rights reserved\x1c")]
    return rows


def plain_lines(rows, threshold, min_chars=1):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(ASCII_SPACE))

    held = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if held[key(x)] < threshold]
        out.append((i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("threshold", "min_chars"), [(10, 1), (6, 1), (6, 8)])
def test_common_lines_go(spark, threshold, min_chars):
    got = lines.remove_common_lines(documents(spark, line_rows()), threshold, min_chars)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_text"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_lines(line_rows(), threshold, min_chars)


def test_no_documents_no_lines(spark):
    assert lines.remove_common_lines(documents(spark, line_rows()).limit(0)).count() == 0


def test_runs_keep_counts_over_levels(spark):
    """Counts spread thinly over many batches still add up; known keys are left out; levels stay short; tables go."""
    runs, whole = lines.LineRuns(spark, threshold=5, fanout=2, buckets=3), Counter()
    for batch in range(7):
        new = {"often": 4, "twice a time": 2, "thin": 1, f"only {batch}": 1}
        whole.update(new)
        rows = [(k.encode(), v) for k, v in new.items()]
        runs.add(spark.createDataFrame(rows, "key binary, n long"))
        assert all(len(level) < 2 for level in runs.levels)
    assert [len(level) for level in runs.levels] == [1, 1, 1]
    got = {bytes(r["key"]).decode() for r in runs.common().collect()}
    assert got == {k for k, v in whole.items() if v >= 5}
    # "often" was known from the second compaction on, so later batches did not count it again
    assert spark.table(runs.levels[0][0]).where(F.col("key") == F.lit(b"often")).count() == 0
    names = sum(runs.levels, [])
    runs.drop()
    assert not any(spark.catalog.tableExists(n) for n in names)


# --- Merkle manifest -------------------------------------------------------------------------------------------------

def leaf_of(r):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"])))


def plain_tree(row):
    levels = [row]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i:i + 2])) for i in range(0, len(last), 2)])
    return levels


def plain_manifest(rows, claim):
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees[name] = plain_tree([leaf_of(r) for r in groups[name]])
    top = plain_tree([trees[n][-1][0] for n in names])
    out = []
    for at, name in enumerate(names):
        for pos, r in enumerate(groups[name]):
            digest, proof = claim(r), ""
            for levels, i in ((trees[name], pos), (top, at)):
                for row in levels[:-1]:
                    pair = list(row[i & ~1:(i & ~1) + 2])
                    proof += "".join(pair[:i & 1] + pair[(i & 1) + 1:])
                    pair[i & 1] = digest
                    digest = sha("".join(pair))
                    i >>= 1
            root = top[-1][0]
            out.append((r["doc_id"], leaf_of(r), trees[name][-1][0], root, proof, digest, digest == root))
    return sorted(out, key=repr)


def manifest_rows(spark):
    rows = [(i, t, ["en", "de", None, "en", "é", "", "en"][n % 7] if n < 40 else "lone", "s" if n % 3 else None, n if n % 5 else None)
            for n, (i, t) in enumerate(document_rows())]
    rows += [(7, "same", "en", "s", 1)] * 3 + [(None, "same", None, "s", 1)] * 2 + [(-9, "", "en", None, None), (-9, None, "en", None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.select("*", *[F.lit("clash").alias(c) for c in ("g", "pos", "digest", "claim", "total", "block", "root", "path")])


@pytest.mark.parametrize("height", [1, 2, 12])
def test_manifest(spark, height):
    docs = manifest_rows(spark)
    rows = docs.collect()
    touched = F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    got = merkle.manifest(docs, "lang", height, n_chars=touched).collect()

    def claim(r):
        hit = r["doc_id"] is not None and r["doc_id"] % 3 == 0 and r["n_chars"] is not None
        return leaf_of({**r.asDict(), "n_chars": r["n_chars"] + 1} if hit else r)

    names = ["doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified"]
    want = plain_manifest(rows, claim)
    assert sorted((tuple(r[c] for c in names) for r in got), key=repr) == want
    assert {w[-1] for w in want} == {True, False}


def test_manifest_of_few_rows(spark):
    docs = manifest_rows(spark)
    assert merkle.manifest(docs.limit(0)).count() == 0
    one = merkle.manifest(docs.where("doc_id = 9")).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof"] == "" and one["verified"]


def plain_layout(levels, node=1, depth=0):
    """Nodes (numbered as in a heap) of the tree below ``node`` in van Emde Boas order."""
    if levels == 1:
        return [node]
    upper = levels // 2
    out = plain_layout(upper, node)
    for i in range(1 << upper):
        out += plain_layout(levels - upper, (node << upper) + i)
    return out


@pytest.mark.parametrize("levels", range(1, 11))
def test_van_emde_boas_places(levels):
    order = plain_layout(levels)
    layout = merkle.Layout(levels)
    for depth in range(levels):
        places = layout.place(depth, np.arange(1 << depth))
        assert [order[p] for p in places] == list(range(1 << depth, 2 << depth))
    for at in range(1, levels):
        assert int(layout.place(at, (1 << at) - 1)) < layout.size


# --- fill in the middle ----------------------------------------------------------------------------------------------

def test_fenwick_descent():
    rng = np.random.default_rng(5)
    for size in [*range(1, 20), 64, 100]:
        counts = rng.integers(0, 4, (size, 2))
        tree, total = infill.Fenwick(counts), np.cumsum(counts, axis=0)
        for target in range(1, int(total[-1, 0]) + 1):
            blocks, sums = tree.descend(target)
            assert blocks == int(np.searchsorted(total[:, 0], target))
            assert sums.tolist() == (total[blocks - 1].tolist() if blocks else [0, 0])


@pytest.mark.parametrize("block", [1, 3, 7, 64])
def test_line_cuts(block):
    for text in ["", "\n", "a", "a\n", "\n\n\n", "é\nñandú\n\n𝔘x", "one\ntwo\nthree", "ü" * 50 + "\n" + "z\n" * 30]:
        units, found = re.findall(r"[^\n]*\n|[^\n]+", text), infill.Lines(text.encode(), block)
        assert found.count == len(units)
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert found.cut(k) == (len(head.encode()), len(head))


def plain_infill(doc_id, text, seed, rate, share):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    a, b, use, order = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or use % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text, text
    low, high = sorted((a % (len(units) + 1), b % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    form = "spm" if order % 100 < share else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, len(units), form, len(p), len(m), out, text


@pytest.mark.parametrize(("seed", "rate", "share"), [(7, 100, 50), (1, 60, 0), (2, 100, 100)])
def test_fill_in_middle(spark, seed, rate, share):
    rows = document_rows() + line_rows() + [
        (400, "a\n<S>\nb"), (401, "<M>"), (402, "<P"), (403, "<\nS>\n<S\n>M>\n<"), (404, "<S\n<P\n<M\n" * 9), (-3, "x\ny\n"), (405, "\n" * 5000),
        (406, "".join(f"zeile {i} ä𝔘\n" for i in range(20_000)))]
    docs = documents(spark, rows)
    found = infill.fill_in_middle(docs, seed, rate, share)
    got = found.withColumn("restored", infill.restored(F.col("output"), F.col("form"))).collect()
    want = [plain_infill(i, t, seed, rate, share) for i, t in rows]
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    assert infill.fill_in_middle(docs.limit(0)).count() == 0
