"""Small tables with the odd rows that every text operator must stand: nulls, empties, ties, repeats, clashing names."""

import random

from pyspark.sql import functions as F

#: Names that the operators use inside.
CLASHES = ["row", "text_key", "kept", "d", "k", "id", "spans", "anchor", "bucket", "flush", "u", "v", "n_items", "held_out", "range"]


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def document_rows(seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join(words(rng, rng.randrange(60, 160)))) for i in range(24)]
    base = rows[3][1].split()
    rows += [
        (100, rows[3][1]), (101, rows[3][1]),                                  # exact copies
        (102, " ".join([*base[:-3], "x1", "x2", "x3"])), (103, " ".join(["y1", *base])),  # near copies
        (104, " ".join([*words(rng, 30), *base[:55], *words(rng, 30)])),        # a passage of 55 words
        (105, " ".join(["a", "b"] * 90)), (106, " ".join(["a", "b"] * 70)),     # a period of two
        (107, "z " * 120), (108, "z " * 130),                                   # runs
        (109, None), (110, ""), (111, " \t\n\x0b "), (112, "one two"), (113, "one two"), (114, "One TWO"),
        (115, " ".join(words(rng, 9000, 3000))),                                # long
        (116, " ".join(base[:49])), (117, "naïve café – ½ 𝔘nicode  x y\x1cz " * 9),
        (None, rows[3][1]), (None, "only here " * 30), (3, rows[3][1]), (3, rows[3][1] + " other end"),
    ]
    return rows


def documents(spark, rows=None):
    data = [(i, t, "en", "s", None if t is None else len(t)) for i, t in (document_rows() if rows is None else rows)]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars int")
    return frame.select("*", *[F.lit(None).cast("string").alias(c) for c in CLASHES])
