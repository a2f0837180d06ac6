"""Personal data by bootstrapped contextual extraction.

E-mail addresses, IP addresses, payment cards and phone numbers that match fixed forms are seeds, and so are long
hexadecimal keys (kind ``secret``); these become spans only where their context says so. All tokens with a digit or an at
sign are instances. What stands before a token is its pattern: the word to the left, two words, or ``key=``.

Spark scores the graph of patterns and instances in rounds. A pattern's confidence is the share of seeds among *all*
tokens that follow it in the corpus, ordinary words included, so that a stop word never is a pattern; it also needs
``SEEDS`` distinct seeds. An instance is accepted if confident patterns make it likely (noisy or) and at least the share
``KEPT`` of its occurrences stands behind them. Accepted instances are seeds of the next round, where they may bring in
further patterns, until a round accepts nothing new. Unseen instances behind confident patterns become spans, of the kind
that seeds of the same shape have, or else the pattern's.

Context words are the whole words before the token in which an identifier begins; a word of more than ``LONG`` characters
counts as one class, as do words with a digit and those with an at sign. Words are cut at ASCII white space.

Nulls and odd rows: a null or empty text has no spans; repeated rows get the same spans; a null id is kept. An empty table
gives an empty result. Only id and text are read. Tokens of any length are handled in time linear in the text.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from flowlens.llm.common import keyed
from flowlens.session import materialize

KINDS = ["email", "ip", "card", "phone", "secret"]
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is tried from its first digit only: from a later one it would go on the same way
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SIGN = re.compile(r"[0-9@]")
#: A key that is a seed: hexadecimal digits, letters among them.
KEY = re.compile(r"(?=[0-9]*[a-fA-F])[0-9a-fA-F]{32,}")
WHITE = " \t\n\x0b\x0c\r"
SPACE = re.compile(f"[{WHITE}]")
EDGES = "\"'`.,;:!?()[]{}<>|#$%&*"
SHORTEST = 5
#: Distinct seeds that a pattern needs, the confidence at which it finds new spans, and the share of an instance's
#: occurrences that must stand behind such patterns.
SEEDS, CONFIDENT, KEPT = 5, 0.8, 0.125
#: Words of more characters than this are one class.
LONG = 64


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def emails(text: str):
    """Matches of local part, ``@`` and dotted domain, found from each ``@``."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed forms, by kind and start."""
    out = [("email", a, b) for a, b in emails(text)]
    if not SIGN.search(text):
        return out
    for m in IP.finditer(text):
        if all(int(x) <= 255 for x in (p.lstrip("0")[:4] or "0" for p in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def words_before(text: str, start: int) -> list[str]:
    """The two words that end before ``start``, nearest first; of a long word just the last ``LONG`` + 1 characters."""
    out = []
    at = start
    for _ in range(2):
        while at > 0 and text[at - 1] in WHITE:
            at -= 1
        end = at
        while at > 0 and text[at - 1] not in WHITE:
            at -= 1
        if at < end:
            out.append(text[max(at, end - LONG - 1):end])
    return out


def instances(text: str, known: list[tuple[str, int, int]]) -> list[tuple[str | None, list[str], str, str | None, int, int]]:
    """(key, words before, token, kind or None, start, end) of seeds and of other identifier-shaped tokens."""
    out = []
    seeds = sorted((a, b, kind) for kind, a, b in known)
    at_seed = covered = end = 0
    found = SIGN.search(text)
    while found:
        at = found.start()
        start = max(max(text.rfind(c, end, at) for c in WHITE) + 1, end)
        stop = SPACE.search(text, at)
        end = stop.start() if stop else len(text)
        key, equals, value = text[start:end].partition("=")
        key = key[-LONG - 1:] if equals and value else None
        before = words_before(text, start) if key is None else []
        first = at_seed
        while at_seed < len(seeds) and seeds[at_seed][0] < end:
            a, b, kind = seeds[at_seed]
            out.append((key, before, text[a:b].lower(), kind, a, b))
            covered = max(covered, b)
            at_seed += 1
        if at_seed == first and start >= covered:
            a = start if key is None else end - len(value)
            token = text[a:end]
            a += len(token) - len(token.lstrip(EDGES))
            token = token.strip(EDGES)
            if len(token) >= SHORTEST and SIGN.search(token):
                out.append((key, before, token.lower(), "secret" if KEY.fullmatch(token) else None, a, a + len(token)))
        found = SIGN.search(text, end)
    return out


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
INSTANCE = pa.struct([
    ("key", pa.string()), ("before", pa.list_(pa.string())), ("token", pa.string()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def extract(rows):
    """doc_id, text_key, base spans and instances of every text."""

    def find(batches):
        for batch in batches:
            spans, found = [], []
            for t in batch.column("text"):
                text = t.as_py()
                own = base_spans(text)
                spans.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in own])
                found.append([dict(zip(INSTANCE.names, s, strict=True)) for s in instances(text, own)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(spans, pa.list_(SPAN)), pa.array(found, pa.list_(INSTANCE))],
                ["doc_id", "text_key", "base", "instances"])

    span = "struct<kind: string, start: int, end: int>"
    return rows.mapInArrow(find, f"doc_id long, text_key long, base array<{span}>, instances "
                           "array<struct<key: string, before: array<string>, token: string, kind: string, start: int, end: int>>")


def word_class(word):
    """The word without marks at its ends, in lower case; one class each for long words, those with an at sign, or a digit."""
    return F.when(F.length(word) > LONG, "<long>").when(word.contains("@"), "<email>").when(
        word.rlike("[0-9]"), "<number>").otherwise(F.lower(F.btrim(word, F.lit(EDGES))))


def patterns_of(key, nearest, second):
    """Hashes of the patterns of one token: of its key, or else of the class of the word before and of the two before."""
    return F.when(key.isNotNull(), F.array(F.xxhash64(key, F.lit("=")))).when(nearest.isNull(), F.array().cast("array<bigint>")).when(
        second.isNull(), F.array(F.xxhash64(nearest))).otherwise(F.array(F.xxhash64(nearest), F.xxhash64(second, nearest)))


def followers(rows, wanted):
    """pattern, total: how many tokens of the corpus follow each wanted pattern."""
    words = F.filter(F.split("text", f"[{WHITE}]+"), lambda w: w != "")
    listed = rows.select(words.alias("words")).where(F.size("words") > 0)
    listed = listed.select("words", F.transform("words", word_class).alias("classes"))

    def own(w, i):
        key = F.when(w.rlike("(?s)^[^=]*=."), word_class(F.substring_index(w, "=", 1)))
        return patterns_of(key, F.get("classes", i - 1), F.get("classes", i - 2))

    met = listed.select(F.explode(F.flatten(F.transform("words", own))).alias("pattern"))
    return met.join(wanted, "pattern", "left_semi").groupBy("pattern").agg(F.count(F.lit(1)).alias("total"))


def confident_patterns(edges, totals, confident: float, seeds: int = SEEDS):
    """pattern, kind and confidence, and the accepted tokens, from ``edges`` (pattern, token, kind, n)."""
    spark = edges.sparkSession
    accepted = spark.createDataFrame([], "token long")
    size = 0
    while True:
        known = edges.join(accepted.withColumn("met", F.lit(True)), "token", "left")
        good = F.col("kind").isNotNull() | F.col("met").isNotNull()
        judged = known.groupBy("pattern").agg(
            F.sum(F.when(good, F.col("n")).otherwise(0)).alias("good"), F.sum("n").alias("n"), F.count(F.when(good, 1)).alias("seeds"))
        judged = judged.where(F.col("seeds") >= seeds).join(totals, "pattern")
        patterns = materialize(judged.select(
            "pattern", (F.col("good") / (F.greatest("n", "total") + 1)).alias("confidence")).where(F.col("confidence") >= confident), "patterns")
        weighed = edges.join(patterns, "pattern", "left").groupBy("token").agg(
            (1 - F.exp(F.sum(F.log(1 - 0.95 * F.coalesce("confidence", F.lit(0.0)))))).alias("score"),
            (F.sum(F.when(F.col("confidence").isNotNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("kept"))
        now = materialize(weighed.where((F.col("score") >= 0.95 * confident) & (F.col("kept") >= KEPT)).select("token").union(accepted).distinct(), "accepted")
        accepted, before, size = now, size, now.count()
        if size == before:
            break
    named = edges.where("kind is not null").groupBy("pattern", "kind").agg(F.sum("n").alias("n"))
    named = named.groupBy("pattern").agg(F.max_by("kind", F.struct("n", "kind")).alias("kind"))
    return patterns.join(named, "pattern", "left"), accepted


def shape_of(token):
    """The token with each run of digits as 9 and each run of letters as a."""
    return F.regexp_replace(F.regexp_replace(token, "[0-9]+", "9"), r"\p{L}+", "a")


def find_personal(docs, confident: float = CONFIDENT):
    """doc_id, text_key, ``base`` and ``added`` spans (kind, start, end; code points) for each row of ``docs``."""
    rows = keyed(docs)
    found = materialize(extract(rows), "instances")
    i = F.col("i")
    classes = [F.when(F.size(i["before"]) > k, word_class(F.get(i["before"], F.lit(k)))) for k in range(2)]
    seen = found.select("doc_id", "text_key", F.explode("instances").alias("i")).select(
        "doc_id", "text_key", F.explode(patterns_of(F.when(i["key"].isNotNull(), word_class(i["key"])), *classes)).alias("pattern"),
        F.xxhash64("i.token").alias("token"), F.xxhash64(shape_of(i["token"])).alias("shape"), "i.kind", "i.start", "i.end")
    edges = materialize(seen.groupBy("pattern", "token").agg(F.max("kind").alias("kind"), F.count(F.lit(1)).alias("n")), "edges")
    # no other pattern can ever have enough seeds
    wanted = materialize(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SEEDS).select("pattern"), "wanted")
    good, likely = confident_patterns(edges, materialize(followers(rows, wanted), "totals"), confident)
    shaped = seen.where("kind is not null").groupBy("shape", "kind").agg(F.count(F.lit(1)).alias("n"))
    shaped = shaped.groupBy("shape").agg(F.max_by("kind", F.struct("n", "kind")).alias("like"))
    new = seen.where("kind is null or kind = 'secret'").drop("kind").join(good.withColumnRenamed("kind", "named"), "pattern")
    new = new.join(likely, "token").join(shaped, "shape", "left")
    # a pattern that only accepted tokens have brought in has no kind of its own
    new = new.withColumn("kind", F.coalesce("like", "named", F.lit("secret")))
    spans = new.groupBy("doc_id", "text_key", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    added = spans.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))
    added = added.withColumnRenamed("doc_id", "d").withColumnRenamed("text_key", "k")
    return found.drop("instances").join(added, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left").select(
        "doc_id", "text_key", "base", F.coalesce("added", F.expr("cast(array() as array<struct<kind: string, start: int, end: int>>)")).alias("added"))


def spans_text(spans):
    """``kind:start:end`` by kind as listed and start, joined by commas."""
    rank = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(rank, s["kind"]).alias("r"), s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("k"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["k"], s["a"], s["b"])), ",")


def count_kind(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Spans become ``<KIND>``; overlapping ones become one, named after the first."""
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs, confident: float = CONFIDENT):
    """``docs`` with every span masked, and n_chars, where there is such a column, counted anew."""
    @F.pandas_udf("string")
    def masked(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(text, found):
            if not found:
                return text
            return mask(text, [(int(a), int(b), k) for k, a, b in (s.split(":") for s in found.split(","))])

        return pd.Series([one(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    found = find_personal(docs, confident).dropDuplicates(["doc_id", "text_key"]).select(
        F.col("doc_id").alias("d"), F.col("text_key").alias("k"), spans_text(F.concat("base", "added")).alias("spans")).where("spans != ''")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(text).alias("own_key"))
    joined = rows.join(found, F.col("own_id").eqNullSafe(F.col("d")) & (F.col("own_key") == F.col("k")), "left")
    joined = joined.withColumn("clean", masked(F.col("row.text"), F.coalesce("spans", F.lit(""))))
    kinds = dict(docs.dtypes)
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast(kinds.get("n_chars", "long"))}
    return joined.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
