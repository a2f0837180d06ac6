"""Chat, URLs, fingerprints, personal data, language, leaks, scores, packing, and the pipeline against plain versions."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from llm_fixtures import document_rows, documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowlens.llm import chat, decontaminate, fingerprints, langid, lm, packing, pii, urls
from flowlens.llm.common import Words, held_out, keyed, subwords, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CONTROL = ["<|im_start|>", "<|im_end|>", "<|esc|>", "%3C|", "%25", "<|", "|>", "\n", "<|im_end|>\n<|im_start|>assistant\nok", "", None]


# --- chat ------------------------------------------------------------------------------------------------------------

def test_chat_round_trip(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd\nrole", "x<|esc|>", "%0A"]),
             "".join(x or "" for x in rng.sample(CONTROL, 4)) if t else rng.choice(CONTROL)) for c in range(40) for t in range(c % 5 + 1)]
    rows += [(7, None, "user", "no turn"), (None, 0, "user", "no id"), (8, 0, "user", "tie"), (8, 0, "user", "tie")]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("formatted", F.lit("clash"))
    got = chat.read_back(chat.format_conversations(frame)).collect()
    assert len(got) == len({r[0] for r in rows})
    for r in got:
        want = sorted((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == r["conv_id"])
        assert r["round_trip"] and sorted(tuple(t) for t in r["turns"]) == sorted(x[1:] for x in want)
        if len({w[0] for w in want}) == len(want):
            assert [tuple(t) for t in r["turns"]] == [x[1:] for x in want]
            assert r["loss_text"] == "".join(x[2] for x in want if x[1] == "assistant")


def test_plain_turns_are_not_escaped(spark):
    frame = spark.createDataFrame([(1, 0, "user", "50% <b>")], "conv_id long, turn int, role string, text string")
    assert chat.format_conversations(frame).first()["formatted"] == "<|im_start|>user\n50% <b><|im_end|>\n"
    assert chat.format_conversations(frame.limit(0)).count() == 0


# --- urls ------------------------------------------------------------------------------------------------------------

RULES = [urls.Rule("com", "/", "allow"), urls.Rule("example.com", "/en/", "block"), urls.Rule("www.example.com", "/en/", "allow"),
         urls.Rule("net", "/es/", "block"), urls.Rule("a.net", "", "block"), urls.Rule("org", "/pre", "block")]


def plain_rule(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def test_urls(spark):
    hosts = ["com", "x.com", "example.com", "www.example.com", "a.www.example.com", "wexample.com", "net", "b.a.net", "org", "", "EXAMPLE.Com", "é.com"]
    paths = ["", "/", "/en", "/en/", "/en/x/y", "/es/", "/es", "/prefix/1", "/pre", "//", "/EN/"]
    rows = [(i, f"http://{h}{p}{q}") for i, (h, p, q) in enumerate((h, p, q) for h in hosts for p in paths for q in ("", "?a=/en/", "#/x"))]
    rows += [(-1, None), (-2, ""), (-3, "no scheme/en/"), (-4, "a://b://c/d"), (-5, "://x.com/"), (None, "http://x.com/"), (-6, "http://x.com\n/y\nz")]
    frame = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    got = {r["page_id"]: r for r in urls.judge_urls(frame, RULES).collect()}
    assert len(got) == len(rows)
    for i, u in rows:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        rule = plain_rule(host, path)
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        assert (got[i]["rule"], got[i]["verdict"]) == ((rule.text, rule.verdict) if rule else (None, "allow")), u
    assert urls.judge_urls(frame.limit(0), RULES).count() == 0


# --- fingerprints ----------------------------------------------------------------------------------------------------

def pieces(text):
    solid = fingerprints.SOLID.replace(r"\x{20000}-\x{3FFFF}", "\U00020000-\U0003ffff")
    units = regex.findall(rf"[{solid}]|(?:(?![{solid}])[\p{{L}}\p{{M}}\p{{N}}])+[^\p{{L}}\p{{M}}\p{{N}}]*|[^\p{{L}}\p{{M}}\p{{N}}]+", text)
    assert "".join(units) == text

    def ends(unit):
        h = xxhash.xxh64_intdigest(unit.encode(), 42)
        return "\n" in unit or (h - (h >> 63 << 64)) % fingerprints.SHARE == 0

    return set("".join(u + fingerprints.END * ends(u) for u in units).split(fingerprints.END)) - {""}


def alike(a, b):
    return 1.0 if not a and not b else 1 - len(a ^ b) / (len(a) + len(b))


def test_fingerprints(spark):
    rows = [(i, t.replace(" w1", "\nw1")) if t and i else (i, t) for i, t in document_rows()]
    got = fingerprints.compare_versions(documents(spark, rows), 5).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for k, (i, t) in enumerate(order):
        if len(by[i]) > 1:
            continue
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        edited = t[:len(t) - third] + after[:third]
        r = by[i][0]
        assert r["edited"] == edited and r["n_chars"] == len(t)
        assert r["near_edited"] == pytest.approx(alike(pieces(t), pieces(edited))) and r["near_next"] == pytest.approx(alike(pieces(t), pieces(after)))
    prints = {}
    for r in got:
        prints.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert prints[112] == prints[113] and prints[110] == prints[109] and prints[0] != prints[1]
    assert fingerprints.compare_versions(documents(spark, []), 5).count() == 0
    one = fingerprints.compare_versions(documents(spark, [(1, "abcdef")]), 5).first()
    assert one["edited"] == "abcdab"


@pytest.mark.parametrize("differing", [0, 3, 40, 700])
def test_peeling_recovers_what_differs(spark, differing):
    ours = [f"line {k}" for k in range(60)]
    theirs = ours[:50] + [f"other {k}" for k in range(differing)]
    c = F.col
    frame = spark.createDataFrame([("\n".join(ours), "\n".join(theirs))], "a string, b string").select(
        fingerprints.paragraphs(c("a")).alias("a"), fingerprints.paragraphs(c("b")).alias("b"))
    frame = frame.select("a", "b", fingerprints.sketch(c("a")).alias("x"), fingerprints.sketch(c("b")).alias("y"))
    r = frame.select("a", "b", fingerprints.differences(c("a"), c("b"), c("x"), c("y")).alias("d")).first()
    assert {(x["digest"], x["side"]) for x in r["d"]} == {(x, 1) for x in set(r["a"]) - set(r["b"])} | {(x, -1) for x in set(r["b"]) - set(r["a"])}


@pytest.mark.parametrize("end", [". ", ", ", "nd "])
def test_an_insertion_changes_paragraphs_around_it_only(spark, end):
    rng = random.Random(6)
    text = "".join(" ".join(f"k{rng.randrange(900)}" for _ in range(9)) + end for _ in range(60))
    c = F.col
    frame = spark.createDataFrame([(text, "inserted " + text)], "a string, b string").select(
        fingerprints.paragraphs(c("a")).alias("a"), fingerprints.paragraphs(c("b")).alias("b"))
    frame = frame.select("a", "b", fingerprints.sketch(c("a")).alias("x"), fingerprints.sketch(c("b")).alias("y"))
    assert frame.select(fingerprints.likeness(c("a"), c("b"), c("x"), c("y")).alias("s")).first()["s"] > 0.9


@pytest.mark.parametrize("script, gap, number", [("абвгдежзиклмнопрстуф", " ", 600), ("\u05d0\u05d1\u05d2\u05d3\u05d4\u05d5", " ", 600), ("", "", 3000)])
def test_near_copies_in_any_script(spark, script, gap, number):
    rng = random.Random(4)
    word = (lambda: "".join(rng.choice(script) for _ in range(5))) if script else (lambda: chr(0x4E00 + rng.randrange(3000)))
    text = gap.join(word() for _ in range(number))
    c = F.col
    frame = spark.createDataFrame([(text, word() + gap + text)], "a string, b string").select(
        fingerprints.paragraphs(c("a")).alias("a"), fingerprints.paragraphs(c("b")).alias("b"))
    frame = frame.select("a", "b", fingerprints.sketch(c("a")).alias("x"), fingerprints.sketch(c("b")).alias("y"))
    assert frame.select(fingerprints.likeness(c("a"), c("b"), c("x"), c("y")).alias("s")).first()["s"] > 0.9


def test_cells_of_a_difference_are_made_at_once(spark):
    c = F.col
    rows = [([f"a {k}" for k in range(n)], [f"a {k}" for k in range(n // 2)] + [f"b {k}" for k in range(m)]) for n, m in ((0, 0), (1, 0), (0, 5), (30, 9), (400, 90))]
    frame = spark.createDataFrame([("\n".join(a), "\n".join(b)) for a, b in rows], "a string, b string").select(
        fingerprints.paragraphs(c("a")).alias("a"), fingerprints.paragraphs(c("b")).alias("b"))
    frame = frame.select(fingerprints.sketch_apart(c("a"), c("b")).alias("x"), fingerprints.minus(fingerprints.sketch(c("a")), fingerprints.sketch(c("b"))).alias("y"))
    for r in frame.collect():
        assert r["x"] == r["y"]


def test_common_digests_do_not_differ_beyond_the_last_retry(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "DEPTH", 1)
    c = F.col
    both = [f"line {k}" for k in range(500)]
    frame = spark.createDataFrame([("\n".join([*both, *(f"a {k}" for k in range(400))]), "\n".join(both))], "a string, b string").select(
        fingerprints.paragraphs(c("a")).alias("a"), fingerprints.paragraphs(c("b")).alias("b"))
    frame = frame.select("a", "b", fingerprints.sketch(c("a")).alias("x"), fingerprints.sketch(c("b")).alias("y"))
    r = frame.select("a", "b", fingerprints.differences(c("a"), c("b"), c("x"), c("y")).alias("d")).first()
    assert {(x["digest"], x["side"]) for x in r["d"]} == {(x, 1) for x in set(r["a"]) - set(r["b"])} | {(x, -1) for x in set(r["b"]) - set(r["a"])}
    assert len(r["d"]) < 410


# --- personal data ---------------------------------------------------------------------------------------------------

def plain_spans(t):
    def ok(kind, m):
        digits = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")),
                "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
    forms = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    return [(k, m.start(), m.end()) for k, f in forms.items() for m in re.finditer(f, t) if ok(k, m[0])]


def test_base_spans():
    rng = random.Random(5)
    bits = ["a@b.c", "@", "x.y@z", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111111111111111", "4111-1111 1111 1111", "+1 (555) 123-4567", "+", "00",
            " ", ".", "-", "é", "\n", "a@b@c.d", "4111111111111112", "(", "255.255.255.255", "0000.1.2.3", "word"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        assert pii.base_spans(t) == plain_spans(t), t


@pytest.mark.parametrize("text", ["7" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "@" * 200_000, "+1" * 100_000])
def test_long_runs_take_linear_time(text):
    spans = pii.base_spans(text)
    pii.instances(text, spans)


def test_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"write to my number +1 (555) 123-{4000 + i} or else") for i in range(12)]
    rows += [(50, "call my number 555x99 today"), (51, "the 555x98 is no secret"), (52, None), (53, "")]
    got = {r["doc_id"]: r for r in pii.find_personal(documents(spark, rows)).collect()}
    assert [tuple(s) for s in got[50]["added"]] == [("phone", 15, 21)]
    assert len(got) == len(rows) and not got[51]["added"] and all(len(got[i]["base"]) == 1 for i in range(12)) and not got[52]["base"]
    clean = {r["doc_id"]: r for r in pii.redact(documents(spark, rows)).collect()}
    assert clean[50]["text"] == "call my number <PHONE> today" and clean[50]["n_chars"] == len(clean[50]["text"]) and clean[52]["text"] is None
    assert clean[51]["text"] == rows[13][1] and "spans" in clean[51].asDict()


def identifier_rows():
    rng = random.Random(8)
    keys = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(68)]
    plain = [f"q{rng.randrange(10 ** 6)}-z{k}x" for k in range(14)]
    rows = [(i, f'so it token = "{k}" ends') for i, k in enumerate(keys[:60])]
    rows += [(100 + i, f"use token = {k}!! now") for i, k in enumerate(plain[:12])]
    # keys and numbers behind a stop word, which mostly stands before words
    rows += [(200 + i, "the word the house the " + (keys[60 + i] if i < 8 else f"{4000 + i}77")) for i in range(16)]
    # what one pattern has found is the seed of another
    rows += [(300 + i, f"apikey is: {k} here") for i, k in enumerate(plain)]
    rows += [(400 + i, f"login=u{i}n{i}") for i in range(8)] + [(500, "token = nothing"), (501, f"the {plain[0]}"), (502, ""), (503, None)]
    return rows, keys, plain


def plain_added(rows):
    """Positions of what confident patterns find, by plain loops over whole words."""
    def word(w):
        return "<long>" if len(w) > pii.LONG else "<email>" if "@" in w else "<number>" if re.search("[0-9]", w) else w.strip(pii.EDGES).lower()

    totals, met = Counter(), []
    for i, t in rows:
        spans = [(m.start(), m.end()) for m in re.finditer(r"[^ \t\n\x0b\f\r]+", t or "")]
        left = [word(t[a:b]) for a, b in spans]
        for k, (a, b) in enumerate(spans):
            w = t[a:b]
            key, _, value = w.partition("=")
            own = [(word(key), "=")] if value else [tuple(left[k - n:k]) for n in (1, 2) if k >= n]
            totals.update(own)
            token = (value or w).strip(pii.EDGES)
            if re.search("[0-9]", w) and len(token) >= pii.SHORTEST:
                at = t.index(token, a)
                met.append((i, own, token.lower(), bool(re.fullmatch("[0-9a-fA-F]{32,}", token)), at, at + len(token)))
    accepted = {m[2] for m in met if m[3]}
    found = set()
    for _ in range(6):
        good = {}
        for p in totals:
            fillers = [m for m in met if p in m[1]]
            known = [m for m in fillers if m[2] in accepted]
            if len({m[2] for m in known}) >= pii.SEEDS and len(known) / (totals[p] + 1) >= pii.CONFIDENT:
                good[p] = len(known)
        for token in {m[2] for m in met}:
            edges = [p for m in met if m[2] == token for p in m[1]]
            if edges and sum(p in good for p in edges) / len(edges) >= pii.KEPT:
                found.add(token)
        accepted |= found
    return {(m[0], m[4], m[5]) for m in met if m[2] in found and any(p in good for p in m[1])}


def test_accepted_identifiers_bring_in_patterns_and_stop_words_do_not(spark):
    rows, keys, plain = identifier_rows()
    got = {r["doc_id"]: r["added"] for r in pii.find_personal(documents(spark, rows)).collect()}
    found = {(i, s["start"], s["end"]) for i, added in got.items() for s in added}
    assert found == plain_added(rows)
    text = dict(rows)
    said = {text[i][a:b] for i, a, b in found}
    assert said == set(keys[:60]) | set(plain) and all(not got[i] for i in range(200, 216)) and not got[500] and not got[501]
    assert {s["kind"] for added in got.values() for s in added} == {"secret"}


def test_planted_keys_are_found(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").dropDuplicates(["doc_id"])
    # as often as in a table ten times as large
    planted = docs.where("doc_id % 10 = 3 and length(text) > 60").withColumn("key", F.sha1(F.col("doc_id").cast("string"))).withColumn(
        "text", F.concat(F.left("text", F.lit(40)), F.lit(' token = "'), "key", F.lit('" '), F.expr("substr(text, 41)")))
    both = docs.withColumn("key", F.lit(None).cast("string")).join(planted.select("doc_id"), "doc_id", "left_anti").unionByName(planted)
    got = {r["doc_id"]: r["added"] for r in pii.find_personal(both).collect()}
    rows = both.collect()
    texts = {r["doc_id"]: r["text"] or "" for r in rows}
    said = {i: [texts[i][s["start"]:s["end"]] for s in added] for i, added in got.items()}
    keys = {r["doc_id"]: r["key"] for r in rows if r["key"]}
    assert sum(k in said[i] for i, k in keys.items()) >= 0.9 * len(keys) >= 9
    clean = [i for i, t in texts.items() if not re.search("[0-9a-fA-F]{32}", t)]
    assert not any(said[i] for i in clean)


def test_personal_data_of_odd_rows(spark):
    assert pii.find_personal(documents(spark)).count() == len(document_rows()) and pii.find_personal(documents(spark, [])).count() == 0


# --- language --------------------------------------------------------------------------------------------------------

def test_language_on_held_out_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs.where(~held_out(F.col("doc_id"), 5, 0)))
    got = langid.predict(docs, model, ["doc_id", "lang"]).collect()
    held = [r for r in got if zlib.crc32(str(r["row"]["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 20 and sum(r["lang_pred"] == r["row"]["lang"] for r in held) >= 0.97 * len(held)
    assert sum(r["rejected"] for r in got) <= 0.01 * len(got) and all(0 <= r["score"] <= 1 for r in got)
    odd = documents(spark, [(1, None), (2, ""), (3, "12 !? 34"), (4, "xqzj vkqx zzqj wvxq kjqz " * 40), (None, "the and of with"), (5, "é" * 200_000)])
    by = {r["row"]["doc_id"]: r for r in langid.predict(odd, model, ["doc_id", "row"]).collect()}
    assert len(by) == 6 and all(by[i]["lang_pred"] == "und" and by[i]["rejected"] and by[i]["score"] == 0 for i in (1, 2, 3))
    assert by[4]["rejected"] and by[4]["lang_pred"] in model.languages
    assert langid.predict(odd.limit(0), model, ["doc_id"]).count() == 0
    assert langid.fit(odd.where("doc_id < 2")) is None
    assert {r["lang_pred"] for r in langid.predict(odd, None, ["doc_id"]).collect()} == {"und"}


def test_judging_holds_little_at_once():
    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.integers(97, 123, 2000))) for _ in range(1200)]
    codes, number = np.unique(langid.grams(*langid.symbols([t.encode() for t in texts[:20]])), return_counts=True)
    part = langid.KneserNey(codes, number, 27)
    hashed = langid.mix(codes)
    order = np.argsort(hashed)
    costs = np.repeat(-np.log(part.probability(codes))[order][:, None], 8, 1).astype(np.float32)
    model = langid.Model(list("abcdefgh"), [part] * 8, hashed[order], costs)
    langid.letter_table()
    tracemalloc.start()
    for _, chunk in langid.text_chunks(pa.array(texts), None, langid.CHUNK):
        model.judge(chunk)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # every byte of a chunk takes some 100 bytes of symbols, grams and costs
    assert peak < 60e6


def test_kneser_ney_adds_up_to_one():
    found, begins = langid.symbols([b"abab cabc abca", "Été à la".encode()])
    keys, counts = np.unique(langid.grams(found, begins), return_counts=True)
    letters = np.unique(found)
    model = langid.KneserNey(keys, counts, len(letters))
    for context in (keys[3] >> np.uint64(16), np.uint64(0), np.uint64(ord("c"))):
        codes = (context << np.uint64(16)) | letters
        assert model.probability(codes).sum() == pytest.approx(1)


# --- leaks -----------------------------------------------------------------------------------------------------------

def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(9)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 40))] for _ in range(2))
        assert decontaminate.common_subsequence(decontaminate.Item(0, a).masks(), len(a), b) == longest_common(a, b)


def test_overlapping_stretches_are_added_up_once(monkeypatch):
    rng = np.random.default_rng(3)
    words = Words([" ".join(f"w{k}" for k in rng.integers(0, 60, n)).encode() for n in (0, 1, 23, 24, 25, 47, 48, 49, 72, 73, 400)])
    known = np.unique(words.hashes)[::2]
    space = decontaminate.Space(
        [], np.arange(5), known, np.ones(len(known), np.float32), rng.standard_normal((len(known), 6)), np.zeros((5, 6)), 0.0, None, None, np.zeros(0))
    met, made, plain = [], [], decontaminate.stretch_sums
    monkeypatch.setattr(decontaminate, "answers_and_copies", lambda *_: [np.zeros((0, 4), np.int64)])
    monkeypatch.setattr(decontaminate, "stretch_sums", lambda *given: met.append(given) or made.append(plain(*given)) or made[-1])
    assert decontaminate.candidates(space, words) == []
    (_, at, hit, start, _, _, stop, _), vectors = met[0], made[0]
    want = [sum((space.axes[at[k]] for k in range(a, z) if hit[k]), np.zeros(6)) for a, z in zip(start, stop, strict=True)]
    sizes = words.counts()
    assert np.allclose(vectors, want) and len(vectors) == sum(max(1, -(-int(n - 24) // 24)) for n in sizes if n)


def test_leaks_against_all_stretches(spark):
    rng = random.Random(4)
    common, rare = [f"c{k}" for k in range(30)], [f"r{k}" for k in range(4000)]
    say = lambda n: [rng.choice(common) if rng.random() < 0.6 else rng.choice(rare) for _ in range(n)]
    items = [(k, say(rng.randrange(10, 45))) for k in range(25)]
    rows = []
    for i in range(60):
        w = say(rng.randrange(0, 300))
        if i % 3 == 0:
            own = list(rng.choice(items)[1])
            for _ in range(i % 4 * len(own) // 12):
                own[rng.randrange(max(1, len(own) - 6))] = rng.choice(rare)
            at = rng.randrange(len(w) + 1)
            w[at:at] = own
        rows.append((i, " ".join(w)))
    rows += [(90, None), (91, ""), (92, " ".join(items[3][1]).upper()), (None, " ".join(items[4][1])), (93, " ".join(items[5][1] + items[6][1]))]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(98, None), (99, "")], "item_id long, text string").withColumn("row", F.lit(0))
    found = decontaminate.find_leaks(documents(spark, rows), bench, ["doc_id", "row"])
    got = {r["row"]["doc_id"]: (r["contaminated"], r["n_items"]) for r in found.collect()}
    parsed = [decontaminate.Item(i, Words([" ".join(w).encode()], lower=True).hashes.tolist()) for i, w in items]
    for i, t in rows:
        w = Words([(t or "").encode()], lower=True).hashes.tolist()
        n = sum(decontaminate.best_share(x, w, 0, len(w))[1] for x in parsed)
        assert got[i] == (n > 0, n), i
    assert sum(x[0] for x in got.values()) > 15
    assert not decontaminate.find_leaks(documents(spark, rows), bench.limit(0), ["doc_id"]).where("contaminated").count()
    assert decontaminate.find_leaks(documents(spark, []), bench, ["doc_id"]).count() == 0


def test_copies_of_long_items_and_rare_words_replaced(spark):
    rng = random.Random(12)
    vocabulary = [f"v{k}" for k in range(6000)]
    say = lambda n: [vocabulary[int(6000 ** rng.random()) - 1] for _ in range(n)]
    long = [(k, say(n)) for k, n in enumerate([200, 260, 400, 640, 1000])]
    short = [(10 + k, say(rng.randrange(25, 60))) for k in range(20)]
    rows = []
    for i, w in long:
        rows.append((i, " ".join([*say(90), *w, *say(70)])))
    for i, w in short:
        rarest = sorted(range(len(w) - 5), key=lambda k: -int(w[k][1:]))
        own = list(w)
        for k in rarest[:int(0.38 * len(w))]:
            own[k] = f"v{rng.randrange(3000, 6000)}"
        rows.append((i, " ".join([*say(rng.randrange(90)), *own, *say(rng.randrange(90))])))
    rows += [(100 + k, " ".join(say(300))) for k in range(300)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in long + short], "item_id long, text string")
    got = {r["row"]["doc_id"]: r["best_item"] for r in decontaminate.find_leaks(documents(spark, rows), bench, ["doc_id"]).where("contaminated").collect()}
    assert got == {i: i for i, _ in long + short}


def test_leaks_of_the_tables(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {r["row"]["doc_id"]: r["contaminated"] for r in decontaminate.find_leaks(docs, bench, ["doc_id"]).collect()}
    items = [" ".join(r["text"].split()) for r in bench.collect()]
    whole = {r["doc_id"]: any(x in " ".join(r["text"].split()) for x in items) for r in docs.collect()}
    assert all(got[i] for i, leak in whole.items() if leak) and sum(got.values()) <= sum(whole.values()) + 2 and any(whole.values())


# --- scores ----------------------------------------------------------------------------------------------------------

def test_word_scores(spark):
    rows = document_rows()
    out = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    got = sorted((tuple(r) for r in lm.score_texts(documents(spark), held_out(F.col("doc_id"), 7, 2), tokenizer_path()).collect()), key=repr)
    split = [(i, [w for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]) for i, t in rows]
    counts = Counter(x for i, w in split if not out[i] for x in [*w, 0])
    total = sum(counts.values())
    want = []
    for i, w in split:
        w = [*w, 0]
        want.append((i, out[i], len(w), sum(counts[x] > 0 for x in w), total, sum(np.log10((counts[x] + 1) / (total + len(counts) + 1)) for x in w)))
    want.sort(key=repr)
    assert any(out.values()) and len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: repr(r[:4]) + f"{r[5]:.6f}"), sorted(want, key=lambda r: repr(r[:4]) + f"{r[5]:.6f}"), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5]) and g[6] < 0
    assert lm.score_texts(documents(spark, []), held_out(F.col("doc_id"), 7, 2), tokenizer_path()).count() == 0


def test_windows_score_every_token_once():
    classes, offsets = np.arange(100) % lm.CLASSES, np.array([0, 0, 30, 100])
    inputs, targets, weight, doc = lm.windows_of(classes, offsets, 5)
    assert weight.sum() == 103
    for d, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        own = doc == d
        assert targets[own][weight[own] > 0].tolist() == [*classes[a:b], 5]
        before = [*[lm.CLASSES] * (lm.LEAD + 1), *classes[a:b]]
        for k, row in enumerate(inputs[own]):
            seen = before[k * lm.STRIDE:k * lm.STRIDE + lm.WINDOW]
            assert row[:len(seen)].tolist() == seen


def test_attention_is_causal_and_its_gradient_right():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in lm.start_parameters(np.zeros(lm.CLASSES)).items()}
    p["U"] *= 10
    inputs, targets = rng.integers(0, lm.CLASSES + 1, (3, lm.WINDOW)), rng.integers(0, lm.CLASSES, (3, lm.STRIDE))
    weight = np.ones(targets.shape)
    weight[1, 5:] = 0

    def loss(q):
        hidden, _ = lm.attend(q, inputs)
        out = lm.log_softmax(hidden.reshape(-1, lm.DIM) @ q["U"] + q["b"])
        return -(out[np.arange(len(out)), targets.ravel()] * weight.ravel()).sum() / weight.sum()

    g = lm.gradient(p, inputs, targets, weight)
    for k in lm.SHAPES:
        at = tuple(int(rng.integers(0, n)) for n in lm.SHAPES[k]) if k != "E" else (int(inputs[0, 7]), 3)
        up, down = ({n: v.copy() for n, v in p.items()} for _ in range(2))
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert g[k][at] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-6), k
    later = inputs.copy()
    later[:, -1] = 0
    p32 = {k: v.astype(np.float32) for k, v in p.items()}
    assert np.allclose(lm.class_scores(p32, inputs, targets)[:, :-1], lm.class_scores(p32, later, targets)[:, :-1], atol=1e-5)


def test_shares_and_classes_add_up():
    v = lm.Vocabulary(np.array([50.0, 0, 3, 900, 7, 0, 1] * 40))
    assert np.allclose([np.sum(10 ** v.share[v.classes == k]) for k in np.unique(v.classes)], 1) and np.exp(v.log_class).sum() >= 0.99


def test_training_beats_the_start():
    rng = np.random.default_rng(0)
    classes = np.cumsum(rng.integers(1, 3, 60_000)) % 20
    inputs, targets, weight, _ = lm.windows_of(classes, np.array([0, 60_000]), 0)
    p = lm.start_parameters(np.log(np.bincount(classes, minlength=lm.CLASSES) / len(classes) + 1e-6))
    before = -lm.class_scores(p, inputs, targets).mean()
    p, seen = lm.adam(p, lm.batched([(inputs, targets, weight)] * 2, lm.BATCH))
    assert seen == 2 * len(inputs) and -lm.class_scores(p, inputs, targets).mean() < 0.5 * before


def test_the_model_tells_ids_of_one_class_apart():
    rng = np.random.default_rng(2)
    # ids 0 and 1 are of one class; 0 is followed by 2, 1 by 3, which are of two classes
    first = rng.integers(0, 2, 20_000)
    ids, of = np.stack([first, first + 2], 1).ravel(), np.array([0, 0, 1, 2, 3])
    inputs, targets, weight, _ = lm.windows_of(of[ids], np.array([0, len(ids)]), 3, ids, 4)
    p = lm.start_parameters(np.full(lm.CLASSES, -np.log(lm.CLASSES)), of[:4])
    uses = np.zeros(5, np.int64)
    p, _ = lm.adam(p, lm.batched([(inputs, targets, weight)] * 2, lm.BATCH), uses)
    scores = lm.class_scores(p, inputs, targets)
    # not knowing the id before costs log 2
    assert scores[targets == 1].mean() > -0.2 and scores[targets == 2].mean() > -0.2
    assert p["E"].shape == (5, lm.DIM) and uses.sum() == 2 * inputs.size


def test_embeddings_of_ids_that_occur_are_learned(spark):
    rows = keyed(documents(spark, [(i, f"one two three {i}") for i in range(20)])).withColumn("held_out", F.col("doc_id") == 0)
    size = subwords(tokenizer_path()).size
    tokens = lm.token_rows(rows, tokenizer_path()).localCheckpoint()
    vocabulary = lm.Vocabulary(lm.count_ids(tokens, size))
    learned, start = lm.train(tokens, vocabulary, size)["E"], lm.start_parameters(vocabulary.log_class, vocabulary.classes[:size])["E"]
    seen = np.unique(subwords(tokenizer_path()).encode([f"one two three {i}" for i in range(1, 20)])[0])
    changed = np.flatnonzero((learned != start).any(1))
    assert learned.shape == (size + 1, lm.DIM) and set(changed) <= {*seen, size} and len(changed) > 4


@pytest.mark.parametrize("text", ["one two", "three four five", "six"])
def test_every_window_is_trained_on(spark, text):
    rows = keyed(documents(spark, [(1, text)])).withColumn("held_out", F.lit(False))
    size = subwords(tokenizer_path()).size
    tokens = lm.token_rows(rows, tokenizer_path())
    vocabulary = lm.Vocabulary(lm.count_ids(tokens, size))
    learned, start = lm.train(tokens, vocabulary, size), lm.start_parameters(vocabulary.log_class)
    assert not np.array_equal(learned["b"], start["b"])


# --- packing ---------------------------------------------------------------------------------------------------------

def test_subwords_of_odd_texts():
    coder, plain = subwords(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    texts = [t or "" for _, t in document_rows()] + ["It's 3.5% — DON'T, ﬁne! İstanbul ΣΑΣ naïve naïve <|endoftext|> \x1c\x85\u2028 x", "ab\r\ncd\x00e", "“quote”, 漢字 😀!",
        "<|endoftext|>", "a<|endoftext|><|startoftext|>b.c <|ENDOFTEXT|> <|endoftext|", "e<|endoftext|>\u0301 \u0301x", "<|endof text|>"]
    ids, offsets = coder.encode(texts)
    for k, t in enumerate(texts):
        assert ids[offsets[k]:offsets[k + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids


def test_packing(spark):
    rows = [*document_rows(), (500, "<|endoftext|> one <|startoftext|>two")]
    got = packing.pack_pieces(packing.cut_documents(documents(spark, rows), tokenizer_path(), 512), 512, 16).toPandas()
    plain = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 512)):
            part = ids[a:a + 512]
            want[i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    seen = Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples())
    assert seen == want
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own.offset == own.length.cumsum() - own.length).all() and own.length.sum() <= 512
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 512) + 2
    assert packing.pack_documents(documents(spark, []), tokenizer_path()).count() == 0


def test_fullest_combination():
    rng = random.Random(8)
    for _ in range(300):
        counts = Counter(rng.randrange(1, 30) for _ in range(rng.randrange(1, 9)))
        room = rng.randrange(0, 60)
        chosen = packing.fullest(sorted(counts, reverse=True), counts, room)
        sums = {0}
        for x in counts.elements():
            sums |= {s + x for s in sums}
        assert sum(chosen) == max(s for s in sums if s <= room) and not Counter(chosen) - counts


# --- pipeline --------------------------------------------------------------------------------------------------------

def test_packed_sequences_hold_their_ids(spark):
    import corpus_pipeline

    got = corpus_pipeline.best_fit_packing(spark, documents(spark), None).collect()
    assert got and all(len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)


def test_pipeline(spark, sf):
    import corpus_pipeline
    from flowlens.session import materialize
    from test_llm_dedup import plain_groups

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(materialize(stage(spark, kept[-1], sf), "stage"))
        assert kept[-1].columns == docs.columns
    ids = [{r["doc_id"] for r in k.select("doc_id").collect()} for k in kept]
    assert len(ids[1]) >= 0.99 * len(ids[0])
    rows = [(r["doc_id"], r["text"]) for r in kept[1].collect()]
    assert ids[2] == {i for i, _, component, _ in plain_groups(rows, 80) if i == component}
    items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in kept[2].collect() if not any(x in " ".join(r["text"].split()) for x in items)}
    assert ids[3] <= clean and len(ids[3]) >= len(clean) - 2 and ids[4] == ids[3]
    assert not any(plain_spans(r["text"]) for r in kept[4].collect())
    packed = corpus_pipeline.run(spark, sf).toPandas()
    assert set(packed.doc_id) == ids[4] and packed.groupby("sequence_id").length.sum().max() <= 4096
