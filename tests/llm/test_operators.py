"""Each operator against a brute-force version, over texts that hold every edge."""

import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import xxhash

from chronofold.llm import bpe, fingerprints, graph, licenses, packing, pii, simhash, suffix_array, suffix_dedup, topk, toxicity, viterbi
from tests.llm.test_similar_stage import brute_roots

rng = np.random.default_rng(11)
WORDS = ["".join(rng.choice(list("abcdeéøu中"), rng.integers(1, 9))) for _ in range(200)]
PROSE = [" ".join(rng.choice(WORDS, rng.integers(1, 250))) for _ in range(25)]
EDITED = [t.replace(" ", "  ", 1)[: len(t) - 5] + " end" for t in PROSE[:8]]
EDGES = [
    None,
    "",
    "",
    " ",
    "\t\n \x0b",
    "a",
    "A a",
    "x" * 5000,
    "ab" * 400,
    " " * 9000 + "z",
    "!" * 3000,
    "\x00\x01" + chr(0xE000) + chr(0xE001) + " 1.2.3.4",
    "😀 " * 300,
    "line\r\n" * 200,
    "1 2 3 " * 500,
    "ÀÉ ÀÉ Straße İ",
    "call +1 (888) 555-6841 or mail bob.smith@mail.example.com, server 10.0.0.255, card 4111 1111 1111 1111",
    "Licensed under the Apache License, Version 2.0. All rights reserved.",
    "you are an idiot and a worthless clown",
]
TEXTS = [*PROSE, *EDITED, *PROSE[:6], *PROSE[:3], *EDGES]


@pytest.fixture(scope="module")
def docs(spark):
    """Repeated rows, a repeated id with two texts, null ids, and columns whose names the operators use themselves."""
    rows = [(i, t, "en", "src0", -1, 7, "x", 3) for i, t in enumerate(TEXTS)]
    rows += [rows[0], rows[0], (3, "another text of the same id", None, None, None, None, None, None), (None, PROSE[1], "en", None, 1, 1, "y", 1), (None, "no id", None, None, 1, 1, "z", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key long, spans string, bucket int")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def same(found, wanted):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(wanted, key=key)


def test_written_tables_can_be_cleared(spark):
    from chronofold.llm import common

    kept = common.written(spark.range(3).toDF("x"), "clear")
    assert kept.count() == 3
    folder = common._own_folder(spark).removeprefix("file://")
    assert os.path.isdir(folder)
    common.clear(spark)
    assert not os.path.exists(folder)


# --- 1


def test_toxicity_learns_and_scores(spark, docs, empty):
    table = spark.createDataFrame([(i, f"It is a {w} day. You are such an idiot {i}." if i % 2 else f"It is a {w} day {i}.") for i, w in enumerate(WORDS)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, "extra") for i in range(len(WORDS))] + [(None, 1, ""), (5, None, "")], "doc_id long, toxic int, text string")
    found = toxicity.score(table, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    assert all(r["predicted"] == r["doc_id"] % 2 == (r["score"] >= 0.5) for r in found)
    assert toxicity.without_toxic(table, labels).count() == len(WORDS) / 2
    all_rows = toxicity.score(docs, labels).collect()
    assert len(all_rows) == docs.count() and all(0 <= r["score"] <= 1 for r in all_rows)
    assert toxicity.score(empty, labels).count() == 0
    assert toxicity.score(docs, labels.limit(0)).count() == docs.count()
    assert toxicity.without_toxic(docs, labels).columns == docs.columns


def test_insults_are_learned_from_labels(spark):
    r = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(600):
        toxic = int(r.random() < 0.2)
        words = list(r.choice(WORDS, 30)) + ["zorqu" + "".join(r.choice(list("abcde"), 3)) for _ in range(3 * toxic)] + (["krelm"] if toxic and i % 2 else [])
        rows.append((i, " ".join(r.permutation(words))))
        labels.append((i, toxic))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon, _ = toxicity.learn(table, known)
    assert list(lexicon.stems) == ["zorqu"] and set(lexicon.words) - set(toxicity.INSULTS) <= {"krelm"}
    held = [x for x in toxicity.score(table, known).collect() if x["held_out"]]
    assert held and all(x["predicted"] == labels[x["doc_id"]][1] for x in held)


def test_grammar_reads_clauses():
    reader = toxicity.Grammar(toxicity.Lexicon(dict.fromkeys(toxicity.INSULTS, 1)))
    kinds = lambda text: [dict(m) for m in reader.clauses(text)]
    assert kinds("You idiot!") == [{"insult at a target": 1}]
    assert kinds("a day. Not an idiot. fine") == [{"negated insult": 1}]
    assert kinds("Somebody said the idiot was late") == [{"reported insult": 1}]
    assert kinds("what a clown") == [{"insult": 1}]
    assert kinds("I will kill you; kill time") == [{"threat at a target": 1}]
    assert kinds("I never kill them") == [{"negated or reported threat": 1}]
    assert kinds("idiotic clownfish killer") == []
    assert kinds("word " * 50_000 + "idiot") == [{"insult": 1}]
    assert kinds("") == []


# --- 2


def test_token_counts_match_the_unigram_library(docs, rows, empty):
    from tokenizers import Tokenizer, models

    vocabulary = viterbi.vocabulary(P.path("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    wanted = [(i, len(library.encode(viterbi.MARK + t.replace(" ", viterbi.MARK), add_special_tokens=False).ids) if t else 0) for i, t in rows]
    same(viterbi.count_tokens(docs, P.path("piece_bpe_32k.model")).select("doc_id", "n_tokens").collect(), wanted)
    assert viterbi.count_tokens(empty, P.path("piece_bpe_32k.model")).count() == 0


@pytest.mark.parametrize("fallback", [True, False])
def test_viterbi_ties_and_unknowns(fallback):
    from tokenizers import Tokenizer, models

    for seed in range(60):
        r = np.random.default_rng(seed)
        pieces = sorted({"".join(r.choice(list("ab▁"), r.integers(1, 4))) for _ in range(12)})
        vocabulary = [("<unk>", 0.0)] + ([(f"<0x{b:02X}>", -50.0) for b in range(256)] if fallback else []) + [(p, float(-r.integers(1, 4))) for p in pieces]
        library = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=fallback))
        counter = viterbi.Counter(vocabulary, fallback)
        for _ in range(20):
            text = "".join(r.choice(list("ab▁cé"), r.integers(1, 15)))
            assert counter.count(text)[1] == len(library.encode(text, add_special_tokens=False).ids), (text, vocabulary[-12:])


# --- 3


def in_order(rows):
    """(doc_id, characters, hash of the edited text, extension): by descending id, then by XXH64 of the text."""
    order = sorted(rows, key=lambda r: (-r[0] if r[0] is not None else float("inf"), (xxhash.xxh64_intdigest(r[1].encode(), 42) + (1 << 63)) % (1 << 64)))
    out = []
    for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        extension = next((n for n, (x, y) in enumerate(zip(text, edited, strict=False)) if x != y), min(len(text), len(edited)))
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), extension))
    return out


def test_fingerprints_of_frequent_ids(spark):
    """One id, or none, for most rows: they are dealt out by their texts."""
    r = np.random.default_rng(9)
    for ids in ([5], [None], [5] * 30 + list(range(10)) + [None] * 30):
        rows = [(ids[i % len(ids)], " ".join(r.choice(WORDS, r.integers(1, 30)))) for i in range(300)] + [(ids[0], "same text")] * 20
        table = spark.createDataFrame(rows, "doc_id long, text string")
        found = fingerprints.fingerprint_documents(table)
        same([(x["doc_id"], x["n_chars"], x["edited_sha256"], x["extension"]) for x in found.collect()], in_order(rows))
        sizes = [x["count"] for x in found.withColumn("p", fingerprints.F.spark_partition_id()).groupBy("p").count().collect()]
        assert len(sizes) > 1 and max(sizes) < 0.75 * len(rows)


def test_likeness_follows_shared_spans(spark):
    """near_edited and near_next against the exact share of spans, on texts edited to every degree."""
    r, span = np.random.default_rng(10), fingerprints.SPAN
    rows = [(i, " ".join(r.choice(WORDS, r.integers(150, 600)))) for i in range(60)]
    exact = lambda a, b: 2 * sum((Counter(a[i : i + span] for i in range(len(a) - span + 1)) & Counter(b[i : i + span] for i in range(len(b) - span + 1))).values()) / (len(a) + len(b) - 2 * span + 2)
    texts = dict(rows)
    found = fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    errors = []
    for x in found:
        text, after = texts[x["doc_id"]], texts[(x["doc_id"] - 1) % 60]
        k = len(text) // 3
        errors += [x["near_edited"] - exact(text, text[: len(text) - k] + after[:k]), x["near_next"] - exact(text, after)]
    assert abs(np.mean(errors)) < 0.03 and np.mean(np.abs(errors)) < 0.06 and np.max(np.abs(errors)) < 0.3


def test_fingerprints(spark, docs, rows, empty):
    found = fingerprints.fingerprint_documents(docs).collect()
    wanted = in_order(rows)
    same([(r["doc_id"], r["n_chars"], r["edited_sha256"], r["extension"]) for r in found], wanted)
    texts = dict(rows)
    prints = {}
    for r in found:
        prints.setdefault(r["fingerprint"], set()).add(texts.get(r["doc_id"]) if r["doc_id"] not in (3, None) else None)
    assert all(len(v - {None}) == 1 for v in prints.values() if v - {None})
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[0]["near_next"] == 1.0 or by_id[0]["near_next"] < 0.5
    long = [r for r in found if r["n_chars"] > 300 and r["doc_id"] is not None and r["doc_id"] < 25]
    assert np.mean([r["near_edited"] for r in long]) > 0.5 > 0.2 > np.mean([r["near_next"] for r in long])
    assert fingerprints.fingerprint_documents(empty).count() == 0
    one = fingerprints.fingerprint_documents(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1.0


def test_prefix_hashes_answer_spans():
    powers = fingerprints.Powers()
    text = "abracadabra" * 5
    hashed = fingerprints.PrefixHash(text, powers)
    for a, b, n in ((0, 11, 11), (0, 7, 4), (3, 5, 1), (0, 1, 3)):
        assert (hashed.span(a, a + n) == hashed.span(b, b + n)) == (text[a : a + n] == text[b : b + n])
    assert hashed.extension(0, hashed, 11) == len(text) - 11
    assert hashed.extension(0, hashed, 7) == 4


# --- 4


def test_suffix_array_sorts():
    for seed in range(400):
        r = np.random.default_rng(seed)
        s = r.integers(1, 1 + r.integers(1, 5), r.integers(0, 40)).tolist()
        assert suffix_array.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
    for s in ([1] * 300, [1, 2] * 200, list(range(300)), list(range(300, 0, -1)), [2, 1, 1] * 100):
        assert suffix_array.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute_repeats(rows, length):
    data = [t.encode() for _, t in rows]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (i, _), d in zip(rows, data, strict=True):
        gone = bytearray(len(d))
        for at in range(len(d) - length + 1):
            if seen[d[at : at + length]] > 1:
                gone[at : at + length] = b"\1" * length
        runs = sum(1 for k in range(len(d)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(d), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "large", "huge"), [(400, 4000, 50_000), (400, 1, 50_000), (400, 1, 1), (120, 4000, 2)])
def test_repeats_against_brute_force(spark, docs, rows, monkeypatch, length, large, huge):
    monkeypatch.setattr(suffix_dedup, "LARGE", large)
    monkeypatch.setattr(suffix_dedup, "HUGE", huge)
    more = []
    r = np.random.default_rng(length)
    for t in PROSE[:12]:
        words = t.split(" ")
        for at in r.integers(0, len(words), 2):
            words[at] = str(r.choice(WORDS))
        more.append((1000 + len(more), (" ".join(words) + PROSE[20][100:])[int(r.integers(0, 30)) :]))
    table = docs.select("doc_id", "text", "key").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    found = suffix_dedup.deduplicate(table, length).collect()
    same(found, brute_repeats(rows + more, length))


def test_many_identical_rows(spark):
    """Copies of one row, in id and text, lose all that one loses, and cost no more than their rows."""
    r = np.random.default_rng(12)
    text = " ".join(r.choice(WORDS, 400))
    rows = [(7, text)] * 500 + [(8, "own " * 3 + text[1000:2000]), (9, " ".join(r.choice(WORDS, 300)))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffix_dedup.repeats(table).collect()
    assert max(len(x["spans"]) for x in found) < 2 * len(text.encode()) // 50
    got = {tuple(x) for x in suffix_dedup.deduplicate(table).collect()}
    same(list(got), sorted(set(brute_repeats([rows[0], *rows[499:]], 400))))
    assert suffix_dedup.without_repeats(table.withColumn("spans", suffix_dedup.F.lit(1)).withColumn("key", suffix_dedup.F.lit(2))).count() == 502


def test_span_hashes():
    hasher, data = suffix_dedup.Hasher(5000), np.random.default_rng(2).integers(0, 256, 4000).astype(np.uint8)
    sums, base = hasher.sums(data), int(hasher.up[1])
    for a, b in ((0, 1), (5, 900), (3000, 4000), (17, 17)):
        wanted = sum((int(x) + 1) * pow(base, k, suffix_dedup.PRIME) for k, x in enumerate(data[a:b])) % suffix_dedup.PRIME
        assert int(hasher.span(sums, np.array([a]), np.array([b]))[0]) == wanted
    morse = np.array([bin(i).count("1") & 1 for i in range(4096)], np.uint8)  # weak for any base modulo 2^64
    other = hasher.sums(1 - morse)
    assert hasher.span(hasher.sums(morse), np.array([0]), np.array([4096])) != hasher.span(other, np.array([0]), np.array([4096]))


def test_repeats_of_nothing(docs, empty):
    assert suffix_dedup.deduplicate(empty).count() == 0
    kept = suffix_dedup.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()


# --- 5

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def strict_spans(text):
    out = []
    for kind, pattern in zip(pii.KINDS, PATTERNS, strict=True):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_personal_data_keeps_every_strict_span(spark, docs, rows, empty):
    r = np.random.default_rng(5)
    noise = [(2000 + i, "".join(r.choice(list("0123456789.@-+ ()ab.c%_\n"), r.integers(0, 200)))) for i in range(400)]
    noise += [(3000, "a@b.c_d@e.f @x a@b.c@d.e"), (3001, "1.2.3.4.5.6.7.8 256.1.1.1 01.1.1.001"), (3002, "4111 1111 1111 1111 and 5500000000000004"), (3003, "a@b" + ".c" * 5000), (3004, "a@" * 500 + "b.c"), (3005, "+" + "1" * 9000), (3006, "1 " * 9000)]
    table = docs.select("doc_id", "text", "spans").unionByName(spark.createDataFrame(noise, "doc_id long, text string"), allowMissingColumns=True)
    found = pii.find(table).collect()
    told = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    wanted = [(i, *(sum(s[0] == k for s in strict_spans(t)) for k in pii.KINDS), hashlib.sha256(told(strict_spans(t)).encode()).hexdigest()) for i, t in rows + noise]
    same([r[:6] for r in found], wanted)
    texts = dict(rows + noise)
    assert all(set(filter(None, told(strict_spans(texts[r["doc_id"]])).split(","))) <= set(r["spans"].split(",")) for r in found if r["doc_id"] not in (3, None))
    assert pii.find(empty).count() == 0


def test_personal_data_is_masked(docs):
    out = pii.masked(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    text = out.where("text LIKE 'call%'").first()["text"]
    assert text == "call <PHONE> or mail <EMAIL>, server <IP>, card <CARD>"


def test_reliabilities_separate_the_truths():
    rows = [{"kind": 0, "n": 900, "strict": 1, "checksum": 1, "gazetteer": 1, "context": 1, "alone": 1, "size": 1}, {"kind": 0, "n": 50, "strict": 0, "checksum": 1, "gazetteer": 1, "context": 1, "alone": 1, "size": 1}, {"kind": 0, "n": 800, "strict": 0, "checksum": -1, "gazetteer": 0, "context": 0, "alone": -1, "size": 1}]
    p = pii._reliabilities(rows)
    assert p[0] > 0.9 and p[1] > 0.5 > 0.1 > p[2]


# --- 6


def test_license_phrases_and_notices(docs, rows, empty):
    extra = licenses.Searcher()
    for i, text in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        places = [(at, label) for phrase, label in licenses.BASE for at in range(len(words)) if words[at : at + len(phrase.split())] == phrase.split()]
        got = licenses.scan_text(text, extra)
        starts = [at for at, _ in places]
        assert got[:5] == (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))), text[:80]
    assert licenses.scan(docs).count() == len(rows) and licenses.scan(empty).count() == 0
    assert licenses.scan_text("cc by cc BY-cc by", extra)[1:4] == (3, 0, 4)


@pytest.mark.parametrize("notice", licenses.NOTICES)
def test_notices_are_found_with_edits(notice):
    words, label = notice
    searcher = licenses.Searcher()
    edits = len(words) // licenses.EDITS_EVERY
    r = np.random.default_rng(len(words))
    for _ in range(10):
        text = list(words)
        for at in sorted(r.choice(np.arange(1, len(words) - 1), edits, replace=False), reverse=True):
            text[at] = "q"
        joined = "some words " + "".join(text) + " more words"
        found = [x for x in searcher.find(joined) if x[3] == label]
        assert found and max(x[4] for x in found) >= 1 - edits / len(words) - 1e-9
        assert any(joined[x[0] : x[1]] == "".join(text) for x in found)


# --- 7


def test_top_k_against_all_products(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET", 64)
    monkeypatch.setattr(topk, "BLOCK", 4)
    r = np.random.default_rng(2)
    vectors = r.normal(0, 0.2, (500, 16)) * r.choice([0.05, 1, 4], (500, 1))
    vectors[100:140] = vectors[99]
    data = [(i, [float(np.float32(x)) for x in v], 1) for i, v in enumerate(vectors)]
    data += [(500, None, 1), (520, [None] * 16, 1), (540, [float("nan")] * 16, 1), (560, [float("inf")] + [0.0] * 15, 1), (580, [0.0] * 16, 1), (None, [1.0] * 16, 1)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>, v int")
    good = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v, _ in data if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    wanted = []
    for q, v in good:
        if q % 20 == 0:
            ranked = sorted((-int(v @ w), i) for i, w in good if i != q)[:20]
            wanted += [(q, k + 1, i, -s) for k, (s, i) in enumerate(ranked)]
    same(topk.top_k(table).select("query_id", "rank", "vec_id", "score").collect(), wanted)
    assert topk.top_k(table.limit(0)).count() == 0
    assert topk.top_k(table.where("vec_id < 3")).count() == 2


# --- 8


def test_pieces_and_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    found = packing.pack_documents(docs, P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    wanted = []
    for i, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048 if len(ids) > 2048 else len(ids)
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        wanted += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    same([r[:5] for r in found], wanted)
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(empty, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def test_counted_best_fit_is_best_fit():
    for seed in range(80):
        r = np.random.default_rng(seed)
        size = int(r.integers(1, 40))
        lengths = r.integers(1, size + 1, r.integers(0, 120)).tolist()
        bins = []
        for n in sorted(lengths, reverse=True):
            fits = [b for b in bins if b[0] >= n]
            best = min(fits, key=lambda b: b[0]) if fits else None
            if best is None:
                best = [size]
                bins.append(best)
            best[0] -= n
        placed, used = Counter(), {}
        for n, rank, each, first, offset in packing.best_fit(Counter(lengths), size):
            placed[n] = max(placed[n], rank)
            used.setdefault(n, []).append((rank, each, first, offset))
        room = {}
        for n, count in Counter(lengths).items():
            starts = sorted(used[n])
            for rank in range(count):
                at = max(x for x in starts if x[0] <= rank)
                k = rank - at[0]
                room.setdefault(at[2] + k // at[1], []).append((at[3] + k % at[1] * n, n))
        for places in room.values():
            at = 0
            for offset, n in sorted(places):
                assert offset == at
                at += n
            assert at <= size
        assert len(room) == len(bins)


# --- 9


def test_ids_are_the_librarys(docs, rows, empty):
    encoding = bpe.load(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    wanted = []
    for i, t in rows:
        if " " * 5000 in t:
            ids = encoding.encode_ordinary(" " * 8999) + encoding.encode_ordinary(" z")
        else:
            ids = encoding.encode_ordinary(t)
        wanted.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    path = P.path("byte_bpe_multi_50k.tiktoken")
    same(bpe.encode_decode(docs, path, P.PATTERN).collect(), wanted)
    assert bpe.encode_decode(empty, path, P.PATTERN).count() == 0


def test_safe_boundaries(monkeypatch):
    encoding = bpe.load(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    monkeypatch.setattr(bpe, "PIECE_CHARS", 7)
    r = np.random.default_rng(9)
    for _ in range(300):
        text = "".join(r.choice(list("ab1 2 \n\t\x1c \x85'st.,é中"), r.integers(0, 120)))
        assert "".join(bpe.pieces(text)) == text
        assert np.frombuffer(bpe.encode_bytes(encoding, text), "<u4").tolist() == encoding.encode_ordinary(text)


def test_endless_white_space():
    encoding = bpe.load(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    text = "a" + " " * 1_500_000 + "b" + "\n" * 6000
    ids = np.frombuffer(bpe.encode_bytes(encoding, text), "<u4").tolist()
    assert encoding.decode_bytes(ids) == text.encode()


# --- 10


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash(docs, rows, empty):
    prints = [brute_fingerprint(t) for _, t in rows]
    groups = brute_components(prints, 4)
    least = {}
    for (i, _), g in zip(rows, groups, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    same(simhash.near_duplicates(docs).collect(), [(i, f"{p:016x}", least.get(g)) for (i, _), p, g in zip(rows, prints, groups, strict=True)])
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(brute_roots([t for _, t in rows])))
    smallest = {}
    for (i, _), g in zip(rows, brute_roots([t for _, t in rows]), strict=True):
        if i is not None:
            smallest[g] = min(i, smallest.get(g, i))
    assert {r["doc_id"] for r in kept.collect()} - {None} == set(smallest.values())


@pytest.mark.parametrize("tile", [1024, 8])
def test_links_join_all_near_fingerprints(spark, tile):
    r = np.random.default_rng(4)
    values = set()
    for center in r.integers(0, 1 << 62, 12):
        for _ in range(40):
            x = int(center)
            for bit in r.integers(0, 64, r.integers(0, 6)):
                x ^= 1 << int(bit)
            values.add(x & (1 << 64) - 1)
    values = sorted(values | {0, (1 << 64) - 1})
    signed = [x - (1 << 64) if x >> 63 else x for x in values]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, tile)
    pairs = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in found.collect()]
    assert all(0 < (a ^ b).bit_count() <= 4 for a, b in pairs)
    place = {x: i for i, x in enumerate(values)}
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = find(place[a]), find(place[b])
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(values))] == brute_components(values, 4)


def test_components(spark):
    edges = [(i + 1, i) for i in range(60)] + [(100, 200), (200, 300), (5, 5), (300, 100), (100, 200)]
    found = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
