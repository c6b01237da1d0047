"""Every pipeline stage on null ids and texts, repeated rows, very long texts and clashing columns; the whole against brute force."""

import re

import numpy as np
import pytest

import corpus_pipeline
from chronofold.llm import pii, simhash, suffix_dedup, toxicity
from tests.llm.test_operators import brute_repeats
from tests.llm.test_similar_stage import brute_roots

CLASHES = ["key", "check", "_key", "__key", "__check", "found", "__found", "spans", "__spans", "sid", "root", "row", "chosen", "h", "a.b"]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    r = np.random.default_rng(21)
    words = ["".join(r.choice(list("abcdefgh\u00e9"), r.integers(2, 9))) for _ in range(300)]
    prose = [" ".join(r.choice(words, r.integers(20, 120))) for _ in range(30)]
    passage = " ".join(r.choice(words, 90))
    rows = list(enumerate(prose))
    rows += [(None, None), (None, None), (None, prose[0]), (40, ""), (41, None), (42, prose[1]), (42, prose[1]), (43, " ".join(r.choice(words, 60_000))), (44, prose[2] + " " + passage), (45, prose[3] + " " + passage), (46, "you are an idiot"), (47, "write to me@example.org or +49 30 1234567, 10.0.0.1 " + prose[4]), (None, "mail a@b.co " * 300)]
    folder = str(tmp_path_factory.mktemp("edges"))
    docs = spark.createDataFrame([(i, t, "en", "s", -1 if t is None else len(t), *range(len(CLASHES))) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHES))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i == 46)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def masked(text):
    """Python's version of the mask, on the spans that the query tells."""

    def mask(spans):
        out, at = [], 0
        for kind, s, e in sorted(((k, int(a), int(b)) for k, a, b in (x.split(":") for x in spans.split(",") if x)), key=lambda x: (x[1], x[2], pii.KINDS.index(x[0]))):
            if s >= at:
                out += [text[at:s], f"<{kind.upper()}>"]
            at = max(at, e)
        return "".join([*out, text[at:]])

    return mask


def test_each_stage(spark, table):
    folder, rows = table
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    by = {name: stage(spark, docs, folder) for name, stage in corpus_pipeline.STAGES[:-1]}
    assert all(df.columns == docs.columns and df.schema == docs.schema for df in by.values())
    assert of(by["toxicity"]) == sorted((x for x in rows if x[0] != 46), key=str)
    first, wanted = {}, brute_roots([t for _, t in rows])
    for (i, t), g in zip(rows, wanted, strict=True):
        own = (float("inf") if i is None else i, t or "")
        first[g] = min(first.get(g, own), own)
    assert sorted((str(i), t or "") for i, t in of(by["near_duplicates"])) == sorted(("None" if i == float("inf") else str(i), t) for i, t in first.values())
    cut = brute_repeats([(i, t or "") for i, t in rows], corpus_pipeline.PASSAGE_BYTES)
    got = by["repeats"].collect()
    assert sorted(len((r["text"] or "").encode()) for r in got) == sorted(x[1] - x[2] for x in cut)
    spans = {(r["doc_id"], r["base_sha256"]): r["spans"] for r in pii.find(docs).collect()}
    told = {}
    for r in pii.find(docs.selectExpr("row_number() over (order by doc_id, text) doc_id", "text")).collect():
        told[r["doc_id"]] = r["spans"]
    texts = [r["text"] for r in docs.selectExpr("row_number() over (order by doc_id, text) n", "text").orderBy("n").collect()]
    assert spans and sorted((r["text"] for r in by["personal_data"].collect()), key=str) == sorted((t if t is None else masked(t)(told[n + 1]) for n, t in enumerate(texts)), key=str)
    assert all(r["n_chars"] == len(r["text"]) for n in ("repeats", "personal_data") for r in by[n].collect() if r["text"] is not None)


def test_whole_pipeline(spark, table):
    """run() keeps what the stages keep, one after the other, and packs all of it."""
    folder, _ = table
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in packed} == set(kept)
    bins = {}
    for r in packed:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in b) <= 2048 and all(a + n == c for (a, n), (c, _) in zip(sorted(b), sorted(b)[1:], strict=False)) for b in bins.values())


def test_masks_are_linear_in_matches(spark):
    """A megabyte of addresses, and one of digits and points, in single texts."""
    docs = spark.createDataFrame([(1, " ".join(f"user{i}@example{i}.com" for i in range(40_000))), (2, "1." * 300_000), (3, "a+1 (" * 50_000)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert found[1]["n_email"] == 40_000 and found[2]["n_ip"] == 75_000
    texts = {r["doc_id"]: r["text"] for r in pii.masked(docs).collect()}
    assert texts[1] == " ".join(["<EMAIL>"] * 40_000) and not re.search("[0-9]", texts[2])


def test_operators_do_not_touch_the_callers_columns(spark, table):
    docs = spark.read.parquet(f"{table[0]}/documents.parquet")
    for df in (simhash.without_near_duplicates(docs), suffix_dedup.without_repeats(docs), pii.masked(docs), toxicity.without_toxic(docs, spark.read.parquet(f"{table[0]}/labels.parquet"))):
        assert all(r[c] == i for r in df.collect() for i, c in enumerate(CLASHES))
