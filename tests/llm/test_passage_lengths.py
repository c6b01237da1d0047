"""Which repeated passages of over 50 words op4's rule and the pipeline's stage remove, by their length in bytes."""

import numpy as np

import corpus_pipeline
from chronofold.llm import suffix_dedup


def _planted(size, r):
    """51 words of ``size`` bytes between letters that differ in the two texts."""
    lengths = np.full(51, (size - 50) // 51) + (np.arange(51) < (size - 50) % 51)
    passage = " ".join("".join(r.choice(list("aeioulmnrst"), n)) for n in lengths)
    own = [" ".join("".join(r.choice(list("bcdfghkpq"), 7)) for _ in range(60)) for _ in range(4)]
    return passage, [f"{own[0]}X{passage}Y{own[1]}", f"{own[2]}V{passage}W{own[3]}"]


def test_passages_of_over_50_words_by_bytes(spark):
    r = np.random.default_rng(41)
    sizes = [271, 394, 399, 400, 401]
    planted = [_planted(n, r) for n in sizes]
    assert [len(p.encode()) for p, _ in planted] == sizes
    docs = spark.createDataFrame([(2 * i + k, text) for i, (_, pair) in enumerate(planted) for k, text in enumerate(pair)], "doc_id long, text string")
    removed = {x.doc_id: (x.n_removed, x.n_spans) for x in suffix_dedup.deduplicate(docs).collect()}
    assert removed == {2 * i + k: (n, 1) if n >= 400 else (0, 0) for i, n in enumerate(sizes) for k in (0, 1)}
    kept = {x.doc_id: x.text for x in corpus_pipeline.drop_repeats(spark, docs, "").collect()}
    assert kept == {2 * i + k: text.replace(p, "") for i, (p, pair) in enumerate(planted) for k, text in enumerate(pair)}
