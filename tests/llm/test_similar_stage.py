"""The pipeline's near-duplicate stage against all pairs of shingle sets."""

import numpy as np
import pytest

import corpus_pipeline
from chronofold.llm import simhash


def words_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_roots(texts):
    sets = [words_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def planted():
    """Texts with a footer in common, and of each third one copies with one to seven words replaced: similarities of 0.6 to 0.98."""
    r = np.random.default_rng(8)
    words = [f"w{i}" for i in range(900)]
    footer = " ".join(f"foot{i}" for i in range(60))
    texts = []
    for i in range(60):
        base = list(r.choice(words, int(r.integers(90, 260))))
        texts.append(" ".join(base) + (f" {footer}" if i % 2 else ""))
        for k in range(1, 8) if i % 3 == 0 else ():
            copy = list(base)
            for at in r.choice(len(base), k, replace=False):
                copy[at] = f"new{r.integers(1 << 40)}"
            texts.append(" ".join(copy) + (f" {footer}" if i % 2 else ""))
    few = [" ".join(r.choice(words[:6], int(r.integers(1, 12)))) for _ in range(80)]
    return [*texts, *few, None, "", " ", texts[0].upper(), texts[0].replace(" ", "\n")]


@pytest.mark.parametrize("tile", [1024, 8])
def test_stage_against_all_pairs(spark, monkeypatch, tile):
    """Small tiles deal every group out; links of 0.8 and more are found but for few, none below is made."""
    monkeypatch.setattr(simhash.near_links, "__defaults__", (tile,))
    texts = planted()
    roots, sets = brute_roots(texts), [words_set(t) for t in texts]
    likeness = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a and b and a != b]
    assert sum(0.8 <= x < 0.95 for x in likeness) > 50
    docs = spark.createDataFrame([(i, t, -1, 5) for i, t in enumerate(texts)], "doc_id long, text string, key long, `che.ck` long").repartition(3)
    found = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert found.columns == docs.columns
    kept, exact = {r["doc_id"] for r in found.collect()}, set(roots)
    assert exact <= kept  # nothing goes that all pairs would keep
    assert len(kept - exact) <= 0.02 * (len(texts) - len(exact))


def test_edges(spark):
    docs = spark.createDataFrame([(None, None), (None, "a b c"), (7, "A b  c"), (7, "A b  c"), (7, "other words"), (3, ""), (4, " ")], "doc_id long, text string")
    kept = sorted((tuple(r) for r in simhash.without_near_duplicates(docs).collect()), key=str)
    assert kept == sorted([(7, "A b  c"), (7, "other words"), (3, "")], key=str)
    assert simhash.without_near_duplicates(docs.limit(0)).count() == 0


def test_spanning_forest_joins_what_every_closer_bound_joins():
    r = np.random.default_rng(4)
    prints = r.integers(0, 1 << 63, (60, simhash.PRINTS), dtype=np.uint64)
    prints = np.concatenate([prints, prints ^ np.uint64(1 << 5), prints ^ np.uint64(0b1110000)])
    group = r.integers(0, 4, len(prints))
    a, b, bits = simhash.close_pairs(group, np.full(len(group), -1), prints)
    wanted = {(i, j) for i in range(len(group)) for j in range(i) if group[i] == group[j] and int(np.bitwise_count(prints[i] ^ prints[j]).sum()) <= simhash.REACH}
    assert {(max(x), min(x)) for x in zip(a.tolist(), b.tolist(), strict=True)} == wanted and len(a) == len(wanted)

    def labels(pairs):
        root = list(range(len(group)))
        for _ in range(len(group)):
            for x, y in pairs:
                root[x] = root[y] = min(root[x], root[y])
        return root

    kept = simhash.spanning(a, b, bits, len(group))
    for bound in (4, 8, 12, 16, 64):
        assert labels([(a[k], b[k]) for k in kept if bits[k] <= bound]) == labels([(a[k], b[k]) for k in range(len(a)) if bits[k] <= bound])
