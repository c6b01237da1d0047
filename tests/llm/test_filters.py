"""The filter audit against filters that are really applied, one after the other, in every order."""

import re
from itertools import permutations

import pytest

from chronofold.llm import filters

LONG = " ".join(f"word{i}" for i in range(220))
TEXTS = [
    None, "", "", "short one", LONG, LONG, LONG + " #", "a " * 300, "A b " * 150, LONG.upper(), LONG.upper(), LONG.upper() + " 100%", "x" * 9000, "\x0b\t\n \x0c\r".join(["é中"] * 250),
    "A" + "b" * 49, "A" + "b" * 48, " ".join([f"w{i}" for i in range(100)] * 2), " ".join([f"w{i}" for i in range(99)] * 2 + ["w1", "w2"]), "\xa0".join(["one word"] * 300), "a|b", "É" * 50,
]


def rows_of():
    rows = [(i, t, ("src0", "src1", None, "")[i % 4] if i % 3 else "src0") for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[4], (4, LONG, "src1"), (None, LONG, "src0"), (None, LONG, "src0"), (None, "only nameless", "src2"), (None, "only nameless", "src2")]
    return [*rows, *((1000 + i, "hot text " * 120, "src0") for i in range(30))]


LABELS = [(0, 1, 0), (4, 1, 1), (4, 0, None), (5, 0, 1), (9, 1, 0), (10, 1, 1), (1003, 1, 0), (1000, None, 1), (None, 1, 1), (77777, 1, 1), (15, 2, -1)]


def fails(row, rows):
    i, text, _ = row
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    capitals = sum("A" <= c <= "Z" for c in text or "")
    smaller = any(j is not None and i is not None and j < i and (t or "") == (text or "") for j, t, _ in rows)
    return {
        "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * capitals > 2 * len(text or ""), "D": any(c in "#$%&*|" for c in text or ""), "E": smaller,
    }


def brute(rows, labels):
    failed = [fails(r, rows) for r in rows]
    out = []
    for part in {r[2] or "" for r in rows}:
        own = [(r, f) for r, f in zip(rows, failed, strict=True) if (r[2] or "") == part]
        marked = lambda r, at: any(x[0] is not None and x[0] == r[0] and x[at] == 1 for x in labels)
        taken = dict.fromkeys("ABCDE", 0)
        now = []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                redundant = sum(x[1][f] for x in own) - len(gone)  # those that fail this filter and were removed earlier
                taken[f] += len(gone)
                alone = sum(x[1][f] and sum(x[1].values()) == 1 for x in own)
                now.append((part, order, step, len(left), len(gone), redundant, alone, sum(marked(r, 1) for r, _ in gone), sum(marked(r, 2) for r, _ in gone), f))
        out += [(*r[:-1], taken[r[-1]]) for r in now]
    return sorted(out)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows_of()], "doc_id long, text string, source string, mask int, part string, good int")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(*r, 1) for r in LABELS], "doc_id long, quality int, toxic int, here int")


def test_same_as_filters_applied(docs, labels):
    found = filters.audit(docs, labels)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in found.collect()) == brute(rows_of(), LABELS)


def test_empty_and_unlabelled(docs, labels):
    assert filters.audit(docs.limit(0), labels).collect() == []
    found = filters.audit(docs, labels.limit(0)).collect()
    assert sorted(tuple(r) for r in found) == brute(rows_of(), [])


def test_cells_add_up(docs, labels):
    found = filters.cells(docs, labels).collect()
    assert sum(r["n"] for r in found) == len(rows_of())
    assert len({(r["part"], r["mask"]) for r in found}) == len(found) and all(0 <= r["mask"] < 32 for r in found)
