"""What the toxicity grammar is fitted to."""

import zlib

import numpy as np

from chronofold.llm import toxicity


def test_rows_of_one_footer_are_all_learned_from(spark, monkeypatch):
    """Different texts of one footer count each, with their own labels; copies and near copies of one label count once."""
    r = np.random.default_rng(3)
    footer = " ".join(f"foot{i}" for i in range(60))
    ids = iter(i for i in range(1000) if zlib.crc32(str(i).encode()) % 5)
    rows = [(next(ids), " ".join(f"word{x}" for x in r.integers(0, 1 << 40, 40)) + f" {footer}", int(k % 3 == 0)) for k in range(60)]
    rows += [(next(ids), t, y) for _, t, y in rows[:6]] + [(next(ids), f"{t} more", y) for _, t, y in rows[:6]] + [(next(ids), rows[0][1], 0)]
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda x, y: seen.append((x.tolist(), y.tolist())) or toxicity.PRIOR)
    for parts in (1, 5):
        table = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(parts)
        toxicity.learn(table, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert seen[0] == seen[1]
    assert sorted(seen[0][1]) == [0] * 41 + [1] * 20
