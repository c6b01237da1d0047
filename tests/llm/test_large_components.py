"""Very large components take part in the search, or are refused."""

import pytest

from chronofold.llm import topk


def test_large_components_take_part_or_are_errors(spark):
    table = lambda rows: spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    found = topk.top_k(table([[1.0], [1.2e17]]), factor=1).collect()
    assert [tuple(x) for x in found] == [(0, 1, 1, 120_000_000_000_000_000)]
    with pytest.raises(Exception, match="64-bit"):
        topk.top_k(table([[1.0], [1e30]])).collect()
    with pytest.raises(ValueError, match="64-bit"):
        topk.top_k(table([[1e12], [1e12]])).collect()
