"""Notices of one kind that stand close together are all found."""

import numpy as np
import pytest

from chronofold.llm import licenses


@pytest.mark.parametrize("notice", licenses.NOTICES)
def test_adjacent_notices(notice):
    words, label = notice
    searcher = licenses.Searcher()
    r = np.random.default_rng(len(words))
    for _ in range(20):
        text, wanted = "", []
        for _ in range(int(r.integers(2, 6))):
            one = list(words)
            if r.random() < 0.6:
                one[int(r.integers(2, len(one) - 2))] = "q"
            wanted.append((len(text), len(text) + len(one)))
            text += "".join(one) + " "
        assert sorted(x[:2] for x in searcher.find(text.strip()) if x[3] == label and licenses.NOTICES[x[2]] == notice) == wanted
    if words == "all rights reserved":
        assert [x[:2] for x in sorted(searcher.find("all rights reservd all rights reserved"))] == [(0, 18), (19, 38)]
