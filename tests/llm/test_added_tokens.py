"""Ids of packed texts are those of the tokenizers library, also where its added token stands in a text."""

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from chronofold.llm import packing

END = "<|endoftext|>"


@pytest.fixture(scope="module")
def both():
    library, encode = Tokenizer.from_file(P.path("byte_bpe_50k.json")), packing.encoder(P.path("byte_bpe_50k.json"), P.PATTERN)
    return lambda text: (np.frombuffer(encode(text), "<u4").tolist(), library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", [END, f"{END} hi", f"hi {END}", f"end {END} hi", f"{END}{END}", f"a{END}{END}  b\n{END}\n", f" {END} ", f"<|{END}|>", "<|endoftext", "<|endoftext|", f"12{END}34 \u00e9{END}\U0001f600", " " * 9000 + END + " " * 9000 + "x"])
def test_added_token(both, text):
    got, wanted = both(text)
    assert got == wanted


def test_random_texts(both):
    r = np.random.default_rng(3)
    parts = [END, " ", "  ", "\n", "a", "Bc", "7", "'s", "<|", "|>", "endoftext", "\u4e2d", "\U0001f600", "\u00a0", "\u0301", "word ", "."]
    for _ in range(800):
        got, wanted = both("".join(r.choice(parts, r.integers(0, 40))))
        assert got == wanted


def test_other_files_are_refused():
    with pytest.raises((ValueError, KeyError)):
        packing.encoder(P.path("word_bpe_49k.json"), P.PATTERN)
