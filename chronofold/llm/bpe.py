"""Byte-level BPE with the tiktoken library and a local rank file.

Texts longer than PIECE_CHARS are cut before encoding, only where the splitting pattern always ends a match: between
a character that is no white space and white space (no alternative of the pattern holds white space after
anything else), or between an ASCII letter and an ASCII digit. What stands before such a place ends there in any case,
and no alternative looks back, so the pieces' ids, joined, are the whole text's. A run without such a place stays whole.
White-space runs of over RUN_CHARS characters are one match (but for their last character, if text follows) and go to
the merges directly, as the library's pattern engine gives up on them.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from chronofold.llm.common import slices

PIECE_CHARS = 1 << 16
RUN_CHARS = 4096
#: White space as the pattern's \s has it (fixed values of Unicode).
_SPACE = "\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_RUN = re.compile(f"[{_SPACE}]{{{RUN_CHARS},}}")
_SAFE = re.compile(r"(?<=\S)(?=\s)|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def load(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str) -> Iterator[str]:
    """The text in pieces of PIECE_CHARS characters or a little more, cut at safe boundaries."""
    at = 0
    while len(text) - at > PIECE_CHARS:
        found = _SAFE.search(text, at + PIECE_CHARS)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def encode_bytes(encoding: tiktoken.Encoding, text: str) -> bytes:
    """Ids of the whole text, without special tokens, as little-endian unsigned 32-bit integers."""
    core, out, at = encoding._core_bpe, [], 0

    def put(part: str) -> None:
        out.extend(core.encode_to_tiktoken_buffer(piece, set()) for piece in pieces(part) if piece)

    if len(text) >= RUN_CHARS:
        for run in _RUN.finditer(text):
            put(text[at : run.start()])
            at = run.end() if run.end() == len(text) else run.end() - 1
            out.append(np.array(core.encode_single_piece(text[run.start() : at].encode()), "<u4").tobytes())
    put(text[at:])
    return b"".join(out)


def encode_decode(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Per row of docs(doc_id, text): number of ids, SHA-256 of the ids and of the bytes that they decode to.

    Null texts count as empty: no ids, the hash of no bytes. Rows repeat as often as in the input; a null doc_id stays
    null; other columns are not read. One narrow stage: nothing is shuffled, each task loads the rank file once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load(rank_file, pattern)
        for batch in slices(batches):
            counts, hashes, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                ids = encode_bytes(encoding, text or "")
                counts.append(len(ids) // 4)
                hashes.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(encoding.decode_bytes(np.frombuffer(ids, "<u4").tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
