"""Best-fit decreasing packing of tokenised documents into sequences of a fixed length.

Which document goes where depends on lengths only, and there are at most ``capacity`` of them. So the tasks count pieces
by length, the driver places the counted lengths (longest first, each into the tightest open bin, found by descending a
segment tree over remaining capacities), and the tasks look up every piece's place by its rank among the pieces of its
length. The plan holds runs of pieces, not pieces: each length closes or splits only few ranges of alike bins, so its size
is bounded by a small multiple of the capacity, whatever the number of documents.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm import bpe
from chronofold.llm.common import partitions, slices, written

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class CapacityTree:
    """A segment tree over the remaining capacities 0..size: which of them has an open bin."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, at: int, count: int) -> None:
        at += self.leaves
        while at:
            self.open[at] += count
            at >>= 1

    def tightest(self, least: int) -> int:
        """The smallest capacity of at least ``least`` that has an open bin, or -1: up from the leaf, then down."""
        at = least + self.leaves
        if self.open[at]:
            return least
        while at > 1:
            if not at & 1 and self.open[at + 1]:
                at += 1
                break
            at >>= 1
        else:
            return -1
        while at < self.leaves:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counted lengths: runs (length, first rank, items a bin, first bin, offset).

    Items of one length are alike. After an item of length n the tightest bin is again the tightest for the next one as
    long as n fits in it, so bins are filled with as many items as they hold, range of alike bins by range.
    """
    tree, ranges, runs, bins = CapacityTree(capacity), defaultdict(deque), [], 0

    def put(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            ranges[remaining].append((first, n))
            tree.add(remaining, n)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room < 0:
                room, each = capacity, capacity // length
                first, n = bins, -(-left // each)
                bins += n
            else:
                first, n = ranges[room].popleft()
                tree.add(room, -n)
                each = room // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, each, first, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:  # one bin takes what is left
                runs.append((length, rank, each, first + full, capacity - room))
                put(room - left * length, first + full, 1)
                full, left = full + 1, 0
            put(room, first + full, n - full)
    return runs


def encoder(tokenizer_file: str, pattern: str) -> Callable[[str], bytes]:
    """A byte-level BPE tokenizer's file of the tokenizers library -> text to ids, as that library gives them without special
    tokens added: little-endian unsigned 32-bit integers. Added tokens that stand in a text are cut out of it first and get
    their own ids, as there. The merges run in tiktoken, which needs the ids to follow the merges' order; files for which
    this does not hold, or with added tokens of other kinds, are an error.
    """
    with open(tokenizer_file, encoding="utf-8") as lines:
        told = json.load(lines)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the bytes that stand for themselves; others follow from 256 on
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    added = {x["content"]: x["id"] for x in told["added_tokens"]}
    vocabulary = {token: i for token, i in told["model"]["vocab"].items() if token not in added}
    merges = [m if isinstance(m, str) else " ".join(m) for m in told["model"]["merges"]]
    if any(x[flag] for x in told["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")) or told["normalizer"] or told["model"]["type"] != "BPE" or [vocabulary[m.replace(" ", "")] for m in merges] != list(range(256, 256 + len(merges))):
        raise ValueError(f"{tokenizer_file}: not a plain byte-level BPE whose ids follow its merges")
    ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items()}
    encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    cut = re.compile(f"({'|'.join(map(re.escape, sorted(added, key=len, reverse=True)))})") if added else None

    def encode(text: str) -> bytes:
        if not any(a in text for a in added):
            return bpe.encode_bytes(encoding, text)
        parts = cut.split(text)  # every second one is an added token
        return b"".join(added[x].to_bytes(4, "little") if i % 2 else bpe.encode_bytes(encoding, x) for i, x in enumerate(parts))

    return encode


def pieces(docs: DataFrame, tokenizer_file: str, pattern: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Tokenises docs(doc_id, text), appends end_id and cuts longer documents; the first piece may be shorter.

    A null text counts as empty and gives the end id alone; rows repeat as often as in the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_file, pattern), np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                rows += [(doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, PIECES)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Places pieces(..., length): adds sequence_id and offset; no sequence holds over ``capacity`` tokens.

    The result's places are right for whichever of alike pieces gets them; ties go by doc_id and piece. Ranks within a
    length are counted in parts (part, length) and added up, so a length that a third of all rows have is no single task.
    """
    spark = cut.sparkSession
    parts = partitions(spark)
    part: Column = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int")
    cut = written(cut.withColumn("part", part), "pieces")
    counted = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = counted.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    before = written(before, "ranks")
    # at most `capacity` rows reach the driver
    counts = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = sorted(best_fit(counts, capacity))
    wide = 1 << 44  # ranks within a length stay below
    keys = np.array([length * wide + rank for length, rank, _, _, _ in runs], "i8")
    each, first, offset = (np.array([r[i] for r in runs], "i8") for i in (2, 3, 4))
    lengths, firsts = np.array([r[0] for r in runs], "i8"), np.array([r[1] for r in runs], "i8")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length * wide + rank, "right") - 1
            k = rank - firsts[at]
            columns = [*(batch.column(i) for i in range(5)), pa.array(first[at] + k // each[at]), pa.array(offset[at] + k % each[at] * lengths[at])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # both sides are dealt by (part, length) already; the ranks' table grows with the parts, so it is not to be broadcast
    own = F.row_number().over(Window.partitionBy("part", "length").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = cut.withColumn("own", own).join(before.drop("n").hint("merge"), ["part", "length"]).withColumn("rank", (F.col("before") + F.col("own") - 1).cast("long"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_file: str, pattern: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Tokenises, cuts and packs docs(doc_id, text) by a tokenizers file, see encoder(); a row for each piece.

    Null and empty texts are the end id alone, a null doc_id stays null, repeated rows are packed as often as they stand,
    very long texts are tokenised whole and cut, an empty table gives an empty result, other columns are not read. One narrow
    stage over the texts; only (id, piece, start, length, checksum) rows are shuffled.
    """
    return pack(pieces(docs, tokenizer_file, pattern, end_id, capacity), capacity)
