"""Document fingerprints from prefix polynomial hashes.

``PrefixHash`` keeps, for two bases modulo the prime 2^31 - 1, the running sums of code point times power. The hash of
any span is a difference of two of them, moved to power zero by an inverse power, so spans of any two texts compare in
constant time, and the longest common extension of two places is found by binary search.

A fingerprint is the hash of the whole text followed by a sketch: the hashes of all spans of SPAN code points, each with
the number of its occurrence (so repeats count), are dealt into SLOTS slots by their leading bits, and each slot keeps its
smallest. The share of slots in which two sketches agree estimates the Jaccard likeness J of the span multisets; the
likeness reported is 2J / (1 + J), the share of spans that they have in common.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import partitions, slices

PRIME = (1 << 31) - 1
BASES = (911382323, 972663749)
SPAN, SLOTS = 16, 64
_LEAST = -(1 << 63)


class Powers:
    """Powers of the bases and their inverses, longer whenever a longer text comes."""

    def __init__(self) -> None:
        self.up = [np.ones(1, np.uint64) for _ in BASES]
        self.down = [np.ones(1, np.uint64) for _ in BASES]

    def reach(self, n: int) -> None:
        p = np.uint64(PRIME)
        for at, base in enumerate(BASES):
            for kept, step in ((self.up, base), (self.down, pow(base, -1, PRIME))):
                while len(kept[at]) <= n:
                    kept[at] = np.concatenate([kept[at], kept[at] * np.uint64(pow(step, len(kept[at]), PRIME)) % p])


class PrefixHash:
    def __init__(self, text: str, powers: Powers) -> None:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        self.n, self.powers = len(points), powers
        powers.reach(self.n)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(points * up[: self.n] % np.uint64(PRIME))]) for up in powers.up]

    def spans(self, length: int) -> np.ndarray:
        """Hashes (62 bits) of all spans of a length, by start."""
        p, n = np.uint64(PRIME), self.n - length + 1
        one, two = ((s[length:] - s[:n]) % p * down[:n] % p for s, down in zip(self.sums, self.powers.down, strict=True))
        return one << np.uint64(31) | two

    def span(self, start: int, end: int) -> tuple[int, ...]:
        return tuple((int(s[end]) - int(s[start])) % PRIME * int(down[start]) % PRIME for s, down in zip(self.sums, self.powers.down, strict=True))

    def extension(self, at: int, other: PrefixHash, place: int) -> int:
        """Length of the longest common extension of self[at:] and other[place:], by binary search."""
        lo, hi = 0, min(self.n - at, other.n - place)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.span(at, at + mid) == other.span(place, place + mid):
                lo = mid
            else:
                hi = mid - 1
        return lo


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashed: PrefixHash, span: int = SPAN, slots: int = SLOTS) -> str:
    """16 hex digits of the whole text, then 4 for each slot; ffff: an empty slot."""
    one, two = hashed.span(0, hashed.n)
    head = f"{one << 31 | two:016x}"
    kept = np.full(slots, 0xFFFF, ">u2")
    if hashed.n:
        x = np.sort(mix(hashed.spans(min(span, hashed.n))))
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        if len(first) < len(x):  # the k-th occurrence of a span is a value of its own
            nth = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
            x = np.sort(np.where(nth > 0, mix(x + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), x))
        bits = slots.bit_length() - 1
        ends = np.arange(slots, dtype=np.uint64) << np.uint64(64 - bits)
        at = np.searchsorted(x, ends)
        there = np.flatnonzero(at < np.append(at[1:], len(x)))
        kept[there] = (x[at[there]] >> np.uint64(8) & np.uint64(0xFFFF)).astype(np.uint16) % 0xFFFF
    return head + kept.tobytes().hex()


def likeness(a: str, b: str) -> float:
    """0 to 1; equal fingerprints: 1."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f[16:]), ">u2") for f in (a, b))
    some = (x != 0xFFFF) | (y != 0xFFFF)
    n = int(some.sum())
    same = int((some & (x == y)).sum())
    return 2 * same / (n + same) if n else 0.0


def _buckets(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at least the key: 0 for the largest keys. Binary search in an array literal."""
    if not bounds:
        return F.lit(0)
    array, n = F.array(*(F.lit(b).cast("long") for b in bounds)), len(bounds)
    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))

    def halve(found: Column, _: Column) -> Column:
        mid = F.shiftright(found["lo"] + found["hi"], 1)
        done, below = found["lo"] >= found["hi"], F.get(array, F.least(mid, F.lit(n - 1))) < key
        return F.struct(F.when(done | ~below, found["lo"]).otherwise(mid + 1).alias("lo"), F.when(done | below, found["hi"]).otherwise(mid).alias("hi"))

    return F.lit(n) - F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length() + 1)), start, halve, lambda found: found["lo"])


def with_next(docs: DataFrame, per_row) -> DataFrame:  # noqa: ANN001
    """docs(doc_id, text) in descending doc_id, each row with the next one's text; the last row's next is the first.

    The ids are cut into ranges, a range is sorted within a task, and the first row of each range is sent to the range
    before it as well: one shuffle of the texts, no global order in one task. Rows of equal doc_id go by a hash of their
    text, null ids come last; an id that takes up several ranges is cut by these hashes, so it is no single task either.
    per_row(batches) gets batches (halo, doc_id, text), range by range in order, rows marked halo ending a range: the first
    of them is the next of the row before.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text")).withColumns({"key": F.coalesce("doc_id", F.lit(_LEAST)), "h": F.xxhash64("text")})
    shares = [i / n for i in range(1, n)]
    found = keyed.agg(F.percentile_approx("key", shares, 20 * n).alias("q")).first()["q"] if shares else None
    times = Counter(found or ())
    # a bucket is (bounds that are at least the key, part of a frequent key by hash, then its smaller keys): in the order's order
    hot = F.create_map(*(x for key, m in times.items() if m > 1 for x in (F.lit(key).cast("long"), F.lit(m)))) if any(m > 1 for m in times.values()) else None
    width = 2 * n + 2
    part = F.lit(width - 1)
    if hot is not None:
        of = F.try_element_at(hot, F.col("key"))
        part = F.when(of.isNotNull(), F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * of).cast("int")).otherwise(part)
    keyed = keyed.withColumn("bucket", (_buckets(F.col("key"), sorted(times)) * width + part).cast("int"))
    first = F.max(F.struct("key", (-1 - F.col("h")).alias("h"))).alias("head")  # -1 - h: the smallest hash, without overflow
    heads = [(r["bucket"], r["head"]["key"], -1 - r["head"]["h"]) for r in keyed.groupBy("bucket").agg(first).orderBy("bucket").collect()]  # at most 3 n rows
    before = [(key, h, (i or len(heads)) - 1) for i, (_, key, h) in enumerate(heads)]
    halos = spark.createDataFrame(before, "key long, h long, before int")
    places = spark.createDataFrame([(b, i) for i, (b, _, _) in enumerate(heads)], "bucket int, at int")
    told = keyed.join(F.broadcast(halos), ["key", "h"], "left").join(F.broadcast(places), "bucket").drop("bucket").withColumnRenamed("at", "bucket")
    own, halo = (F.struct(F.col(c).alias("b"), F.lit(i).alias("halo")) for i, c in enumerate(("bucket", "before")))
    spread = told.select("doc_id", "text", "key", "h", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, halo))).alias("at"))
    dealt = spread.select(F.col("at.halo").alias("halo"), "doc_id", "text", F.col("at.b").alias("bucket"), "key", "h").repartitionById(max(1, len(heads)), F.col("bucket"))
    return dealt.sortWithinPartitions("bucket", "halo", F.desc("key"), "h", "text").select("halo", "doc_id", "text").mapInArrow(*per_row)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """A fingerprint of every whole text and of its edited text: the last third replaced by the next document's beginning.

    Null texts count as empty; the fingerprint of an empty text has no spans, its likeness to any other text is 0 and to an
    empty one 1. Null ids come last; rows of equal id go by a hash of their text, repeated rows are each other's next. With
    one row, it is its own next; an empty table gives an empty result. Very long texts are hashed whole; other columns are not
    read. extension is the longest common extension of the text and the edited text from their beginnings.
    """
    columns = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, extension long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held = Powers(), None
        for batch in slices(batches, 2):
            rows = []
            for halo, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                hashed = PrefixHash(text, powers)
                print_ = fingerprint(hashed)
                if held is not None:
                    own_id, own, own_hashed, own_print = held
                    k = len(own) // 3
                    edited = own[: len(own) - k] + text[:k]
                    edited_hashed = PrefixHash(edited, powers)
                    edited_print = fingerprint(edited_hashed)
                    rows.append((own_id, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own_print, edited_print, likeness(own_print, edited_print), likeness(own_print, print_), own_hashed.extension(0, edited_hashed, 0)))
                held = None if halo else (doc_id, text, hashed, print_)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int64()), strict=True)], names=[c.split()[0] for c in columns.split(", ")])

    return with_next(docs, (run, columns))
