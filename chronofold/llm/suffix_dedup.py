"""Removal of every byte that lies in a ``length``-byte string which also starts anywhere else in the corpus.

1. Anchors. A place is an anchor if the hash of its SEED bytes is the least of some window of W places. Which places of a
   repeated string are anchors is decided inside it, but for W + SEED bytes at its ends, so every copy of a string has the
   same anchors at the same distances. Each string of ``length`` bytes belongs to the first anchor at least W after its
   start, and all strings of an anchor hold the bytes from W before it to length - 2 W + 1 after it: its core.
2. Classes. Strings can only be equal if their anchors' cores are. Hashes of the cores are counted over the corpus (combined
   before the shuffle); a core that stands once is done with. Of the others, anchors whose whole stretch (all bytes of all
   their strings) stands twice are repeated throughout. Left are the anchors at the ends of repeats.
3. Suffix array. The distinct stretches of a class that has such an end are written as symbols - the core one symbol, the
   bytes to its left and right ranked blocks of BLOCK bytes, counted from the core, so that equal strings have equal
   blocks - and sorted by linear grouping (suffix_array). The common prefixes of neighbouring suffixes, in bytes, cut the
   order into runs that share what a string needs; within a run the up to BLOCK - 1 bytes before the suffix decide.
4. Each text meets its repeated stretches, which are united and cut out.

The texts are shuffled twice (stretches, result) and the anchors three times as hashes; nothing else is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import mapped, partitions, private, slices, written
from chronofold.llm.suffix_array import suffix_array

LENGTH, SEED, BLOCK = 400, 16, 8
#: Bytes of a text that are searched for anchors at a time.
STEP = 1 << 18
#: Stretches whose suffixes are sorted together (a class is never split here), and those from which a class is refined.
BATCH, LARGE = 4_000, 500
#: Stretches of one refined class from which its strings are counted instead of sorted: no task ever holds more.
HUGE = 50_000
_LEAST = -(1 << 63)
_U, PRIME = np.uint64, (1 << 61) - 1


def window_of(length: int) -> int:
    """The widest window that leaves three of them and a seed in a string."""
    return min(96, (length + 2 - SEED) // 3)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME of numbers below it: 2^61 counts as 1."""
    a1, a0, b1, b0 = a >> _U(31), a & _U((1 << 31) - 1), b >> _U(31), b & _U((1 << 31) - 1)
    middle = a1 * b0 + a0 * b1
    return reduced(a1 * b1 * _U(2) + (middle >> _U(30)) + ((middle & _U((1 << 30) - 1)) << _U(31)) + a0 * b0)


def reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _U(PRIME)) + (x >> _U(61))
    return np.where(x >= _U(PRIME), x - _U(PRIME), x)


class Hasher:
    """Polynomial hashes of byte spans modulo the prime 2^61 - 1, to a fixed random base.

    The powers are split into their low 30 and high 31 bits, so that running sums of bytes times half a power stay exact in 64
    bits, and only what is asked for is reduced. Two spans of n bytes that differ share a hash for at most n bases in 2^61.
    """

    def __init__(self, most: int) -> None:
        base = 0x0B9D3C8E6F5A1742D
        self.up, self.down = self._powers(base % PRIME, most), self._powers(pow(base, -1, PRIME), most)
        self.low, self.high = self.up & _U((1 << 30) - 1), self.up >> _U(30)

    @staticmethod
    def _powers(base: int, most: int) -> np.ndarray:
        out = np.ones(1, _U)
        while len(out) <= most:
            out = np.concatenate([out, times(out, np.full(1, pow(base, len(out), PRIME), _U))])
        return out

    def sums(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        digits, zero = data.astype(_U) + _U(1), np.zeros(1, _U)
        return tuple(np.concatenate([zero, np.cumsum(digits * half[: len(data)])]) for half in (self.low, self.high))

    def parts(self, sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """What hashes() needs of each span: the sums' differences, and the start."""
        return np.stack([*(s[end] - s[start] for s in sums), start.astype(_U)])

    def hashes(self, parts: np.ndarray) -> np.ndarray:
        low, high, start = parts
        return times(reduced(times(high, np.full(1, 1 << 30, _U)) + low), self.down[start])

    def span(self, sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.hashes(self.parts(sums, start, end))


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the SEED bytes from each place on, from the two 8-byte words that they are; it only chooses anchors."""
    words, raw = np.empty(len(data) - 7, _U), data.tobytes()
    for k in range(8):
        words[k::8] = np.frombuffer(raw, "<u8", (len(data) - k) // 8, k)
    return mix(words[:-8] * _U(0x9E3779B97F4A7C15) + mix(words[8:]))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:  # noqa: ANN001
    """best(x[i], ..., x[i + width - 1]) for each i, by doubling."""
    n, span, now = len(x) - width + 1, 1, x
    while 2 * span <= width:
        now, span = best(now[:-span], now[span:]), 2 * span
    return best(now[:n], now[width - span : width - span + n]) if span < width else now[:n]


def anchor_records(data: bytes, length: int, hasher: Hasher) -> tuple[np.ndarray, ...] | None:
    """(anchor, least and greatest distance of a string's start before anchor - W, core, stretch), the last two as parts of hashes:
    those of many texts are finished together, by finished()."""
    n, w = len(data), window_of(length)
    if n < length:
        return None
    whole, out = np.frombuffer(data, np.uint8), []
    for base in range(0, n, STEP):
        lo = max(0, base - 4 * w)
        part = whole[lo : min(n, base + STEP + length + 4 * w)]
        if len(part) < SEED + w:
            continue
        sums, seeds = hasher.sums(part), seed_hashes(part)
        least = _sliding(seeds, w, np.minimum)
        edge = np.zeros(w - 1, _U)
        at = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), w, np.maximum) == seeds)
        before = np.concatenate([[-1 - lo], at[:-1]])
        first, last = np.maximum(before - w + 1, -lo), np.minimum(at - w, n - length - lo)
        kept = (last >= first) & (at + lo >= base) & (at + lo < base + STEP)
        at, first, last = at[kept], first[kept], last[kept]
        if not len(at):
            continue
        low, high = at - w - last, at - w - first
        out.append((at + lo, low, high, hasher.parts(sums, at - w, at + length - 2 * w + 1), hasher.parts(sums, first, last + length)))
    return tuple(np.concatenate(x, axis=-1) for x in zip(*out, strict=True)) if out else None


def finished(low: np.ndarray, high: np.ndarray, core: np.ndarray, stretch: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Core and stretch hashes of 64 bits."""
    return mix(hasher.hashes(core)), mix(hasher.hashes(stretch) * _U(0xD6E8FEB86659FD93) + (low * 65536 + high + 1).astype(_U))


def keyed(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with two columns and their names: rows of equal doc_id and text are told apart from all others, also where doc_id
    is null."""
    key, check = private(docs, "key", "check")
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.withColumns({key: F.coalesce(docs["doc_id"].cast("long"), F.lit(_LEAST)), check: F.xxhash64(docs["doc_id"].cast("long"), text)}), key, check


def _texts(docs: DataFrame) -> DataFrame:
    """(key, check, text) of docs, see keyed()."""
    rows, key, check = keyed(docs)
    return rows.select(F.col(key).alias("key"), F.col(check).alias("check"), F.coalesce("text", F.lit("")).alias("text"))


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    columns = "key long, check long, at long, low int, high int, core long, stretch long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(STEP + 2 * length + 2048)
        for batch in slices(batches, 2):
            out = []
            for key, check, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = anchor_records(text.encode("utf-8", "surrogatepass"), length, hasher)
                if found:
                    n = len(found[0])
                    out.append((np.full(n, key, "i8"), np.full(n, check, "i8"), *found))
            if out:
                key, check, at, low, high, core, stretch = (np.concatenate(x, axis=-1) for x in zip(*out, strict=True))
                core, stretch = finished(low, high, core, stretch, hasher)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, check, at.astype("i8"), low.astype("i4"), high.astype("i4"), core.view("i8"), stretch.view("i8"))], names=[c.split()[0] for c in columns.split(", ")])

    return _texts(docs).where(F.octet_length("text") >= length).mapInArrow(run, columns)


def repeated_starts(rows: list[tuple], core: int, length: int) -> np.ndarray:
    """rows (class, copies, low, left bytes, right bytes), distinct within a class: which strings stand in another row too.

    A string starts ``d`` bytes before its core, low <= d <= len(left). All cores have ``core`` bytes and are equal within a
    class. The result is true at (row, d) for strings that at least two rows of the class hold.
    """
    m = len(rows)
    n_left, n_right = (np.array([len(r[i]) for r in rows]) for i in (3, 4))
    low = np.array([r[2] for r in rows])
    across_left, across_right = int(n_left.max(initial=0)) // BLOCK + 1, -(-int(n_right.max(initial=0)) // BLOCK)
    left = np.frombuffer(b"".join(r[3].rjust(across_left * BLOCK, b"\0") for r in rows), ">u8").reshape(m, across_left)[:, ::-1].astype(_U)
    right = np.frombuffer(b"".join(r[4].ljust(across_right * BLOCK, b"\0") for r in rows), ">u8").reshape(m, across_right).astype(_U) if across_right else np.zeros((m, 0), _U)
    right_size = np.clip(n_right[:, None] - BLOCK * np.arange(across_right)[None, :], 0, BLOCK)
    full = n_left // BLOCK
    # ranks in byte order; 0 ends a row, a shorter last block stands before its continuations
    left_used, right_used = np.arange(across_left)[None, :] < full[:, None], right_size > 0
    values = np.concatenate([left[left_used], right[right_used]])
    sizes = np.concatenate([np.full(int(left_used.sum()), BLOCK), right_size[right_used]])
    order = np.lexsort((sizes, values))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(values[order]) != 0) | (np.diff(sizes[order]) != 0)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    left_rank, right_rank = np.zeros((m, across_left), np.int64), np.zeros((m, across_right), np.int64)
    left_rank[left_used], right_rank[right_used] = rank[: int(left_used.sum())], rank[int(left_used.sum()) :]
    classes = {}
    kind = np.array([classes.setdefault(r[0], len(classes)) for r in rows])
    core_rank = len(order) + 1 + kind
    # all rows one after the other: left blocks, core, right blocks, 0
    wide = np.concatenate([left_rank[:, ::-1], core_rank[:, None], right_rank, np.zeros((m, 1), np.int64)], axis=1)
    used = np.concatenate([left_used[:, ::-1], np.ones((m, 1), bool), right_used, np.ones((m, 1), bool)], axis=1)
    row, column = np.nonzero(used)
    sorted_ = np.array(suffix_array(wide[used].tolist()))
    row, block = row[sorted_], across_left - column[sorted_]  # the block that a suffix starts with: 0 the core, j the j-th to its left
    out = np.zeros((m, int(n_left.max(initial=0)) + 1), bool)
    for j in range(across_left):
        mine = row[block == j]
        if len(mine) < 2:
            continue
        a, b = mine[:-1], mine[1:]
        # bytes that neighbours share, from the block on; blocks left of the core, the core, blocks right of it
        same = np.zeros(len(a), np.int64)
        alive = kind[a] == kind[b]
        for t in range(j - 1, -1, -1):
            equal = left_rank[a, t] == left_rank[b, t]
            same += np.where(alive, np.where(equal, BLOCK, _common(left[a, t], left[b, t])), 0)
            alive &= equal
        same += np.where(alive, core, 0)
        for t in range(across_right):
            equal = (right_rank[a, t] == right_rank[b, t]) & (right_size[a, t] > 0)
            most = np.minimum(right_size[a, t], right_size[b, t])
            same += np.where(alive, np.where(equal, right_size[a, t], np.minimum(most, _common(right[a, t], right[b, t]))), 0)
            alive &= equal
        for r in range(BLOCK):
            d = BLOCK * j + r
            if d >= out.shape[1]:
                break
            run = np.concatenate([[0], np.cumsum(same < length - r)])
            there = (low[mine] <= d) & (d <= n_left[mine])
            run, rows_here = run[there], mine[there]
            before = left[rows_here, j] & _U((1 << 8 * r) - 1)
            order = np.lexsort((before, run))
            equal = (np.diff(run[order]) == 0) & (np.diff(before[order]) == 0)
            twice = np.zeros(len(order), bool)
            twice[1:] |= equal
            twice[:-1] |= equal
            out[rows_here[order[twice]], d] = True
    return out


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Leading bytes that two blocks share."""
    different, out = x ^ y, np.zeros(len(x), np.int64)
    for k in range(1, BLOCK + 1):
        out += different >> _U(64 - 8 * k) == 0
    return out


def _stretches(docs: DataFrame, ends: DataFrame, length: int) -> DataFrame:
    """The bytes around the cores of ends(key, check, at, low, high, core, copies, large).

    A large class is refined: for each block of BLOCK start distances the core grows to all bytes that these strings share.
    """
    w = window_of(length)
    columns = "class binary, core_bytes int, copies boolean, key long, check long, origin long, low int, left binary, right binary"
    by_doc = ends.groupBy("key", "check").agg(F.collect_list(F.struct("at", "low", "high", "core", "copies", "large")).alias("found"))
    # rows repeated in id and text are one before they are shuffled
    texts = _texts(docs).groupBy("key", "check").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            out = []
            for key, check, text, found in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for e in found:
                    at, low, high, name = e["at"] - w, e["low"], e["high"], e["core"].to_bytes(8, "little", signed=True)
                    end = at + length - w + 1
                    if not e["large"]:
                        out.append((name, length - w + 1, e["copies"], key, check, at, low, data[at - high : at], data[end : at - low + length]))
                        continue
                    for j in range(low // BLOCK, high // BLOCK + 1):
                        near, far = max(low, j * BLOCK), min(high, j * BLOCK + BLOCK - 1)
                        a, b = at - j * BLOCK, at - min(w - 1, j * BLOCK + BLOCK - 1) + length
                        core = hashlib.blake2b(data[a:b], digest_size=16, person=j.to_bytes(2, "little")).digest()
                        out.append((name + core, b - a, e["copies"], key, check, a, near - j * BLOCK, data[at - far : a], data[b : at - near + length]))
            kinds = [pa.binary(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            for at in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[at : at + 20_000], strict=True), kinds, strict=True)], names=[c.split()[0] for c in columns.split(", ")])

    return texts.join(by_doc, ["key", "check"]).select("key", "check", "text", "found").mapInArrow(run, columns)


def _sorted_ends(stretches: DataFrame, length: int) -> DataFrame:
    """(key, check, first, end) of the repeated bytes of stretches that stand once, by the suffix array of their classes."""
    columns = "key long, check long, first long, end long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            out, by_core = [], {}
            for r in held:
                by_core.setdefault(r[1], []).append(r)
            for core, rows in by_core.items():
                distinct: dict[tuple, list] = {}
                for r in rows:
                    distinct.setdefault((r[0], r[6], r[7], r[8]), []).append(r)
                found = repeated_starts([(k[0], None, k[1], k[2], k[3]) for k in distinct], core, length)
                for same, marks in zip(distinct.values(), found, strict=True):
                    if len(same) > 1:  # the same bytes stand elsewhere, so all of these strings do
                        marks = (np.arange(len(marks)) >= same[0][6]) & (np.arange(len(marks)) <= len(same[0][7]))
                    for r in same:
                        if r[2]:  # of a stretch that stands twice: known already
                            continue
                        edges = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
                        out += [(r[3], r[4], r[5] - int(b) + 1, r[5] - int(a) + length) for a, b in edges.reshape(-1, 2)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["key", "check", "first", "end"])

        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                if len(held) >= BATCH and r[0] != held[-1][0]:
                    yield from flush()
                    held = []
                held.append(r)
        if held:
            yield from flush()

    return stretches.repartition(2 * partitions(stretches.sparkSession), "class").sortWithinPartitions("class").mapInArrow(run, columns)


def _counted_ends(stretches: DataFrame, huge: DataFrame, length: int) -> DataFrame:
    """The same as _sorted_ends for classes of very many stretches: within a class, a string is told by the few bytes before
    and behind the core; equal ones are counted, combined before the shuffle, and found again by a join."""
    rows = stretches.join(huge, "class").withColumn("d", F.explode(F.sequence(F.col("low"), F.length("left"))))
    before = F.expr("substring(left, length(left) - d + 1, d)")
    behind = F.expr(f"substring(right, 1, {length} - core_bytes - d)")
    strings = rows.select("class", "d", before.alias("before"), behind.alias("behind"), "copies", "key", "check", (F.col("origin") - F.col("d")).alias("first"))
    told = ["class", "d", "before", "behind"]
    twice = written(strings.groupBy(*told).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "twice")
    return strings.where("NOT copies").join(twice, told).select("key", "check", "first", (F.col("first") + length).alias("end"))


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, check, spans array<struct<first, end>>): bytes to remove from each text that has any; see keyed().

    Rows repeated in id and text share a key and have equal spans, which count once.
    """
    anchors = _anchors(docs, length)
    cores = anchors.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.min("stretch").alias("a"), F.max("stretch").alias("b"))
    # both are written before they are joined: a join of two plain exchanges can be split where one core has very many rows
    several = written(cores.where("n > 1").select("core", (F.col("a") != F.col("b")).alias("several")), "cores")
    shared = written(anchors.join(several, "core"), "shared")
    copies = written(shared.groupBy("core", "stretch").agg(F.count(F.lit(1)).alias("n")), "copies")
    counted = written(shared.join(copies, ["core", "stretch"]), "counted")
    w = window_of(length)
    whole = counted.where("n > 1").select("key", "check", (F.col("at") - w - F.col("high")).alias("first"), (F.col("at") - w - F.col("low") + length).alias("end"))
    single = counted.where("n = 1 AND several")
    sizes = counted.where("several").groupBy("core", "stretch").agg(F.max("n").alias("n")).groupBy("core").agg(F.count(F.lit(1)).alias("distinct"), F.min("n").alias("least")).where("least = 1")
    classes = written(sizes.select("core", (F.col("distinct") > LARGE).alias("large")), "classes")
    kept = ["key", "check", "at", "low", "high"]
    others = counted.where("n > 1 AND several").groupBy("core", "stretch").agg(*(F.first(c).alias(c) for c in kept))
    ends = single.select("core", *kept, F.lit(False).alias("copies")).union(others.select("core", *kept, F.lit(True).alias("copies"))).join(classes, "core")
    stretches = written(_stretches(docs, ends, length), "stretches")
    huge = written(stretches.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HUGE).select("class"), "huge")
    if huge.isEmpty():
        found = whole.union(_sorted_ends(stretches, length))
    else:
        rest = stretches.join(huge, "class", "left_anti").select(*stretches.columns)
        found = whole.union(_sorted_ends(rest, length)).union(_counted_ends(stretches, huge, length))
    return written(found.groupBy("key", "check").agg(F.collect_set(F.struct("first", "end")).alias("spans")), "repeats")


def united(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the spans cover."""
    out: list[tuple[int, int]] = []
    for first, end in sorted((s["first"], s["end"]) for s in spans):
        if out and first <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((first, end))
    return out


def cut(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    ends = [0, *(end for _, end in runs)]
    return b"".join(data[a:b] for a, b in zip(ends, [*(first for first, _ in runs), len(data)], strict=True))


def _with_spans(docs: DataFrame, length: int) -> tuple[DataFrame, str]:
    """docs with a column of spans, and its name."""
    rows, key, check = keyed(docs)
    (spans,) = private(rows, "spans")
    found = repeats(docs, length).withColumnsRenamed({"key": key, "check": check, "spans": spans})
    return rows.join(found, [key, check], "left"), spans


def deduplicate(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs(doc_id, text) -> a digest of what is removed and kept, a row for each row.

    Null texts count as empty; texts under ``length`` bytes lose nothing. Matches never cross texts; a repeated row loses all
    that its copies make repeated, as any copy does. Null ids stay null, very long texts are searched whole, an empty table
    gives an empty result. Other columns are not read.
    """
    columns = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                runs = united(spans or [])
                rows.append((len(data), sum(b - a for a, b in runs), len(runs), hashlib.sha256(cut(data, runs)).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=[c.split()[0] for c in columns.split(", ")])

    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    rows, spans = _with_spans(docs, length)
    return rows.select("doc_id", "text", spans).mapInArrow(run, columns)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The same rows and columns, each text without its repeated bytes; characters that lose only some bytes go as a whole.

    Texts that lose nothing stay as they are, null ones null; ids may be null or repeat; an empty table gives an empty one;
    other columns are carried along, whatever their names.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            kept = []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                kept.append(text if not spans else cut(text.encode("utf-8", "surrogatepass"), united(spans)).decode("utf-8", "ignore"))
            columns = [pa.array(kept, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    rows, spans = _with_spans(docs, length)
    return mapped(rows.select(*(F.col(f"`{c}`") for c in docs.columns), spans), run, docs.schema)
