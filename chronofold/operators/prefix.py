"""Sigma clipping by prefix moments: all passes in one stage.

Counted values (keys, v, copies) are dealt by key and sorted by value. Over a key's distinct values run the sums of copies, of
values and of squares; what lies within two bounds is then a difference of two running sums, and a pass is two binary
searches. A task goes through its sorted rows once, a run of keys at a time, all of a run's keys together.

A key with more distinct values than a task should hold is only named by that stage, and cut into ranges of neighbouring values
instead, each with its totals. A pass adds the totals of the ranges that lie within the bounds and looks into the two at most
that the bounds cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from chronofold.spec import StackSpec

#: Distinct values that a key may have to be held by one task, rows whose keys are clipped together, values of a range.
HELD_VALUES, RUN, RANGE = 1 << 20, 1 << 18, 4096


def by_key(left: DataFrame, right: DataFrame, keys: tuple[str, ...] | list[str], how: str = "inner") -> DataFrame:
    """left joined to right on the keys, null keys being equal to each other, as they are one group."""
    same, names = F.lit(True), {k: f"{k} of the right" for k in keys}
    for k, other in names.items():
        same = same & F.col(k).eqNullSafe(F.col(f"`{other}`"))
    return left.join(right.withColumnsRenamed(names), same, how).drop(*names.values())


def bounds_of(n: np.ndarray, s: np.ndarray, q: np.ndarray, spec: StackSpec) -> tuple[np.ndarray, np.ndarray]:
    """(lo, hi) as sigma.bounds has them."""
    total = s.astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.rint(total / n)
        sigma = np.sqrt((q.astype(float) - total * total / n) / np.where(n > 1, n - 1, 0))
        lo, hi = np.ceil(mean - sigma * spec.rej_low), np.floor(mean + sigma * spec.rej_high)
    lo, hi = (np.where((n > 1) & np.isfinite(x), x, 0).clip(0, float(1 << 62)).astype(np.int64) for x in (lo, hi))
    return (lo, hi) if spec.top is None else (np.minimum(lo, spec.top), np.minimum(hi, spec.top))


def first_not_below(v: np.ndarray, start: np.ndarray, stop: np.ndarray, x: np.ndarray, above: bool) -> np.ndarray:
    """For each part v[start:stop], sorted, the place of its first value that is x or more (over x, where ``above``)."""
    lo, hi = start.copy(), stop.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        at = v[np.minimum(mid, len(v) - 1)]
        below = open_ & ((at <= x) if above else (at < x))
        lo, hi = np.where(below, mid + 1, lo), np.where(open_ & ~below, mid, hi)
    return lo


def clipped(v: np.ndarray, copies: np.ndarray, start: np.ndarray, spec: StackSpec) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """([n, s, q] clipped, [n, s, q] of all, counts after each pass) of the keys whose values begin at ``start``."""
    stop = np.append(start[1:], len(v))
    whole = copies * v.astype(float) ** 2
    if len(v) and (np.abs(v).max() > 3_037_000_499 or np.add.reduceat(whole, start).max() > 9.2e18):
        raise OverflowError("sums of squares are beyond 64 bits: set wide in the spec")
    # running sums may wrap around: their differences do not, as every key's sums fit
    running = [np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (copies, copies * v, copies * v * v)]
    full = [x[stop] - x[start] for x in running]
    now, counts = full, []
    for _ in range(spec.max_iter):
        lo, hi = bounds_of(*now, spec)
        a = first_not_below(v, start, stop, lo, False)
        b = np.maximum(a, first_not_below(v, start, stop, hi, True))
        none = running[0][b] == running[0][a]
        now = [np.where(none, f, x[b] - x[a]) for f, x in zip(full, running, strict=True)]
        counts.append(now[0])
    return now, full, np.stack(counts, axis=1)


def _same(column: pa.Array) -> np.ndarray:
    """Whether each value but the first equals the one before it; nulls do, and values that are not numbers."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    equal = pc.fill_null(pc.equal(a, b), False)
    equal = pc.or_(equal, pc.and_(a.is_null(), b.is_null()))
    if pa.types.is_floating(column.type):
        equal = pc.or_(equal, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
    return equal.to_numpy(zero_copy_only=False)


def by_prefix(counts: DataFrame, spec: StackSpec) -> DataFrame:
    """counts(keys, v, copies) -> (keys, n, s, q, fn, fs, fq, most, passes array<long>, large): clipped sums, full sums, the greatest
    value, the count after each pass. A key of over HELD_VALUES distinct values is large, and nothing else is said of it."""
    keys = list(spec.keys)
    plain = [f"k{i}" for i in range(len(keys))]
    sums = ["n", "s", "q", "fn", "fs", "fq", "most"]
    schema = StructType([StructField(k, counts.schema[name].dataType) for k, name in zip(plain, keys, strict=True)] + [StructField(x, LongType()) for x in sums])
    schema = schema.add("passes", ArrayType(LongType())).add("large", BooleanType())
    limit, run_rows = HELD_VALUES, RUN

    def same_key(rows: pa.RecordBatch) -> np.ndarray:
        return np.logical_and.reduce([_same(rows.column(i)) for i in range(len(keys))]) if keys else np.ones(rows.num_rows - 1, bool)

    def end_of_first(rows: pa.RecordBatch) -> int:
        ends = np.flatnonzero(~same_key(rows))
        return int(ends[0]) + 1 if len(ends) else rows.num_rows

    def told(rows: pa.RecordBatch) -> pa.RecordBatch:
        n = rows.num_rows
        start = np.concatenate([[0], np.flatnonzero(~same_key(rows)) + 1]).astype(np.int64)
        v, copies = (rows.column(len(keys) + j).to_numpy() for j in range(2))
        now, full, passes = clipped(v, copies, start, spec)
        most = v[np.append(start[1:], n) - 1]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, passes.size + 1, passes.shape[1]), pa.int32()), pa.array(passes.reshape(-1)))
        named = [rows.column(i).take(pa.array(start)) for i in range(len(keys))]
        return pa.RecordBatch.from_arrays([*named, *map(pa.array, (*now, *full, most)), lists, pa.array(np.zeros(len(start), bool))], names=schema.names)

    def large(row: pa.RecordBatch) -> pa.RecordBatch:
        nothing = [*(pa.nulls(1, pa.int64()) for _ in sums), pa.nulls(1, pa.list_(pa.int64())), pa.array([True])]
        return pa.RecordBatch.from_arrays([*(row.column(i) for i in range(len(keys))), *nothing], names=schema.names)

    def whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, gone = [], 0, None  # gone: a row of the large key whose rows go by
        for batch in batches:
            if gone is not None and batch.num_rows:
                batch = batch.slice(end_of_first(whole([gone, batch])) - 1)
                gone = None if batch.num_rows else gone
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < run_rows:
                continue
            rows = whole(held)
            cuts = np.flatnonzero(~same_key(rows))
            if len(cuts):
                yield told(rows.slice(0, int(cuts[-1]) + 1))
                rows = rows.slice(int(cuts[-1]) + 1)  # the last key may go on
            if rows.num_rows > limit:
                yield large(rows.slice(0, 1))
                gone, rows = rows.slice(0, 1), rows.slice(0, 0)
            held, size = ([rows] if rows.num_rows else []), rows.num_rows
        if size:
            yield told(whole(held))

    rows = counts.select(*(F.col(k).alias(x) for k, x in zip(keys, plain, strict=True)), F.col("v").cast("long").alias("v"), F.col("copies").cast("long").alias("copies"))
    dealt = rows.repartition(*plain) if plain else rows.repartition(1)
    return dealt.sortWithinPartitions(*plain, "v").mapInArrow(run, schema).toDF(*keys, *schema.names[len(keys) :])


def ranges(counts: DataFrame, spec: StackSpec, cut) -> DataFrame:
    """(keys, least, most, n, s, q, members): neighbouring values of a key, some RANGE of them, with their totals. ``cut`` writes a
    table: places in a sorted order have to stand."""
    keys = list(spec.keys)
    ordered = counts.repartitionByRange(*keys, "v").sortWithinPartitions(*keys, "v").select(*keys, "v", "copies", F.monotonically_increasing_id().alias("place"))
    ordered = cut(ordered, "ordered")
    v, c = F.col("v"), F.col("copies")
    rows = ordered.groupBy(*keys, F.floor(F.col("place") / RANGE).alias("place")).agg(
        F.min("v").alias("least"), F.max("v").alias("most"), F.sum(c).alias("n"), F.sum(c * v).alias("s"), F.sum(c * v * v).alias("q"), F.collect_list(F.struct("v", "copies")).alias("members")
    )
    return cut(rows.drop("place"), "ranges")


def within(found: DataFrame, limits: DataFrame, spec: StackSpec) -> DataFrame:
    """ranges and (keys, lo, hi) -> (keys, n1, s1, q1): what lies within."""
    lo, hi = F.col("lo"), F.col("hi")
    inside, outside = (F.col("least") >= lo) & (F.col("most") <= hi), (F.col("most") < lo) | (F.col("least") > hi)

    def total(name: str, of) -> Column:
        cut = F.aggregate("members", F.lit(0).cast("long"), lambda a, m: a + F.when(m["v"].between(lo, hi), of(m)).otherwise(0))
        return F.sum(F.when(inside, F.col(name)).when(outside, 0).otherwise(cut)).alias(f"{name}1")

    rows = by_key(found, limits, spec.keys)
    return rows.groupBy(*spec.keys).agg(total("n", lambda m: m["copies"]), total("s", lambda m: m["copies"] * m["v"]), total("q", lambda m: m["copies"] * m["v"] * m["v"]))
