"""Scans along ordered series that many tasks share: numbering, running maxima, first values.

Rows are sorted by (keys, order) into ranges, written, and each range is scanned by itself. What a range has to know of earlier
ones it gets as a summary: only keys that go on over the border of a range are concerned, at most two a range, so the
summaries are few and bounded by the number of ranges. A series of any length, one that holds most rows as well, is
spread over as many tasks as its rows are worth.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions.names import private
from chronofold.operators.sigma import settled

#: Ranges for each shuffle partition.
RANGES = 4


@dataclass(frozen=True)
class Series:
    """Rows laid out in so many ranges: ``part`` and ``place`` name their range and their place in the order. Once ``dealt``, a
    range is a partition."""

    rows: DataFrame
    keys: tuple[str, ...]
    part: str
    place: str
    ranges: int
    dealt: bool = False

    @property
    def plain(self) -> DataFrame:
        return self.rows.drop(self.part, self.place)

    def where(self, condition: Column) -> Series:
        return replace(self, rows=self.rows.where(condition))

    def scanned(self, number: str | None = None, length: str | None = None, most: dict[str, Column] | None = None, first: dict[str, Column] | None = None) -> Series:
        """With further columns: a row's number in its series (from 0), the series' length, greatest values up to and with
        the row, and values of the series' first row."""
        rows, most, first = self.rows, dict(most or {}), dict(first or {})
        count, total, spans, *named = private(rows, "before", "total", "spans", *(f"most{i}" for i in range(len(most))), *(f"first{i}" for i in range(len(first))), *(f"key{i}" for i in range(len(self.keys))), "range")
        m, f, k, at = named[: len(most)], named[len(most) : len(most) + len(first)], named[len(most) + len(first) : -1], named[-1]
        summary = rows.groupBy(self.part, *self.keys).agg(
            F.count(F.lit(1)).alias(count), *(F.max(c).alias(x) for x, c in zip(m, most.values(), strict=True)), *(F.min_by(F.struct(c.alias("value")), self.place).alias(x) for x, c in zip(f, first.values(), strict=True))
        )
        series = Window.partitionBy(*self.keys)
        before = series.orderBy(self.part).rowsBetween(Window.unboundedPreceding, -1)
        whole = series.orderBy(self.part).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        carried = summary.select(
            F.col(self.part).alias(at), *(F.col(c).alias(x) for c, x in zip(self.keys, k, strict=True)),
            F.coalesce(F.sum(count).over(before), F.lit(0)).alias(count), F.sum(count).over(whole).alias(total), F.count(F.lit(1)).over(whole).alias(spans),
            *(F.max(x).over(before).alias(x) for x in m), *(F.first(x).over(whole).alias(x) for x in f),
        )
        carried = carried.where(F.col(spans) > 1).drop(spans)  # at most two rows a range
        own = Window.partitionBy(self.part, *self.keys)
        so_far = own.orderBy(self.place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = [*((number and [F.row_number().over(own.orderBy(self.place)).cast("bigint").alias(number)]) or []), *((length and [F.count(F.lit(1)).over(own).alias(length)]) or [])]
        local += [F.max(c).over(so_far).alias(name) for name, c in most.items()]
        local += [F.first(F.struct(c.alias("value"))).over(own.orderBy(self.place).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(name) for name, c in first.items()]
        same = F.col(self.part) == F.col(at)
        for c, x in zip(self.keys, k, strict=True):
            same = same & F.col(c).eqNullSafe(F.col(x))
        # windows take this partitioning as it is, so ranges are never mixed by a hash
        dealt = rows if self.dealt else rows.repartitionById(self.ranges, F.col(self.part))
        found = dealt.select("*", *local).join(F.broadcast(carried), same, "left")
        told = []
        if number:
            told.append((F.col(number) - 1 + F.coalesce(F.col(count), F.lit(0))).alias(number))
        if length:
            told.append(F.coalesce(F.col(total), F.col(length)).alias(length))
        told += [F.greatest(F.col(name), F.col(x)).alias(name) for name, x in zip(most, m, strict=True)]
        told += [F.coalesce(F.col(x), F.col(name)).getField("value").alias(name) for name, x in zip(first, f, strict=True)]
        return replace(self, rows=found.select(*rows.columns, *told), dealt=True)


def laid_out(rows: DataFrame, keys: tuple[str, ...], order: list[str]) -> Series:
    """rows sorted into ranges by (keys, order), written: RANGES for each shuffle partition. Nulls come first, rows of equal order
    stay together in any order of their own."""
    part, place = private(rows, "part", "place")
    ranges = RANGES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(ranges, *keys, *order).sortWithinPartitions(*keys, *order)
    return Series(settled(dealt.select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().alias(place)), "series"), tuple(keys), part, place, ranges)


def numbered(rows: DataFrame, keys: tuple[str, ...], order: list[str], number: str = "i", length: str | None = None) -> DataFrame:
    """rows with their numbers in their series, and the series' length if asked for, as stack.with_frames has them, whatever share
    of the rows a series holds."""
    return laid_out(rows, keys, order).scanned(number, length).plain


def running_max(px: DataFrame, keys: tuple[str, ...], order: list[str], value: str = "v") -> DataFrame:
    """The maximum of ``value`` up to each row, in its place."""
    found = laid_out(px, keys, order)
    (most,) = private(found.rows, "most")
    rest = [c for c in px.columns if c != value]
    return found.scanned(most={most: F.col(value)}).plain.select(*rest, F.col(most).alias(value))


def before_first(found: Series, bad: Column) -> Series:
    """Rows of each series before its first bad one; a null is no bad one."""
    (kept,) = private(found.rows, "bad")
    marked = found.scanned(most={kept: F.coalesce(bad, F.lit(False)).cast("int")}).where(F.col(kept) == 0)
    return replace(marked, rows=marked.rows.drop(kept))


def stop_on_failed(frames: DataFrame, valid: Column, keys: tuple[str, ...] = ("series",), order: tuple[str, ...] = ("i",)) -> DataFrame:
    """frames.stop_on_failed for series of any length."""
    return before_first(laid_out(frames, keys, list(order)), ~valid).plain


def prefix_of_first_shape(frames: DataFrame, shape: Column, keys: tuple[str, ...] = ("series",), order: tuple[str, ...] = ("i",)) -> DataFrame:
    """frames.prefix_of_first_shape for series of any length."""
    found = laid_out(frames, keys, list(order))
    (first,) = private(found.rows, "first")
    told = before_first(found.scanned(first={first: shape}), ~shape.eqNullSafe(F.col(first)))
    return told.plain.drop(first)
