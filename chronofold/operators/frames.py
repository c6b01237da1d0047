"""Bad frames: skipped and reported, or the end of their part of the sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions.names import private


def skip_failed(frames: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(good frames, errors(series, i, reason))."""
    return frames.where(valid), frames.where(~valid).select("series", "i", F.lit("not decodable").alias("reason"))


def with_parts(frames: DataFrame, parts: Column) -> DataFrame:
    """frames(i, n) with part, the contiguous part of its series (of ``parts``, nearly equal ones) that a frame falls into."""
    return frames.withColumn("part", F.floor(((F.col("i") + 1) * parts - 1) / F.col("n")).cast("bigint"))


def wanted_parts(n: Column, cores: int) -> Column:
    """About the root of the number of frames, and no more than the cores are good for; see spec.partition_plan."""
    return F.greatest(F.lit(1), F.least(F.floor(F.sqrt(n)), F.lit(cores // 4 + (1 if cores <= 8 else 0)))).cast("bigint")


def _before_first(bad: Column) -> Column:
    so_far = Window.partitionBy("series").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.max(bad.cast("int")).over(so_far) == 0


def _kept(frames: DataFrame, kept: Column) -> DataFrame:
    """Frames for which kept, a window's value, is true."""
    (name,) = private(frames, "kept")
    return frames.withColumn(name, kept).where(F.col(name)).drop(name)


def stop_on_failed(frames: DataFrame, valid: Column) -> DataFrame:
    """Frames of each series before its first bad one. For series that many tasks share, see series.stop_on_failed."""
    return _kept(frames, _before_first(~valid))


def _first(shape: Column) -> Column:
    return F.first(shape).over(Window.partitionBy("series").orderBy("i"))


def prefix_of_first_shape(frames: DataFrame, shape: Column) -> DataFrame:
    """Frames of each series before the first whose shape is not that of the series' first frame. For series that many tasks
    share, see series.prefix_of_first_shape."""
    (bad,) = private(frames, "bad")
    return _kept(frames.withColumn(bad, ~shape.eqNullSafe(_first(shape))), _before_first(F.col(bad))).drop(bad)


def of_first_shape(frames: DataFrame, shape: Column) -> DataFrame:
    """Only the frames of another shape are dropped, not those after them."""
    return _kept(frames, shape.eqNullSafe(_first(shape)))


def merged_by_shape(parts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """parts(keys, part, shape, first, n, s, q), accumulators of parts by shape -> (keys, shape, n, s, q): those of the shape
    that the series starts with (least ``first``), added up; the others are left out. Accumulators meet, never frames."""
    sums = parts.groupBy(*keys, "shape").agg(F.min("first").alias("first"), *(F.sum(c).alias(c) for c in "nsq"))
    kept = sums.groupBy(*keys).agg(F.min_by("shape", "first").alias("shape"))
    return sums.join(kept, [*keys, "shape"]).select(*keys, "shape", *"nsq")


def counters(frames: DataFrame, valid: Column) -> DataFrame:
    return frames.groupBy("series").agg(F.count_if(valid).alias("stacked"), F.count_if(~valid).alias("failed"))
