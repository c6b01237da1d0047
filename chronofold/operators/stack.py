"""Maximum, minimum, mean and fused stacks: one grouped aggregate each, combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions.expressions import fade_weight, int_weight, rescaled, rounded_mean, variance
from chronofold.operators.prefix import by_key
from chronofold.spec import StackSpec, scale_between


def with_frames(px: DataFrame, keys: tuple[str, ...], order: list[str]) -> DataFrame:
    """Adds i, the frame's place in its series, and n, the series' length."""
    series = Window.partitionBy(*keys)
    return px.withColumn("i", F.row_number().over(series.orderBy(*order)).cast("bigint") - 1).withColumn("n", F.count(F.lit(1)).over(series))


def square(v: Column, wide: bool) -> Column:
    """v squared, in a type whose sums hold 32-bit data where ``wide``."""
    return (v.cast("decimal(19,0)") * v.cast("decimal(19,0)")).cast("decimal(38,0)") if wide else v * v


def moments(px: DataFrame, keys: tuple[str, ...], wide: bool = False) -> DataFrame:
    """(keys, n, s, q): count, sum and sum of squares as whole numbers, so that any order of adding gives the same."""
    v = F.col("v")
    return px.groupBy(*keys).agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(square(v, wide)).alias("q"))


def finished(stats: DataFrame, keys: tuple[str, ...], precise: bool = False) -> DataFrame:
    """(keys, n, mu, var); the mean is half-even rounded unless ``precise``."""
    n, s = F.col("n"), F.col("s")
    mean = s / n if precise else rounded_mean(s, n).cast("bigint")
    return stats.select(*keys, "n", mean.alias("mu"), variance(n, s, F.col("q")).alias("var"))


def max_stack(px: DataFrame, spec: StackSpec) -> DataFrame:
    """(keys, v): the greatest value, of faded values if asked for; faded values are floored at the end.

    With integer weights the products are whole numbers and are divided back after the maximum. Without fades there is no
    weight in the plan at all.
    """
    v = F.col("v")
    if not spec.faded:
        out = px.groupBy(*spec.keys).agg(F.max(v).alias("v"))
    else:
        w = fade_weight(F.col("i"), F.col("n"), spec.fade_in, spec.fade_out)
        if spec.int_weight:
            bits = spec.in_bits or 8
            most = F.max(v * int_weight(w, bits))
            out = px.groupBy(*spec.keys).agg(F.floor(most / scale_between(bits, 2 * bits)).cast("bigint").alias("v"))
        else:
            out = px.groupBy(*spec.keys).agg(F.floor(F.max(v * w)).cast("bigint").alias("v"))
    return scaled(out, spec)


def min_stack(px: DataFrame, spec: StackSpec) -> DataFrame:
    v = F.col("v")
    value = v if not spec.faded else v * fade_weight(F.col("i"), F.col("n"), spec.fade_in, spec.fade_out)
    return scaled(px.groupBy(*spec.keys).agg(F.floor(F.min(value)).cast("bigint").alias("v")), spec)


def mean_stack(px: DataFrame, spec: StackSpec) -> DataFrame:
    return scaled_mean(finished(moments(px, spec.keys, spec.wide), spec.keys, spec.precise), spec)


def scaled_mean(out: DataFrame, spec: StackSpec) -> DataFrame:
    """Mean and variance at the depth asked for; the variance goes by the square and keeps its precision."""
    if not (spec.in_bits and spec.out_bits) or spec.in_bits == spec.out_bits:
        return out
    up = spec.out_bits > spec.in_bits
    scale = scale_between(min(spec.in_bits, spec.out_bits), max(spec.in_bits, spec.out_bits))
    mean = F.col("mu") * scale if up else F.col("mu") / scale
    mean = mean if spec.precise else F.floor(mean).cast("bigint")
    square_of = F.lit(float(scale * scale))
    return out.withColumn("mu", mean).withColumn("var", F.col("var") * square_of if up else F.col("var") / square_of)


def fused_stack(px: DataFrame, keys: tuple[str, ...], wide: bool = False) -> DataFrame:
    """Maximum, minimum and moments in one pass over the frames."""
    v = F.col("v")
    stats = px.groupBy(*keys).agg(F.max(v).alias("most"), F.min(v).alias("least"), F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(square(v, wide)).alias("q"))
    n, s = F.col("n"), F.col("s")
    return stats.select(*keys, "most", "least", "n", rounded_mean(s, n).cast("bigint").alias("mu"), variance(n, s, F.col("q")).alias("var"))


def max_stack_by_table(px: DataFrame, weights: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The faded maximum with weights(n, i, w) as a table: for series of every length n, a weight for each frame."""
    return px.join(weights, ["n", "i"]).groupBy(*keys).agg(F.floor(F.max(F.col("v") * F.col("w"))).cast("bigint").alias("v"))


def weight_table(frames: DataFrame, fade_in: float, fade_out: float) -> DataFrame:
    """(n, i, w) for the lengths that series of frames(n) have: as many rows as their distinct lengths add up to."""
    rows = frames.select("n").distinct().select("n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("i"))
    return rows.select("n", "i", fade_weight(F.col("i"), F.col("n"), fade_in, fade_out).alias("w"))


def scaled(out: DataFrame, spec: StackSpec) -> DataFrame:
    """Values at the depth asked for."""
    if spec.in_bits and spec.out_bits and spec.in_bits != spec.out_bits:
        return out.withColumn("v", rescaled(F.col("v"), spec.in_bits, spec.out_bits))
    return out


def union_moments(parts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Accumulators of parts of the frames, added up."""
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))


def subtract_moments(full: DataFrame, part: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Accumulators of the frames that are in ``full`` but not in ``part``."""
    other = part.select(*keys, *(F.col(c).alias(f"{c}2") for c in "nsq"))
    return full.join(other, list(keys), "left").select(*keys, *((F.col(c) - F.coalesce(F.col(f"{c}2"), F.lit(0))).alias(c) for c in "nsq"))


def merge_mean_variance(parts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(n, mean, population variance) of parts, merged around their common mean: variances small beside the mean keep their
    digits. Parts meet twice, frames never."""
    n, mean, var, of_all = F.col("n"), F.col("mean"), F.col("var"), F.col("mean of all")
    means = parts.groupBy(*keys).agg((F.sum(n * mean) / F.sum("n")).alias("mean of all"))
    around = by_key(parts, means, keys)
    total = around.groupBy(*keys).agg(F.sum("n").alias("n"), F.first("mean of all").alias("centre"), F.sum(n * (mean - of_all)).alias("off"), F.sum(n * (var + (mean - of_all) * (mean - of_all))).alias("spread"))
    off = F.col("off") / F.col("n")  # what rounding has left of the centre
    return total.select(*keys, "n", (F.col("centre") + off).alias("mean"), (F.col("spread") / F.col("n") - off * off).alias("var"))


def subtract_mean_variance(full: DataFrame, part: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(n, mean, population variance) of the frames that are in ``full`` but not in ``part``, by the distance of the means; keys
    that would have none left keep none: n 0, nulls."""
    other = part.select(*keys, *(F.col(c).alias(f"{c}2") for c in ("n", "mean", "var")))
    n, mean, var = F.col("n"), F.col("mean"), F.col("var")
    n2, mean2, var2 = F.coalesce(F.col("n2"), F.lit(0)), F.coalesce(F.col("mean2"), mean), F.coalesce(F.col("var2"), F.lit(0.0))
    some = F.nullif(n - n2, F.lit(0).cast("bigint"))
    apart = mean - mean2
    spread = n * var - n2 * var2 - apart * apart * (n * n2 / some)
    return by_key(full, other, keys, "left").select(*keys, (n - n2).alias("n"), F.when(some.isNotNull(), mean + apart * (n2 / some)).alias("mean"), F.when(some.isNotNull(), F.greatest(F.lit(0.0), spread / some)).alias("var"))


def ordered_cube(px: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, vs): each key's values in frame order. For bounded series such as the frames of an image sequence."""
    pairs = F.array_sort(F.collect_list(F.struct("i", "v")))
    return px.groupBy(*keys).agg(F.transform(pairs, lambda p: p["v"]).alias("vs"))


def running_max(px: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The maximum stack after each frame."""
    so_far = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return px.select(*keys, "i", F.max("v").over(so_far).alias("v"))


def block_mean(px: DataFrame, size: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Means over blocks of size x size places; the whole-number case of scaling down."""
    return px.groupBy(*keys, F.floor(F.col("y") / size).cast("bigint").alias("y"), F.floor(F.col("x") / size).cast("bigint").alias("x")).agg(rounded_mean(F.sum("v"), F.count("v")).cast("bigint").alias("v"))
