"""Mask mix: sky from the corrected maximum, ground from the clipped mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.functions.expressions import expected_max, rounded_mean, variance
from chronofold.operators.sigma import clip
from chronofold.operators.stack import max_stack, moments, scaled
from chronofold.spec import StackSpec


def normalised_mask(mask: Column, bits: int | None, most: Column | None = None) -> Column:
    """0..1: by the depth's largest value, or by the mask's own."""
    return mask / (F.lit(float((1 << bits) - 1)) if bits else most)


def mixed(parts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """parts(keys, most, mu, var, frames, m) -> (keys, v): the excess that noise adds to a maximum is taken off it.

    Where the maximum is smaller than that excess, nothing is taken off.
    """
    excess = expected_max(F.col("frames")) * F.sqrt(F.col("var"))
    off = F.when(F.col("most") < excess, F.lit(0.0)).otherwise(F.coalesce(excess, F.lit(0.0)))
    m = F.col("m")
    return parts.select(*keys, F.floor((F.col("most") - off) * m + (1 - m) * F.col("mu")).cast("bigint").alias("v"))


def mask_mix(px: DataFrame, mask: DataFrame, spec: StackSpec, clipped: bool = True, n_total: int | None = None) -> DataFrame:
    """mask(keys, m) with m from 0 (ground) to 1 (sky). Without fades the frames are read once: clipping tells the maximum
    too. Joins are on the keys."""
    keys = list(spec.keys)
    if clipped:
        stats = clip(px, spec)
    else:
        stats = moments(px, spec.keys, spec.wide).withColumn("fn", F.col("n"))
    if not clipped or spec.faded:
        most = max_stack(px, StackSpec("max", spec.keys, spec.fade_in, spec.fade_out, spec.int_weight, in_bits=spec.in_bits)).withColumnsRenamed({"v": "most"})
        stats = stats.drop("most").join(most, keys)
    return mix_stats(stats, mask, spec, n_total)


def mix_stats(stats: DataFrame, mask: DataFrame, spec: StackSpec, n_total: int | None = None) -> DataFrame:
    """stats(keys, n, s, q, fn, most), clipped sums, the number of frames and the maximum, with mask(keys, m) -> (keys, v)."""
    n, s = F.col("n"), F.col("s")
    frames = (F.lit(n_total) if n_total else F.col("fn")).cast("bigint").alias("frames")
    parts = stats.select(*spec.keys, "most", rounded_mean(s, n).alias("mu"), variance(n, s, F.col("q")).alias("var"), frames)
    return scaled(mixed(parts.join(mask, list(spec.keys)), spec.keys), spec)
