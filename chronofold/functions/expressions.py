"""Column expressions of the stacking model; all divisions in doubles, all of them inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronofold.spec import scale_between


def hundredths(amount: Column) -> Column:
    """A two-decimal amount as a whole number of hundredths."""
    return F.rint(amount * 100).cast("bigint")


def unit_byte(x: Column) -> Column:
    """-1..1 to 0..255."""
    return F.rint((x.cast("double") + 1) * 127.5).cast("bigint")


def fade_weight(i: Column, n: Column, fade_in: float, fade_out: float) -> Column:
    """Weight of frame i of n: rising from 0.01 over the first share, falling to 0.01 over the last, else 1."""
    a, b = F.floor(n * fade_in), F.floor(n * fade_out)
    rising = (1 + i * (F.lit(99.0) / F.nullif(a, F.lit(0).cast("bigint")))) / 100
    falling = (1 + (n - 1 - i) * (F.lit(99.0) / F.nullif(b, F.lit(0).cast("bigint")))) / 100
    return F.when(i < a, rising).when(i >= n - b, falling).otherwise(F.lit(1.0))


def int_weight(weight: Column, in_bits: int = 8) -> Column:
    """The weight as a whole number of steps: 257 of them for 8-bit data, 65537 for 16-bit data."""
    return F.floor(weight * scale_between(in_bits, 2 * in_bits))


def rounded_mean(s: Column, n: Column) -> Column:
    """Half-even."""
    return F.rint(s / n)


def variance(n: Column, s: Column, q: Column, ddof: int = 1) -> Column:
    """From count, sum and sum of squares; NULL where there are too few values."""
    total = s.cast("double")
    return (q.cast("double") - total * total / n) / F.nullif(n - ddof, F.lit(0).cast("bigint"))


def rescaled(v: Column, in_bits: int, out_bits: int) -> Column:
    """Full range to full range between depths; going down floors."""
    if out_bits > in_bits:
        return (v * scale_between(in_bits, out_bits)).cast("bigint")
    if out_bits < in_bits:
        return F.floor(v / scale_between(out_bits, in_bits)).cast("bigint")
    return v.cast("bigint")


def expected_max(n: Column) -> Column:
    """Expected maximum of n standard normal values (an empirical fit)."""
    small, large = F.pow(F.log(n), F.lit(0.91)) * 0.5 + 0.52, F.pow(F.log(n + 1), F.lit(0.84)) * 0.5 + 0.71
    return F.when(n < 80, small).otherwise(large)


def gray(red: Column, green: Column, blue: Column) -> Column:
    """Luma of the usual weights, rounded."""
    return F.rint(red * 0.299 + green * 0.587 + blue * 0.114).cast("bigint")


def long_edge_size(height: Column, width: Column, edge: int) -> tuple[Column, Column]:
    """(height, width) of an image whose long edge is brought to ``edge``; the other one floors. See spec.resize_plan."""
    e, tall = F.lit(edge).cast("bigint"), height >= width
    return F.when(tall, e).otherwise(F.floor(height * e / width)).cast("bigint"), F.when(tall, F.floor(width * e / height)).otherwise(e).cast("bigint")


def suffix_of(path: Column) -> Column:
    """The last dot part, lower-case."""
    return F.lower(F.element_at(F.split(path, r"\."), -1))


#: Suffixes of files that are taken (fixed values).
SUFFIXES = ("tif", "tiff", "png", "jpg", "jpeg", "bmp", "gif", "fits", "cr2", "cr3", "arw", "nef", "dng")
ALIASES = {"tiff": "tif", "jpeg": "jpg"}


def supported(path: Column) -> Column:
    return suffix_of(path).isin(*SUFFIXES)


def plain_suffix(path: Column) -> Column:
    suffix = suffix_of(path)
    for alias, name in ALIASES.items():
        suffix = F.when(suffix == alias, F.lit(name)).otherwise(suffix)
    return suffix


def color_space(profile: Column) -> Column:
    """First known name in a profile's text; none for an empty profile, 'unsupported' for an unknown one."""
    found = F.lit("unsupported")
    for name in ("sRGB", "ProPhoto RGB", "Adobe RGB"):
        found = F.when(F.contains(profile, F.lit(name)), F.lit(name)).otherwise(found)
    return F.when(F.coalesce(F.length(profile), F.lit(0)) > 0, found)
