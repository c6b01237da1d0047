"""Attribute profiles of input files, exact exposure totals and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions.expressions import plain_suffix


def attributes(rows: DataFrame, fname: Column, **values: Column) -> DataFrame:
    """Long form (fname, attr, value) of some attributes."""
    pairs = F.array(*(F.struct(F.lit(name).alias("attr"), value.cast("string").alias("value")) for name, value in values.items()))
    return rows.select(fname.cast("string").alias("fname"), F.explode(pairs).alias("p")).select("fname", "p.attr", "p.value")


def file_attributes(files: DataFrame) -> DataFrame:
    """files(path, width, height, bits) -> suffix, size and depth in long form."""
    size = F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string"))
    return attributes(files, F.col("path"), suffix=plain_suffix(F.col("path")), size=size, bits=F.col("bits"))


def value_counts(attrs: DataFrame) -> DataFrame:
    """(attr, value, n, rank): rank 1 is the most frequent value, ties to the smaller one. All attributes in one pass."""
    counts = attrs.groupBy("attr", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("attr").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank)


def mode(attrs: DataFrame) -> DataFrame:
    """(attr, value, n): the most frequent value, ties to the smaller one. Counts are spread by value, and of an attribute's values
    each task hands on the first of those it has: no task sees them all."""
    counts = attrs.groupBy("attr", "value").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct((-F.col("n")).alias("less"), "value"))
    return counts.groupBy("attr").agg(first.alias("first")).select("attr", "first.value", (-F.col("first.less")).alias("n"))


def other_values(attrs: DataFrame) -> DataFrame:
    return value_counts(attrs).where("rank > 1")


def outliers(attrs: DataFrame) -> DataFrame:
    """Files that hold another than the most frequent value."""
    common = mode(attrs).select("attr", F.col("value").alias("common"))
    return attrs.join(common, "attr").where(~F.col("value").eqNullSafe(F.col("common"))).select("attr", "fname", "value")


def report(attrs: DataFrame) -> DataFrame:
    """(attr, mode_value, mode_n, others): a row for each attribute, its other values in descending order of their number."""
    ranked = value_counts(attrs)
    others = F.transform(F.filter(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))), lambda r: r["rank"] > 1), lambda r: F.struct(r["value"].alias("value"), r["n"].alias("n")))
    first = F.col("rank") == 1
    return ranked.groupBy("attr").agg(F.max(F.when(first, F.col("value"))).alias("mode_value"), F.max(F.when(first, F.col("n"))).alias("mode_n"), others.alias("others"))


def _rational(exposure: Column) -> tuple[Column, Column]:
    """Numerator and denominator of "1/250" or "30"; nulls for anything else."""
    parts = F.split(F.trim(exposure), "/")
    return F.try_element_at(parts, F.lit(1)).try_cast("bigint"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("1")).try_cast("bigint")


def exposure_groups(rows: DataFrame, exposure: Column) -> DataFrame:
    """Exposures as written ("1/250", "30") -> (num, den, n); rows without one are left out."""
    num, den = _rational(exposure)
    found = rows.select(num.alias("num"), den.alias("den")).where("num IS NOT NULL AND den > 0")
    return found.groupBy("num", "den").agg(F.count(F.lit(1)).alias("n"))


def estimated_exposures(frames: DataFrame, exposure: Column) -> DataFrame:
    """frames(series, i) -> (series, num, den): the first frame's exposure for every frame of the series, as a fraction."""
    first = frames.select("series", "i", exposure.alias("e")).groupBy("series").agg(F.min_by("e", "i").alias("e"), F.count(F.lit(1)).alias("n"))
    num, den = _rational(F.col("e"))
    return first.select("series", (num * F.col("n")).alias("num"), den.alias("den"))


def paired(numbers: list[Fraction]) -> Fraction:
    """The sum, added pair by pair: large denominators meet as few others as can be."""
    while len(numbers) > 1:
        numbers = [sum(numbers[i : i + 2], Fraction(0)) for i in range(0, len(numbers), 2)]
    return numbers[0] if numbers else Fraction(0)


def total_exposure(groups: DataFrame, fan_in: int = 32) -> Fraction:
    """The exact sum of groups(num, den, n). Numerators are added up by denominator, the fractions pair by pair in tasks, whose
    sums meet ``fan_in`` at a time; the driver gets one fraction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[Fraction] = []
        for batch in batches:
            pairs = zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True)
            found.append(paired([Fraction(int.from_bytes(a, "big", signed=True), int.from_bytes(b, "big", signed=True)) for a, b in pairs]))
        total = paired(found)
        told = [pa.array([x.to_bytes(x.bit_length() // 8 + 1, "big", signed=True)]) for x in (total.numerator, total.denominator)]
        yield pa.RecordBatch.from_arrays(told, names=["num", "den"])

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [pa.array([(x := int(v)).to_bytes(x.bit_length() // 8 + 1, "big", signed=True) for v in batch.column(k).to_pylist()], pa.binary()) for k in range(2)]
            yield pa.RecordBatch.from_arrays(told, names=["num", "den"])

    by_den = groups.groupBy("den").agg(F.sum(F.col("num").cast("decimal(38,0)") * F.col("n").cast("decimal(19,0)")).cast("decimal(38,0)").alias("num"))
    tasks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = by_den.select("num", F.col("den").cast("decimal(38,0)").alias("den")).mapInArrow(wide, "num binary, den binary").mapInArrow(run, "num binary, den binary")
    while tasks > 1:
        tasks = -(-tasks // fan_in)
        parts = parts.repartition(tasks).mapInArrow(run, "num binary, den binary")
    return paired([Fraction(int.from_bytes(r["num"], "big", signed=True), int.from_bytes(r["den"], "big", signed=True)) for r in parts.collect()])  # one row


def estimated_exposure(first: str, n_frames: int) -> Fraction:
    """The first frame's exposure for every frame."""
    num, _, den = first.strip().partition("/")
    return Fraction(int(num), int(den or 1)) * n_frames


def new_paths(known: DataFrame, added: DataFrame) -> DataFrame:
    """Added (category, path) rows that are not known yet, once each."""
    return added.select("category", "path").distinct().join(known, ["category", "path"], "left_anti")
