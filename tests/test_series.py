"""Scans of series over many ranges against windows over one."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronofold.operators import frames, series, stack


@pytest.fixture(scope="module")
def rows(spark):
    """One series holds half of all rows; null keys, null orders, repeated orders, columns whose names are used inside."""
    found = spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 41 == 1, F.lit(None)).otherwise(F.concat(F.lit("s"), (F.col("id") % 17).cast("string"))).alias("series"),
        F.when(F.col("id") % 97 != 5, F.hash(F.col("id")) % 5000).alias("t"), "id", ((F.col("id") * 37) % 1009).alias("v"), F.lit("x").alias("part"), F.lit(1).alias("kept"),
    )
    return found.repartition(6)


def told(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_numbers_and_lengths(rows):
    window = Window.partitionBy("series").orderBy("t", "id")
    wanted = rows.withColumn("i", F.row_number().over(window).cast("bigint") - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("series")))
    assert told(series.numbered(rows, ("series",), ["t", "id"], "i", "n")) == told(wanted)
    assert told(series.numbered(rows, (), ["id"], "i")) == told(rows.withColumn("i", F.col("id")))
    assert series.numbered(rows.limit(0), ("series",), ["id"]).collect() == []


def test_running_maxima(rows):
    px = stack.with_frames(rows.withColumn("v", F.when(F.col("id") % 5 != 0, F.col("v"))), ("series",), ["t", "id"])
    found = series.running_max(px, ("series",), ["i"])
    assert told(found.select("series", "i", "v")) == told(stack.running_max(px, ("series",)))


@pytest.mark.parametrize("bad_from", [0, 1, 1200, 5000])
def test_cut_at_the_first_bad_one(rows, bad_from):
    px = stack.with_frames(rows, ("series",), ["t", "id"]).cache()
    valid = (F.col("i") < bad_from) | (F.col("i") % 7 == 1)
    assert told(series.stop_on_failed(px, valid)) == told(frames.stop_on_failed(px, valid))
    shape = F.when(F.col("i") < bad_from, F.lit("a")).when(F.col("i") % 3 == 0, F.lit(None)).otherwise(F.lit("b"))
    assert told(series.prefix_of_first_shape(px, shape)) == told(frames.prefix_of_first_shape(px, shape))


def test_a_hot_series_is_spread_over_the_ranges(rows):
    found = series.laid_out(rows, ("series",), ["id"])
    by_part = [r["count"] for r in found.rows.groupBy(found.part).count().collect()]
    assert len(by_part) >= 12 and max(by_part) <= 2 * sorted(by_part)[len(by_part) // 2]
    hot = found.rows.where("series = 'hot'").select(found.part).distinct().count()
    assert hot >= len(by_part) // 2 - 1


def test_tasks_of_a_scan_are_even(rows):
    """One exchange, by range: the fullest partition has at most twice the median, though a series holds half of all rows."""
    found = series.running_max(rows, ("series",), ["id"])
    sizes = sorted(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) >= 12 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("shufflepartitionidpassthrough") == 1 and "hashpartitioning(id" not in plan
    cut = series.prefix_of_first_shape(rows, F.lit("x"), ("series",), ("id",))
    assert cut.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 2 * sizes[len(sizes) // 2]
