"""Exact sums of fractions, most frequent values, variances that keep their digits, names that clash."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.operators import frames, profile, stack


def test_exact_sum_of_very_many_denominators(spark):
    n = 20_000
    groups = spark.range(1, n + 1).select(((F.col("id") * 7919) % 1009 - 300).alias("num"), F.col("id").alias("den"), (F.col("id") % 5 + 1).alias("n"))
    wanted = profile.paired([Fraction((i * 7919) % 1009 - 300, i) * (i % 5 + 1) for i in range(1, n + 1)])
    assert profile.total_exposure(groups) == profile.total_exposure(groups, 2) == wanted
    assert profile.total_exposure(groups.limit(0)) == 0


def test_exact_sum_beyond_64_bits(spark):
    groups = spark.createDataFrame([(2**62, 3, 9), (2**62, 3, 2**40), (-1, 7, 1)], "num long, den long, n long")
    assert profile.total_exposure(groups) == Fraction(2**62 * (9 + 2**40), 3) - Fraction(1, 7)


def test_mode_of_very_many_values(spark):
    attrs = spark.range(200_000).select(F.col("id").cast("string").alias("fname"), F.lit("a").alias("attr"), F.when(F.col("id") % 1000 == 1, "often").when(F.col("id") % 1000 == 2, "again").otherwise(F.col("id").cast("string")).alias("value"))
    attrs = attrs.union(attrs.limit(10).withColumn("attr", F.lit("b")))
    assert {tuple(r) for r in profile.mode(attrs).collect()} == {("a", "again", 200), ("b", "0", 1)}
    assert [tuple(r) for r in profile.mode(attrs.where("attr = 'b'").withColumn("value", F.when(F.col("fname") > "5", F.col("value")))).collect()] == [("b", None, 6)]
    assert "Window" not in profile.mode(attrs)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("mean", [0.0, 1e9, -3e11])
def test_variances_small_beside_the_mean(spark, mean):
    values = np.random.default_rng(4).normal(0, 1, 600)
    parts = np.split(values, [1, 50, 51, 400])
    rows = [("k", len(p), float(mean + p.mean()), float(p.var())) for p in parts]
    table = spark.createDataFrame([*rows, (None, 3, 5.0, 2.0)], "k string, n long, mean double, var double")
    found = {r["k"]: r for r in stack.merge_mean_variance(table, ("k",)).collect()}
    assert found[None]["n"] == 3 and found[None]["var"] == 2.0
    tolerance = 1e-9 + abs(mean) * 1e-15
    assert found["k"]["n"] == 600 and abs(found["k"]["mean"] - mean - values.mean()) <= tolerance * 10
    assert abs(found["k"]["var"] - values.var()) <= 1e-9 + abs(mean) * 4e-15
    rest = stack.subtract_mean_variance(stack.merge_mean_variance(table, ("k",)), table.where("n = 349"), ("k",)).where("k = 'k'").first()
    others = np.concatenate([p for p in parts if len(p) != 349])
    assert rest["n"] == len(others) and abs(rest["var"] - others.var()) <= 1e-8 + abs(mean) * 1e-14
    none = stack.subtract_mean_variance(table.where("n = 349"), table.where("n = 349"), ("k",)).first()
    assert tuple(none) == ("k", 0, None, None)


def test_callers_columns_of_any_name(spark):
    rows = [("s", i, i != 3, "a" if i != 2 else "b", 1, 2, 3) for i in range(6)]
    df = spark.createDataFrame(rows, "series string, i long, ok boolean, shape string, kept int, bad int, __kept int")
    for found, n in ((frames.stop_on_failed(df, F.col("ok")), 3), (frames.prefix_of_first_shape(df, F.col("shape")), 2), (frames.of_first_shape(df, F.col("shape")), 5)):
        assert found.columns == df.columns and found.count() == n
        assert {tuple(r) for r in found.select("kept", "bad", "__kept").collect()} == {(1, 2, 3)}
