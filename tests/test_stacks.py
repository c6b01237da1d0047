"""Stacks against numpy on small cubes, and the edges of the definitions."""

from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronofold.operators import profile, sigma, stack
from chronofold.plans.stacking import stack as run_stack
from chronofold.spec import StackSpec, output_bits, partition_plan, resize_plan, scale_between


def relation(spark, cube):
    """(frames, keys) array -> (k, i, n, v)."""
    n, keys = cube.shape
    data = [(k, i, n, int(cube[i, k])) for i in range(n) for k in range(keys)]
    return spark.createDataFrame(data, "k long, i long, n long, v long")


def by_key(df, *columns):
    return {r["k"]: tuple(r[c] for c in columns) for r in df.collect()}


def weights(n, fin, fout):
    a, b = int(np.floor(n * fin)), int(np.floor(n * fout))
    w = np.ones(n)
    for i in range(n):
        if i < a:
            w[i] = (1 + i * (99.0 / a)) / 100
        elif i >= n - b:
            w[i] = (1 + (n - 1 - i) * (99.0 / b)) / 100
    return w


def clip(values, high=3.0, low=3.0, passes=5, top=None):
    values = np.array(values, dtype=np.int64)

    def stats(x):
        n, s, q = len(x), int(x.sum()), int((x * x).sum())
        var = (float(q) - float(s) * float(s) / n) / (n - 1) if n > 1 else None
        return n, float(np.rint(s / n)), var

    now = stats(values)
    for _ in range(passes):
        n, mu, var = now
        sd = None if var is None else np.sqrt(var)
        hi, lo = (0, 0) if sd is None else (max(0, np.floor(mu + sd * high)), max(0, np.ceil(mu - sd * low)))
        if top is not None:
            hi, lo = min(hi, top), min(lo, top)
        kept = values[(values >= lo) & (values <= hi)]
        new = stats(kept) if len(kept) else stats(values)
        done, now = new[0] == n, new
        if done:
            break
    return now


CUBES = {
    "random": np.random.default_rng(1).integers(0, 256, (40, 9)),
    "one frame": np.array([[5, 0, 255]]),
    "two frames": np.array([[5, 0, 255], [6, 0, 1]]),
    "equal": np.full((12, 3), 77),
    "outlier": np.concatenate([np.random.default_rng(2).integers(90, 110, (30, 4)), np.full((1, 4), 60_000)]),
    "half": np.array([[1, 2, 0], [2, 3, 1]]),
}


@pytest.mark.parametrize("name", CUBES)
def test_against_numpy(spark, name):
    cube = CUBES[name]
    n = len(cube)
    px = relation(spark, cube)
    assert by_key(run_stack(px, StackSpec("max")), "v") == {k: (int(cube[:, k].max()),) for k in range(cube.shape[1])}
    assert by_key(run_stack(px, StackSpec("min")), "v") == {k: (int(cube[:, k].min()),) for k in range(cube.shape[1])}
    w = weights(n, 0.4, 0.3)
    assert by_key(run_stack(px, StackSpec("max", fade_in=0.4, fade_out=0.3)), "v") == {k: (int(np.floor((cube[:, k] * w).max())),) for k in range(cube.shape[1])}
    found = by_key(run_stack(px, StackSpec("sigmaclip-mean")), "n", "mu", "var")
    for k in range(cube.shape[1]):
        count, mu, var = clip(cube[:, k])
        assert found[k][:2] == (count, int(mu))
        assert (found[k][2] is None and var is None) or found[k][2] == pytest.approx(var, rel=1e-12, abs=1e-9)
    mean = by_key(run_stack(px, StackSpec("mean")), "n", "mu", "var")
    for k in range(cube.shape[1]):
        assert mean[k][0] == n and mean[k][1] == int(np.rint(cube[:, k].sum() / n))
        assert mean[k][2] is None if n == 1 else mean[k][2] == pytest.approx(np.var(cube[:, k].astype(float), ddof=1), rel=1e-9, abs=1e-9)


def test_no_frames(spark):
    px = relation(spark, np.zeros((0, 3), int))
    for mode in ("max", "min", "mean", "sigmaclip-mean"):
        assert run_stack(px, StackSpec(mode)).count() == 0


def test_mask_ends(spark):
    cube = CUBES["random"]
    px = relation(spark, cube)
    mask = spark.createDataFrame([(k, float(k % 2)) for k in range(cube.shape[1])], "k long, m double")
    mixed, mean = by_key(run_stack(px, StackSpec("mask-mix"), mask), "v"), by_key(run_stack(px, StackSpec("sigmaclip-mean")), "mu")
    assert all(mixed[k] == mean[k] for k in mixed if k % 2 == 0)
    assert all(mixed[k][0] <= cube[:, k].max() for k in mixed if k % 2)
    with pytest.raises(ValueError, match="mask"):
        run_stack(px, StackSpec("mask-mix"))


def test_moments_add_and_subtract(spark):
    px = relation(spark, CUBES["random"])
    full, part = stack.moments(px, ("k",)), stack.moments(px.where("i < 10"), ("k",))
    rest = stack.moments(px.where("i >= 10"), ("k",))
    assert by_key(stack.subtract_moments(full, part, ("k",)), "n", "s", "q") == by_key(rest, "n", "s", "q")
    assert by_key(stack.union_moments(part.unionByName(rest), ("k",)), "n", "s", "q") == by_key(full, "n", "s", "q")


def test_wide_sums_hold_32_bits(spark):
    px = spark.createDataFrame([(0, (1 << 32) - 1)] * 5000, "k long, v long")
    found = stack.moments(px, ("k",), wide=True).first()
    assert int(found["q"]) == 5000 * ((1 << 32) - 1) ** 2


def test_value_order_does_not_matter(spark):
    px = relation(spark, CUBES["outlier"])
    again = px.orderBy(F.rand(3)).repartition(7)
    spec = StackSpec("sigmaclip-mean")
    assert by_key(sigma.sigma_stack(px, spec), "n", "mu", "var") == by_key(sigma.sigma_stack(again, spec), "n", "mu", "var")


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 5000), st.integers(1, 64), st.one_of(st.none(), st.integers(1, 200)))
def test_partitions_cover_every_frame(n, cores, wanted):
    ranges = partition_plan(n, cores, wanted)
    assert [x for a, b in ranges for x in range(a, b)] == list(range(n))


def test_plans():
    assert [scale_between(8, 16), scale_between(16, 32), scale_between(8, 32)] == [257, 65537, 16843009]
    assert resize_plan("30x20", 5, 5) == (20, 30)
    assert resize_plan("100", 400, 200) == (100, 50)
    assert resize_plan("100", 200, 400) == (50, 100)
    assert resize_plan("", 1, 1) is None and resize_plan("abc", 1, 1) is None
    assert output_bits("a.JPG", 16)[0] == 8 and output_bits("a.png", 16) == (16, None)
    for wrong in ({"mode": "median"}, {"mode": "max", "fade_in": 0.6, "fade_out": 0.6}, {"mode": "min", "fade_in": 0.1, "int_weight": True}, {"mode": "sigmaclip-mean", "max_iter": 0}, {"mode": "max", "out_bits": 12}):
        with pytest.raises(ValueError):
            StackSpec(**wrong)


def test_exposure_total(spark):
    rows = spark.createDataFrame([("1/250",), ("30",), (None,), ("1/3",), ("1/3",), ("junk",), ("1/0",)], "e string")
    groups = profile.exposure_groups(rows, F.col("e"))
    assert profile.total_exposure(groups) == Fraction(1, 250) + 30 + Fraction(2, 3)


def test_report_ties_go_to_the_smaller_value(spark):
    files = spark.createDataFrame([("a.TIFF", 4, 3, 8), ("b.tif", 4, 3, 16), ("c.jpeg", 4, 3, None), ("d.jpg", 2, 3, 8)], "path string, width int, height int, bits int")
    found = {r["attr"]: (r["mode_value"], r["mode_n"], [(o["value"], o["n"]) for o in r["others"]]) for r in profile.report(profile.file_attributes(files)).collect()}
    assert found["suffix"] == ("jpg", 2, [("tif", 2)])
    assert found["size"] == ("4x3", 3, [("2x3", 1)])
    assert found["bits"][0] == "8"
