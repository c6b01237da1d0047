"""Clipping and mixing over tiles against pixels, accumulators joined in rounds, one hot place."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.operators import tile_clip
from chronofold.operators.sigma import settled
from chronofold.plans.stacking import reduce_tiles, stack, stack_images
from chronofold.sources import formats, images
from chronofold.spec import StackSpec

KEYS = ("y", "x", "c")


def told(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def series(spark):
    """Frames of two tiles' height, colour, with trails and one frame of noise; values of 8 and of 16 bits."""
    r = np.random.default_rng(12)
    cubes = {}
    for bits in (8, 16):
        cube = r.normal(90, 6, (11, 290, 40, 3)) + r.integers(0, 20, (290, 40, 3))
        cube[3, 100:110, 5:30] = 250
        cube[7] = r.uniform(0, 255, cube[7].shape)
        cubes[bits] = (cube.clip(0, 255) * (1 if bits == 8 else 257)).astype(f"u{bits // 8}")
    found = {}
    for bits, cube in cubes.items():
        files = spark.createDataFrame([(f"f{i:02}", formats.encode_png(x, 1)) for i, x in enumerate(cube)], "path string, content binary").repartition(4)
        cut = images.tiles(files).cache()
        order = spark.createDataFrame([(f"f{i:02}", i, len(cube)) for i in range(len(cube))], "path string, i long, n long")
        found[bits] = cut, order
    return found


@pytest.mark.parametrize("bits", [8, 16])
@pytest.mark.parametrize("cube", [64 << 20, 4 * 11 * 1000])
def test_clipping_gives_what_pixels_give(series, monkeypatch, bits, cube):
    monkeypatch.setattr(tile_clip, "CUBE", cube)  # with little room, tiles are cut into many pieces
    cut, _ = series[bits]
    for spec in (StackSpec("sigmaclip-mean", KEYS, in_bits=bits), StackSpec("sigmaclip-mean", KEYS, rej_high=1.7, rej_low=2.2, max_iter=3, in_bits=bits, out_bits=32, precise=True)):
        assert told(reduce_tiles(cut, spec)) == told(stack(images.pixels(cut), spec))


@pytest.mark.parametrize("fade", [{}, {"fade_in": 0.4, "fade_out": 0.3}, {"fade_in": 0.4, "int_weight": True}], ids=["plain", "faded", "whole weights"])
def test_mixing_gives_what_pixels_give(spark, series, fade):
    cut, order = series[8]
    mask = images.pixels(cut.where("path = 'f05'")).select(*KEYS, (F.col("v") / 255.0).alias("m"))
    spec = StackSpec("mask-mix", KEYS, in_bits=8, **fade)
    px = images.pixels(cut.join(order, "path"), "i", "n")
    assert told(reduce_tiles(cut, spec, order, mask)) == told(stack(px, spec, mask))


def test_no_row_for_a_pixel_of_a_frame(series):
    cut, _ = series[8]
    plan = reduce_tiles(settled(cut, "tiles"), StackSpec("sigmaclip-mean", KEYS, in_bits=8))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") == 1
    assert stack(images.pixels(cut), StackSpec("max", KEYS)).count() == 290 * 40 * 3


def test_no_tiles(series):
    none = series[8][0].limit(0)
    for mode in ("max", "min", "mean", "sigmaclip-mean"):
        assert reduce_tiles(none, StackSpec(mode, KEYS, in_bits=8)).collect() == []


def test_no_task_takes_over_32_accumulators(spark):
    parts = spark.range(3 * 500).select((F.col("id") % 3).alias("place"), F.floor(F.col("id") / 3).cast("int").alias("task"))
    slots, most = 500, []
    while slots > 1:
        parts, slots = images.gathered(parts, F.col("place"), 3, slots)
        most.append(max(r["count"] for r in parts.groupBy(F.spark_partition_id()).count().collect()))
        assert parts.rdd.getNumPartitions() == 3 * slots
        parts = parts.distinct()
    assert most == [32, 16]


@pytest.mark.parametrize(("mode", "tasks", "fan_in", "rounds"), [("max", 500, 32, 2), ("min", 40, 4, 3), ("mean", 40, 4, 3)])
def test_one_tile_of_many_partitions(spark, monkeypatch, mode, tasks, fan_in, rounds):
    monkeypatch.setattr(images, "FAN_IN", fan_in)
    values = np.random.default_rng(2).integers(0, 256, (tasks, 4)).astype(np.uint8)
    rows = [(f"f{i}", None, 2, 2, 1, 8, 0, 0, v.tobytes(), None) for i, v in enumerate(values)]
    cut = spark.createDataFrame(rows, images.TILES).repartition(tasks)
    found = images.folded(cut, mode)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == rounds
    row = found.toPandas().iloc[0]
    assert len(found.columns) == 6 + len(images._REDUCED[mode][0]) and set(row["kind"].split(",")) <= {"|u1", "<u2", "<u4"}
    v = [r[{"max": "most", "min": "least", "mean": "s"}[mode]] for r in sorted(images.reduced(cut, mode).collect())]
    assert v == list({"max": values.max, "min": values.min, "mean": values.astype(int).sum}[mode](0))


def test_whole_runs_over_files(spark, tmp_path):
    """Clip and mix from files to files; the result is the one of the pixel path."""
    r = np.random.default_rng(9)
    cube = r.normal(120, 9, (9, 30, 20, 3)).clip(0, 255).astype(np.uint8)
    for i, x in enumerate(cube):
        (tmp_path / f"f{i}.png").write_bytes(formats.encode_png(x))
    mask = np.zeros((15, 10, 1), np.uint8)
    mask[:7] = 255
    (tmp_path / "mask").mkdir()
    (tmp_path / "mask" / "m.png").write_bytes(formats.encode_png(mask))
    for mode in ("sigmaclip-mean", "mask-mix"):
        out = str(tmp_path / "mask" / f"{mode}.png")
        run = stack_images(spark, f"file://{tmp_path}", StackSpec(mode, fade_in=0.3), out, mask_file=f"file://{tmp_path}/mask/m.png")
        assert run.ok
        px = spark.createDataFrame([(i, len(cube), *map(int, at), int(v)) for i, x in enumerate(cube) for at, v in np.ndenumerate(x) for at in [at]], "i long, n long, y long, x long, c long, v long")
        m = spark.createDataFrame([(y, x, c, float(y < 14)) for y in range(30) for x in range(20) for c in range(3)], "y long, x long, c long, m double")
        wanted = stack(px, StackSpec(mode, KEYS, fade_in=0.3, in_bits=8), m)
        wanted = wanted if "v" in wanted.columns else wanted.select(*KEYS, F.col("mu").alias("v"))
        image = formats.decode(open(out, "rb").read())
        assert {(r["y"], r["x"], r["c"]): r["v"] for r in wanted.collect()} == {tuple(map(int, at)): int(v) for at, v in np.ndenumerate(image)}
