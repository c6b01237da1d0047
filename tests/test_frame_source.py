"""Image sequences by partition: packing, order, headers alone, bad files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.sources import formats, frame_source, images


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("frames")
    r = np.random.default_rng(1)
    for i in range(9):
        (at / f"f{i}.png").write_bytes(formats.encode_png(r.integers(0, 256, (300 if i == 4 else 20, 10, 3)).astype(np.uint8), info=formats.Info({"Model": f"m{i}"})))
    (at / "g.tif").write_bytes(formats.encode_tiff(r.integers(0, 60000, (5, 6, 1)).astype(np.uint16)))
    (at / "h.png").write_bytes(b"damaged")
    (at / "notes.txt").write_bytes(b"no image")
    (at / "more").mkdir()
    (at / "more" / "z.png").write_bytes(formats.encode_png(np.zeros((2, 2, 1), np.uint8)))
    spark.dataSource.register(frame_source.FrameSource)
    return at


def test_packing():
    sizes = [(str(i), n) for i, n in enumerate([5, 5, 5, 20, 1, 1, 9, 0, 0])]
    told = lambda found: [[int(p) for p, _ in f.files] for f in found]
    assert told(frame_source.packed(sizes, 10)) == [[0, 1], [2], [3], [4, 5], [6, 7, 8]]
    assert told(frame_source.packed(sizes, 10, 4)) == [[0, 1, 2, 3], [4, 5, 6, 7], [8]]
    assert [f.first for f in frame_source.packed(sizes, 10)] == [0, 2, 3, 4, 6] and frame_source.packed([], 10) == []


@pytest.mark.parametrize("options", [{"partitionFrames": 2}, {"partitionBytes": 1}, {"partitionBytes": 1 << 30}])
def test_same_tiles_as_the_folder_has(spark, folder, options):
    read = spark.read.format("frames").options(**options).load(f"file://{folder}")
    name = F.element_at(F.split("path", "/"), -1).alias("path")
    what = [name, "reason", "height", "width", "channels", "bits", "y0", "x0", "data", F.col("about.exif").cast("string").alias("exif")]
    mine, theirs = (sorted(map(tuple, df.select(*what).collect()), key=repr) for df in (read, images.folder_tiles(spark, f"file://{folder}")))
    assert mine == theirs
    places = {r["path"]: (r["i"], r["part"]) for r in read.select(name, "i", "part").distinct().collect()}
    assert [places[p][0] for p in sorted(places)] == list(range(11))
    parts = 6 if "partitionFrames" in options else 11 if options["partitionBytes"] == 1 else 1
    assert {p for _, p in places.values()} == set(range(parts)) and read.rdd.getNumPartitions() == parts


def test_headers_alone(spark, folder):
    found = spark.read.format("frames").option("headers", "true").option("recursive", "true").load(f"file://{folder}").orderBy("i").collect()
    assert len(found) == 12 and all(r["data"] is None for r in found)
    assert (found[4]["about"]["height"], found[4]["about"]["width"], found[4]["about"]["exif"]["Model"]) == (300, 10, "m4")
    assert found[9]["about"]["bits"] == 16 and found[10]["about"]["height"] is None


def test_an_empty_folder(spark, folder, tmp_path):
    assert spark.read.format("frames").load(f"file://{tmp_path}").count() == 0


def test_files_are_read_once(spark, folder):
    """Headers and tags come with the tiles."""
    told = images.told(images.scan(spark, f"file://{folder}"), images.folder_tiles(spark, f"file://{folder}"))
    assert {r["exif"].get("Model") for r in told.collect() if r["exif"]} >= {"m0", "m8"}
    assert sorted((r["height"], r["width"], r["bits"]) for r in told.where("height IS NOT NULL").select("height", "width", "bits").collect()) == sorted([(20, 10, 8)] * 8 + [(300, 10, 8), (5, 6, 16)])
