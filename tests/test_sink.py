"""Images written in strips read back the same, by our own decoder and by others."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.sources import formats, images, sink
from chronofold.sources.formats import Info

ABOUT = Info({"Software": "chronofold", "ExposureTime": "1/3"}, b"some profile")


def pixels_of(spark, image):
    rows = [(*map(int, at), int(v)) for at, v in np.ndenumerate(image)]
    return spark.createDataFrame(rows, "y long, x long, c long, v long").repartition(5)


def test_checksums_of_pieces_join():
    r = np.random.default_rng(0)
    pieces = [r.integers(0, 256, n).astype(np.uint8).tobytes() for n in (0, 1, 5000, 70_000, 3)]
    assert sink.joined_checksum([(zlib.adler32(p), len(p)) for p in pieces]) == zlib.adler32(b"".join(pieces))
    assert sink.joined_checksum([]) == zlib.adler32(b"")


@pytest.mark.parametrize("suffix", ["png", "tif"])
@pytest.mark.parametrize(("bits", "channels"), [(8, 1), (8, 3), (16, 3), (16, 1)])
@pytest.mark.parametrize("values", [1, 200, 1 << 20], ids=["a line each", "some lines", "one strip"])
def test_strips_read_back(spark, tmp_path, suffix, bits, channels, values):
    image = np.random.default_rng(bits).integers(0, 1 << bits, (23, 17, channels)).astype(f"u{bits // 8}")
    path = f"file://{tmp_path}/new/out.{suffix}"
    sink.write_strips(pixels_of(spark, image), path, image.shape, bits, suffix, about=ABOUT, values=values)
    content = (tmp_path / "new" / f"out.{suffix}").read_bytes()
    assert np.array_equal(formats.decode(content), image)
    found = formats.info(content)
    assert found.exif["Software"] == "chronofold" and found.profile == b"some profile"
    assert [f.name for f in (tmp_path / "new").iterdir()] == [f"out.{suffix}"]


def test_whole_stream_is_one_of_its_kind(spark, tmp_path):
    """A decoder that checks everything: the joined pieces are one zlib stream with its checksum."""
    image = np.random.default_rng(3).integers(0, 50, (40, 30, 3)).astype(np.uint8)
    sink.write_strips(pixels_of(spark, image), f"{tmp_path}/a.png", image.shape, 8, "png", values=300)
    body = b"".join(b for name, b in formats._png_chunks((tmp_path / "a.png").read_bytes()) if name == b"IDAT")
    assert zlib.decompress(body) == formats.png_lines(image)
    drawn = spark.read.format("image").load(f"file://{tmp_path}/a.png").select("image.height", "image.width", "image.data").first()  # the JVM's decoder
    assert np.array_equal(np.frombuffer(drawn["data"], np.uint8).reshape(40, 30, 3)[:, :, ::-1], image)


def test_missing_pixels_and_strips_are_zero(spark, tmp_path):
    image = np.zeros((20, 4, 1), np.uint8)
    image[[0, 13, 19]] = 7
    some = pixels_of(spark, image).where("v > 0")
    for suffix in ("png", "tif"):
        sink.write_strips(some, f"{tmp_path}/a.{suffix}", image.shape, 8, suffix, values=8)
        assert np.array_equal(formats.decode((tmp_path / f"a.{suffix}").read_bytes()), image)


def test_values_are_clipped_and_large_images_come_back(spark, tmp_path):
    """Six megapixels, computed and written by tasks; what the driver gets are strips."""
    wide = spark.range(3000).select(F.col("id").alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(1999)))).withColumn("c", F.lit(0)).withColumn("v", F.col("y") * 31 + F.col("x") * 7 - 100)
    images.write_image(wide, f"{tmp_path}/big.png", 16, 1)
    y, x = np.indices((3000, 2000))
    assert np.array_equal(formats.decode((tmp_path / "big.png").read_bytes())[:, :, 0], np.clip(y * 31 + x * 7 - 100, 0, 65535))


def test_other_kinds(spark, tmp_path):
    image = np.full((9, 8, 3), 100, np.uint8)
    images.write_image(pixels_of(spark, image), f"{tmp_path}/a.jpg", 8)
    assert (tmp_path / "a.jpg").read_bytes()[:2] == b"\xff\xd8"
    with pytest.raises(ValueError, match="4 GB"):
        formats.tiff_ends(100_000, 100_000, 3, 16)
    with pytest.raises(ValueError, match="8 or 16"):
        formats.png_head(2, 2, 1, 32)
