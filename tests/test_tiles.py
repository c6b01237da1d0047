"""Images larger than a tile, further kinds of files, folders of folders, and refused outputs."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.plans.stacking import decode_images, not_ready, reduce_tiles, stack, stack_images
from chronofold.sources import formats, images
from chronofold.spec import StackSpec


def chunk(name, body):
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def png(width, height, bits, kind, raw, interlaced=0, more=b""):
    return formats.PNG_MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, kind, 0, 0, interlaced)) + more + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_low_bits_and_palettes(bits):
    r = np.random.default_rng(bits)
    values = r.integers(0, 1 << bits, (5, 11))
    packed = [np.packbits(((row[:, None] >> np.arange(bits)[::-1]) & 1).reshape(-1).astype(np.uint8)).tobytes() for row in values]
    raw = b"".join(b"\0" + x for x in packed)
    assert np.array_equal(formats.decode(png(11, 5, bits, 0, raw))[:, :, 0], values * (255 // ((1 << bits) - 1)))
    colours = r.integers(0, 256, (1 << bits, 3)).astype(np.uint8)
    assert np.array_equal(formats.decode(png(11, 5, bits, 3, raw, more=chunk(b"PLTE", colours.tobytes()))), colours[values])


@pytest.mark.parametrize("shape", [(1, 1), (3, 2), (13, 17), (8, 8)])
def test_interlaced(shape):
    pixels = np.random.default_rng(4).integers(0, 256, (*shape, 3)).astype(np.uint8)
    raw = b""
    for x0, y0, dx, dy in ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)):
        part = pixels[y0::dy, x0::dx]
        raw += b"".join(b"\0" + row.tobytes() for row in part) if part.size else b""
    assert np.array_equal(formats.decode(png(shape[1], shape[0], 8, 2, raw, interlaced=1)), pixels)


def test_mixed_predictions_of_sixteen_bits():
    """All five predictions in one image, against a byte-by-byte version."""
    r = np.random.default_rng(6)
    raw = r.integers(0, 256, (20, 1 + 9 * 6)).astype(np.uint8)
    raw[:, 0] = np.arange(20) % 5
    out = np.zeros((20, 54), int)
    for y in range(20):
        for i in range(54):
            a, b, c = out[y, i - 6] if i >= 6 else 0, out[y - 1, i] if y else 0, out[y - 1, i - 6] if y and i >= 6 else 0
            p = a + b - c
            near = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
            out[y, i] = (int(raw[y, 1 + i]) + (0, a, b, (a + b) // 2, near)[raw[y, 0]]) % 256
    wanted = out.astype(np.uint8).reshape(-1).view(">u2").reshape(20, 9, 3)
    assert np.array_equal(formats.decode(png(9, 20, 16, 2, raw.tobytes())), wanted)


def test_tiff_runs_and_differences():
    pixels = np.random.default_rng(7).integers(0, 3, (6, 40, 1)).astype(np.uint8)
    plain = formats.encode_tiff(pixels)
    strip = b"".join(bytes([39]) + row.tobytes() for row in pixels[:, :, 0])  # forty literal bytes a line
    strip += bytes([128])

    def with_tags(data, changes):
        order, tags = formats._tiff_tags(plain)
        entries = b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in sorted(({t: v[0] for t, v in tags.items()} | {273: 8, 279: len(data)} | changes).items()))
        return b"II*\0" + struct.pack("<I", 8 + len(data)) + data + struct.pack("<H", len(entries) // 12) + entries + b"\0\0\0\0"

    assert np.array_equal(formats.decode(with_tags(strip, {259: 32773})), pixels)
    runs = b"".join(bytes([257 - 40, v]) for v in range(6))
    assert np.array_equal(formats.decode(with_tags(runs, {259: 32773}))[:, :, 0], np.repeat(np.arange(6), 40).reshape(6, 40))
    steps = np.diff(pixels, axis=1, prepend=np.zeros((6, 1, 1), np.uint8)).astype(np.uint8)
    assert np.array_equal(formats.decode(with_tags(zlib.compress(steps.tobytes()), {259: 8, 317: 2})), pixels)
    assert "compression 5" in formats.read(with_tags(strip, {259: 5}))[1]


@pytest.fixture(scope="module")
def series(spark):
    cube = np.random.default_rng(8).integers(0, 65536, (7, 300, 270, 3)).astype(np.uint16)
    files = spark.createDataFrame([(f"f{i}", formats.encode_png(x, 1)) for i, x in enumerate(cube)], "path string, content binary").repartition(3)
    return cube, images.tiles(files).cache(), images.order(files)


@pytest.mark.parametrize("mode", ["max", "min", "mean"])
@pytest.mark.parametrize("held", [192 << 20, 1 << 20])
def test_tiles_give_what_pixels_give(spark, series, monkeypatch, mode, held):
    monkeypatch.setattr(images, "HELD", held)  # with little room, accumulators leave again and again
    cube, cut, _ = series
    spec = StackSpec(mode, ("y", "x", "c"), in_bits=16)
    good = cut.where("data IS NOT NULL")
    tiles, px = reduce_tiles(good, spec), stack(images.pixels(good), spec)
    assert tiles.count() == cube[0].size and sorted(tiles.columns) == sorted(px.columns)
    assert tiles.select(*px.columns).exceptAll(px).isEmpty()
    column = {"max": "v", "min": "v", "mean": "mu"}[mode]
    found = tiles.toPandas()
    image = np.zeros(cube.shape[1:], np.int64)
    image[found["y"], found["x"], found["c"]] = found[column]
    assert np.array_equal(image, {"max": cube.max(axis=0), "min": cube.min(axis=0), "mean": np.rint(cube.sum(axis=0, dtype=np.int64) / 7)}[mode])


@pytest.mark.parametrize("spec", [StackSpec("max", ("y", "x", "c"), fade_in=0.5, in_bits=16), StackSpec("max", ("y", "x", "c"), fade_out=0.4, int_weight=True, in_bits=16), StackSpec("min", ("y", "x", "c"), fade_in=0.3, in_bits=16, out_bits=8)])
def test_faded_tiles(series, spec):
    _, cut, order = series
    order = order.withColumn("n", F.lit(7).cast("bigint"))
    good = cut.where("data IS NOT NULL")
    wanted = stack(images.pixels(good.join(order, "path"), "i", "n"), spec)
    assert reduce_tiles(good, spec, order).select(*wanted.columns).exceptAll(wanted).isEmpty()


def test_folders_of_folders(spark, tmp_path):
    for i, name in enumerate(("a.png", "b/c.PNG", "b/d/e.tif", "b/d/f.txt")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        pixels = np.full((2, 3), i, np.uint8)
        (tmp_path / name).write_bytes(formats.encode_tiff(pixels) if name.endswith("tif") else formats.encode_png(pixels))
    flat, deep = stack_images(spark, f"file://{tmp_path}", StackSpec("max")), stack_images(spark, f"file://{tmp_path}", StackSpec("max"), recursive=True)
    assert {r["v"] for r in flat.result.collect()} == {0} and {r["v"] for r in deep.result.collect()} == {2}
    assert [tuple(r)[1:] for r in deep.counts.collect()] == [(3, 0)]


def test_reasons_and_refused_outputs(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8\xff")
    (tmp_path / "b.png").write_bytes(formats.encode_png(np.zeros((3, 3), np.uint8))[:45])
    (tmp_path / "c.nef").write_bytes(b"raw")
    run = stack_images(spark, f"file://{tmp_path}", StackSpec("max"))
    reasons = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in run.errors.collect()}
    assert not run.ok and "damaged JPEG" in reasons["a.jpg"] and "unknown kind" in reasons["c.nef"] and reasons["b.png"].startswith("not decodable: ")
    with pytest.raises(ValueError, match="png, tif"):
        stack_images(spark, "file:///does/not/exist", StackSpec("max"), "out.nef")
    with pytest.raises(ValueError, match="mask"):
        stack_images(spark, "file:///does/not/exist", StackSpec("mask-mix"))


def test_runs_on_decoded_images(spark, tmp_path):
    cube = np.random.default_rng(3).integers(0, 256, (4, 5, 6, 3)).astype(np.uint8)
    for i, x in enumerate(cube):
        (tmp_path / f"{i}.png").write_bytes(formats.encode_png(x))
    decoded = decode_images(spark, f"file://{tmp_path}")
    for mode, wanted in (("max", cube.max(axis=0)), ("min", cube.min(axis=0))):
        found = stack_images(spark, "", StackSpec(mode), decoded=decoded).result.toPandas()
        image = np.zeros(wanted.shape, int)
        image[found["y"], found["x"], found["c"]] = found["v"]
        assert np.array_equal(image, wanted)


def test_readiness():
    spec = StackSpec("max")
    assert "3 frames" in not_ready(2, spec, "o.png", None) and "output" in not_ready(3, spec, None, None)
    assert "mask" in not_ready(3, StackSpec("mask-mix"), "o.png", None) and not_ready(3, spec, "o.png", None) is None


def test_jpeg_files(spark, tmp_path):
    """JPEG files in and out, of any spelling of the suffix, with blanks in names, and what stands beside the picture."""
    y, x = np.mgrid[:64, :48]
    cube = [np.stack([x * 4 + i, y * 3 + i, (x + y) * 2], axis=2).clip(0, 255).astype(np.uint8) for i in range(3)]
    about = formats.Info({"ExposureTime": "1/250", "Make": "m", "Model": "a model", "Software": "x"}, b"profile of sRGB")
    (tmp_path / "in" / "sub dir").mkdir(parents=True)
    for i, (name, pixels) in enumerate(zip(("a+b.JPG", "c.jpeg", "sub dir/d e.jpg"), cube, strict=True)):
        content = images.encode_jpeg(spark, pixels, 100, about if i == 0 else None)
        assert formats.info(content) == (about if i == 0 else formats.Info()) and formats.header(content) == (48, 64, 8)
        (tmp_path / "in" / name).write_bytes(content)
    out = str(tmp_path / "out.jpg")
    run = stack_images(spark, f"file://{tmp_path}/in", StackSpec("max"), out, recursive=True, quality=98)
    assert run.ok and run.bits == 8 and run.errors.isEmpty()
    again = images.pixels(images.folder_tiles(spark, f"file://{out}")).toPandas()
    image = np.zeros(cube[0].shape, int)
    image[again["y"], again["x"], again["c"]] = again["v"]
    assert np.abs(image - np.max(cube, axis=0).astype(int)).mean() < 3
    written = formats.info(open(out, "rb").read())
    assert written.exif["ExposureTime"] == "1/250" and written.exif["Software"] == "chronofold" and written.profile == about.profile
    faded = stack_images(spark, f"file://{tmp_path}/in", StackSpec("max", fade_in=0.4), recursive=True)
    assert faded.result.count() == cube[0].size
    gray = np.arange(64, dtype=np.uint8).reshape(8, 8, 1)
    assert formats.header(images.encode_jpeg(spark, gray, 90)) == (8, 8, 8)


def test_exif_blocks():
    for exif in ({}, {"Make": "abc"}, {"ExposureTime": "30"}, {"ExposureTime": "7501/250", "DateTime": "2024:01:01 00:00:00", "Software": "s"}, {"ExposureTime": "soon"}):
        found = formats._tiff_info(formats.exif_block(exif)).exif
        wanted = dict(exif)
        if exif.get("ExposureTime") == "soon":
            del wanted["ExposureTime"]
        elif exif.get("ExposureTime") == "30":
            wanted["ExposureTime"] = "30/1"
        assert found == wanted
