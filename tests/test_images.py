"""PNG reading and writing, and whole runs over folders of images."""

import struct
import zlib

import numpy as np
import pytest

from chronofold.plans.stacking import stack_images
from chronofold.sources import formats, images
from chronofold.spec import StackSpec


@pytest.mark.parametrize("dtype", [np.uint8, np.uint16])
@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_round_trip(dtype, channels):
    pixels = np.random.default_rng(3).integers(0, np.iinfo(dtype).max + 1, (5, 7, channels)).astype(dtype)
    assert np.array_equal(formats.decode(formats.encode_png(pixels)), pixels)


@pytest.mark.parametrize("kind", range(5))
def test_filters(kind):
    pixels = np.random.default_rng(kind).integers(0, 256, (6, 8, 3))
    raw, above = b"", np.zeros(24, int)
    for row in pixels.reshape(6, -1):
        left, corner = np.concatenate([[0] * 3, row[:-3]]), np.concatenate([[0] * 3, above[:-3]])
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0, left, above, (left + above) // 2, paeth][kind]
        raw += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        above = row
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 6, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert np.array_equal(formats.decode(png), pixels)


def test_damaged_files_are_none():
    about = formats.Info({"Software": "x"}, b"profile of sRGB")
    good = formats.encode_png(np.zeros((3, 3), np.uint8), info=about)
    assert formats.info(good) == about and formats.info(good[:20]) == formats.Info()
    for content in (b"", b"junk", good[:40], good[:-30]):
        assert formats.decode(content) is None


@pytest.mark.parametrize("dtype", [np.uint8, np.uint16, np.uint32])
@pytest.mark.parametrize("channels", [1, 3, 4])
def test_tiff_round_trip(dtype, channels):
    pixels = np.random.default_rng(8).integers(0, np.iinfo(dtype).max, (5, 7, channels)).astype(dtype)
    about = formats.Info({"Software": "chronofold", "Make": "m"}, b"Adobe RGB profile")
    content = formats.encode_tiff(pixels, about)
    assert np.array_equal(formats.decode(content), pixels)
    assert formats.header(content) == (7, 5, 8 * pixels.dtype.itemsize) and formats.info(content) == about
    assert formats.decode(content[:60]) is None


def test_bmp_and_fits():
    pixels = np.random.default_rng(9).integers(0, 256, (3, 5, 3)).astype(np.uint8)
    rows = b"".join(r[:, ::-1].tobytes() + b"\0" for r in pixels[::-1])
    bmp = b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 5, 3, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows
    assert np.array_equal(formats.decode(bmp), pixels) and formats.header(bmp) == (5, 3, 8)
    values = np.random.default_rng(10).integers(0, 65536, (4, 6))
    cards = "".join(f"{k:8}= {v:>20}".ljust(80) for k, v in (("SIMPLE", "T"), ("BITPIX", 16), ("NAXIS", 2), ("NAXIS1", 6), ("NAXIS2", 4), ("BZERO", 32768))) + "END".ljust(80)
    fits = cards.ljust(2880).encode() + (values - 32768).astype(">i2").tobytes()
    assert np.array_equal(formats.decode(fits)[:, :, 0], values) and formats.header(fits) == (6, 4, 16)


def test_headers_of_files_that_are_not_decoded():
    jpeg = b"\xff\xd8\xff\xe0\x00\x04xx\xff\xc0\x00\x11\x08\x01\x02\x03\x04"
    assert formats.header(jpeg) == (0x0304, 0x0102, 8) and formats.decode(jpeg) is None
    assert formats.header(b"GIF89a" + struct.pack("<HH", 9, 4)) == (9, 4, 8)
    assert formats.header(b"") is None and formats.header(None) is None


def test_resize():
    flat = np.full((4, 6, 3), 7, np.uint8)
    assert np.array_equal(formats.resize(flat, 9, 5), np.full((9, 5, 3), 7))
    ramp = np.arange(8, dtype=np.uint16).reshape(1, 8, 1) * 10
    assert formats.resize(ramp, 1, 4)[0, :, 0].tolist() == [5, 25, 45, 65]
    assert np.array_equal(formats.resize(ramp, 1, 8), ramp)


@pytest.fixture
def folder(tmp_path):
    cube = np.random.default_rng(5).integers(0, 256, (9, 4, 6, 3)).astype(np.uint8)
    for i, frame in enumerate(cube):
        (tmp_path / f"img{i:02}.png").write_bytes(formats.encode_png(frame))
    (tmp_path / "img99.png").write_bytes(b"broken")
    (tmp_path / "img98.png").write_bytes(formats.encode_png(np.zeros((2, 2, 3), np.uint8)))
    (tmp_path / "notes.txt").write_text("no image")
    return tmp_path, cube


def test_folder_of_images(spark, folder, tmp_path):
    path, cube = folder
    out = str(tmp_path / "out" / "max.png")
    (tmp_path / "out").mkdir()
    run = stack_images(spark, f"file://{path}", StackSpec("max"), out)
    assert run.ok and run.bits == 8
    assert np.array_equal(formats.decode(open(out, "rb").read()), cube.max(axis=0))
    assert [r["i"] for r in run.errors.collect()] == [10]
    assert [tuple(r)[1:] for r in run.counts.collect()] == [(10, 1)]
    checked = stack_images(spark, f"file://{path}", StackSpec("max", out_bits=16), str(tmp_path / "out" / "max.tif"), resize="3x2", check=True)
    wide = formats.decode(open(tmp_path / "out" / "max.tif", "rb").read())
    assert wide.dtype == np.uint16 and np.array_equal(wide, np.max([formats.resize(x, 2, 3) for x in [*cube, np.zeros((2, 2, 3), np.uint8)]], axis=0).astype(np.uint16) * 257)
    assert {r["attr"]: r["mode_value"] for r in checked.report.collect()}["size"] == "6x4"
    mean = stack_images(spark, f"file://{path}", StackSpec("mean")).result
    found = {(r["y"], r["x"], r["c"]): r["mu"] for r in mean.collect()}
    assert all(found[y, x, c] == np.rint(cube[:, y, x, c].sum() / 9) for y in range(4) for x in range(6) for c in range(3))


@pytest.mark.parametrize("channels", [1, 3])
def test_mask_mix_of_images(channels, spark, folder, tmp_path):
    path, cube = folder
    mask = np.zeros((2, 3, channels), np.uint8)  # half the frames' size
    mask[:1] = 255
    (tmp_path / "mask").mkdir()
    (tmp_path / "mask" / "m.png").write_bytes(formats.encode_png(mask))
    run = stack_images(spark, f"file://{path}", StackSpec("mask-mix"), mask_file=f"file://{tmp_path}/mask/m.png")
    found = {(r["y"], r["x"], r["c"]): r["v"] for r in run.result.collect()}
    mean = stack_images(spark, f"file://{path}", StackSpec("sigmaclip-mean")).result
    assert all(found[r["y"], r["x"], r["c"]] == r["mu"] for r in mean.collect() if r["y"] >= 2)
    assert len(found) == 72


def test_exposures_are_added(spark, tmp_path):
    for i, exposure in enumerate(("1/250", "30", None)):
        about = formats.Info({"ExposureTime": exposure} if exposure else {}, b"sRGB")
        (tmp_path / f"{i}.png").write_bytes(formats.encode_png(np.zeros((2, 2, 3), np.uint8), info=about))
    (tmp_path / "out").mkdir()
    stack_images(spark, f"file://{tmp_path}", StackSpec("mean"), str(tmp_path / "out" / "o.png"))
    about = formats.info((tmp_path / "out" / "o.png").read_bytes())
    assert about.exif == {"ExposureTime": "7501/250", "Software": "chronofold"} and about.profile == b"sRGB"


def test_nothing_to_stack(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"broken")
    run = stack_images(spark, f"file://{tmp_path}", StackSpec("max"))
    assert not run.ok and run.errors.count() == 1


def test_command_line(spark, folder, tmp_path, capsys):
    from chronofold import cli

    path, cube = folder
    (tmp_path / "out").mkdir()
    assert cli.main(["min", f"file://{path}", str(tmp_path / "out" / "min.png"), "--report"]) == 0
    assert np.array_equal(formats.decode((tmp_path / "out" / "min.png").read_bytes()), cube.min(axis=0))
    assert "10 stacked, 1 failed" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["median", "a", "b"])
