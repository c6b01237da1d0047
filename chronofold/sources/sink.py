"""Writing one large image from many tasks.

The result's pixels are dealt into strips of lines, a task for each, which makes the strip's bytes: for PNG a piece of one deflate
stream, flushed at its end so that pieces can stand one behind the other, with its checksum; for TIFF the pixels as they
are. The driver never sees a pixel: it puts the file's head, the strips' bytes, one strip at a time, and the file's end into a
file of any store that Spark knows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.operators.sigma import settled
from chronofold.sources import formats
from chronofold.sources.formats import Info

#: Values of a strip, some.
STRIP = 1 << 20
_ADLER = 65521


def joined_checksum(parts: list[tuple[int, int]]) -> int:
    """Adler-32 of pieces one behind the other, from (checksum, bytes) of each."""
    a, b = 1, 0
    for checksum, n in parts:
        own_a, own_b = checksum & 0xFFFF, checksum >> 16
        a, b = (a + own_a - 1) % _ADLER, (b + own_b + n * (a - 1)) % _ADLER
    return b << 16 | a


def strips(result: DataFrame, shape: tuple[int, int, int], bits: int, suffix: str, level: int = 6, values: int = STRIP) -> DataFrame:
    """result(y, x, c, v) of an image -> (strip, size, checksum, body): the bytes of its strips. Pixels that are not there are 0."""
    height, width, channels = shape
    lines = max(1, values // (width * channels))
    count = -(-height // lines)
    schema = "strip int, size long, checksum long, body binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strip, image = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            y, x, c, v = (batch.column(k).to_numpy() for k in range(4))
            if image is None:  # a partition has one strip
                strip = int(y[0]) // lines
                image = np.zeros((min(lines, height - strip * lines), width, channels), f"<u{bits // 8}")
            image[y - strip * lines, x, c] = np.clip(v, 0, (1 << bits) - 1)
        if image is None:
            return
        if suffix == "png":
            raw = formats.png_lines(image)
            packer = zlib.compressobj(level, zlib.DEFLATED, -15)
            body = packer.compress(raw) + packer.flush(zlib.Z_FULL_FLUSH if strip < count - 1 else zlib.Z_FINISH)
            body = formats.png_chunk(b"IDAT", (b"\x78\x9c" if strip == 0 else b"") + body)
        else:
            raw = body = image.tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([strip], pa.int32()), pa.array([len(raw)]), pa.array([zlib.adler32(raw)], pa.int64()), pa.array([body])], names=["strip", "size", "checksum", "body"])

    places = result.select(*(F.col(k).cast("int").alias(k) for k in "yxc"), F.col("v").cast("long").alias("v"))
    return places.repartitionById(count, F.floor(F.col("y") / lines).cast("int")).mapInArrow(run, schema)


class _File:
    """A file of any store that Spark's session knows, written from its beginning to its end."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store = store.getRawFileSystem() if store.getScheme() == "file" else store  # no checksum file beside an image
        self._out = store.create(at)

    def write(self, content: bytes) -> None:
        if content:
            self._out.write(bytearray(content))

    def close(self) -> None:
        self._out.close()


def write_content(spark: SparkSession, path: str, content: bytes) -> None:
    out = _File(spark, path)
    out.write(content)
    out.close()


def write_strips(result: DataFrame, path: str, shape: tuple[int, int, int], bits: int, suffix: str, level: int = 6, about: Info | None = None, values: int = STRIP) -> None:
    """Writes a PNG or TIFF file. A strip without any pixel is one of zeros."""
    height, width, channels = shape
    rows = settled(strips(result, shape, bits, suffix, level, values), "strips")
    lines = max(1, values // (width * channels))
    count = -(-height // lines)
    told = {r["strip"]: (r["checksum"], r["size"]) for r in rows.select("strip", "checksum", "size").collect()}  # a row for each strip
    if len(told) < count:
        corner = result.sparkSession.range(count).select((F.col("id") * lines).alias("y"), F.lit(0).alias("x"), F.lit(0).alias("c"), F.lit(0).alias("v"))
        missing = corner.where(~F.floor(F.col("y") / lines).isin(list(told)) if told else F.lit(True))
        return write_strips(result.select("y", "x", "c", "v").union(missing), path, shape, bits, suffix, level, about, values)
    head, tail = (formats.png_head(height, width, channels, bits, about), b"") if suffix == "png" else formats.tiff_ends(height, width, channels, bits, about)
    if suffix == "png":
        checksum = joined_checksum([told[k] for k in range(count)])
        tail = formats.png_chunk(b"IDAT", struct.pack(">I", checksum)) + formats.png_chunk(b"IEND", b"")
    out = _File(result.sparkSession, path)
    out.write(head)
    for row in rows.select("strip", "body").orderBy("strip").toLocalIterator():  # one strip at a time
        out.write(bytes(row["body"]))
    out.write(tail)
    out.close()
