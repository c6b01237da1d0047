"""Sigma clipping over image tiles: no row for each pixel of each frame.

Tiles of all frames are cut, by Spark, into pieces so short that one piece of every frame fits a task, and dealt by place: the
only shuffle, of the pixels' own bytes. A task sorts each pixel's values over the frames and clips by running sums, all passes
at once (see prefix), and leaves a pixel's sums. How short the pieces are follows from the number of frames, so a sequence
of any length is clipped whole, with the same memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.operators import prefix
from chronofold.spec import StackSpec

#: Bytes of all frames' pieces of one place, and values that are sorted at a time.
CUBE, SORTED = 64 << 20, 4 << 20
_SUMS = ("n", "s", "q", "fn", "fs", "fq")


def pieces(tiles: DataFrame, frames: int, edge: int, weight: str | None = None) -> tuple[DataFrame, int]:
    """tiles of one shape -> (their places, piece, bits, data, w) with at most CUBE bytes of all frames in a piece of a place, and
    the number of values in a piece."""
    run = max(1, CUBE // (4 * max(1, frames)))
    per = (F.col("bits") / 8).cast("int") * run
    cut = tiles.select("width", "height", "channels", "bits", "y0", "x0", "data", (F.col(weight).cast("double") if weight else F.lit(None).cast("double")).alias("w"))
    cut = cut.withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.octet_length("data") / per).cast("int") - 1)))
    return cut.withColumn("data", F.substr("data", F.col("piece") * per + 1, per)), run


def clipped(tiles: DataFrame, spec: StackSpec, edge: int, weight: str | None = None) -> DataFrame:
    """tiles of one shape, of 8 or 16 bits, written -> (y, x, c, n, s, q, fn, fs, fq, most): each pixel's clipped sums, full sums and
    greatest value (of values times ``weight``, a column, in doubles). One place of all frames is one partition."""
    shape = tiles.select("height", "width", "channels").first()
    schema = "y bigint, x bigint, c bigint, " + ", ".join(f"{s} bigint" for s in _SUMS) + f", most {'double' if weight else 'bigint'}"
    if shape is None:
        return tiles.sparkSession.createDataFrame([], schema)
    height, width, channels = shape
    frames = tiles.where("y0 = 0 AND x0 = 0").count()
    cut, run = pieces(tiles, frames, edge, weight)
    across, down = -(-width // edge), -(-height // edge)
    share = -(-min(edge, width) * min(edge, height) * channels // run)
    place = (F.floor(F.col("y0") / edge) * across + F.floor(F.col("x0") / edge)) * share + F.col("piece")

    def clip(held: list[tuple[np.ndarray, float | None]], y0: int, x0: int, piece: int) -> Iterator[pa.RecordBatch]:
        kind = max((v.dtype for v, _ in held), key=lambda d: d.itemsize)
        cube = np.stack([v.astype(kind, copy=False) for v, _ in held])
        weights = np.array([w for _, w in held]) if weight else None
        n, values = cube.shape
        w = min(edge, width - x0)
        step = max(1, SORTED // n)
        for at in range(0, values, step):
            part = cube[:, at : at + step]
            most = part.max(0).astype(np.int64) if weights is None else (part * weights[:, None]).max(0)
            k = part.shape[1]
            v = np.sort(part, axis=0).T.reshape(-1).astype(np.int64)
            now, full, _ = prefix.clipped(v, np.ones(len(v), np.int64), np.arange(0, len(v), n), spec)
            number = piece * run + at + np.arange(k)
            places = (number // (w * channels) + y0, number // channels % w + x0, number % channels)
            names = ["y", "x", "c", *_SUMS, "most"]
            yield pa.RecordBatch.from_arrays([*(pa.array(p.astype(np.int64)) for p in places), *map(pa.array, (*now, *full, most))], names=names)

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                y0, x0, piece, bits, data, w = (batch.column(k)[i].as_py() for k in range(6))
                if (y0, x0, piece) != now and held:
                    yield from clip(held, *now)
                    held = []
                now = y0, x0, piece
                held.append((np.frombuffer(data, f"<u{bits // 8}"), w))
        if held:
            yield from clip(held, *now)

    dealt = cut.repartitionById(across * down * share, place.cast("int")).sortWithinPartitions("y0", "x0", "piece")
    return dealt.select("y0", "x0", "piece", "bits", "data", "w").mapInArrow(run_task, schema)
