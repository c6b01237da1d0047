"""Image files as DataFrames: scanning, headers, decoding into tiles, pixels, and writing a result."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions.expressions import supported, suffix_of
from chronofold.operators.series import numbered
from chronofold.operators.sigma import settled
from chronofold.sources import formats, sink
from chronofold.sources.formats import Info
from chronofold.spec import resize_plan

#: Edge of a tile in pixels. A decoded file is a row for each tile, its pixels in as few bytes as they need.
TILE = 256
#: A file's first row, or its only one where it can't be decoded, also says what the file says about itself.
ABOUT = "struct<width: int, height: int, bits: int, exif: map<string, string>, profile: binary>"
TILES = f"path string, reason string, height int, width int, channels int, bits int, y0 int, x0 int, data binary, about {ABOUT}"
_ABOUT = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("bits", pa.int32()), ("exif", pa.map_(pa.string(), pa.string())), ("profile", pa.binary())])
_KINDS = {"path": pa.string(), "reason": pa.string()} | dict.fromkeys(("height", "width", "channels", "bits", "y0", "x0"), pa.int32()) | {"data": pa.binary(), "about": _ABOUT}


#: Files that Spark's image source decodes: JPEG and GIF, by suffix.
_LIBRARY = "{*.[jJ][pP][gG],*.[jJ][pP][eE][gG],*.[gG][iI][fF]}"
_PATH = "url_decode(replace(_metadata.file_path, '+', '%2B'))"


def _load(spark: SparkSession, kind: str, folder: str, recursive: bool) -> DataFrame:
    return spark.read.format(kind).option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", _LIBRARY if kind == "image" else "*").load(folder)


def scan(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """Supported files of a folder, (path, content); a folder names no file twice. What is not selected is not read."""
    files = _load(spark, "binaryFile", folder, recursive).select(F.expr(_PATH).alias("path"), "content")
    return files.where(supported(F.col("path")))


def folder_tiles(spark: SparkSession, folder: str, recursive: bool = False, resize: str | None = None) -> DataFrame:
    """TILES of a folder's supported files: JPEG and GIF files by Spark's image source, the others by formats."""
    own = scan(spark, folder, recursive).where(~of_library(F.col("path")))
    drawn = _load(spark, "image", folder, recursive).select(F.expr(_PATH).alias("path"), "image.*")
    return tiles(own, resize).union(library_tiles(drawn, resize))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS.values(), strict=True)], names=list(_KINDS))


def about_of(content: bytes) -> dict:
    """What a file says about itself, from its head; nulls and nothing where it can't be read."""
    found, (width, height, bits) = formats.info(content), formats.header(content) or (None, None, None)
    return {"width": width, "height": height, "bits": bits, "exif": list(found.exif.items()), "profile": found.profile}


def _sized(pixels: np.ndarray, resize: str | None) -> np.ndarray:
    if size := resize_plan(resize, *pixels.shape[:2]):
        pixels = formats.resize(pixels, *size)
    return pixels.astype(pixels.dtype.newbyteorder("<"))


def _corners(pixels: np.ndarray, edge: int) -> list[tuple[int, int]]:
    return [(y, x) for y in range(0, pixels.shape[0], edge) for x in range(0, pixels.shape[1], edge)]


def _cut(path: str, pixels: np.ndarray | None, reason: str | None, resize: str | None, edge: int, about: dict | None = None) -> Iterator[pa.RecordBatch]:
    """One file's rows, a few tiles at a time."""
    if pixels is None:
        yield _batch([(path, reason, *[None] * 7, about)])
        return
    pixels = _sized(pixels, resize)
    places = _corners(pixels, edge)
    for at in range(0, len(places), 64):
        yield _batch([(path, None, *pixels.shape, 8 * pixels.dtype.itemsize, y, x, pixels[y : y + edge, x : x + edge].tobytes(), None if y or x else about) for y, x in places[at : at + 64]])


def tiles(files: DataFrame, resize: str | None = None, edge: int = TILE) -> DataFrame:
    """files(path, content) -> TILES; a file that can't be decoded is one row that says why. resize: see resize_plan.

    One file is decoded at a time, and leaves in tiles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                content = batch.column(1)[i].as_py()
                yield from _cut(batch.column(0)[i].as_py(), *formats.read(content), resize, edge, about_of(content))

    return files.select("path", "content").mapInArrow(run, TILES)


def library_tiles(drawn: DataFrame, resize: str | None = None, edge: int = TILE) -> DataFrame:
    """The same for rows (path, height, width, nChannels, data) of Spark's image source: 8 bits, blue first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, height, width, channels, data = (batch.column(k)[i].as_py() for k in range(5))
                pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels) if height > 0 else None
                if pixels is not None and channels > 1:
                    pixels = pixels[:, :, [2, 1, 0, *range(3, channels)]]
                yield from _cut(path, pixels, "not decodable: damaged JPEG or GIF file", resize, edge)

    return drawn.select("path", "height", "width", "nChannels", "data").mapInArrow(run, TILES)


def files_of(cut: DataFrame) -> DataFrame:
    """tiles -> (path, valid, reason, height, width, channels, bits), a row for each file; no pixel is read."""
    return cut.where("y0 IS NULL OR (y0 = 0 AND x0 = 0)").select("path", F.col("reason").isNull().alias("valid"), "reason", "height", "width", "channels", "bits")


def _pixels(row: dict, edge: int) -> np.ndarray:
    h, w = min(edge, row["height"] - row["y0"]), min(edge, row["width"] - row["x0"])
    return np.frombuffer(row["data"], f"<u{row['bits'] // 8}").reshape(h, w, row["channels"])


def _places(row: dict, shape: tuple[int, int, int]) -> list[pa.Array]:
    """y, x and c of a tile's pixels."""
    y, x, c = np.indices(shape).reshape(3, -1)
    return [pa.array((y + row["y0"]).astype(np.int64)), pa.array((x + row["x0"]).astype(np.int64)), pa.array(c.astype(np.int64))]


#: Pixels from which those of several tiles or files leave a task together.
MANY = 1 << 16


def _listed(rows: DataFrame, kept: tuple[str, ...]) -> tuple[list[str], str]:
    """Names of the kept columns, and the schema of pixels with them."""
    more = [f for f in rows.schema if f.name in kept]
    return [f.name for f in more], ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in more), "y bigint, x bigint, c bigint, v bigint"])


def _unrolled(batch: pa.RecordBatch, names: list[str], pieces: Iterable[tuple[int, int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(kept columns, y, x, c, v) of the pieces of a batch's rows: a row's number, y0, x0 and its values there."""

    def record(held: list[tuple]) -> pa.RecordBatch:
        again = pa.array(np.repeat([i for i, *_ in held], [found.size for *_, found in held]))
        at = np.concatenate([np.indices(found.shape).reshape(3, -1) + [[y], [x], [0]] for _, y, x, found in held], axis=1)
        v = np.concatenate([found.reshape(-1).astype(np.int64) for *_, found in held])
        return pa.RecordBatch.from_arrays([*(batch.column(n).take(again) for n in names), *(pa.array(k) for k in at), pa.array(v)], names=[*names, "y", "x", "c", "v"])

    held: list[tuple] = []
    size = 0
    for piece in pieces:
        held.append(piece)
        size += piece[3].size
        if size >= MANY:
            yield record(held)
            held, size = [], 0
    if held:
        yield record(held)


def pixels(cut: DataFrame, *kept: str, edge: int = TILE) -> DataFrame:
    """(kept columns, y, x, c, v) of tiles."""
    names, schema = _listed(cut, kept)
    needed = list(dict.fromkeys([*names, "height", "width", "channels", "bits", "y0", "x0", "data"]))

    def pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, np.ndarray]]:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield i, row["y0"], row["x0"], _pixels(row, edge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _unrolled(batch, names, pieces(batch))

    return cut.where("data IS NOT NULL").select(*needed).mapInArrow(run, schema)


def file_pixels(files: DataFrame, *kept: str, resize: str | None = None, edge: int = TILE) -> DataFrame:
    """The same for files(kept columns, content), without those that can't be decoded: a task decodes and unrolls in one Python
    process, where pixels(tiles(files)) takes two."""
    names, schema = _listed(files, kept)

    def pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, np.ndarray]]:
        for i in range(batch.num_rows):
            found, _ = formats.read(batch.column("content")[i].as_py())
            if found is not None:
                found = _sized(found, resize)
                yield from ((i, y, x, found[y : y + edge, x : x + edge]) for y, x in _corners(found, edge))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _unrolled(batch, names, pieces(batch))

    return files.select(*dict.fromkeys([*names, "content"])).mapInArrow(run, schema)


#: Bytes of accumulators that a task holds before it hands them on.
HELD = 192 << 20
#: What is kept for each pixel of a tile, by reduction: names of arrays, how a tile enters, how two are joined. A count is one
#: number for all of a tile's pixels.
_REDUCED = {
    "max": (("most",), lambda v, w: (v if w is None else v * w,), lambda a, b: (np.maximum(a[0], b[0]),)),
    "min": (("least",), lambda v, w: (v if w is None else v * w,), lambda a, b: (np.minimum(a[0], b[0]),)),
    "mean": (("n", "s", "q"), lambda v, w: (np.ones(1, np.int64), v.astype(np.int64), v.astype(np.int64) ** 2), lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True))),
}


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes as they need."""
    x = x.reshape(-1)
    if x.dtype.kind == "f" or x.dtype.itemsize < 8:
        return x
    kind = np.result_type(np.min_scalar_type(int(x.min())), np.min_scalar_type(int(x.max())))
    return x.astype(kind if kind.kind in "iu" else np.int64)


#: Accumulators of a place that a task takes in at most.
FAN_IN = 32


def _widened(row: dict, names: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """A row's arrays; sums in 64 bits again."""
    found = (np.frombuffer(row[n], k) for n, k in zip(names, row["kind"].split(","), strict=True))
    return tuple(x.astype(np.int64) if len(names) > 1 else x for x in found)


def gathered(parts: DataFrame, place: Column, places: int, slots: int) -> tuple[DataFrame, int]:
    """parts, whose ``task`` numbers a place's accumulators below ``slots``, with a partition for each place (a number) and FAN_IN
    neighbouring numbers; task is the group's number then. And how many groups a place has."""
    groups = -(-slots // FAN_IN)
    parts = parts.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int"))
    return parts.repartitionById(places * groups, (place * groups + F.col("task")).cast("int")), groups


def folded(cut: DataFrame, mode: str, weight: str | None = None, edge: int = TILE) -> DataFrame:
    """tiles of one shape -> (height, width, channels, y0, x0, arrays, kind): an accumulator for each place, over all frames.

    Every task folds the tiles it has into one accumulator for each place (held up to HELD bytes, then handed on), written to
    the shared folder. These are numbered, and rounds join FAN_IN neighbours of a place each, until one is left: a round has a
    task for each place and group, so no task takes in more, however many tasks there were.
    """
    names, enter, join = _REDUCED[mode]
    place = ["height", "width", "channels", "y0", "x0"]
    schema = ", ".join(f"{n} int" for n in [*place, "task", "turn"]) + ", " + ", ".join(f"{n} binary" for n in names) + ", kind string"
    told = [c.split()[0] for c in schema.split(", ")]

    def record(at: tuple, held: tuple) -> pa.RecordBatch:
        held = [_narrow(x) for x in held]
        arrays = [*(pa.array([x], pa.int32()) for x in at), *(pa.array([x.tobytes()], pa.binary()) for x in held), pa.array([",".join(x.dtype.str for x in held)])]
        return pa.RecordBatch.from_arrays(arrays, names=told)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, turn = TaskContext.get().partitionId(), 0
        held: dict[tuple, tuple] = {}
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                at = tuple(row[n] for n in place)
                new = enter(_pixels(row, edge), row[weight] if weight else None)
                if at in held:
                    held[at] = join(held[at], new)
                else:
                    held[at] = new
                    size += sum(x.nbytes for x in new)
                if size > HELD:
                    yield from (record((*p, task, turn), x) for p, x in held.items())
                    held, size, turn = {}, 0, turn + 1
        yield from (record((*p, task, turn), x) for p, x in held.items())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                at, new = tuple(row[n] for n in told[:7]), _widened(row, names)
                if at == now:
                    held = join(held, new)
                    continue
                if now is not None:
                    yield record(now, held)
                now, held = at, new
        if now is not None:
            yield record(now, held)

    needed = ["height", "width", "channels", "bits", "y0", "x0", "data", *([weight] if weight else [])]
    parts = settled(cut.where("data IS NOT NULL").select(*needed).mapInArrow(partial, schema), "accumulators", **{"parquet.enable.dictionary": "false"})
    size = parts.agg(*(F.max(n).alias(n) for n in ("height", "width", "task", "turn"))).first()
    if size["height"] is None:
        return parts.drop("task", "turn")
    across, slots = -(-size["width"] // edge), (size["task"] + 1) * (size["turn"] + 1)
    places = across * -(-size["height"] // edge)
    where = F.floor(F.col("y0") / edge) * across + F.floor(F.col("x0") / edge)
    parts = parts.withColumn("task", F.col("turn") * (size["task"] + 1) + F.col("task")).withColumn("turn", F.lit(0))
    groups = slots
    while True:
        dealt, groups = gathered(parts, where, places, groups)
        parts = dealt.sortWithinPartitions(*told[:7]).mapInArrow(merge, schema)
        if groups == 1:
            return parts.drop("task", "turn")


def reduced(cut: DataFrame, mode: str, weight: str | None = None, edge: int = TILE) -> DataFrame:
    """tiles of one shape (of 8 or 16 bits for means) -> (y, x, c) with most, least, or n, s and q: all frames reduced, a row for
    each pixel of the result. ``weight`` names a column to multiply values by."""
    names = _REDUCED[mode][0]
    result = "y bigint, x bigint, c bigint, " + ", ".join(f"{n} {'double' if weight else 'bigint'}" for n in names)

    def unrolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                shape = (min(edge, row["height"] - row["y0"]), min(edge, row["width"] - row["x0"]), row["channels"])
                size = shape[0] * shape[1] * shape[2]
                values = [pa.array(np.broadcast_to(x, size).astype(np.float64 if weight else np.int64)) for x in _widened(row, names)]
                yield pa.RecordBatch.from_arrays([*_places(row, shape), *values], names=["y", "x", "c", *names])

    return folded(cut, mode, weight, edge).mapInArrow(unrolled, result)


def of_library(path: Column) -> Column:
    return suffix_of(path).isin("jpg", "jpeg", "gif")


def told(files: DataFrame, cut: DataFrame) -> DataFrame:
    """(path, width, height, bits, exif, profile) of each file: from its tiles, and by reading JPEG and GIF files, of which the
    image source tells pixels only."""
    own = cut.where("about IS NOT NULL").select("path", "about.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([about_of(batch.column(1)[i].as_py())], _ABOUT)], names=["path", "about"])

    others = files.where(of_library(F.col("path"))).select("path", "content").mapInArrow(run, f"path string, about {ABOUT}")
    return own.unionByName(others.select("path", "about.*"))


def headers(files: DataFrame) -> DataFrame:
    """(path, width, height, bits) from the files' headers; nulls where a header can't be read. Never fails a run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [formats.header(x) or (None, None, None) for x in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], **{name: pd.array([r[i] for r in found], dtype="Int32") for i, name in enumerate(("width", "height", "bits"))}})

    return files.select("path", "content").mapInPandas(run, "path string, width int, height int, bits int")


def infos(files: DataFrame) -> DataFrame:
    """(path, exif map, profile binary) of each file; empty where it says nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [formats.info(x) for x in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "exif": [x.exif for x in found], "profile": [x.profile for x in found]})

    return files.select("path", "content").mapInPandas(run, "path string, exif map<string,string>, profile binary")


def order(files: DataFrame) -> DataFrame:
    """(path, i): the place of every file, bad ones counted. Paths alone are sorted, into ranges of many tasks."""
    return numbered(files.select("path"), (), ["path"])


def write_file(path: str, content: bytes) -> None:
    """Writes a file from within a task, into any store that the Arrow library knows by the path's scheme."""
    store, at = pa.fs.FileSystem.from_uri(path if "://" in path else path.removeprefix("file:"))
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(at) as out:
        out.write(content)


def encode_jpeg(spark: SparkSession, pixels: np.ndarray, quality: int = 95, about: Info | None = None) -> bytes:
    """A JPEG file of 8-bit gray or colour pixels, by the library of the driver's JVM."""
    jvm, (height, width, channels) = spark.sparkContext._jvm, pixels.shape
    if pixels.dtype != np.uint8 or channels not in (1, 3):
        raise ValueError("JPEG holds 8 bits of one or three channels")
    image = jvm.java.awt.image.BufferedImage(width, height, 10 if channels == 1 else 5)  # its constants for bytes of gray, and of three colours
    image.getRaster().setDataElements(0, 0, width, height, bytearray(pixels.tobytes()))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpg").next()
    how, out = writer.getDefaultWriteParam(), jvm.java.io.ByteArrayOutputStream()
    how.setCompressionMode(jvm.javax.imageio.ImageWriteParam.MODE_EXPLICIT)
    how.setCompressionQuality(max(0, min(100, quality)) / 100)
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), how)
    stream.close()
    writer.dispose()
    return formats.with_jpeg_info(bytes(out.toByteArray()), about)


def write_image(result: DataFrame, path: str, bits: int = 8, level: int = 6, about: Info | None = None, quality: int = 95) -> None:
    """Writes one image (y, x, c, v) as PNG, TIFF or JPEG into any store that Spark knows. PNG and TIFF files are made in strips by
    the executors; only for JPEG do pixels come to the driver, as its encoder has to see them all."""
    suffix = path.rsplit(".", 1)[-1].lower()
    found = settled(result.select(*(F.col(k).cast("int").alias(k) for k in "yxc"), F.col("v").cast("long").alias("v")), "image")
    most = found.agg(*(F.max(k) for k in "yxc")).first()
    shape = tuple(int(k) + 1 for k in most)
    if suffix not in ("jpg", "jpeg"):
        return sink.write_strips(found, path, shape, bits, suffix, level, about)
    y, x, c, v = (k.to_numpy() for k in found.toArrow().columns)
    image = np.zeros(shape, f"u{bits // 8}")
    image[y, x, c] = np.clip(v, 0, (1 << bits) - 1)
    return sink.write_content(result.sparkSession, path, encode_jpeg(result.sparkSession, image, quality, about))


__all__ = ["TILES", "encode_jpeg", "file_pixels", "files_of", "folder_tiles", "headers", "infos", "library_tiles", "order", "pixels", "reduced", "scan", "suffix_of", "tiles", "write_image"]
