"""Image sequences as a Python data source: contiguous frames by partition, headers without pixels.

    spark.dataSource.register(FrameSource)
    spark.read.format("frames").option("partitionBytes", 256 << 20).load("file:///photos")

One listing on the driver - paths and sizes - orders the files and packs neighbours into partitions of about as many bytes, or
of a number of frames. A task reads its files one at a time and leaves tiles with a file's place in the sequence (i), its
partition (part) and what it says about itself; with the option ``headers`` it leaves that alone, from the first bytes of each
file. Any store that the Arrow library knows by its scheme can be listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from chronofold.functions.expressions import SUFFIXES
from chronofold.sources import formats, images

#: Bytes of a partition, and of a file that are read for its header.
PARTITION, HEAD = 128 << 20, 256 << 10
_PLACE = "i bigint, part int"


@dataclass
class Frames(InputPartition):
    """Neighbouring files of a sequence: (path, size), the place of the first one, and the partition's number."""

    files: list[tuple[str, int]]
    first: int
    part: int


def packed(files: list[tuple[str, int]], most_bytes: int, most_frames: int | None = None) -> list[Frames]:
    """files in their order, neighbours together: as many as have most_bytes, at least one, or most_frames of them."""
    found: list[Frames] = []
    size = 0
    for i, (path, n) in enumerate(files):
        full = not found or (len(found[-1].files) >= most_frames if most_frames else size + n > most_bytes)
        if full:
            found.append(Frames([], i, len(found)))
            size = 0
        found[-1].files.append((path, n))
        size += n
    return found


class FrameReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.recursive = str(options.get("recursive", "false")).lower() == "true"
        self.headers = str(options.get("headers", "false")).lower() == "true"
        self.bytes = int(options.get("partitionbytes", PARTITION))
        self.frames = int(options["partitionframes"]) if "partitionframes" in options else None
        self.resize = options.get("resize")

    def _store(self) -> tuple[pa.fs.FileSystem, str]:
        return pa.fs.FileSystem.from_uri(self.folder if "://" in self.folder else self.folder.removeprefix("file:"))

    def partitions(self) -> list[InputPartition]:
        store, at = self._store()
        there = store.get_file_info(pa.fs.FileSelector(at, recursive=self.recursive))
        files = sorted((f.path, f.size or 0) for f in there if f.is_file and f.path.rsplit(".", 1)[-1].lower() in SUFFIXES)
        return packed(files, self.bytes, self.frames) or [Frames([], 0, 0)]

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        store, _ = self._store()
        for k, (path, size) in enumerate(partition.files):
            i = partition.first + k
            with store.open_input_file(path) as file:
                content = file.read(min(size, HEAD) if self.headers else None)
            about = images.about_of(content)
            if self.headers:
                yield _placed(images._batch([(path, None, *[None] * 7, about)]), i, partition.part)
            else:
                for batch in images._cut(path, *formats.read(content), self.resize, images.TILE, about):
                    yield _placed(batch, i, partition.part)


def _placed(batch: pa.RecordBatch, i: int, part: int) -> pa.RecordBatch:
    n = batch.num_rows
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array([i] * n, pa.int64()), pa.array([part] * n, pa.int32())], names=[*batch.schema.names, "i", "part"])


class FrameSource(DataSource):
    """Options: path, recursive, partitionBytes, partitionFrames, headers, resize. The schema is images.TILES, i and part."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return f"{images.TILES}, {_PLACE}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FrameReader(dict(self.options))
