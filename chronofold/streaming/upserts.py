"""A table of the newest row for each key, kept by a stream: what changed is written, not everything.

Every batch of an update-mode query writes its changed keys to a folder named by the batch; a batch that runs again after a
failure overwrites its own folder, so nothing counts twice. Readers take a key's row of the newest batch. After every so many
batches the newest rows are written together as a base, and readers take the newest whole base with the batches behind it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructType


class KeyedTable:
    """Rows of ``schema`` by ``keys`` in ``folder``; a base is written after every ``base_after`` batches."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: tuple[str, ...], base_after: int = 16) -> None:
        self.spark, self.folder, self.schema, self.keys, self.base_after = spark, folder.rstrip("/"), schema, keys, base_after

    def _folders(self) -> dict[str, set[int]]:
        """Numbers of the whole folders (those with a _SUCCESS file) of bases and batches."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/*/_SUCCESS")
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
        found: dict[str, set[int]] = {"base": set(), "batch": set()}
        for f in files:
            if name := re.fullmatch(r"(base|batch)-(\d+)", f.getPath().getParent().getName()):
                found[name[1]].add(int(name[2]))
        return found

    def _read(self, upto: int | None) -> DataFrame:
        there = self._folders()
        bases = [b for b in there["base"] if upto is None or b < upto]
        base = max(bases, default=-1)
        batches = sorted(b for b in there["batch"] if b > base and (upto is None or b <= upto))
        whole = StructType([*self.schema, *StructType().add("batch", LongType())])
        paths = ([f"{self.folder}/base-{base}"] if base >= 0 else []) + [f"{self.folder}/batch-{b}" for b in batches]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        values = [f.name for f in self.schema if f.name not in self.keys]
        newest = self.spark.read.schema(whole).parquet(*paths).groupBy(*self.keys).agg(F.max_by(F.struct(*values), "batch").alias("newest"))
        return newest.select(*self.keys, "newest.*").select(*self.schema.names)

    def read(self) -> DataFrame:
        """The newest row of each key."""
        return self._read(None)

    def upsert(self, changed: DataFrame, batch: int) -> None:
        """A sink for foreachBatch: a row for each key that changed, with its whole new state."""
        tagged = lambda df: df.select(*self.schema.names, F.lit(batch).cast("long").alias("batch"))
        tagged(changed).write.mode("overwrite").parquet(f"{self.folder}/batch-{batch}")
        if (batch + 1) % self.base_after == 0:
            tagged(self._read(batch)).write.mode("overwrite").parquet(f"{self.folder}/base-{batch}")


def keep_up(stacked: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Takes what is there now, batch by batch, in update mode; run again with the same checkpoint, it goes on where it was."""
    query = stacked.writeStream.outputMode("update").foreachBatch(table.upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def first_of_each(stream: DataFrame, keys: tuple[str, ...], time: str, within: str) -> DataFrame:
    """Rows of a stream whose keys have not come within so long a time before: repeats go, and so do rows that come later than
    the watermark. State is held for ``within`` only. Null keys are equal to each other; a row without a time is never late."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(list(keys))


def append_new(new: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there now to a folder of Parquet files, exactly once, whatever is run again."""
    query = new.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
