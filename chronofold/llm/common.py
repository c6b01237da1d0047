"""What the operators share: tables, written cuts in the shared folder, Arrow plumbing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

#: Rows that an operator turns into Python objects at a time; bounds a worker's memory, not what is processed.
SLICE_ROWS = 256
#: Bytes of string data in such a slice; a single longer text makes a slice of its own.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where a session names none, it has to be a single machine's (local mode), which
    gets a temporary one; on a cluster that is an error, as executors would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='chronofold-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def private(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, each behind as many underscores as make it no column of df (whatever the case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/chronofold-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes what this application has written on the way; for after its results are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """The name of a folder of this application that nothing is in."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet to the shared folder and reads it again, so a lost executor loses nothing."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """df.mapInArrow(run, schema) for columns of any name: within ``run`` they go by place."""
    plain = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)])
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, plain).toDF(*schema.names)


def slices(batches: Iterator[pa.RecordBatch], text_at: int | None = 1) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most SLICE_ROWS rows and, but for single longer texts, about SLICE_BYTES."""
    for batch in batches:
        n, at = batch.num_rows, 0
        while at < n:
            part = batch.slice(at, SLICE_ROWS)
            while text_at is not None and part.num_rows > 1 and part.column(text_at).nbytes > SLICE_BYTES:
                part = part.slice(0, part.num_rows // 2)
            at += part.num_rows
            yield part


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
