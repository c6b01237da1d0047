"""Stacks over streams: maximum, minimum and moments are associative, so a stream can keep them up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_at_once: int = 4) -> DataFrame:
    """A Parquet table (a file or a folder of them) as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(f"{sf_dir}/{name}.parque[t]")


def running_stack(px: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, most, least, n, s, q) over all frames that have come; mean and variance follow from n, s and q (finished)."""
    v = F.col("v")
    return px.groupBy(*keys).agg(F.max(v).alias("most"), F.min(v).alias("least"), F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))


def run_to_end(stacked: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Takes what is there now, batch by batch, and hands every complete result to the sink."""
    query = stacked.writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
