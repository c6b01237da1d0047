"""Keyed pixel relations (keys, v, and for ordered ones i and n) from analytic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions.expressions import hundredths, unit_byte
from chronofold.operators.stack import with_frames


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_px(spark: SparkSession, sf_dir: str, key: str = "user_id") -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col(key).alias("k"), hundredths(F.col("value")).alias("v"))


def events_frames(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """A series for each user, in time order."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "ts", "event_id", hundredths(F.col("value")).alias("v"), *more)
    return with_frames(rows, ("k",), ["ts", "event_id"]).drop("ts", *({"event_id"} - set(more)))


def embeddings_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector is one frame of as many places as it has components."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "e"))
    return rows.select("vec_id", "label", "pos", unit_byte(F.col("e")).alias("v"))


def lineitem_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls"), hundredths(F.col("l_extendedprice")).alias("v"))
