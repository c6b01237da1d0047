"""Connected components of an edge table, as stars on the smallest node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(a long, b long) -> (node, root), root being the smallest node of the component.

    Alternates the large-star and small-star operations: every node links its larger neighbours, then its smaller ones,
    to the smallest node it sees, until nothing changes. Each step is a minimum by key (combined before the shuffle) and a
    join back, with the tables cut in the shared folder; no adjacency list is gathered. The minima are written before they are
    joined: two written tables can be split where one node has very many links. Loops and repeated edges are harmless.
    """
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def marks(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    mark = marks(now)
    for _ in range(rounds):
        if not mark[0]:
            break
        around = _both(now)
        least = written(around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least")
        large = written(around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        below = written(large.groupBy("a").agg(F.min("b").alias("m")), "below")
        small = large.join(below, "a").select(F.explode(F.array(F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct()
        now = written(small, "edges")
        if (new := marks(now)) == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
