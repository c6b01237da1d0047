"""Sigma clipping: mean and variance of the values near the mean, over repeated passes.

Frames are first counted by (key, value) - combined before the shuffle, so a key that holds a third of all rows is spread
over its values - and every pass goes over these counts, not the frames. A pass sums what lies within the bounds from the pass
before, for all values anew; a key that would lose everything keeps its full sums. Where a key's distinct values fit a task,
all passes run in one stage over its running sums (see prefix), straight from the frames; larger keys go pass by pass over
ranges of values with their totals, and sums beyond 64 bits over the counts themselves, each pass's few columns cut in the
shared folder.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.functions.expressions import rounded_mean, variance
from chronofold.operators import prefix
from chronofold.operators.prefix import by_key
from chronofold.operators.stack import finished, scaled_mean, square
from chronofold.spec import StackSpec


def _folder(df: DataFrame) -> str:
    spark = df.sparkSession
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='chronofold-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def settled(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends here, and any executor can read it."""
    path = f"{_folder(df)}/stack/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounds(stats: DataFrame, spec: StackSpec) -> DataFrame:
    """(keys, lo, hi): whole numbers, not below 0 and not above the depth's largest value."""
    n, s = F.col("n"), F.col("s")
    mean, sigma = rounded_mean(s, n), F.sqrt(variance(n, s, F.col("q")))
    hi = F.greatest(F.lit(0).cast("bigint"), F.floor(mean + sigma * spec.rej_high))
    lo = F.greatest(F.lit(0).cast("bigint"), F.ceil(mean - sigma * spec.rej_low))
    if spec.top is not None:
        hi, lo = F.least(F.lit(spec.top).cast("bigint"), hi), F.least(F.lit(spec.top).cast("bigint"), lo)
    return stats.select(*spec.keys, lo.alias("lo"), hi.alias("hi"))


def counted(px: DataFrame, spec: StackSpec) -> DataFrame:
    return px.where("v IS NOT NULL").groupBy(*spec.keys, "v").agg(F.count(F.lit(1)).alias("copies"))


def sums(counts: DataFrame, spec: StackSpec) -> DataFrame:
    v, c = F.col("v"), F.col("copies")
    return counts.groupBy(*spec.keys).agg(F.sum(c).alias("n"), F.sum(c * v).alias("s"), F.sum(c * square(v, spec.wide)).alias("q"))


def clip_once(counts: DataFrame, full: DataFrame, last: DataFrame, spec: StackSpec, keep_rejected: bool = False) -> DataFrame:
    """(keys, n, s, q) of the values within the bounds of ``last`` (or of the others, if ``keep_rejected``)."""
    keys, v, c = list(spec.keys), F.col("v"), F.col("copies")
    within = v.between(F.col("lo"), F.col("hi"))
    kept = ~within if keep_rejected else within
    some = by_key(counts, bounds(last, spec), keys).groupBy(*keys).agg(
        F.sum(F.when(kept, c).otherwise(0)).alias("n1"), F.sum(F.when(kept, c * v).otherwise(0)).alias("s1"), F.sum(F.when(kept, c * square(v, spec.wide)).otherwise(0)).alias("q1")
    )
    if keep_rejected:
        return some.select(*keys, *(F.col(f"{x}1").alias(x) for x in "nsq"))
    none = F.col("n1") == 0
    return by_key(some, full, keys).select(*keys, *(F.when(none, F.col(x)).otherwise(F.col(f"{x}1")).alias(x) for x in "nsq"))


def _kept(some: DataFrame, full: DataFrame, spec: StackSpec) -> DataFrame:
    """The sums of a pass; of a key that would lose everything, the full ones."""
    keys, none = list(spec.keys), F.coalesce(F.col("n1"), F.lit(0)) == 0
    return by_key(full, some, keys, "left").select(*keys, *(F.when(none, F.col(x)).otherwise(F.col(f"{x}1")).alias(x) for x in "nsq"))


def _by_passes(full: DataFrame, spec: StackSpec, one_pass) -> DataFrame:
    """(keys, n, s, q, passes): every pass written, from one_pass(sums of the pass before) -> (keys, n, s, q)."""
    keys, now, told = list(spec.keys), full, full.select(*spec.keys, F.array().cast("array<bigint>").alias("passes"))
    for _ in range(spec.max_iter):
        now = settled(one_pass(now), "pass")
        told = by_key(told, now.select(*keys, F.col("n").alias("count")), keys).select(*keys, F.array_append("passes", F.col("count")).alias("passes"))
    return by_key(now, told, keys)


def clip(px: DataFrame, spec: StackSpec) -> DataFrame:
    """(keys, n, s, q, fn, fs, fq, most, passes): clipped sums, full sums, the greatest value, and the count after each pass. How a key
    is clipped depends on the number of its distinct values, what comes out does not. Frames are read once, and once more
    for keys of very many distinct values."""
    keys = list(spec.keys)
    if spec.wide:
        counts = settled(counted(px, spec), "counts")
        full = settled(sums(counts, spec), "full")
        found = _by_passes(full, spec, lambda now: clip_once(counts, full, now, spec))
        found = by_key(found, full.select(*keys, *(F.col(x).alias(f"f{x}") for x in "nsq")), keys)
        return by_key(found, counts.groupBy(*keys).agg(F.max("v").alias("most")), keys)
    small = settled(prefix.by_prefix(counted(px, spec), spec), "clipped")
    large = small.where("large").select(*keys)
    small = small.where("NOT large").drop("large")
    if large.isEmpty():
        return small
    parts = prefix.ranges(by_key(counted(px, spec), large, keys), spec, settled)
    full = settled(parts.groupBy(*keys).agg(*(F.sum(x).alias(x) for x in "nsq"), F.max("most").alias("most")), "full")
    found = _by_passes(full.drop("most"), spec, lambda now: _kept(prefix.within(parts, bounds(now, spec), spec), full, spec))
    found = by_key(found, full.select(*keys, *(F.col(x).alias(f"f{x}") for x in "nsq"), "most"), keys)
    return small.unionByName(found.select(*small.columns))


def sigma_stack(px: DataFrame, spec: StackSpec) -> DataFrame:
    return scaled_mean(finished(clip(px, spec).select(*spec.keys, *"nsq"), spec.keys, spec.precise), spec)


def convergence(px: DataFrame, spec: StackSpec) -> DataFrame:
    """(pass, share): the share of keys whose count did not change in a pass; passes after one that changed none share 1."""
    found = clip(px, spec)
    before = lambda i: F.when(i == 0, F.col("fn")).otherwise(F.get("passes", i - 1))
    rows = found.select(F.posexplode(F.transform("passes", lambda n, i: (n == before(i)).cast("double"))).alias("i", "same"))
    shares = {r["i"]: r["share"] for r in rows.groupBy("i").agg(F.avg("same").alias("share")).collect()}  # a row for each pass
    told, done = [], False
    for i in range(spec.max_iter):
        told.append((i + 1, 1.0 if done else shares.get(i, 1.0)))
        done = done or told[-1][1] == 1.0
    return px.sparkSession.createDataFrame(told, "pass int, share double")
