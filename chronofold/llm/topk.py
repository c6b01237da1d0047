"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are ordered by length into buckets of some BUCKET vectors, longest first. The longest vectors give each query a
first threshold, the k-th best product among them. For a bucket of greatest length L a query of length q needs a cosine of at
least threshold / (q L): a query that needs more than 1 skips the bucket, and as lengths fall it skips all further ones.
Queries that stop at about the same bucket share a block of some BLOCK, and the vectors of a bucket go only to the blocks that
want it. Within a bucket a query prunes by length, dropping vectors too short for its threshold, or, where the local cosine
threshold is high, by coordinates, dropping vectors whose largest query coordinates lie outside the range that this cosine
allows. What remains is verified by whole integer products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm.common import written

#: Vectors of a bucket, queries of a block, bands of lengths that the driver knows at most, queries multiplied at a time, and
#: the local cosine threshold from which coordinates are looked at.
BUCKET, BLOCK, BANDS, ROWS, COORDINATE_FROM, FOCUS = 8192, 4096, 1024, 256, 0.55, 3
#: A floor that every product reaches. Sums of products below EXACT are exact in doubles.
NONE = -(1 << 63) + 1
EXACT = float(1 << 53)


def integer_vectors(vectors: DataFrame, factor: int = 64) -> DataFrame:
    """(vec_id, v array<long>, norm): floor(factor * x) of every component; rows that are not all finite are left out.

    A finite component whose product is no 64-bit integer is an error.
    """
    good = F.col("e").isNotNull() & ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("e")).where(good)
    v = v.select("vec_id", F.transform("e", lambda x: F.when(F.abs(x * factor) < float(1 << 63), F.floor(x * factor)).otherwise(F.raise_error(F.lit("a component is too large for 64-bit integers")))).alias("v"))
    return v.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of the list column, zero-padded to a width; int64."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer products: by doubles where every partial sum stays exact, else by 64-bit integers."""
    if left.size and right.size and float(np.abs(left).max()) * float(np.abs(right).max()) * left.shape[1] < EXACT:
        return (left.astype(float) @ right.astype(float).T).astype(np.int64)
    return left @ right.T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= kth)
        return kept[np.lexsort((ids[kept], -scores[kept]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def best_rows(scores: np.ndarray, ids: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best scores of each row that reach its floor, ties to smaller ids."""
    least = floors if scores.shape[1] <= k else np.maximum(floors, np.partition(scores, scores.shape[1] - k, axis=1)[:, -k])
    row, column = np.nonzero(scores >= least[:, None])
    order = np.lexsort((ids[column], -scores[row, column], row))
    row, column = row[order], column[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], column[rank < k]


def search_bucket(queries: np.ndarray, own: np.ndarray, floors: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(queries' places, vec_ids, scores) of each query's best k in a bucket that reach its floor."""
    norms = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
    order = np.argsort(-norms, kind="stable")
    vectors, ids, norms = vectors[order], ids[order], norms[order]
    lengths = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
    unit = vectors / np.where(norms, norms, 1)[:, None]
    bounded = (floors > 0) & (lengths > 0)
    slack, whole = 1 - 1e-9, np.full(len(own), len(ids))
    whole[bounded] = [np.searchsorted(-norms * n, -f * slack, "right") for n, f in zip(lengths[bounded], floors[bounded], strict=True)]  # by length
    needed = np.where(bounded, floors / np.where(bounded, lengths * max(norms[0], 1e-300), 1), 0)
    told = lambda at, keep, scores, some: (np.full(len(some), at), ids[keep[some]], scores[some])
    for at in np.flatnonzero((needed >= COORDINATE_FROM) & (whole > 0)):  # by coordinates: |v_f - c q_f| is bounded for a cosine of at least c
        q, keep, c = queries[at], np.arange(whole[at]), min(1.0, needed[at])
        for f in np.argsort(-np.abs(q))[:FOCUS]:
            x = q[f] / lengths[at]
            reach = np.sqrt(max(0.0, (1 - c * c) * (1 - x * x))) + 1e-9
            low = c * x - reach if x >= 0 else -1.0
            high = 1.0 if x >= 0 else c * x + reach
            keep = keep[(unit[keep, f] >= low) & (unit[keep, f] <= high)]
        keep = keep[ids[keep] != own[at]]
        if len(keep):
            scores = products(q[None, :], vectors[keep])[0]
            kept = scores >= floors[at]
            scores, keep = scores[kept], keep[kept]
            yield told(at, keep, scores, best(scores, ids[keep], k))
    rest = np.flatnonzero((needed < COORDINATE_FROM) & (whole > 0))
    rest = rest[np.argsort(-whole[rest], kind="stable")]
    for start in range(0, len(rest), ROWS):
        here = rest[start : start + ROWS]
        seen = whole[here[0]]  # vectors beyond a query's own bound stay below its floor
        scores = products(queries[here], vectors[:seen])
        scores[ids[None, :seen] == own[here, None]] = NONE - 1
        row, column = best_rows(scores, ids[:seen], floors[here], k)
        yield here[row], ids[column], scores[row, column]


def _ranges(df: DataFrame, name: str, n: int, *by) -> DataFrame:  # noqa: ANN002
    """df, written, with the number (below n) of each row's range in the order ``by``; Spark may make more partitions than n."""
    dealt = written(df.repartitionByRange(n, *by).withColumn(name, F.spark_partition_id()), name)
    made = max(n, (dealt.agg(F.max(name)).first()[0] or 0) + 1)
    return dealt.withColumn(name, F.floor(F.col(name) * n / made).cast("int"))


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, factor: int = 64) -> DataFrame:
    """vectors(vec_id, embedding) -> (query_id, rank, vec_id, score): the k best of all other rows for each query.

    Queries are the rows whose vec_id is divisible by ``every``; a query's own row is the one of the same vec_id, so rows
    that repeat a vec_id are no candidates for each other, and a repeated query id is searched once, with its smallest
    vector. Vectors that are null, or hold a null or a non-finite component, take no part; finite ones too large for 64-bit
    integers, or for products of 64 bits, are an error; shorter vectors count as padded
    with zeros; a null vec_id takes no part. Rows repeated in id and vector are a candidate each. An empty table gives an
    empty result; other columns are not read. Vectors go only to the blocks of queries that want their bucket; the driver
    gets at most BANDS lengths and 1024 vectors.
    """
    data = written(integer_vectors(vectors.where("vec_id IS NOT NULL"), factor).withColumn("row", F.monotonically_increasing_id()), "vectors")
    size = data.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    if not size["n"]:
        return data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(1, size["width"])
    queries = data.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).select(F.col("vec_id").alias("query_id"), "v")
    queries = written(queries.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))), "queries")
    # no product is larger than its two lengths multiplied
    (top, *second), most = data.orderBy(F.desc("norm"), "vec_id").limit(2).collect(), queries.agg(F.max("norm")).first()[0]
    if (most or 0) * (second[0]["norm"] if second and top["vec_id"] % every == 0 else top["norm"]) >= float(1 << 63) and (second or top["vec_id"] % every):
        raise ValueError("products of these vectors may not fit into 64-bit integers")
    # the longest vectors, at most 1024: a first threshold for each query, from a side of fixed size
    longest = data.orderBy(F.desc("norm"), "vec_id").limit(1024).select("vec_id", "v").toArrow()
    long_ids, long_rows = longest.column("vec_id").to_numpy(), longest.column("v").combine_chunks()
    long_vectors = _matrix(long_rows, width)

    # buckets by length, longest first; rows of equal length, or repeated, are told apart by their row numbers
    buckets = -(-size["n"] // BUCKET)
    placed = _ranges(data, "bucket", buckets, F.desc("norm"), "vec_id", "row").select("vec_id", "v", "norm", "bucket")
    last = placed.agg(F.max("bucket")).first()[0]
    # the driver knows the longest vector of each band of buckets, at most BANDS of them
    band = -(-(last + 1) // BANDS)
    tops = sorted(tuple(r) for r in placed.groupBy(F.floor(F.col("bucket") / band).cast("int").alias("band")).agg(F.max("norm").alias("most")).collect())
    most_of, ends = np.array([t[1] for t in tops]), np.array([min(last, (t[0] + 1) * band - 1) for t in tops])

    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids, q = part.column(0).to_numpy(), _matrix(part.column(1), width)
                scores, norms = products(q, long_vectors), part.column(2).to_numpy()
                floors = []
                for i in range(len(ids)):
                    mine = scores[i][long_ids != ids[i]]
                    floors.append(int(np.partition(mine, len(mine) - k)[len(mine) - k]) if len(mine) >= k else NONE)
                floors = np.array(floors, np.int64)
                wanted = (floors[:, None] <= 0) | (most_of[None, :] * norms[:, None] >= floors[:, None] * (1 - 1e-9))
                until = np.where(wanted.any(axis=1), ends[len(ends) - 1 - np.argmax(wanted[:, ::-1], axis=1)], -1)  # -1: none
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(floors), pa.array(until.astype(np.int32))], names=["query_id", "v", "floor", "until"])

    asked = written(queries.mapInArrow(thresholds, "query_id long, v array<long>, floor long, until int").where("until >= 0"), "asked")
    blocks = max(1, -(-asked.count() // BLOCK))
    blocked = _ranges(asked, "block", blocks, "until", "query_id")
    upto = lambda df: df.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("until"))))
    wanted = upto(blocked.groupBy("block").agg(F.max("until").alias("until"))).select(F.col("block").alias("to"), F.col("bucket").alias("of"))
    offered = placed.join(wanted, F.col("bucket") == F.col("of")).select("of", "to", "vec_id", "v")

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            q, v = _matrix(left.column("v").combine_chunks(), width), _matrix(right.column("v").combine_chunks(), width)
            own, ids = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy()
            found = [(own[at], vec_id, score) for at, vec_id, score in search_bucket(q, own, left.column("floor").to_numpy(), v, ids, k)]
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 3
        return pa.table({name: pa.array(x.astype(np.int64)) for name, x in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    keys = ["bucket", "block"]
    found = upto(blocked).select(*keys, "query_id", "v", "floor").groupBy(*keys).cogroup(offered.groupBy("of", "to")).applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
