"""k-means with Drake's adaptive bounds, over whole numbers.

Each vector carries the numbers of its nearest centroids, an upper bound of the distance to the first, a lower bound for each of
the others, and one lower bound for all the rest. When centroids move, bounds move by as much. A vector whose upper bound
stays below all its lower bounds keeps its centroid unseen. Otherwise its upper bound is made exact, and only as many of its
near centroids are measured as are needed before the lower bounds behind them lie above; where even the bound of the rest
does not, all centroids are measured and the bounds are set anew. How many near centroids are carried adapts to how many
the round before has needed, between an eighth and a quarter of all.

A round is one narrow pass: it writes the vectors with their new bounds and, in the same table, a few rows a task with the
sums of its clusters, which alone are read for the next centroids. Distances are whole numbers: floats only while every term
and sum stays below 2^53, Python's integers beyond. Bounds have a margin for rounding, so a bound never decides a tie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import written
from chronofold.llm.topk import integer_vectors

#: Centroids, rounds, components, factor; vectors handled at a time; sizes up to which floats are exact (in up to 2^11 components).
CLUSTERS, ROUNDS, WIDTH, FACTOR, ROWS, EXACT = 40, 5, 64, 256, 4096, 1 << 20
_STATE = "vec_id long, v array<long>, near array<int>, low array<double>, up double, distance decimal(38,0), cluster int, n long, depth int, sums array<decimal(38,0)>, inertia decimal(38,0)"
_NAMES = [c.split()[0] for c in _STATE.replace("(38,0)", "").split(", ")]
_WHOLE = pa.decimal128(38, 0)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of every row of x to every row of c."""
    if x.dtype == object:
        return ((x[:, None, :] - c[None]) ** 2).sum(2)
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None]


def surely_less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a < b for bounds that rounding may have moved."""
    return a * (1 + 1e-9) + 1e-9 < b


class Bounds:
    """near (n, b + 1), low (n, b + 1; the last is that of all centroids not in near) and up (n) of some vectors."""

    def __init__(self, x: np.ndarray, near: np.ndarray, low: np.ndarray, up: np.ndarray) -> None:
        self.x, self.near, self.low, self.up = x, near, low, up
        self.depth, self.full = 0, 0

    @classmethod
    def none(cls, x: np.ndarray, b: int) -> Bounds:
        """Bounds that certify nothing."""
        return cls(x, np.zeros((len(x), b + 1), np.int32), np.zeros((len(x), b + 1)), np.full(len(x), np.inf))

    def narrowed(self, b: int) -> Bounds:
        """With b near centroids but the first: the others go to the rest."""
        if self.near.shape[1] - 1 <= b:
            return self
        rest = self.low[:, b:].min(1, keepdims=True)
        return Bounds(self.x, self.near[:, : b + 1], np.hstack([self.low[:, :b], rest]), self.up)

    def needed(self, rows: np.ndarray) -> np.ndarray:
        """How many near centroids behind the first have to be measured; one more than there are where the rest may be nearer."""
        behind = np.minimum.accumulate(self.low[rows][:, ::-1], axis=1)[:, ::-1]
        sure = surely_less(self.up[rows][:, None], behind)
        return np.where(sure.any(1), sure.argmax(1), behind.shape[1])

    def rescan(self, rows: np.ndarray, centroids: np.ndarray) -> None:
        b = self.near.shape[1] - 1
        far = squared(self.x[rows], centroids)
        # equal distances by number: the sort is stable
        first = np.argsort(far, axis=1, kind="stable")[:, : b + 2]
        root = np.sqrt(np.take_along_axis(far, first, 1).astype(float))
        self.near[rows] = first[:, : b + 1]
        self.up[rows] = root[:, 0]
        self.low[rows, : b] = root[:, 1 : b + 1]
        self.low[rows, b] = root[:, b + 1] if first.shape[1] > b + 1 else np.inf
        self.full += len(rows)

    def measured(self, rows: np.ndarray, count: int, centroids: np.ndarray) -> None:
        """Exact distances to the first count + 1 near centroids, put in order."""
        near = self.near[rows, : count + 1]
        near = np.sort(near, axis=1)  # by number, so that a stable sort by distance puts ties in that order
        gap = self.x[rows][:, None, :] - centroids[near]
        far = (gap * gap).sum(2)
        order = np.argsort(far, axis=1, kind="stable")
        root = np.sqrt(np.take_along_axis(far, order, 1))
        self.near[rows, : count + 1] = np.take_along_axis(near, order, 1)
        self.up[rows], self.low[rows, :count] = root[:, 0], root[:, 1:]

    def assign(self, centroids: np.ndarray, moved: np.ndarray) -> None:
        b = self.near.shape[1] - 1
        if self.x.dtype == object:
            self.rescan(np.arange(len(self.x)), centroids)
            self.depth = b
            return
        self.up += moved[self.near[:, 0]]
        self.low[:, :b] -= moved[self.near[:, 1:]]
        self.low[:, b] -= moved.max(initial=0.0)
        open_ = np.flatnonzero(self.needed(np.arange(len(self.x))) > 0)
        gap = self.x[open_] - centroids[self.near[open_, 0]]
        known = np.isfinite(self.up[open_])
        self.up[open_[known]] = np.sqrt((gap[known] * gap[known]).sum(1))
        wanted = self.needed(open_)
        for count in np.unique(wanted[(wanted > 0) & (wanted <= b)]):
            self.measured(open_[wanted == count], int(count), centroids)
        self.depth = int(min(b, wanted.max(initial=0)))
        if (wanted > b).any():
            self.rescan(open_[wanted > b], centroids)

    def distances(self, centroids: np.ndarray) -> np.ndarray:
        gap = self.x - centroids[self.near[:, 0]]
        return (gap * gap).sum(1)


def _fitting(v: np.ndarray, most: int) -> np.ndarray:
    return v.astype(float) if most <= EXACT else v.astype(object)


def _lists(column: pa.Array, n: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(n, -1) if n else np.zeros((0, 1), kind)


def _listed(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width), pa.int32()), pa.array(np.ascontiguousarray(rows).reshape(-1), kind))


def _pass(state: DataFrame, centroids: list[list[int]], moved: list[float], b: int, fresh: bool, last: bool) -> DataFrame:
    """A round over the vectors' rows of ``state``: _STATE, those rows with new bounds and the sums of clusters."""
    numbers = np.array(centroids, object)
    size = max((abs(x) for c in centroids for x in c), default=0)
    moves = np.array(moved)

    def rows_of(found: Bounds, ids: pa.Array, v: pa.Array, far: np.ndarray) -> pa.RecordBatch:
        n = len(ids)
        told = {"vec_id": ids, "v": v, "near": _listed(found.near, pa.int32()), "low": _listed(found.low, pa.float64()), "up": pa.array(found.up), "cluster": pa.array(found.near[:, 0])}
        if last:
            told = {"vec_id": ids, "cluster": told["cluster"], "distance": pa.array([Decimal(int(x)) for x in far], _WHOLE)}
        return _batch(told, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        depth = 0
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                n = batch.num_rows
                v = _lists(batch.column(1), n, np.int64)
                most = max(size, max(abs(int(v.min())), abs(int(v.max()))))
                x, c = _fitting(v, most), _fitting(numbers, most)
                if fresh:
                    found = Bounds.none(x, b)
                else:
                    found = Bounds(x, _lists(batch.column(2), n, np.int32), _lists(batch.column(3), n, float), batch.column(4).to_numpy().copy()).narrowed(b)
                found.assign(c, moves)
                far = found.distances(c)
                depth = max(depth, found.depth)
                for k in np.unique(found.near[:, 0]):
                    own = found.near[:, 0] == k
                    add = [int(s) for s in v[own].sum(0)] if most <= EXACT else [int(s) for s in v[own].astype(object).sum(0)]
                    held = sums.setdefault(int(k), [0, [0] * len(add), 0])
                    held[0] += int(own.sum())
                    held[1] = [p + q for p, q in zip(held[1], add, strict=True)]
                    held[2] += sum(int(d) for d in far[own])
                yield rows_of(found, batch.column(0), batch.column(1), far)
        if sums:
            told = list(sums.items())
            yield _batch(
                {
                    "cluster": pa.array([k for k, _ in told], pa.int32()),
                    "n": pa.array([h[0] for _, h in told], pa.int64()),
                    "depth": pa.array([depth] * len(told), pa.int32()),
                    "sums": pa.array([[Decimal(s) for s in h[1]] for _, h in told], pa.list_(_WHOLE)),
                    "inertia": pa.array([Decimal(h[2]) for _, h in told], _WHOLE),
                },
                len(told),
            )

    def _batch(told: dict[str, pa.Array], n: int) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.float64(), _WHOLE, pa.int32(), pa.int64(), pa.int32(), pa.list_(_WHOLE), _WHOLE]
        return pa.RecordBatch.from_arrays([told[name].cast(k) if name in told else pa.nulls(n, k) for name, k in zip(_NAMES, kinds, strict=True)], names=_NAMES)

    return state.mapInArrow(run, _STATE)


def first_centroids(points: DataFrame, k: int, salt: str = "2") -> list[list[int]]:
    """The k vectors whose ids have the smallest hashes, equal ones by their components; null ids come last."""
    hashed = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    return [r["v"] for r in points.select(hashed.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()]  # k rows


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, factor: int = FACTOR) -> DataFrame:
    """vectors(vec_id, embedding) -> (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each vector
    of ``width`` finite components.

    Centroids start as the vectors of the smallest hashed ids, fewer where there are fewer vectors. Other vectors - null, of
    another width, with null or non-finite components - are left out. Null ids are kept, repeated rows repeat, ties go to
    the smaller centroid, an empty table gives an empty result, further columns are not read. Components or sums of
    squared distances beyond 64 bits are an error. The driver gets k centroids and the sums of k clusters.
    """
    points = integer_vectors(vectors.where(F.size("embedding") == width), factor).select("vec_id", "v")
    state = written(points, "vectors")
    centroids = first_centroids(state, k)
    k = len(centroids)
    names = ["vec_id", "v", "near", "low", "up"]
    least, b = max(1, k // 8), max(1, k // 4)
    b = min(b, max(0, k - 1))
    moved, sums = [0.0] * k, {}
    for i in range(rounds + 1):
        last = i == rounds
        found = written(_pass(state, centroids, moved, b, i == 0, last), f"round-{i}")
        totals = found.where("n IS NOT NULL").select("cluster", "n", "depth", "inertia", F.posexplode("sums").alias("at", "s"))
        totals = totals.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.max("depth").alias("depth"), F.sum("inertia").alias("inertia"), F.sum("s").alias("s")).collect()  # k * width rows
        sums = {(r["cluster"], r["at"]): r for r in totals}
        if last:
            break
        after = [[int(sums[c, j]["s"]) // sums[c, j]["n"] for j in range(width)] if (c, 0) in sums else old for c, old in enumerate(centroids)]
        moved = [float(sum((p - q) ** 2 for p, q in zip(x, y, strict=True))) ** 0.5 for x, y in zip(centroids, after, strict=True)]
        centroids = after
        b = min(b, max(least, max((r["depth"] for r in totals), default=b)))
        state = found.where("n IS NULL").select(*names)
    inertia = [int(sums[c, 0]["inertia"]) if (c, 0) in sums else 0 for c in range(k)] or [0]
    if sum(inertia) >= 1 << 63:
        raise OverflowError("the sum of squared distances is beyond 64 bits")
    told = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids] or [""]
    own = lambda values: F.element_at(F.array(*(F.lit(x) for x in values)), F.col("cluster") + 1)
    return found.where("n IS NULL").select(
        "vec_id", "cluster", F.col("distance").cast("long").alias("distance"), own(inertia).cast("long").alias("cluster_inertia"), F.lit(sum(inertia)).cast("long").alias("inertia"), own(told).alias("centroid_sha256")
    )
