"""Centroid clustering by exponion search, exact in integers.

Vectors become integers, floor(scale * x). The first centroids are the vectors whose ids have the smallest digests; each
round assigns every vector to its nearest centroid (squared distance, ties to the smaller number) and moves each
non-empty centroid to the componentwise floor of its vectors' mean.

A round is one pass over a written table that carries with each vector its centroid, an upper bound of the distance to
it and a lower bound of the distance to any other. Moves of the centroids loosen the bounds. A vector whose upper bound
is below the lower one, or below half the way from its centroid to the next, keeps it unseen. Any other gets its exact
distance, and if that does not settle it, it looks at the centroids inside a ball around its own: of radius twice its
distance plus the way to the nearest other centroid, which holds the nearest and the second nearest. Balls are read off
the sorted distances between centroids; the radius is inclusive and bounds are compared strictly, so ties are seen.

The same pass sums the vectors of each cluster, one row for each task and cluster, so that a round reads the vectors
once and writes them once, and a lost executor costs its tasks only. The driver holds the centroids, their distances,
and one sum for each cluster and component, whatever the number of vectors.

Nulls: vectors that are null, of another length, or that hold a null or non-finite component take no part. A null id
is kept; it comes last among the candidates for first centroids. Ties of digests (repeated ids) go by the vector. With
fewer vectors than clusters each is a centroid, repeated ones too; an empty table gives an empty result; other columns are ignored.
Components are refused beyond 2^27 after scaling, where squared distances leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import new_path, only

DIM, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Largest component after scaling, and the largest for which products in double precision are exact.
MOST, MOST_DOUBLE = 1 << 27, 1 << 22
#: Bounds are widened by this part, far more than rounding takes.
SLACK = 1e-9
_STATE = "kind string, vec_id long, vec binary, cluster int, distance long, upper double, lower double, n long, sums array<decimal(38,0)>"
_ARROW = pa.schema([
    ("kind", pa.string()), ("vec_id", pa.int64()), ("vec", pa.binary()), ("cluster", pa.int32()), ("distance", pa.int64()),
    ("upper", pa.float64()), ("lower", pa.float64()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))),
])


class Centres:
    """Centroids of one round with what a search needs: distances between them, sorted for each, and how far each moved."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None):
        self.at = at
        k = len(at)
        apart = np.stack([np.sqrt(squared(at, np.full(k, j), at).astype(float)) for j in range(k)]) if k else np.zeros((0, 0))
        # The order of each row puts the centroid itself first: also if others lie at the same place.
        np.fill_diagonal(apart, -1.0)
        self.order = np.argsort(apart, axis=1, kind="stable").astype(np.int32)
        np.fill_diagonal(apart, 0.0)
        self.sorted = np.take_along_axis(apart, self.order, 1)
        self.next = self.sorted[:, 1] if k > 1 else np.full(k, np.inf)
        moved = np.zeros(k) if before is None else np.sqrt(((at - before) ** 2).sum(1).astype(float)) * (1 + SLACK)
        self.moved = moved
        first = int(moved.argmax()) if k else 0
        others = np.delete(moved, first).max() if k > 1 else 0.0
        #: The farthest move of any other centroid.
        self.moved_else = np.where(np.arange(k) == first, others, moved[first] if k else 0.0)


def squared(x: np.ndarray, j: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distance of each vector to the centroid named beside it."""
    out = np.zeros(len(x), np.int64)
    for a in range(0, len(x), 4096):
        out[a : a + 4096] = ((x[a : a + 4096] - centres[j[a : a + 4096]]) ** 2).sum(1)
    return out


def table_of(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors to all given centroids: a product in doubles where that is exact."""
    if not len(x) or not len(centres):
        return np.zeros((len(x), len(centres)), np.int64)
    if max(np.abs(x).max(), np.abs(centres).max()) <= MOST_DOUBLE:
        a, b = x.astype(float), centres.astype(float)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2.0 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centres], 1)


def _two_nearest(x: np.ndarray, numbers: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest of some centroids, ties to the smaller number, and the second's distance."""
    numbers = np.sort(numbers)
    d = table_of(x, centres[numbers])
    at = d.argmin(1)
    rows = np.arange(len(x))
    best = d[rows, at]
    if len(numbers) < 2:
        return numbers[at], best, np.full(len(x), np.inf)
    d[rows, at] = np.iinfo(np.int64).max
    return numbers[at], best, np.sqrt(d.min(1).astype(float)) * (1 - SLACK)


def search(x: np.ndarray, cluster: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None, c: Centres) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """cluster, upper and lower bound of each vector after the centroids moved, and how many distances that took."""
    k = len(c.at)
    if cluster is None:
        best, d, second = _two_nearest(x, np.arange(k, dtype=np.int32), c.at)
        return best.astype(np.int32), np.sqrt(d.astype(float)) * (1 + SLACK), second, len(x) * k
    cluster, upper, lower = cluster.copy(), upper + c.moved[cluster], np.maximum(lower - c.moved_else[cluster], 0.0)
    bound = np.maximum(lower, c.next[cluster] / 2 * (1 - SLACK))
    open_ = np.flatnonzero(upper >= bound)
    exact = np.sqrt(squared(x[open_], cluster[open_], c.at).astype(float))
    upper[open_] = exact * (1 + SLACK)
    spent = len(open_)
    still = upper[open_] >= bound[open_]
    open_, exact = open_[still], exact[still]
    ball = (2 * exact + c.next[cluster[open_]]) * (1 + SLACK)
    own = cluster[open_]
    for a in np.unique(own):
        mine = own == a
        # As many of the sorted list as the ball takes, rounded up to a power of two so that vectors go together.
        reach = np.searchsorted(c.sorted[a], ball[mine], side="right")
        reach = np.minimum(1 << np.ceil(np.log2(np.maximum(reach, 1))).astype(int), k)
        for m in np.unique(reach):
            rows = open_[mine][reach == m]
            best, d, second = _two_nearest(x[rows], c.order[a, :m], c.at)
            cluster[rows], upper[rows] = best, np.sqrt(d.astype(float)) * (1 + SLACK)
            lower[rows] = second
            spent += len(rows) * int(m)
    return cluster, upper, lower, spent


def _pass(c: Centres, fresh: bool, last: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A round over the vectors of a task: their new state, and at the end a row with the sums of each cluster."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(c.at)
        n, sums, inertia = np.zeros(k, np.int64), np.zeros(c.at.shape, np.int64), [0] * k
        for b in batches:
            if not b.num_rows:
                continue
            flat = b["vec"].flatten().to_numpy() if fresh else np.frombuffer(b"".join(b["vec"].to_pylist()), "<i4")
            x = flat.reshape(b.num_rows, -1).astype(np.int64)
            state = (None, None, None) if fresh else (b["cluster"].to_numpy(), b["upper"].to_numpy(), b["lower"].to_numpy())
            cluster, upper, lower, _ = search(x, *state, c)
            distance = np.zeros(len(x), np.int64)
            if last:
                distance = squared(x, cluster, c.at)
                for j in np.unique(cluster):
                    inertia[j] += sum(distance[cluster == j].tolist())
            else:
                order = np.argsort(cluster, kind="stable")
                found, start = np.unique(cluster[order], return_index=True)
                sums[found] += np.add.reduceat(x[order], start, axis=0)
            n += np.bincount(cluster, minlength=k)
            size = len(x)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * x.shape[1]), size, [None, pa.py_buffer(x.astype("<i4").tobytes())]).cast(pa.binary())
            yield pa.record_batch([
                pa.array(["row"] * size), b["vec_id"], packed, pa.array(cluster, pa.int32()), pa.array(distance), pa.array(upper, pa.float64()), pa.array(lower, pa.float64()),
                pa.nulls(size, pa.int64()), pa.nulls(size, _ARROW.field("sums").type),
            ], schema=_ARROW)
        some = np.flatnonzero(n).tolist()
        if some:
            gone = pa.nulls(len(some), pa.float64())
            totals = [[inertia[j]] if last else sums[j].tolist() for j in some]
            yield pa.record_batch([
                pa.array(["sum"] * len(some)), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.binary()), pa.array(some, pa.int32()), pa.nulls(len(some), pa.int64()), gone, gone,
                pa.array(n[some]), pa.array(totals, _ARROW.field("sums").type),
            ], schema=_ARROW)

    return run


def kept_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, vec): the vectors that take part, floor(scale * x) of each component."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = only(df, key, vector).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where((F.size(v) == dim) & F.coalesce(finite, F.lit(False)))
    far = F.exists(v, lambda x: F.abs(x * scale) >= MOST)
    whole = F.transform(v, lambda x: F.floor(x * scale).cast("int"))
    return rows.select("vec_id", F.when(far, F.raise_error(F.lit(f"a component reaches {MOST} after scaling"))).otherwise(whole).alias("vec"))


def seeds(kept: DataFrame, clusters: int = CLUSTERS, seed: int | str = SEED, dim: int = DIM) -> np.ndarray:
    """The first centroids: vectors of the smallest sha256 digests of ``seed:id``, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select("vec", digest.alias("d")).orderBy(F.asc_nulls_last("d"), "vec").limit(clusters).collect()
    return np.array([r["vec"] for r in first], np.int64).reshape(len(first), dim)


def cluster_vectors(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int | str = SEED
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and centroid of every vector that takes part."""
    spark = df.sparkSession
    kept = kept_vectors(df, key, vector, dim, scale)
    centres = Centres(seeds(kept, clusters, seed, dim))
    state = kept
    for r in range(rounds + 1):
        last = r == rounds
        path = new_path(spark, f"clusters-{r}")
        state.mapInArrow(_pass(centres, r == 0, last), _STATE).write.option("compression", "zstd").partitionBy("kind").parquet(path)
        whole = spark.read.schema(_STATE).parquet(path)
        state = whole.where("kind = 'row'").select("vec_id", "vec", "cluster", "distance", "upper", "lower")
        sums = whole.where("kind = 'sum'").select("cluster", "n", F.posexplode("sums").alias("i", "s"))
        sums = sums.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
        if not last:
            at = centres.at.copy()
            for x in sums:
                at[x["cluster"], x["i"]] = int(x["s"]) // x["n"]
            centres = Centres(at, centres.at)
    inertia = {x["cluster"]: int(x["s"]) for x in sums}
    rows = [(j, inertia.get(j, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest(), c) for j, c in enumerate(centres.at.tolist())]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    # One row a cluster, so the broadcast is bounded by their number.
    return state.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")

