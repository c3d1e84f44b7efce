"""Centroid clustering with Exponion search: exact k-means on integers that looks at few centroids for each vector.

Every vector carries its cluster, an upper bound of the distance to that centroid and a lower bound of the distance to any
other. A round moves the bounds by what the centroids moved; only where they no longer settle the matter is the upper one
made exact, and only where that doesn't settle it either are centroids scanned: those in a ball around the current centroid of
radius 2 * upper + the distance to its nearest neighbour, which holds the nearest and the second nearest. Each
centroid's neighbours are sorted by distance, so a ball is a prefix of that list; prefixes are scanned in sizes of powers of two. The radius is
inclusive and bounds settle only strict comparisons, so centroids at equal distance are always seen and the smaller number wins.

All distances that decide are exact integers; bounds are doubles, widened by far more than rounding can take away. A round is one pass
over the written state of the round before; its sums are those of the vectors that changed their cluster, added on executors
and collected as one row for each centroid.

Kept are vectors of exactly ``dims`` components, none null or non-finite. A component x counts as floor(scale * x); a vector with one
beyond +-isqrt(2^61 / dims) isn't kept either, as its distances wouldn't fit in 64 bits (189,812,531 at 64 dimensions). Vectors without an id are
clustered, but none starts a centroid before those with one. Repeated rows count once each. With fewer vectors than k there are as many
centroids as vectors. An empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import Workspace, prepare

DIMS, K, ROUNDS, SEED, SCALE = 64, 40, 5, 2, 256
#: Relative width by which bounds are kept away from the exact distances.
SLACK = 1e-9
_DDL = "vec_id long, v array<int>, cluster int, previous int, upper double, lower double, distance long, scanned long"


def whole_numbers(embeddings: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the components as integers, of the vectors that are kept."""
    most = isqrt((1 << 61) // dims)

    def usable(x: Column) -> Column:
        scaled = x.cast("double") * scale
        return (scaled >= -most) & (scaled < most + 1)  # false for NaN, which Spark orders last

    vector = F.col("embedding")
    kept = embeddings.where(F.coalesce((F.size(vector) == dims) & F.forall(vector, usable), F.lit(False)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"))


def starts(vectors: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of "<seed>:<vec_id>"; equal ids by their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return [row["v"] for row in vectors.select("v", key.alias("key")).orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()]


class Search:
    """The centroids of a round, each with its neighbours in order of distance, and how far each has moved."""

    def __init__(self, centroids: list[list[int]], before: list[list[int]] | None = None):
        self.centroids = np.array(centroids, dtype=np.int64)
        between = np.sqrt(squared_distances(self.centroids, self.centroids).astype(np.float64))
        self.order = np.argsort(between, axis=1, kind="stable")
        self.sorted = np.take_along_axis(between, self.order, axis=1)
        self.k = len(centroids)
        others = between + np.diag(np.full(self.k, np.inf))
        self.nearest = others.min(axis=1)
        moved = np.zeros(self.k) if before is None else np.sqrt(((self.centroids - np.array(before, dtype=np.int64)) ** 2).sum(axis=1).astype(np.float64))
        self.moved = moved * (1 + SLACK)
        top = np.sort(self.moved)[::-1][:2]
        self.moved_most = np.where((self.moved == top[0]) & (np.sum(self.moved == top[0]) == 1), top[-1], top[0])  # of the others

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
        """cluster, upper, lower and the number of centroids looked at, of every row; a cluster of -1 is none yet."""
        cluster, scanned = cluster.copy(), np.zeros(len(x), dtype=np.int64)
        new = cluster < 0
        held = np.where(new, 0, cluster)
        upper = np.where(new, np.inf, upper + self.moved[held])
        lower = np.where(new, 0.0, lower - self.moved_most[held])
        settled = np.maximum(lower, self.nearest[held] / 2 * (1 - SLACK))
        unsure = np.flatnonzero(~new & ~(upper < settled))
        upper[unsure] = np.sqrt(paired_distances(x[unsure], self.centroids[cluster[unsure]]).astype(np.float64)) * (1 + SLACK)
        scanned[unsure] += 1
        unsure = unsure[~(upper[unsure] < settled[unsure])]
        size = np.full(len(x), self.k)
        for c in np.unique(cluster[unsure]):
            own = unsure[cluster[unsure] == c]
            radius = (2 * upper[own] + self.nearest[c]) * (1 + SLACK)
            size[own] = np.searchsorted(self.sorted[c], radius, side="right")
        size = np.minimum(1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64), self.k)
        every = np.concatenate([np.flatnonzero(new), unsure])
        keys = np.where(size[every] == self.k, -1, held[every]) * (self.k + 1) + size[every]
        for key in np.unique(keys):
            own = every[keys == key]
            n, c = size[own[0]], held[own[0]]
            near = np.sort(self.order[c, :n]) if n < self.k else np.arange(self.k)  # by number, so that the first of equals is the smallest
            found = squared_distances(x[own], self.centroids[near])
            best = found.argmin(axis=1)
            rows = np.arange(len(own))
            cluster[own] = near[best]
            upper[own] = np.sqrt(found[rows, best].astype(np.float64)) * (1 + SLACK)
            found[rows, best] = np.iinfo(np.int64).max
            lower[own] = np.sqrt(found.min(axis=1).astype(np.float64)) * (1 - SLACK) if n > 1 else np.inf
            scanned[own] += n
        return cluster, upper, lower, scanned


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids; by a product of doubles where every step of it is a whole number below 2^53."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * x.shape[1] * largest**2 < 1 << 53:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def paired_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((x - y) ** 2).sum(axis=1)


def _pass(state: DataFrame, search: Search, last: bool) -> DataFrame:
    """One assignment of all vectors: the next state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("v").flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1)
            before = batch.column("cluster").to_numpy()
            cluster, upper, lower, scanned = search.assign(x, before, batch.column("upper").to_numpy(), batch.column("lower").to_numpy())
            distance = paired_distances(x, search.centroids[cluster]) if last else np.zeros(len(x), dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array(cluster.astype(np.int32)), pa.array(before.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(distance), pa.array(scanned + batch.column("scanned").to_numpy())],
                names=["vec_id", "v", "cluster", "previous", "upper", "lower", "distance", "scanned"],
            )

    return state.mapInArrow(run, _DDL)


def _changes(state: DataFrame, dims: int) -> list:
    """For each centroid what the vectors that came to it add and those that left it take away: number and sum by component."""
    moves = state.where("cluster <> previous").select("v", F.inline(F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("sign")), F.struct(F.col("previous").alias("c"), F.lit(-1).alias("sign"))))).where("c >= 0")
    return moves.groupBy("c").agg(F.sum("sign").alias("n"), *(F.sum(F.get("v", F.lit(i)).cast("long") * F.col("sign")).alias(f"s{i}") for i in range(dims))).collect()


def cluster(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (its components), scanned (centroids looked at in all rounds) of each kept vector.

    Each round assigns all vectors, then replaces every centroid with vectors by floor(sum / count) of each component; after the last round all are assigned
    once more. Rounds after one in which nothing changed would change nothing and are left out.
    """
    if k < 1 or rounds < 0 or dims < 1:
        raise ValueError("k and dims must be positive, rounds not negative")
    spark = prepare(embeddings.sparkSession)
    work = Workspace(spark, "exponion")
    vectors = work.write(whole_numbers(embeddings, dims, scale), "vectors")
    centroids = starts(vectors, k, seed)
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<int>, scanned long"
    if not centroids:
        return spark.createDataFrame([], out)
    counts, sums = [0] * len(centroids), [[0] * dims for _ in centroids]
    state = vectors.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(-1).alias("previous"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("scanned"))
    before = None
    for _ in range(rounds):
        written = work.write(_pass(state, Search(centroids, before), last=False), "round")
        work.keep_only(written)
        state = written
        changes = _changes(state, dims)
        for row in changes:
            counts[row["c"]] += row["n"]
            sums[row["c"]] = [s + row[f"s{i}"] for i, s in enumerate(sums[row["c"]])]
        before, centroids = centroids, [[s // n for s in total] if n else c for c, n, total in zip(centroids, counts, sums)]
        if not changes:
            break
    final = work.write(_pass(state, Search(centroids, before), last=True).select("vec_id", "cluster", "distance", "scanned"), "assigned")
    work.keep_only(final)
    totals = {row["cluster"]: row["total"] for row in final.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    told = [(c, totals[c], sum(totals.values()), centroids[c]) for c in totals]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid array<int>")  # a row for each of at most k centroids
    return final.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "scanned")


def digest(clustered: DataFrame) -> DataFrame:
    centroid = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)
    return clustered.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", centroid.alias("centroid_sha256"))

