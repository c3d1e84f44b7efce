"""Near-duplicate embeddings by cross-polytope hashing.

A vector is turned by three rounds of random signs and a fast Hadamard transform; the largest
coordinate, with its sign, is its vertex of the cross-polytope. A table joins ``k`` such vertices
into a bucket. Each vector stands in the bucket of its own vertices and, as a probe, in those that
come from swapping the second largest coordinate in. Vectors that meet, at least one of them not as a
probe, are compared by cosine in double precision.

``k`` grows with the logarithm of the number of vectors, so that buckets keep their mean size, and
the number of tables follows from MISS and from how often a table finds a pair at the threshold, which
a short simulation tells for the vectors' length and k. Equal vectors are one class with a multiplicity.

What goes to a bucket isn't the vector but its number and a sketch: the sides of SKETCH random hyperplanes that it is on. Pairs
whose sides differ in more places than any of a billion pairs at the threshold would (a normal bound) are passed over; the
members of a meeting with a pair left get their vectors, once for each meeting, and are compared there.
Large buckets are dealt out in pairs of blocks. A pair that meets more than once counts at its first
meeting, which both vectors' hashes tell; a block hands over sums of links by vector and a spanning
forest, never its pairs.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
vectors of different lengths. Rows that repeat a vec_id are vectors like any other. A null vec_id
is never a representative: its row links like any other, keeps a null component of its own if it is
alone, and isn't kept if its component has a smallest id. An empty table gives no rows; other
columns, label among them, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linkage import block_counts, blocked, components, expand_pairs, least_by_root, local_roots, run_ends, whole_runs
from .runtime import Workspace, prepare

COSINE = 0.9
#: Aimed mean bucket size, and the share of pairs at the threshold that all tables may miss.
BUCKET, MISS = 8, 0.001
#: Pairs at the threshold, and tables they are looked for in, by which a table's share of found pairs is told.
TRIED, TRIED_TABLES = 1_000, 4
SEED = 20_240_229
#: Hyperplanes of a vector's sketch.
SKETCH = 128
#: Pairs compared at once.
PAIRS = 50_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of rows whose length is a power of two, scaled to keep lengths."""
    n, h = x.shape[1], 1
    while h < n:
        pair = x.reshape(len(x), -1, 2, h)
        x = np.concatenate((pair[:, :, :1] + pair[:, :, 1:], pair[:, :, :1] - pair[:, :, 1:]), axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


class CrossPolytope:
    def __init__(self, dimension: int, k: int, tables: int, seed: int = SEED):
        self.dimension, self.k, self.tables = dimension, k, tables
        self.width = 1 << max(0, dimension - 1).bit_length()
        self.signs = np.random.default_rng([seed, dimension]).choice([-1.0, 1.0], size=(tables, k, 3, self.width))

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Buckets (vector, table, 2**k): the own one first, then the probes'."""
        n = len(vectors)
        padded = np.zeros((n, self.width))
        padded[:, : self.dimension] = vectors
        out = np.empty((n, self.tables, 1 << self.k), dtype=np.int64)
        for t in range(self.tables):
            code = np.full((n, 1), t, dtype=np.int64)
            for signs in self.signs[t]:
                turned = padded
                for sign in signs:
                    turned = hadamard(turned * sign)
                top = np.argpartition(-np.abs(turned), min(1, self.width - 1), axis=1)[:, :2]
                values = np.take_along_axis(turned, top, axis=1)
                order = np.argsort(-np.abs(values), axis=1, kind="stable")
                top, values = np.take_along_axis(top, order, axis=1), np.take_along_axis(values, order, axis=1)
                vertex = 2 * top + (values < 0)
                if vertex.shape[1] == 1:
                    vertex = np.repeat(vertex, 2, axis=1)
                code = np.concatenate([code * (2 * self.width) + vertex[:, i : i + 1] for i in (0, 1)], axis=1)
            out[:, t] = code
        return out


class Sketcher:
    """The sides of SKETCH random hyperplanes that a vector is on, packed; how many may differ at a cosine."""

    def __init__(self, dimension: int, seed: int = SEED):
        self.planes = np.random.default_rng([seed, dimension, 1]).normal(size=(dimension, SKETCH))

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        """(vector, SKETCH / 64) words."""
        return np.packbits(vectors @ self.planes > 0, axis=1).view("<u8")

    @staticmethod
    def most(cosine: float) -> int:
        """Six standard deviations above the mean number of sides that differ at ``cosine``."""
        share = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
        return min(SKETCH, math.ceil(SKETCH * share + 6 * math.sqrt(SKETCH * share * (1 - share))))


def first_meeting(codes_a: np.ndarray, codes_b: np.ndarray) -> np.ndarray:
    """Number of a pair's first meeting (2 * table, + 1 if only in the bucket of b); a is the smaller vector."""
    in_a = (codes_b == codes_a[:, :, :1]).any(axis=2)
    in_b = (codes_a == codes_b[:, :, :1]).any(axis=2)
    order = np.arange(codes_a.shape[1])
    big = 2 * codes_a.shape[1]
    return np.minimum(np.where(in_a, 2 * order, big), np.where(in_b, 2 * order + 1, big)).min(axis=1)


@cache
def table_recall(dimension: int, k: int, cosine: float, seed: int = SEED) -> tuple[float, float]:
    """(share, standard error) of random pairs at ``cosine`` that one table of ``k`` vertices finds."""
    random = np.random.default_rng([seed, dimension, k])
    a, b = random.normal(size=(2, TRIED, dimension))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = cosine * a + math.sqrt(max(0.0, 1 - cosine * cosine)) * b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
    hasher = CrossPolytope(dimension, k, TRIED_TABLES, seed + 1)
    codes_a, codes_b = hasher.codes(a), hasher.codes(b)
    found = float(((codes_b == codes_a[:, :, :1]).any(axis=2) | (codes_a == codes_b[:, :, :1]).any(axis=2)).mean())
    return found, math.sqrt(found * (1 - found) / (TRIED * TRIED_TABLES))


def tables_for(n: int, dimension: int, cosine: float = COSINE) -> tuple[int, int]:
    """(k, number of tables) for ``n`` vectors; a table is taken to find two standard errors less than simulated."""
    vertices = 2 * (1 << max(0, dimension - 1).bit_length())
    k = max(1, math.ceil(math.log(max(2.0, n / BUCKET)) / math.log(vertices)))
    found, error = table_recall(dimension, k, cosine)
    found = min(1 - MISS, max(1 / (TRIED * TRIED_TABLES), found - 2 * error))
    return k, math.ceil(math.log(MISS) / math.log(1 - found) - 1e-9)


def _met(rows: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(left, right) rows that meet; rows come in runs of one meeting."""
    ends = run_ends(rows["bucket"], rows["i"], rows["j"])
    for left, right in expand_pairs(np.arange(1, len(ends) + 1), ends, PAIRS):
        able = (rows["base"][left] | rows["base"][right]) & ((rows["i"][left] == rows["j"][left]) | (rows["own"][left] != rows["own"][right])) & (rows["node"][left] != rows["node"][right])
        yield left[able], right[able]


def _meet(hasher: CrossPolytope, least: float, rows: dict[str, np.ndarray], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smaller row, larger row) of the links whose first meeting is here; rows come in runs of one meeting."""
    found_a, found_b = [], []
    for left, right in _met(rows):
        near = np.einsum("ij,ij->i", vectors[left], vectors[right]) >= least
        found_a.append(left[near])
        found_b.append(right[near])
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    swap = rows["node"][a] > rows["node"][b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    if not len(a):
        return a, b
    used, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    codes = hasher.codes(vectors[used])
    keep = np.zeros(len(a), dtype=bool)
    for at in range(0, len(a), PAIRS):
        x, y = flat[: len(a)][at : at + PAIRS], flat[len(a) :][at : at + PAIRS]
        first = first_meeting(codes[x], codes[y])
        owner = np.where(first % 2 == 0, x, y)
        keep[at : at + PAIRS] = codes[owner, np.minimum(first // 2, hasher.tables - 1), 0] == rows["bucket"][a[at : at + PAIRS]]
    return a[keep], b[keep]


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = prepare(embeddings.sparkSession)
    work = Workspace(spark, "embeddings")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    plain = "size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)"
    keyed = rows.select("vec_id", "embedding", F.coalesce(F.expr(plain), F.lit(False)).alias("plain"))
    keyed = keyed.select("vec_id", "embedding", "plain", F.when(F.col("plain"), F.xxhash64("embedding")).alias("h1"), F.when(F.col("plain"), F.xxhash64(F.lit(1), "embedding")).alias("h2"))
    grouped = keyed.where("plain").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding"))
    classes = work.write(grouped.select("h1", "h2", F.monotonically_increasing_id().alias("node"), "rep", "n", "embedding"), "classes")  # written once, so a class keeps its number
    sizes = {r["d"]: r["count"] for r in classes.groupBy(F.size("embedding").alias("d")).count().collect()}  # one row for each vector length
    links = None
    for dimension, n in sorted(sizes.items()):
        own = _links(work, classes.where(F.size("embedding") == dimension), dimension, n, cosine)
        links = own if links is None else links.union(own)
    if links is None:
        linked = classes.select("h1", "h2", "n", F.lit(0).cast("long").alias("links"), F.col("rep").alias("component"))
    else:
        links = work.write(links, "links")
        sums = links.where("links IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
        roots = components(work, links.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("id", "node")
        joined = classes.drop("embedding").join(roots, "node", "left").join(sums, "node", "left").withColumn("root", F.coalesce("root", "node"))
        joined = work.write(joined.withColumn("links", F.coalesce("links", F.lit(0))), "classes")
        linked = work.write(least_by_root(work, joined, F.col("rep"), "component").select("h1", "h2", "n", "links", "component"), "linked")
        work.keep_only(linked)
    out = keyed.select("vec_id", "h1", "h2").join(linked, ["h1", "h2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce(F.col("links") + F.col("n") - 1, F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"),
    )


def _units(column) -> np.ndarray:
    vectors = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy().reshape(len(column), -1)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


#: Rows of a meeting: its bucket and blocks, the block of the row, whether it stands there on its own account, and its class.
_MEMBER = "bucket long, i int, j int, own int, base boolean, node long"
_MEETING = ("bucket", "i", "j")


def _links(work: Workspace, classes: DataFrame, dimension: int, n: int, cosine: float) -> DataFrame:
    """(a, null, links) sums by class and (a, b, null) links of a spanning forest; one task gives a class several times."""
    hasher, sketcher = CrossPolytope(dimension, *tables_for(n, dimension, cosine)), Sketcher(dimension)
    most = sketcher.most(cosine)
    words = [f"s{k}" for k in range(SKETCH // 64)]
    schema = pa.schema([("bucket", pa.int64()), ("base", pa.bool_()), ("node", pa.int64()), *((w, pa.int64()) for w in words)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _units(batch.column("embedding"))
            codes, sketches = hasher.codes(vectors), sketcher(vectors).view(np.int64)
            each = codes.shape[1] * codes.shape[2]
            base = np.tile(np.arange(codes.shape[2]) == 0, len(vectors) * codes.shape[1])
            row, node = np.repeat(np.arange(len(vectors)), each), batch.column("node").to_numpy()
            for at in range(0, len(row), 65_536):
                part = slice(at, at + 65_536)
                own = row[part]
                yield pa.RecordBatch.from_arrays([pa.array(codes.ravel()[part]), pa.array(base[part]), pa.array(node[own]), *(pa.array(sketches[own, k]) for k in range(len(words)))], schema=schema)

    ddl = "bucket long, base boolean, node long, " + ", ".join(f"{w} long" for w in words)
    dealt = classes.select("node", "embedding").mapInArrow(deal, ddl)
    crowded = work.write(block_counts(dealt.select("bucket")), "blocks")
    meetings = blocked(dealt.withColumn("salt", F.col("node")).join(crowded, "bucket", "left"))
    meetings = meetings.repartition(*_MEETING).sortWithinPartitions(*_MEETING)
    left_over = pa.schema([("bucket", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("own", pa.int32()), ("base", pa.bool_()), ("node", pa.int64())])

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met in whole_runs(batches, _MEETING):
            rows = {k: met.column(k).to_numpy() for k in left_over.names}
            sketches = np.stack([met.column(w).to_numpy().view(np.uint64) for w in words], axis=1)
            wanted = np.zeros(met.num_rows, dtype=bool)
            for left, right in _met(rows):
                near = np.bitwise_count(sketches[left] ^ sketches[right]).sum(axis=1) <= most
                wanted[left[near]] = wanted[right[near]] = True
            if wanted.any():
                yield pa.RecordBatch.from_arrays([pa.array(rows[f.name][wanted], type=f.type) for f in left_over], schema=left_over)

    members = work.write(meetings.mapInArrow(sift, _MEMBER), "met")
    again = members.join(classes.select("node", "n", "embedding"), "node").select(*left_over.names, "n", "embedding")
    again = again.repartition(*_MEETING).sortWithinPartitions(*_MEETING)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met in whole_runs(batches, _MEETING):
            rows = {k: met.column(k).to_numpy() for k in (*left_over.names, "n")}
            a, b = _meet(hasher, cosine, rows, _units(met.column("embedding")))
            if not len(a):
                continue
            x, y = rows["node"][a], rows["node"][b]
            nodes, flat = np.unique(np.concatenate((x, y)), return_inverse=True)
            sums = np.bincount(flat, weights=np.concatenate((rows["n"][b], rows["n"][a]))).astype(np.int64)
            node, root = local_roots(x, y)
            node, root = node[node != root], root[node != root]
            is_sum = np.arange(len(nodes) + len(node)) < len(nodes)
            ends = np.concatenate((np.zeros(len(nodes), np.int64), root))
            counts = np.concatenate((sums, np.zeros(len(node), np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((nodes, node))), pa.array(ends, mask=is_sum), pa.array(counts, mask=~is_sum)], names=["a", "b", "links"])

    return again.mapInArrow(compare, "a long, b long, links long")
