"""Connected components and bucketed candidate search over written tables.

Nothing here gathers links on the driver or in one task: a round contracts the link graph with
joins and aggregates over written tables, so a lost executor costs tasks, not the lineage.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Workspace

#: Members of a bucket that meet in one task at once; larger buckets are dealt out in pairs of blocks.
BLOCK = 256
#: Bytes of payload of such a block, and of the meetings that a task holds at once.
BLOCK_BYTES = 16 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it is linked to) within the links given, by pointer jumping."""
    nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while not np.array_equal(jumped := root[root], root):
            root = jumped
        if np.array_equal(before, root):
            return nodes, nodes[root]


_EDGE = "a long, b long"


def shrink(edges: DataFrame) -> DataFrame:
    """A spanning forest of each partition's links in their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_a = held_b = np.empty(0, dtype=np.int64)
        for batch in batches:
            a = np.concatenate((held_a, batch.column("a").to_numpy(zero_copy_only=False)))
            b = np.concatenate((held_b, batch.column("b").to_numpy(zero_copy_only=False)))
            if not len(a):
                continue
            held_a, held_b = local_roots(a, b)
            held_a, held_b = held_a[held_a != held_b], held_b[held_a != held_b]
            if len(held_a) > 1 << 20:  # more nodes than a task should hold: hand them over
                yield pa.RecordBatch.from_arrays([pa.array(held_a), pa.array(held_b)], names=["a", "b"])
                held_a = held_b = np.empty(0, dtype=np.int64)
        if len(held_a):
            yield pa.RecordBatch.from_arrays([pa.array(held_a), pa.array(held_b)], names=["a", "b"])

    return edges.mapInArrow(run, _EDGE)


def components(work: Workspace, edges: DataFrame) -> DataFrame:
    """(id, root) of every linked id: the smallest id that links reach from it.

    Each round points every node to its smallest neighbour, follows the pointers to their ends and
    contracts the links onto these; the number of roots at least halves every round.
    """
    edges = work.write(shrink(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")), "edges")
    assigned = None
    while edges.limit(1).count():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("root"))
        parents = work.write(parents, "parents")
        while True:  # pointers fall, so they end at a node that points to itself
            up = parents.select(F.col("id").alias("root"), F.col("root").alias("above"))
            jumped = work.write(parents.join(up, "root").select("id", F.col("above").alias("root")), "jumped")
            moved = jumped.join(parents.withColumnRenamed("root", "was"), "id").where("root <> was").limit(1).count()
            work.drop(parents)
            parents = jumped
            if not moved:
                break
        if assigned is None:
            assigned = parents
        else:
            renamed = parents.select(F.col("id").alias("root"), F.col("root").alias("above"))
            newer = work.write(assigned.join(renamed, "root", "left").select("id", F.coalesce("above", "root").alias("root")), "assigned")
            work.drop(assigned)
            assigned = newer
        ends = parents.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        other = parents.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        half = edges.join(ends, "a").select(F.col("ra").alias("x"), "b")
        contracted = half.join(other, "b").select(F.col("x").alias("a"), F.col("rb").alias("b")).where("a <> b").distinct()
        newer = work.write(shrink(contracted), "edges")
        work.drop(edges)
        if parents is not assigned:
            work.drop(parents)
        edges = newer
    if assigned is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return assigned


def block_counts(members: DataFrame, key: str = "bucket", block: int = BLOCK) -> DataFrame:
    """(``key``, blocks) of the keys with more than ``block`` members; written by the caller, it is joined without bringing a key to one task."""
    return members.groupBy(key).count().where(F.col("count") > block).select(key, F.ceil(F.col("count") / block).cast("int").alias("blocks"))


def blocked(members: DataFrame) -> DataFrame:
    """Members (bucket, ``salt``: any spreading number, ``blocks``: a number for the bucket, ...) as they meet: columns i, j, own are added.

    A bucket of one block (or null) is one meeting (0, 0). A larger one is dealt by salt into
    its blocks, and every unordered pair of blocks is a meeting of its own, so no
    task needs a whole bucket. ``own`` tells which block a row is of.
    """
    blocks = F.coalesce("blocks", F.lit(1))
    placed = members.withColumns({"own": F.pmod(F.xxhash64("salt"), blocks).cast("int"), "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    return placed.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "blocks", "salt")


def whole_runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int = 16_384) -> Iterator[pa.Table]:
    """The rows of sorted batches in tables of about ``rows``, or BLOCK_BYTES, that don't cut a run of equal ``keys``."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows or sum(b.nbytes for b in held) >= BLOCK_BYTES:
            table = pa.Table.from_batches(held).combine_chunks()
            same = np.ones(size, dtype=bool)
            for key in keys:
                column = table.column(key).to_numpy()
                same &= column == column[-1]
            done = size - int(same.sum())  # the last run may go on
            if done:
                yield table.slice(0, done)
            held, size = table.slice(done).to_batches(), size - done
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def run_ends(*columns: np.ndarray) -> np.ndarray:
    """For each row the end of its run of equal values in all ``columns``."""
    differs = np.zeros(len(columns[0]), dtype=bool)
    for column in columns:
        differs[1:] |= column[1:] != column[:-1]
    edges = np.concatenate(([0], np.flatnonzero(differs), [len(differs)]))
    return np.repeat(edges[1:], np.diff(edges))


def expand_pairs(first: np.ndarray, ends: np.ndarray, pairs: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(left, right) for every row and all rows from its ``first`` to its end, about ``pairs`` at once."""
    partners = ends - first
    total, at, n = np.cumsum(partners), 0, len(partners)
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + pairs, side="right")))
        count = partners[at:to]
        left = np.repeat(np.arange(at, to), count)
        yield left, first[left] + np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
        at = to


#: Members of a bucket that meet at once when only pairs across components count, and pairs looked at together.
MEET_AT_ONCE, PAIRS = 2048, 50_000


def across_components(members: DataFrame, decode, linked, pairs: int = PAIRS) -> DataFrame:
    """Links (a, b) between members (bucket, node, comp, blocks, payload) of one bucket but different components.

    ``decode`` turns a list of payloads into what ``linked(decoded, buckets, left rows, right rows)`` tells
    links from; rows of the same left side come together. A meeting hands over a spanning forest of its
    links, so that the output doesn't grow with the pairs.
    """
    meetings = blocked(members.withColumn("salt", F.col("node")))
    meetings = meetings.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "comp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, ("bucket", "i", "j"), MEET_AT_ONCE):
            bucket, i, j, own, node, comp = (rows.column(k).to_numpy() for k in ("bucket", "i", "j", "own", "node", "comp"))
            later = run_ends(bucket, i, j, comp)  # rows of later components in the meeting start here
            decoded, found = None, []
            for left, right in expand_pairs(later, run_ends(bucket, i, j), pairs):
                able = (i[left] == j[left]) | (own[left] != own[right])
                left, right = left[able], right[able]
                if not len(left):
                    continue
                if decoded is None:
                    decoded = decode(rows.column("payload").to_pylist())
                near = linked(decoded, bucket, left, right)
                found.append((node[left[near]], node[right[near]]))
            if found and sum(len(x) for x, _ in found):
                a, b = local_roots(*(np.concatenate(side) for side in zip(*found)))
                yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

    return meetings.mapInArrow(compare, _EDGE)


def pairs_across(members: DataFrame, pairs: int = PAIRS, sided: bool = False) -> DataFrame:
    """All pairs (a < b) of members (bucket, node, comp, blocks) of one bucket but different components, once for each bucket they share.

    With ``sided``, members have a ``side`` and only those of different sides are paired.
    """
    meetings = blocked(members.withColumn("salt", F.col("node")))
    meetings = meetings.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "comp")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, ("bucket", "i", "j")):
            bucket, i, j, own, node, comp = (rows.column(k).to_numpy() for k in ("bucket", "i", "j", "own", "node", "comp"))
            side = rows.column("side").to_numpy() if sided else None
            for left, right in expand_pairs(run_ends(bucket, i, j, comp), run_ends(bucket, i, j), pairs):
                able = (i[left] == j[left]) | (own[left] != own[right])
                if sided:
                    able &= side[left] != side[right]
                x, y = node[left[able]], node[right[able]]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return meetings.mapInArrow(meet, _EDGE)


# What a join looks up by a key that many rows share is written first: Spark then broadcasts it if it is small, and
# else can split the rows of such a key over tasks, which it can't behind an aggregate in the same stage.


def bucket_pivots(work: Workspace, parts: list[DataFrame], common: int = 1) -> tuple[DataFrame, DataFrame]:
    """(members (bucket, node, bytes) of buckets with company, distinct pairs (a, b) of each bucket's smallest node a and the others), both written.

    Pairs must meet so in ``common`` buckets. No bucket lies in two ``parts``: they are shuffled one after the other, and each part's shuffles go before the next.
    """
    written = []
    for buckets in parts:
        crowded = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("pivot")).where("size > 1")
        crowded = work.write(crowded.select("bucket", "pivot"), "crowded")
        written.append(work.write(buckets.join(crowded, "bucket"), "members"))
        if len(parts) > 1:
            work.drop(crowded)
            work.release()
    members = work.union(written)
    pairs = members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    pairs = pairs.distinct() if common == 1 else pairs.groupBy("a", "b").count().where(F.col("count") >= common).select("a", "b")
    return members, work.write(pairs, "pairs")


def mixed_members(work: Workspace, members: DataFrame, roots: DataFrame, block: int = MEET_AT_ONCE) -> DataFrame:
    """Members (bucket, node, bytes, comp, blocks) of the buckets that hold more than one component of ``roots`` (id, root).

    ``blocks`` tells into how many blocks a bucket is dealt: of about ``block`` members and BLOCK_BYTES of their ``bytes``.
    """
    first = roots.select(F.col("id").alias("node"), F.col("root").alias("comp"))
    placed = work.write(members.join(first, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "placed")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("bytes") / BLOCK_BYTES)).cast("int")
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), blocks.alias("blocks")).where("low <> high")
    return placed.join(work.write(mixed.select("bucket", "blocks"), "mixed"), "bucket")


def whole_meetings(work: Workspace, parts: list[DataFrame], roots: DataFrame, block: int = MEET_AT_ONCE) -> DataFrame:
    """All members (bucket, node, comp, blocks) of buckets that hold more than one component of ``roots`` (id, root), written, as :func:`pairs_across` takes them.

    The members (bucket, node) come in ``parts`` that have no bucket in common; each part's shuffles go before the next.
    """
    first = roots.select(F.col("id").alias("node"), F.col("root").alias("comp"))
    written = []
    for part in parts:
        placed = part.join(first, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        blocks = F.ceil(F.count(F.lit(1)) / block).cast("int")
        mixed = placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), blocks.alias("blocks")).where("low <> high")
        mixed = work.write(mixed.select("bucket", "blocks"), "mixed")
        written.append(work.write(placed.join(mixed, "bucket").select("bucket", "node", "comp", "blocks"), "meet"))
        work.drop(mixed)
        work.release()
    return work.union(written)


def shared_pairs(work: Workspace, members: DataFrame, common: int, at_once: int) -> Iterator[DataFrame]:
    """All pairs (a, b) across components that meet in at least ``common`` buckets, written, in rounds of about ``at_once`` meetings.

    Nodes are dealt into groups, and a round holds the members of two groups (or of one): a pair meets in one round, in all its buckets,
    so rounds bound the disk while the pairs may grow with the square of a bucket.
    """
    sizes = members.groupBy("bucket", "comp").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("within"))
    met = sizes.agg(F.sum((F.col("n") * F.col("n") - F.col("within")) / 2)).first()[0] or 0
    groups = max(1, math.ceil(math.sqrt(met / max(1, at_once))))
    group = F.pmod(F.xxhash64(F.lit(groups), "node"), F.lit(groups))
    for x in range(groups):
        for y in range(x, groups):
            sided = x < y
            own = members.withColumn("side", group).where(F.col("side").isin(x, y)) if groups > 1 else members
            own = own.withColumn("blocks", F.ceil(F.col("blocks") * (2 if sided else 1) / groups).cast("int"))
            # Most pairs have one bucket in common, so sums before the shuffle would only cost.
            met = pairs_across(own, sided=sided).repartition("a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
            yield work.write(met.where(F.col("shared") >= common).select("a", "b"), "shared")


def sparse_meetings(work: Workspace, members: DataFrame, longer: Callable[[], DataFrame], steps: list[str], roots: DataFrame, dense: float, block: int = MEET_AT_ONCE) -> DataFrame:
    """What :func:`cut_meetings` gives of members in one part whose longer keys are all at hand: ``longer`` gives (bucket, node, ``steps``)."""
    return cut_meetings(work, [members], lambda crowded: longer().join(crowded, ["bucket", "node"]), steps, roots, dense, block)


def cut_meetings(work: Workspace, parts: list[DataFrame], longer: Callable[[DataFrame], DataFrame], steps: list[str], roots: DataFrame, dense: float, block: int = MEET_AT_ONCE) -> DataFrame:
    """Members (bucket, node, comp, blocks) of buckets that hold more than one component of ``roots`` (id, root), as :func:`pairs_across` takes them.

    The members (bucket, node) come in ``parts`` that have no bucket in common; each part's shuffles go before the next.
    A bucket in which more than ``dense`` pairs a member would meet is cut instead: ``longer`` gives the members it is told (bucket, node, comp) again with what
    lengthens their keys (``steps``), one step after the other as long as a part is too dense. Parts by all steps meet whole.

    This loses pairs whose longer keys differ, so no query uses it: :func:`whole_meetings` loses none.
    """
    first = roots.select(F.col("id").alias("node"), F.col("root").alias("comp"))

    def mixed(rows: DataFrame, *more: str) -> DataFrame:
        low = rows.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("bucket")
        low = work.write(low, "mixed")
        written = work.write(rows.join(low, "bucket").select("bucket", "node", "comp", *more), "mixed-members")
        work.drop(low)
        return written

    written = []
    for part in parts:
        written.append(mixed(part.join(first, "node", "left").withColumn("comp", F.coalesce("comp", "node"))))
        work.release()
    rows, level, done = work.union(written), 0, []
    while True:
        alone = rows.select("bucket", "node", "comp").distinct() if level else rows  # parts of one bucket may fall together again
        sizes = alone.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("within"))
        crowd = (F.col("n").cast("double") * F.col("n") - F.col("within")) / 2 > dense * F.col("n")
        told = work.write(sizes.select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks"), (crowd & F.lit(level < len(steps))).alias("crowd")), "sizes")
        if not level:
            work.release()
        done.append(work.write(alone.join(told.where("NOT crowd").drop("crowd"), "bucket"), "meet"))
        crowded = told.where("crowd").select("bucket")
        if level == len(steps) or not crowded.limit(1).count():
            work.drop(rows, told)
            return reduce(DataFrame.union, done)
        # From the second step on the rows left are those of crowded buckets only.
        cut = rows.join(crowded, "bucket")
        cut = (longer(cut) if level == 0 else cut).withColumn("bucket", F.xxhash64("bucket", steps[level])).drop(steps[level])
        cut = work.write(cut, "longer")
        work.drop(rows, told)
        work.release()
        rows = mixed(cut, *steps[level + 1 :])
        work.drop(cut)
        level += 1


def least_by_root(work: Workspace, classes: DataFrame, least, name: str) -> DataFrame:
    """``classes`` (root, ...) with the smallest of ``least`` among their root's rows as ``name``."""
    return classes.join(work.write(classes.groupBy("root").agg(F.min(least).alias(name)), "smallest"), "root")
