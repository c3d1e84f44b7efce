"""Integrity manifests: sizes, digests, canonical identity, comparison, and fixed-size chunks."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions.numeric import ceiled
from ..shared import held
from ..shipping import ship
from . import scans


def manifest(rows: DataFrame, path: Column, content: Column) -> DataFrame:
    """path, byte_count and sha256 of each row's content."""
    blob = content.cast("binary")
    return rows.select(path.alias("path"), F.octet_length(blob).cast("long").alias("byte_count"), F.sha2(blob, 256).alias("sha256"))


def compared(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Manifest rows that are missing, extra or different, by path."""
    both = expected.toDF("path", "byte_count", "sha256").join(found.toDF("path", "_bytes", "_sha"), "path", "full_outer")
    status = (
        F.when(F.col("_sha").isNull(), "missing")
        .when(F.col("sha256").isNull(), "extra")
        .when(F.col("byte_count") != F.col("_bytes"), "size")
        .when(F.col("sha256") != F.col("_sha"), "content")
    )
    return both.select("path", status.alias("status")).where(F.col("status").isNotNull())


def canonical_digest(files: DataFrame, identity: str, version: int = 1, coverage: dict | None = None) -> DataFrame:
    """SHA-256 of the compact JSON of all entries in path order: one row, file_count and identity_sha256.

    Range partitions of ``files`` (path, byte_count, sha256, executable) spell their entries in parallel as blocks of text, written to the shared folder; the hash's
    state then goes from partition to partition in order, each hashed where it is read. A task holds a block, the driver a state of 112 bytes.
    """
    spark = ship(files.sparkSession)
    ends = json.dumps(identity, ensure_ascii=False), json.dumps({"coverage": coverage}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))[:-1] + "," if coverage is not None else "{"

    def spell(batches):
        for batch in batches:
            rows = batch.to_pylist()
            texts = [json.dumps({"byteCount": r["byte_count"], "executable": r["executable"], "path": r["path"], "sha256": r["sha256"]}, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for r in rows]
            yield pa.RecordBatch.from_pydict({"block": ["".join("," + t for t in texts).encode()], "n": [len(rows)]}) if rows else pa.RecordBatch.from_pydict({"block": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})

    ordered = files.select("path", "byte_count", "sha256", "executable").repartitionByRange("path").sortWithinPartitions("path")
    blocks = held(ordered.mapInArrow(spell, "block binary, n long")).rdd
    state, count = hashing.updated(hashing.started(), (ends[1] + '"files":[').encode()), 0

    def step(state: bytes, fresh: bool):
        def run(rows):
            now, done = state, 0
            for row in rows:
                block = bytes(row["block"])
                now, done = hashing.updated(now, block[1:] if fresh and not done else block), done + row["n"]
            yield now, done

        return run

    for part in range(blocks.getNumPartitions()):
        state, n = spark.sparkContext.runJob(blocks, step(state, count == 0), [part])[0]
        count += n
    digest = hashing.finished(hashing.updated(state, f'],"identityID":{ends[0]},"schemaVersion":{version}}}'.encode()))
    return spark.createDataFrame([(count, digest)], "file_count long, identity_sha256 string")


def chunks(rows: DataFrame, key: list[str], content: Column, size: int) -> DataFrame:
    """Fixed-size chunks of a byte column: chunk_index, chunk_byte_count and cumulative_byte_count; empty content has none."""
    sized = rows.select(*key, F.octet_length(content.cast("binary")).cast("long").alias("_n")).where("_n > 0")
    exploded = sized.select(*key, "_n", F.explode(F.sequence(F.lit(0).cast("long"), ceiled(F.col("_n"), size) - 1)).alias("chunk_index"))
    upto = F.least(F.col("_n"), (F.col("chunk_index") + 1) * size)
    return exploded.select(*key, "chunk_index", (upto - F.col("chunk_index") * size).alias("chunk_byte_count"), upto.alias("cumulative_byte_count"))


def chunk_contents(rows: DataFrame, key: list[str], content: str, size: int) -> DataFrame:
    """The chunks of :func:`chunks` with their bytes, as input of a progressive session."""
    sized = rows.select(*key, F.col(content).cast("binary").alias("_c"), F.octet_length(F.col(content).cast("binary")).cast("long").alias("_n")).where("_n > 0")
    exploded = sized.select(*key, "_c", F.explode(F.sequence(F.lit(0).cast("long"), ceiled(F.col("_n"), size) - 1)).alias("chunk_index"))
    return exploded.select(*key, "chunk_index", F.substring("_c", (F.col("chunk_index") * size + 1).cast("int"), F.lit(size)).alias("chunk"))


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def symmetric_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    a = left.select(key).exceptAll(right.select(key)).withColumn("side", F.lit("left"))
    return a.union(right.select(key).exceptAll(left.select(key)).withColumn("side", F.lit("right")))


def set_equality(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys only on the left, only on the right, and whether the sets are equal."""
    sides = left.select(key).distinct().withColumn("_l", F.lit(1)).join(right.select(key).distinct().withColumn("_r", F.lit(1)), key, "full_outer")
    counted = sides.agg(F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"))
    return counted.withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def running_bytes(rows: DataFrame, key: str, order: str, size: str) -> DataFrame:
    return scans.running_sum(rows, [key], [order], size, "running_bytes")


def bounded_writes(rows: DataFrame, key: str, order: str, size: str, cap: int) -> DataFrame:
    """Bytes that a capped sink takes of each write: whole writes up to the first that would cross the cap, none from there on."""
    total = running_bytes(rows, key, order, size)
    return total.withColumn("accepted", F.when(F.col("running_bytes") <= cap, F.col(size)).otherwise(F.lit(0)))
