"""Source trees: what a tree holds, listed and hashed by executors under rules of coverage, and verified copies of it.

A tree is listed level by level: the folders of a level are dealt over tasks, each of which lists its own, and the entries are written before
the next level is listed. Nothing but the number of levels depends on the driver. A rule that an entry breaks is its ``failure``:

* ``unboundTopLevel``: a name at the top that is neither included nor excluded; ``missing``: an included one that isn't there
* ``nestedReservedName``: a name below the top that is excluded at the top only
* ``symbolicLink``, ``unsupportedEntry``: neither file nor folder
* ``changedWhileReading``: size, time, mode or place of a file not the same before and after it was read

A tree is one that driver and executors mount, since links and modes show nowhere else.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import held
from ..shipping import ship
from .artifacts import copy_files, local_path, read_stable, resolved

#: Entries of one batch that a listing hands over.
_ENTRIES = 10_000


@dataclass(frozen=True)
class Coverage:
    """Which entries belong to a tree. Without ``included`` every name at the top does."""

    included: tuple[str, ...] | None = None
    excluded_top: tuple[str, ...] = ()
    excluded_subtrees: tuple[str, ...] = ()
    excluded_anywhere: tuple[str, ...] = ()

    def judge(self, path: str) -> str | None:
        """'skip', a failure, or None for an entry that belongs to the tree; a folder's own entries are judged once it does."""
        parts = path.split("/")
        if parts[-1] in self.excluded_anywhere or path in self.excluded_subtrees:
            return "skip"
        if len(parts) > 1:
            return "nestedReservedName" if parts[-1] in self.excluded_top else None
        if parts[0] in self.excluded_top:
            return "skip"
        return None if self.included is None or parts[0] in self.included else "unboundTopLevel"


def listing(spark: SparkSession, root: str, coverage: Coverage = Coverage()) -> DataFrame:
    """path and failure of every file of a tree, and of every entry that breaks a rule."""
    ship(spark)
    top = local_path(resolved(spark, root))
    schema = pa.schema([("path", pa.string()), ("folder", pa.bool_()), ("failure", pa.string())])

    def entries(folder: str) -> Iterator[tuple]:
        seen = set()
        with os.scandir(os.path.join(top, folder)) as found:
            for entry in found:
                path = f"{folder}/{entry.name}".lstrip("/")
                seen.add(path)
                verdict = coverage.judge(path)
                if verdict == "skip":
                    continue
                link = entry.is_symlink()
                failure = verdict or ("symbolicLink" if link else None if entry.is_file() or entry.is_dir() else "unsupportedEntry")
                yield path, failure is None and entry.is_dir(follow_symlinks=False), failure
        if not folder:
            yield from ((name, False, "missing") for name in coverage.included or () if name not in seen)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                for row in entries(folder):
                    rows.append(row)
                    if len(rows) >= _ENTRIES:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
                        rows = []
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)

    level, levels = spark.createDataFrame([("",)], "path string"), []
    while True:
        found = held(level.mapInArrow(scan, "path string, folder boolean, failure string"))
        levels.append(found.where("NOT folder").select("path", "failure"))
        level = found.where("folder").select("path")
        if level.isEmpty():
            return reduce(DataFrame.unionAll, levels)
        level = level.repartition(spark.sparkContext.defaultParallelism)


def snapshot(spark: SparkSession, root: str, coverage: Coverage = Coverage()) -> DataFrame:
    """path, byte_count, sha256, executable and failure of a tree's entries; files are dealt over tasks and read in blocks."""
    listed = held(listing(spark, root, coverage))
    top = local_path(resolved(spark, root))
    schema = pa.schema([("path", pa.string()), ("byte_count", pa.int64()), ("sha256", pa.string()), ("executable", pa.bool_()), ("failure", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, failure in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size, digest, executable, failure = (None, None, None, failure) if failure else read_stable(top, path)
                rows.append({"path": path, "failure": failure} | ({} if failure else {"byte_count": size, "sha256": digest, "executable": executable}))
            yield pa.RecordBatch.from_pylist(rows, schema)

    spread = listed.repartition(max(1, min(8 * spark.sparkContext.defaultParallelism, listed.count())))
    return spread.mapInArrow(read, "path string, byte_count long, sha256 string, executable boolean, failure string")


def _first_failure(frame: DataFrame) -> str | None:
    row = frame.where("failure IS NOT NULL").select("path", "failure").orderBy("path").first()
    return row and f"{row['failure']}: {row['path']} ({re.sub('([A-Z])', lambda m: ' ' + m[1].lower(), row['failure'])})"


def identity(spark: SparkSession, root: str, coverage: Coverage = Coverage()) -> DataFrame:
    """The snapshot of a tree that breaks no rule, written; the first entry that does raises an error."""
    found = held(snapshot(spark, root, coverage))
    if failure := _first_failure(found):
        raise ValueError(failure)
    return found.drop("failure")


def differences(known: DataFrame, spark: SparkSession, root: str, coverage: Coverage = Coverage()) -> DataFrame:
    """Rows of an identity that a copy can't be made from: path and failure; of the tree only names are read.

    ``unsafePath``, ``invalidByteCount``, ``invalidDigest``, ``invalidFlag``: malformed rows; ``repeated``; ``missing`` from the tree or ``extra`` in it, and what the listing refuses.
    """
    parts = F.split("path", "/")
    safe = F.coalesce(~F.exists(parts, lambda p: p.isin("", ".", "..")) & ~F.contains("path", F.lit("\\")), F.lit(False))
    rule = (
        F.when(~safe, "unsafePath")
        .when(F.coalesce(F.col("byte_count") < 0, F.lit(True)), "invalidByteCount")
        .when(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "invalidDigest")
        .when(F.col("executable").isNull(), "invalidFlag")
    )
    rows = known.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min(rule).alias("malformed"))
    both = rows.withColumn("known", F.lit(True)).join(listing(spark, root, coverage).withColumn("listed", F.lit(True)), "path", "full_outer")
    failure = F.coalesce("malformed", F.when(F.col("n") > 1, "repeated"), "failure", F.when(F.col("listed").isNull(), "missing"), F.when(F.col("known").isNull(), "extra"))
    return both.select("path", failure.alias("failure")).where("failure IS NOT NULL")


def verified_copy(known: DataFrame, root: str, destination: str, coverage: Coverage = Coverage()) -> None:
    """Copies the tree that ``known`` (path, byte_count, sha256, executable) describes to a new folder outside of it, all or nothing.

    The identity must cover the tree just as it is; every file's size, digest and flag are compared with it while it is copied, and the folder appears once all agree.
    """
    spark = known.sparkSession
    source, target = local_path(resolved(spark, root)), resolved(spark, destination)
    if target.startswith("file:") and f"{os.path.realpath(local_path(target))}/".startswith(f"{os.path.realpath(source)}/"):
        raise ValueError("the copy must lie outside of the tree")
    known = held(known.select("path", "byte_count", "sha256", "executable"))
    if failure := _first_failure(differences(known, spark, root, coverage)):
        raise ValueError(failure)
    copy_files(known, root, destination)
