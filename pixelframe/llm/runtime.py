"""What all corpus operators share: code shipping, shared storage and batch plumbing."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.shipping import ship

#: Documents whose crc32 of the id falls in this residue class are never learnt from.
HELD_OUT_MODULUS, HELD_OUT_REMAINDER = 4, 2
#: Rows of one Arrow batch sent to Python, so that a batch of long texts stays small.
ARROW_ROWS = 512
#: Bytes after which a Python operator hands over what it has produced.
FLUSH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable on executors and bound the Arrow batches, unless the session has bounds of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # Spark's default
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set and everything runs in one process."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "pixelframe-shared")
    return folder.rstrip("/")


class Workspace:
    """Written intermediate tables of one query: lineage is cut at files in shared storage, which go when the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        self._count = 0
        self._written: list[DataFrame] = []

    def new_path(self, label: str) -> str:
        self._count += 1
        return f"{self.path}/{self._count:03d}-{label}"

    def write(self, frame: DataFrame, label: str) -> DataFrame:
        """Write ``frame`` and return it as read back."""
        path = self.new_path(label)
        frame.write.mode("overwrite").option("compression", "zstd").parquet(path)
        read = self.spark.read.schema(frame.schema).parquet(path)
        read._pixelframe_path = path
        self._written.append(read)
        return read

    def union(self, written: list[DataFrame]) -> DataFrame:
        """Written tables of one schema as one, which is dropped as one."""
        read = reduce(DataFrame.union, written)
        read._pixelframe_parts = written
        return read

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        for frame in (part for frame in frames for part in getattr(frame, "_pixelframe_parts", [frame])):
            path = jvm.org.apache.hadoop.fs.Path(frame._pixelframe_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            self._written = [kept for kept in self._written if kept is not frame]

    def release(self) -> None:
        """Let Spark delete the shuffles of what is written by now: it does so once no plan that used them is left, which only a collection tells it."""
        for _ in range(3):  # what holds a plan may itself be held by what only a collection frees, and Spark is told a little later
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)

    def keep_only(self, *frames: DataFrame) -> None:
        """Delete every table but those that the result still reads."""
        self.drop(*(f for f in self._written if not any(f is kept for kept in frames)))


def held_out(doc_id: str = "doc_id"):
    """True where a document is kept for evaluation only (null ids: false)."""
    key = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(key % HELD_OUT_MODULUS == HELD_OUT_REMAINDER, F.lit(False))


def identified_texts(docs: DataFrame) -> DataFrame:
    """doc_id and whole text (null: empty) as UTF-8 bytes, whatever other columns there are."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw"))


class Rows:
    """Collects output rows and gives Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.columns, self.bytes = schema, [[] for _ in schema], 0

    def add(self, *values, size: int = 64) -> None:
        for column, value in zip(self.columns, values):
            column.append(value)
        self.bytes += size

    @property
    def full(self) -> bool:
        return self.bytes >= FLUSH_BYTES

    def batch(self) -> pa.RecordBatch:
        arrays = [pa.array(column, type=field.type) for column, field in zip(self.columns, self.schema)]
        self.columns, self.bytes = [[] for _ in self.schema], 0
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)

    def __bool__(self) -> bool:
        return bool(self.columns[0])


def raw_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts as bytes) of each batch with columns doc_id and raw."""
    for batch in batches:
        if batch.num_rows:
            yield batch.column("doc_id").to_pylist(), batch.column("raw").to_pylist()
