"""Image files, JSON reports and manifests, source trees, runtime facts, and sinks."""

from __future__ import annotations

import platform

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents
from ..shipping import ship
from . import artifacts, trees

MANIFEST_CASES = "id string, file string, kind string, byteCount long, sha256 string, format string, width int, height int, expectedError string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def binary_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """The files below a folder, in a bounded number of tasks: Spark counts 4 MB for opening one, so by itself it gives every 32 small files a task."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).coalesce(8 * spark.sparkContext.defaultParallelism)


def image_files(spark: SparkSession, path: str, cap: int | None = None, pattern: str | None = None) -> DataFrame:
    """path, length and content of files; with ``cap`` only those that fit it, by length, before content is read."""
    files = binary_files(spark, path, pattern)
    if cap is not None:
        files = files.where(F.col("length") <= cap)
    return files.select("path", "length", "content")


def decoded_files(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of JPEG, PNG and GIF files by Spark's image source: path, width, height, channels, pixels (rows of BGR or BGRA) and failure.

    The source takes files that a container walk refuses, so probe first and join on the path.
    """
    rows = spark.read.format("image").option("dropInvalid", "false").load(path).select("image.*")
    bad = F.col("width") <= 0
    return rows.select(F.col("origin").alias("path"), "width", "height", F.col("nChannels").alias("channels"), F.when(~bad, F.col("data")).alias("pixels"), F.when(bad, F.lit("decodeFailed")).alias("failure"))


def oversized(spark: SparkSession, path: str, cap: int) -> DataFrame:
    """Files beyond the cap with their failure; content isn't read."""
    files = binary_files(spark, path)
    return files.where(F.col("length") > cap).select("path", "length", F.lit("encodedBytesExceeded").alias("failure"))


def json_reports(spark: SparkSession, paths: str | list[str], schema: str, version: tuple[str, object] | None = None) -> DataFrame:
    """One row a document, read by a fixed subset schema, with its file; documents of another version are refused."""
    rows = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").option("pathGlobFilter", "*.json").json(paths).withColumn("report_file", F.col("_metadata.file_path"))
    if version is None:
        return rows
    name, value = version
    wrong = F.raise_error(F.concat(F.lit(f"unexpected {name} in "), F.col("report_file")))
    return rows.withColumn(name, F.when(F.col(name) == value, F.col(name)).otherwise(wrong.cast(rows.schema[name].dataType)))


def manifest_cases(spark: SparkSession, path: str) -> DataFrame:
    return json_reports(spark, path, f"schemaVersion int, cases array<struct<{', '.join(c.replace(' ', ': ', 1) for c in MANIFEST_CASES.split(', '))}>>").select("schemaVersion", F.explode("cases").alias("c")).select("schemaVersion", "c.*")


def plain_path(path: Column) -> Column:
    """A path without scheme and authority, its dot segments resolved."""
    parts = F.filter(F.split(F.regexp_replace(path, "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", ""), "/"), lambda p: (p != "") & (p != "."))
    start = F.array().cast("array<string>")
    resolved = F.aggregate(parts, start, lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.lit(0), F.size(done) - 1))).otherwise(F.concat(done, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(resolved, "/"))


def relative(path: Column, root: str) -> Column:
    """A path's place below ``root``, null where it lies elsewhere."""
    plain, start = plain_path(path), F.concat(F.regexp_replace(plain_path(F.lit(root)), "/$", ""), F.lit("/"))
    return F.when(F.startswith(plain, start) & (F.length(plain) > F.length(start)), F.substr(plain, F.length(start) + 1))


def contained(path: Column, root: str) -> Column:
    """Whether a path, its dot segments resolved, lies under ``root``."""
    return relative(path, root).isNotNull()


def verified(files: DataFrame, manifest: DataFrame, root: str) -> DataFrame:
    """Manifest rows (file, byteCount, sha256) with the content of that file below ``root``.

    failure: ``outside`` for a name that leaves the root, ``missing``, ``size`` or ``content``. Files and names are joined by their place below the root.
    """
    named = files.select(relative(F.col("path"), root).alias("_place"), "content").where("_place IS NOT NULL")
    absolute = F.startswith("file", F.lit("/"))
    placed = manifest.withColumn("_place", F.when(~absolute, relative(F.concat(F.lit(root.rstrip("/") + "/"), F.col("file")), root)))
    both = placed.join(named, "_place", "left")
    size, digest = F.octet_length("content") == F.col("byteCount"), F.sha2("content", 256) == F.col("sha256")
    failure = F.when(F.col("_place").isNull(), "outside").when(F.col("content").isNull(), "missing").when(~F.coalesce(size, F.lit(False)), "size").when(~F.coalesce(digest, F.lit(False)), "content")
    return both.withColumn("failure", failure).drop("_place")


def source_tree(spark: SparkSession, root: str, excluded: tuple[str, ...] = (".git", ".build", "__pycache__")) -> DataFrame:
    """path, byte_count, sha256 and executable of a tree's files, links refused; rules of coverage are in :mod:`trees`."""
    return trees.identity(spark, root, trees.Coverage(excluded_anywhere=excluded))


def symbols(spark: SparkSession, path: str) -> DataFrame:
    """Public symbols of symbol-graph documents: module, id, kind, name."""
    schema = "module struct<name: string>, symbols array<struct<identifier: struct<precise: string>, kind: struct<identifier: string>, names: struct<title: string>, accessLevel: string>>"
    rows = json_reports(spark, path, schema).select(F.col("module.name").alias("module"), F.explode("symbols").alias("s"))
    return rows.where("s.accessLevel IN ('public', 'open')").select("module", F.col("s.identifier.precise").alias("id"), F.col("s.kind.identifier").alias("kind"), F.col("s.names.title").alias("name")).orderBy("module", "name", "id")


def case_runs(cases: DataFrame, case: str, repetitions: int, argv: list[str], seconds: int = 600) -> DataFrame:
    """Runs a command in a process of its own for each case and repetition, which it gets as its last two arguments: case, repetition, exit_code and output."""
    import subprocess

    ship(cases.sparkSession)
    planned = cases.select(F.col(case).cast("string").alias("case"), F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("repetition"))

    def run(frames):
        for frame in frames:
            done = [subprocess.run([*argv, c, str(r)], capture_output=True, text=True, timeout=seconds, check=False) for c, r in zip(frame["case"], frame["repetition"])]
            yield frame.assign(exit_code=[d.returncode for d in done], output=[d.stdout for d in done])

    return planned.mapInPandas(run, "case string, repetition int, exit_code int, output string")


def runtime_facts(spark: SparkSession) -> DataFrame:
    """One row: what a measurement's environment is told by."""
    jvm = spark.sparkContext._jvm.System
    return spark.createDataFrame([(spark.version, jvm.getProperty("java.version"), platform.python_version(), platform.machine(), spark.sparkContext.defaultParallelism)], "spark string, java string, python string, machine string, parallelism int")


def canonical_json(rows: DataFrame) -> DataFrame:
    """Each row as compact JSON with keys in order at every depth."""
    return rows.select(documents.of_rows(rows).alias("json"))


def write_report(rows: DataFrame, path: str) -> None:
    """Rows as canonical JSON lines."""
    canonical_json(rows).write.mode("overwrite").text(path)


def write_documents(rows: DataFrame, folder: str, name: str, indent: int = 2) -> None:
    """Each row as a JSON file of its own in a new folder, with keys in order at every depth and lines indented; ``name`` is the column of file names and not written."""
    body = rows.drop(name)
    text = F.concat(documents.of_rows(body, indent, ascii_only=True), F.lit("\n"))
    artifacts.write(rows.select(F.col(name).alias("file"), text.cast("binary").alias("content")), folder)


def write_artifacts(images: DataFrame, folder: str, name: str = "file", content: str = "content") -> None:
    """Each row's bytes as a file of a new folder, all or none, wherever Spark and pyarrow can write; names that leave the folder are refused."""
    artifacts.write(images, folder, name, content)
