"""Queries over files that Spark writes: bounded sinks, trees under rules, verified copies, manifests of folders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import identity
from ..sources import artifacts, files, trees
from ..sources.files import table
from .registry import query
from .report_queries import _scratch

_TREE_SQL = """(SELECT 'src/r' || n_regionkey || '/' || n_name || '.txt' AS path, n_name || ' ' || n_nationkey AS body FROM nation UNION ALL SELECT 'docs/' || r_name, r_name FROM region)"""


def _tree(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = nation.select(F.concat(F.lit("src/r"), F.col("n_regionkey").cast("string"), F.lit("/"), "n_name", F.lit(".txt")).alias("file"), F.concat_ws(" ", "n_name", F.col("n_nationkey").cast("string")).alias("body"))
    return rows.union(region.select(F.concat(F.lit("docs/"), "r_name"), "r_name")).withColumn("content", F.col("body").cast("binary"))


@query(f"""SELECT path, CAST(octet_length(encode(body)) AS BIGINT) AS byte_count, sha256(body) AS sha256, length(path) % 2 = 0 AS executable FROM {_TREE_SQL}""")
def verified_copy(spark, sf_dir):
    """A tree's identity, the tree copied under it, and what the copy holds."""
    source, copy = _scratch(spark, "tree"), _scratch(spark, "copy")
    artifacts.write(_tree(spark, sf_dir).withColumn("x", F.length("file") % 2 == 0), source, executable="x")
    coverage = trees.Coverage(included=("src", "docs"), excluded_top=(".git",), excluded_anywhere=("__pycache__",))
    trees.verified_copy(trees.identity(spark, source, coverage), source, copy, coverage)
    return trees.identity(spark, copy, coverage)


@query(f"""SELECT path, CAST(CASE WHEN path LIKE 'src/%' THEN octet_length(encode(body)) END AS BIGINT) AS byte_count, CASE WHEN path LIKE 'src/%' THEN sha256(body) END AS sha256, CASE WHEN path LIKE 'src/%' THEN false END AS executable, CASE WHEN path NOT LIKE 'src/%' THEN 'unboundTopLevel' END AS failure
  FROM (SELECT CASE WHEN path LIKE 'docs/%' THEN 'docs' ELSE path END AS path, min(body) AS body FROM {_TREE_SQL} WHERE path NOT LIKE 'src/r3/%' GROUP BY 1)
  UNION ALL SELECT * FROM (VALUES ('Package', NULL, NULL, NULL, 'missing'), ('src/r1/.git', NULL, NULL, NULL, 'nestedReservedName'))""")
def tree_refusals(spark, sf_dir):
    """A tree with an unbound name, a missing one, a reserved one below the top and an excluded folder."""
    path = _scratch(spark, "refused")
    artifacts.write(_tree(spark, sf_dir).unionByName(spark.createDataFrame([(n, "x", b"x") for n in ("src/r1/.git/config", ".git/HEAD", "src/__pycache__/a")], "file string, body string, content binary")), path)
    return trees.snapshot(spark, path, trees.Coverage(("src", "Package"), (".git",), ("src/r3",), ("__pycache__",)))


@query("""WITH c AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents), w AS (SELECT doc_id, n, least(4000, n) AS cap_n FROM c WHERE n > 0)
  SELECT doc_id, CAST(CASE WHEN n <= 4000 THEN n ELSE 3072 END AS BIGINT) AS byte_count FROM w""")
def bounded_files(spark, sf_dir):
    """Each document written as a file in pieces of 1,024 bytes under a cap of 4,000; what the files hold."""
    path = _scratch(spark, "bounded")
    docs = table(spark, sf_dir, "documents").withColumn("content", F.coalesce("text", F.lit("")).cast("binary"))
    pieces = identity.chunk_contents(docs, ["doc_id"], "content", 1024).withColumn("file", F.concat((F.col("doc_id") % 10).cast("string"), F.lit("/"), F.col("doc_id").cast("string")))
    artifacts.write_streams(pieces, path, "file", "chunk_index", "chunk", cap=4000)
    found = files.binary_files(spark, path)
    return found.select(F.element_at(F.split("path", "/"), -1).cast("long").alias("doc_id"), F.col("length").alias("byte_count"))


@query("""SELECT file, CASE WHEN kind = 3 THEN 'outside' WHEN kind = 2 THEN 'missing' WHEN kind = 1 THEN 'content' END AS failure FROM (
  SELECT 'r' || n_regionkey || '/' || (n_nationkey % 4) || '.txt' AS file, 0 AS kind FROM nation WHERE n_nationkey < 10 UNION ALL SELECT 'r' || n_regionkey || '/./x/../same.txt', CASE WHEN n_regionkey = 1 THEN 1 ELSE 0 END FROM nation WHERE n_nationkey IN (0, 1, 2, 3, 4)
  UNION ALL SELECT '../r0/same.txt', 3 UNION ALL SELECT 'same.txt', 2) WHERE file LIKE '%same.txt'""")
def verified_nested_files(spark, sf_dir):
    """Files of one name in several folders, told apart by their place below the root."""
    path = _scratch(spark, "nested")
    region = table(spark, sf_dir, "region").select("r_regionkey").withColumn("digit", F.col("r_regionkey").cast("string"))
    artifacts.write(region.select(F.concat(F.lit("r"), "digit", F.lit("/same.txt")).alias("file"), F.col("digit").cast("binary").alias("content")), path)
    wrong = F.when(F.col("r_regionkey") == 1, F.lit("9")).otherwise(F.col("digit"))
    manifest = region.select(F.concat(F.lit("r"), "digit", F.lit("/./x/../same.txt")).alias("file"), F.lit(1).cast("long").alias("byteCount"), F.sha2(wrong.cast("binary"), 256).alias("sha256"))
    odd = spark.createDataFrame([("../r0/same.txt", 1, ""), ("same.txt", 1, "")], manifest.schema)
    return files.verified(files.image_files(spark, path), manifest.union(odd), path).select("file", "failure")
