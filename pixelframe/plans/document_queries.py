"""Queries over whole documents: canonical spelling, equality, identity, and stability with nulls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import documents
from ..operators import identity, statistics
from ..sources import files
from ..sources.files import table
from .registry import query
from .report_queries import _scratch


@query("""SELECT r_regionkey, sha256('{' || chr(10) || '  "body": {' || chr(10) || '    "a": ' || CASE WHEN r_regionkey = 0 THEN '[]' ELSE '[' || chr(10) || string_agg('      ' || i, ',' || chr(10) ORDER BY i) || chr(10) || '    ]' END || ',' || chr(10) || '    "half": ' || r_regionkey || '.5,' || chr(10)
    || '    "none": null,' || chr(10) || '    "z": {' || chr(10) || '      "k": "' || r_name || '\\u00e9\\n"' || chr(10) || '    }' || chr(10) || '  },' || chr(10) || '  "r_regionkey": ' || r_regionkey || chr(10) || '}' || chr(10)) AS sha256
  FROM (SELECT r_regionkey, r_name, unnest(CASE WHEN r_regionkey = 0 THEN [0] ELSE range(0, r_regionkey) END) AS i FROM region) GROUP BY r_regionkey, r_name""")
def canonical_documents(spark, sf_dir):
    """Nested reports written as files of their own, and what the files hold."""
    key = F.col("r_regionkey").cast("int")
    body = F.struct(F.create_map(F.lit("k"), F.concat("r_name", F.lit("\u00e9\n"))).alias("z"), F.lit(None).cast("string").alias("none"), F.slice(F.sequence(F.lit(0), key), F.lit(1), key).alias("a"), (key + 0.5).cast("double").alias("half"))
    path = _scratch(spark, "documents")
    files.write_documents(table(spark, sf_dir, "region").select("r_regionkey", body.alias("body"), F.concat(key.cast("string"), F.lit(".json")).alias("name")), path, "name")
    found = spark.read.format("binaryFile").load(path)
    return found.select(F.regexp_extract("path", r"([0-9]+)\.json$", 1).cast(table(spark, sf_dir, "region").schema["r_regionkey"].dataType).alias("r_regionkey"), F.sha2("content", 256).alias("sha256"))


@query("""SELECT o_orderkey, CAST(2 AS BIGINT) AS reports, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 2 WHEN o_orderkey % 7 = 0 THEN 1 ELSE 1 END AS BIGINT) AS contents, o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AS deterministic FROM orders""")
def document_pairs(spark, sf_dir):
    """Two reports of each order, keys in another order and with other blanks; some differ in a nested value, some aren't JSON."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    nested = F.when(key % 5 == 0, F.lit("other")).otherwise(status)
    first = F.concat(F.lit('{"id":'), key.cast("string"), F.lit(',"body":{"s":"'), status, F.lit('","n":[1,2.50]}}'))
    second = F.when((key % 7 == 0) & (key % 5 != 0), F.lit("{no json")).otherwise(F.concat(F.lit('{ "body" : {"n":[1, 2.5], "s": "'), nested, F.lit('"},\n "id": '), key.cast("string"), F.lit("}")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array(first, second)).alias("report"))
    return statistics.pair_determinism(rows, "o_orderkey", F.col("report"), documents=True)


@query("""SELECT o_orderkey, '/status' AS path, 'changed' AS status FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, unnest(['/tags', '/tags/0', '/tags/1']), 'missing' FROM orders WHERE o_orderkey % 7 = 0
  UNION ALL SELECT o_orderkey, unnest(['/extra~1x', '/extra~1x/n']), 'added' FROM orders WHERE o_orderkey % 11 = 0 UNION ALL SELECT o_orderkey, unnest(['/tags/0', '/tags/1']), 'changed' FROM orders WHERE o_orderkey % 13 = 0 AND o_orderkey % 7 <> 0""")
def document_differences(spark, sf_dir):
    """Recorded and rebuilt documents of orders: values changed, places missing and added, arrays in another order."""
    key, tags = F.col("o_orderkey"), F.array("o_orderpriority", F.lit("x"))
    orders = table(spark, sf_dir, "orders")
    recorded = F.to_json(F.struct(key.alias("id"), F.col("o_orderstatus").alias("status"), tags.alias("tags")))
    turned = F.when(key % 7 == 0, F.lit(None)).when(key % 13 == 0, F.reverse(tags)).otherwise(tags)
    rebuilt = F.to_json(F.struct(turned.alias("tags"), F.when(key % 5 == 0, F.lit("changed")).otherwise(F.col("o_orderstatus")).alias("status"), key.alias("id"), F.when(key % 11 == 0, F.struct(F.lit(1).alias("n"))).alias("extra/x")))
    return documents.differences(orders.select("o_orderkey", recorded.alias("d")), orders.select("o_orderkey", rebuilt.alias("d")), "o_orderkey", "d")


@query("""SELECT CAST(count(*) AS BIGINT) AS file_count, sha256('{"coverage":{"mode":"all"},"files":[' || string_agg('{"byteCount":' || octet_length(encode(coalesce(text, ''))) || ',"executable":' || (doc_id % 2 = 0) || ',"path":"documents/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '","sha256":"' || sha256(coalesce(text, '')) || '"}', ',' ORDER BY doc_id)
  || '],"identityID":"documents","schemaVersion":2}') AS identity_sha256 FROM documents""")
def corpus_identity(spark, sf_dir):
    """One digest of all documents as files of a tree, hashed range by range."""
    path = F.concat(F.lit("documents/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    found = identity.manifest(table(spark, sf_dir, "documents"), path, F.coalesce("text", F.lit("")))
    return identity.canonical_digest(found.withColumn("executable", F.right("path", F.lit(1)).isin(*"02468")), "documents", 2, {"mode": "all"})


@query("""SELECT o_custkey, CAST(count(*) AS BIGINT) AS reports, count(*) FILTER (WHERE o_orderkey % 2 = 0) IN (0, count(*)) AS mark_stable FROM orders GROUP BY 1""")
def null_stability(spark, sf_dir):
    """A field that is null or a zero character: two values, not one."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 2 == 0, F.lit("\0")).alias("mark"))
    return statistics.stable(rows, ["o_custkey"], ["mark"])
