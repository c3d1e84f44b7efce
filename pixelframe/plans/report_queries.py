"""Queries over report-like tables: checkpoint findings, report shapes, summaries, sets, orders, functions, and files written and read again."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import DecodeLimits
from ..functions.numeric import ceiled, half_up, micro, truncated, within
from ..operators import admission, identity, joins, metrics, reports, statistics
from ..shipping import spread
from ..sources import files
from ..sources.files import table
from .queries import _QUANTISED, _STATS, _lines, _pairs
from .registry import query

_CHECKPOINTS = """(SELECT l_orderkey, l_linenumber AS line, l_linenumber % 3 <> 0 AS fa, l_returnflag AS fd, l_linestatus AS fs, (l_linenumber % 3 <> 0) <> (CAST(l_quantity AS BIGINT) % 17 = 0) AS sa, CASE WHEN l_partkey % 11 = 0 THEN 'x' ELSE l_returnflag END AS sd, CASE WHEN l_suppkey % 2 = 0 THEN 'F' ELSE l_linestatus END AS ss FROM lineitem)"""
_ATTEMPTS = f"""(SELECT l_orderkey, bool_and(fa = sa AND fd = sd) AS attempts_equal, count(DISTINCT CASE WHEN fa THEN fd END) = 1 AS stable, CAST(count(*) AS BIGINT) AS checkpoints, bool_or(line = 1 AND fa) AS drawn FROM {_CHECKPOINTS} GROUP BY 1)"""


def _checkpoints(spark, sf_dir) -> DataFrame:
    shown = F.col("l_linenumber") % 3 != 0
    fresh = F.struct(shown.alias("available"), F.col("l_returnflag").alias("digest"), F.col("l_linestatus").alias("status"))
    digest = F.when(F.col("l_partkey") % 11 == 0, F.lit("x")).otherwise(F.col("l_returnflag"))
    status = F.when(F.col("l_suppkey") % 2 == 0, F.lit("F")).otherwise(F.col("l_linestatus"))
    sequential = F.struct((shown != (F.col("l_quantity").cast("long") % 17 == 0)).alias("available"), digest.alias("digest"), status.alias("status"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", fresh.alias("fresh"), sequential.alias("sequential"), (F.col("l_linenumber") == 1).alias("entropy_end"))


@query(f"SELECT l_orderkey, attempts_equal, stable, checkpoints FROM {_ATTEMPTS}")
def attempt_equality(spark, sf_dir):
    return joins.attempts_equal(_checkpoints(spark, sf_dir), ["l_orderkey"], "fresh", "sequential")


def _statuses(column: str) -> str:
    return f"(SELECT list_sort(list({column} || ':' || n)) FROM (SELECT {column}, count(*) AS n FROM {_CHECKPOINTS} GROUP BY 1))"


@query(f"""SELECT CAST(count(*) AS BIGINT) AS scan_count, CAST(sum(checkpoints) AS BIGINT) AS checkpoint_count, CAST(count(*) FILTER (WHERE drawn) AS BIGINT) AS entropy_end_drawn, CAST(count(*) FILTER (WHERE attempts_equal) AS BIGINT) AS attempts_equal_count, CAST(count(*) FILTER (WHERE stable) AS BIGINT) AS stable_count,
  {_statuses('fs')} AS fresh_statuses, {_statuses('ss')} AS sequential_statuses FROM {_ATTEMPTS}""")
def checkpoint_findings(spark, sf_dir):
    return joins.checkpoint_findings(_checkpoints(spark, sf_dir), ["l_orderkey"], "fresh", "sequential", "entropy_end")


_SCANS = """(SELECT l_orderkey, l_linenumber AS line, max(l_linenumber * 1000 + l_partkey) AS off, 5000000 + l_orderkey AS total, max(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS cents FROM lineitem GROUP BY ALL)"""


@query(f"""SELECT l_orderkey, CAST(b.off - a.off AS BIGINT) AS additional_bytes, CAST(sign(b.off - a.off) * (abs(b.off - a.off) * 1000000 // a.total) AS BIGINT) AS additional_ppm, b.cents - a.cents AS psnr_gain FROM {_SCANS} a JOIN {_SCANS} b USING (l_orderkey) WHERE a.line = 2 AND b.line = 3""")
def scan_deltas(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("scan"), (F.col("l_linenumber") * 1000 + F.col("l_partkey")).cast("long").alias("off"), (F.col("l_orderkey") + 5_000_000).alias("total"), F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long").alias("cents"))
    return joins.scan_deltas(rows, ["l_orderkey"], "scan", "off", "cents", "total", 2)


@query("""SELECT k, CASE WHEN k % 31 = 0 THEN 'schema' WHEN k % 29 = 0 THEN 'build' WHEN k % 23 = 0 THEN 'case' WHEN k % 19 = 0 THEN 'chunk size' WHEN k % 17 = 0 THEN 'runtime' WHEN k % 13 = 0 THEN 'low power' WHEN k % 11 = 0 THEN 'thermal state' WHEN bytes <= 0 THEN 'encoded bytes' WHEN k % 37 = 0 THEN 'digests' WHEN k % 7 = 0 THEN 'output'
  WHEN k % 41 = 0 THEN 'generation count' WHEN k % 43 = 0 THEN 'generation numbers' WHEN k % 47 = 0 THEN 'source bytes' WHEN k % 5 = 0 THEN 'fractions' WHEN k % 53 = 0 THEN 'generation digests' END AS broken FROM (SELECT c_custkey AS k, CAST(floor(c_acctbal) AS BIGINT) AS bytes FROM customer)""")
def report_shapes(spark, sf_dir):
    """Quality reports, one for each customer, each with at most a few flaws: the first rule that each breaks."""
    k = F.col("k")

    def flawed(step, bad, good):
        return F.when(k % step == 0, bad).otherwise(good)

    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.floor("c_acctbal").cast("long").alias("encoded_bytes"))
    number = flawed(43, F.lit(2), F.lit(1))
    last = flawed(41, F.lit(3), F.lit(4))
    bytes_of = lambda g: F.when((g == 2) & (k % 47 == 0), F.lit(10)).otherwise(g * 10).cast("long")
    generation = lambda g: F.struct((g + number - 1).alias("generation"), bytes_of(g).alias("source_bytes"), (micro(bytes_of(g), F.col("encoded_bytes")) + flawed(5, F.lit(1), F.lit(0))).alias("fraction_ppm"), flawed(53, F.lit(""), F.lit("d")).alias("sha256"))
    made = rows.select(
        "k", "encoded_bytes", flawed(31, F.lit(2), F.lit(1)).alias("schema_version"), flawed(29, F.lit("debug"), F.lit("release")).alias("build"), flawed(23, F.lit("other"), F.lit("chunk-1k")).alias("case_id"),
        flawed(19, F.lit(2048), F.lit(1024)).alias("chunk_size"), flawed(17, F.lit(None).cast("string"), F.lit("r")).alias("runtime"), F.lit("f#impl=1#contract=2").alias("fingerprint"), (k % 13 == 0).alias("low_power"),
        flawed(11, F.lit("serious"), F.lit("fair")).alias("thermal"), flawed(37, F.lit(""), F.lit("e")).alias("encoded_sha256"), F.lit("p").alias("final_sha256"), flawed(7, F.lit(500), F.lit(512)).alias("width"), F.lit(341).alias("height"),
        F.transform(F.sequence(F.lit(1), last), generation).alias("generations"),
    )
    return made.select("k", reports.first_broken(reports.quality_report_rules({"chunk-1k": 1024, "chunk-4k": 4096}, 1)).alias("broken"))


@query(f"""SELECT event_type, {_STATS.format(v='cents').replace('CAST(sum(cents) // count(*) AS BIGINT) AS mean', 'CAST(sum(cents) * 1000000 // count(*) AS BIGINT) AS mean_micro')} FROM (SELECT event_type, cents, row_number() OVER (PARTITION BY event_type ORDER BY cents) AS rn, count(*) OVER (PARTITION BY event_type) AS n
  FROM (SELECT event_type, CAST(floor(value * 100 + 0.5) AS BIGINT) AS cents FROM events)) GROUP BY event_type""")
def count_statistics(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.floor(F.col("value") * 100 + 0.5).cast("long").alias("cents"))
    return reports.count_statistics(rows, ["event_type"], "cents")


@query("""SELECT o_custkey, list_sort(list(cents)) AS deltas, list_sort(list(cents))[greatest(1, (count(*) + 1) // 2)] AS median, max(cents) AS maximum FROM (SELECT o_custkey, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS cents FROM orders) GROUP BY 1""")
def memory_statistics(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long").alias("cents"))
    return reports.memory_statistics(rows, ["o_custkey"], "cents")


@query(f"""SELECT l_returnflag, field, {_STATS.format(v='value')} FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, field ORDER BY value) AS rn, count(*) OVER (PARTITION BY l_returnflag, field) AS n FROM (
  SELECT l_returnflag, 'quantity' AS field, CAST(floor(l_quantity) AS BIGINT) AS value FROM lineitem WHERE l_linenumber > 1 UNION ALL SELECT l_returnflag, 'price', CAST(floor(l_extendedprice) AS BIGINT) FROM lineitem WHERE l_returnflag <> 'A')) GROUP BY 1, 2""")
def optional_summary(spark, sf_dir):
    """Fields that are missing in some rows, and in all of a group's."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.when(F.col("l_linenumber") > 1, F.floor("l_quantity")).alias("quantity"), F.when(F.col("l_returnflag") != "A", F.floor("l_extendedprice")).alias("price"))
    return reports.optional_summary(rows, ["l_returnflag"], ["quantity", "price"])


@query("""SELECT source, CAST(count(*) AS BIGINT) AS reports, count(DISTINCT lang) + CAST(bool_or(lang IS NULL) AS INTEGER) = 1 AS lang_stable, count(DISTINCT n_chars > 0) + CAST(bool_or(n_chars IS NULL) AS INTEGER) = 1 AS filled_stable FROM documents GROUP BY 1""")
def cardinality_invariants(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("filled", F.col("n_chars") > 0)
    return statistics.stable(rows, ["source"], ["lang", "filled"])


@query(f"""{_QUANTISED} SELECT vec_id, round_even(sum(d) / count(*), 9) AS mae, round_even(sum(d * d) / count(*), 9) AS mse, CASE WHEN sum(d) = 0 THEN 999.0::DOUBLE ELSE round_even(10 * log10(65025.0::DOUBLE / (sum(d * d) / count(*))), 9) END AS psnr FROM (SELECT a.vec_id, abs(a.q - b.q)::DOUBLE AS d FROM q a JOIN q b ON b.vec_id = a.vec_id + 1 AND a.p = b.p) GROUP BY 1""")
def float_metrics(spark, sf_dir):
    """Mean errors as floating-point numbers, rounded half to even at nine places."""
    rows = metrics.error_metrics(_pairs(spark, sf_dir), ["vec_id"], "reference", "candidate")
    n = F.col("channel_count").cast("double")
    mse = F.col("squared_error_sum") / n
    psnr = F.when(mse == 0, F.lit(999.0)).otherwise(F.bround(10 * F.log10(F.lit(65025.0) / mse), 9))
    return rows.select("vec_id", F.bround(F.col("absolute_error_sum") / n, 9).alias("mae"), F.bround(mse, 9).alias("mse"), psnr.alias("psnr"))


@query("""SELECT s_name AS source_name, kind, coalesce(nullif(target_fallback, ''), target) AS target FROM (SELECT 's' || p_partkey % 10 AS source, 's' || p_size AS target, ['Swift.Codable', '', NULL][p_partkey % 3 + 1] AS target_fallback, ['conformsTo', 'memberOf', 'inheritsFrom'][p_size % 3 + 1] AS kind FROM part)
  JOIN (SELECT 's' || s_suppkey AS source, s_name FROM supplier WHERE s_nationkey % 3 < 2) USING (source) WHERE kind <> 'memberOf'""")
def symbol_relations(spark, sf_dir):
    access = F.element_at(F.array(F.lit("public"), F.lit("open"), F.lit("internal")), (F.col("s_nationkey") % 3 + 1).cast("int"))
    symbols = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), access.alias("access"))
    pick = lambda items, at: F.element_at(F.array(*(F.lit(x) for x in items)), (at + 1).cast("int"))
    edges = table(spark, sf_dir, "part").select(F.concat(F.lit("s"), (F.col("p_partkey") % 10).cast("string")).alias("source"), F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("target"), pick(("Swift.Codable", "", None), F.col("p_partkey") % 3).alias("target_fallback"), pick(("conformsTo", "memberOf", "inheritsFrom"), F.col("p_size") % 3).alias("kind"))
    return joins.relationships(symbols, edges)


@query("""SELECT path, status FROM (SELECT 'd/' || doc_id AS path, CASE doc_id % 10 WHEN 0 THEN 'missing' WHEN 1 THEN 'extra' WHEN 2 THEN 'size' WHEN 3 THEN CASE WHEN octet_length(encode(text)) > 0 THEN 'content' END END AS status FROM documents) WHERE status IS NOT NULL""")
def manifest_comparison(spark, sf_dir):
    """A manifest against files: some are missing, extra, longer or of other content."""
    docs = table(spark, sf_dir, "documents")
    expected = identity.manifest(docs, F.concat(F.lit("d/"), F.col("doc_id").cast("string")), F.col("text"))
    key = F.col("doc_id") % 10
    content = F.col("text").cast("binary")
    changed = F.when(key == 2, F.concat(content, F.unhex(F.lit("00")))).when(key == 3, F.unhex(F.repeat(F.lit("01"), F.octet_length(content)))).otherwise(content)
    found = identity.manifest(docs.withColumn("_c", changed), F.concat(F.lit("d/"), F.col("doc_id").cast("string")), F.col("_c"))
    number = F.substring("path", 3, 20).cast("long") % 10
    return identity.compared(expected.where(number != 1), found.where(number != 0))


@query("""SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS pooled, CAST(sum(v) AS BIGINT) AS total FROM (SELECT c_mktsegment, c_custkey AS v FROM customer UNION ALL SELECT c_mktsegment, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT c_mktsegment, c_custkey FROM customer) GROUP BY 1""")
def pooled_union(spark, sf_dir):
    """Samples of three runs pooled with their multiplicity."""
    customer = table(spark, sf_dir, "customer")
    own = customer.select("c_mktsegment", F.col("c_custkey").alias("v"))
    orders = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("c_mktsegment", F.col("o_orderkey").alias("v"))
    return own.unionByName(orders).unionByName(own).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("pooled"), F.sum("v").alias("total"))


@query("""SELECT o_custkey, len(list_filter(list(DISTINCT o_orderpriority), lambda x: x NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))) = 0 AS within, CAST(len(list_filter(list(DISTINCT o_orderpriority), lambda x: x IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))) AS INTEGER) AS common,
  list_min(list_filter(['1-URGENT', '2-HIGH', '3-MEDIUM'], lambda x: NOT list_contains(list(DISTINCT o_orderpriority), x))) AS least_missing FROM orders GROUP BY 1""")
def subset_test(spark, sf_dir):
    """Whether each customer's priorities lie within the known ones, how many are common to both, and the smallest that is missing."""
    known = F.array(*(F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM")))
    own = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    return own.select("o_custkey", reports.subset(F.col("p"), known).alias("within"), F.size(F.array_intersect("p", known)).alias("common"), F.array_min(F.array_except(known, "p")).alias("least_missing"))


@query("SELECT o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, CAST(count(*) AS BIGINT) AS found FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def first_match(spark, sf_dir):
    """Each customer's first order that satisfies a predicate."""
    rows = table(spark, sf_dir, "orders").where("o_totalprice > 100000")
    return rows.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"), F.count(F.lit(1)).alias("found"))


@query("SELECT n_regionkey, n_name, CAST(row_number() OVER (ORDER BY n_regionkey DESC, n_name) AS BIGINT) - 1 AS place FROM nation")
def sorted_cases(spark, sf_dir):
    """Cases in the order of several keys; their place follows from the sorted partitions."""
    ordered = table(spark, sf_dir, "nation").orderBy(F.desc("n_regionkey"), "n_name").select("n_regionkey", "n_name", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i"))
    sizes = ordered.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    # One row for each partition of the sort.
    before = sizes.select(F.col("_p").alias("_q"), F.expr("coalesce(sum(_n) OVER (ORDER BY _p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("_before"))
    placed = ordered.join(F.broadcast(before), F.col("_p") == F.col("_q"))
    return placed.select("n_regionkey", "n_name", (F.col("_before") + F.col("_i").bitwiseAND((1 << 33) - 1)).alias("place"))


@query("""SELECT p_partkey, quality, orientation, CASE WHEN NOT (quality BETWEEN 0 AND 1) THEN 'invalidQuality' END AS quality_failure, CASE WHEN orientation NOT BETWEEN 1 AND 8 THEN 'invalidOrientation' WHEN orientation IS NOT NULL AND policy <> 'preserveRecognized' THEN 'orientationNeedsMetadata' END AS orientation_failure,
  CASE WHEN p_size > 5 AND backend > 0 THEN greatest(CAST(p_size AS BIGINT) - 5, backend) END AS estimate FROM (SELECT *, p_size / 40.0::DOUBLE AS quality, CASE WHEN p_partkey % 3 > 0 THEN CAST(p_partkey % 11 AS INTEGER) END AS orientation, ['discard', 'preserveRecognized'][p_partkey % 2 + 1] AS policy, p_partkey % 30 - 4 AS backend FROM part)""")
def domain_values(spark, sf_dir):
    """Qualities and orientations inside and outside their domains, and the larger of two estimates."""
    key, size = F.col("p_partkey"), F.col("p_size")
    policy = F.when(key % 2 == 1, F.lit("preserveRecognized")).otherwise(F.lit("discard"))
    rows = table(spark, sf_dir, "part").select("p_partkey", (size / F.lit(40.0)).alias("quality"), F.when(key % 3 > 0, (key % 11).cast("int")).alias("orientation"), policy.alias("policy"), (size - 5).cast("long").alias("generic"), (key % 30 - 4).alias("backend"))
    return rows.select("p_partkey", "quality", "orientation", reports.quality_failure(F.col("quality")).alias("quality_failure"), reports.orientation_failure(F.col("orientation"), F.col("policy")).alias("orientation_failure"), reports.conservative_maximum(F.col("generic"), F.col("backend")).alias("estimate"))


@query("""SELECT name, least(ceiling, greatest(CASE WHEN name IN ('metadata_bytes', 'attachments') THEN 0 ELSE 1 END, asked)) AS kept, asked BETWEEN CASE WHEN name IN ('metadata_bytes', 'attachments') THEN 0 ELSE 1 END AND ceiling AS accepted, asked FROM (VALUES ('encoded_bytes', 1073741824), ('dimension', 65536), ('pixel_count', 1000000000), ('frame_count', 4096), ('metadata_bytes', 67108864), ('attachments', 1024)) l(name, ceiling), (VALUES (-5::BIGINT), (0), (1), (700), (65536), (5000000000)) a(asked)""")
def limit_domains(spark, sf_dir):
    """Limits asked for: what the constructor clamps them to, and whether a document that asks is accepted."""
    rows = []
    for name in ("encoded_bytes", "dimension", "pixel_count", "frame_count", "metadata_bytes", "attachments"):
        for asked in (-5, 0, 1, 700, 65_536, 5_000_000_000):
            try:
                accepted = DecodeLimits.checked(**{name: asked}) is not None
            except ValueError:
                accepted = False
            rows.append((name, asked, getattr(DecodeLimits(**{name: asked}), name), accepted))
    return spark.createDataFrame(rows, "name string, asked long, kept long, accepted boolean")


@query("""SELECT p_partkey, CAST(ceil(p_retailprice / 7) AS BIGINT) AS up, CAST(floor(p_retailprice / 7) AS BIGINT) AS down, abs(p_size - 25) AS distance, least(1, greatest(0, p_size / 40.0::DOUBLE)) AS clamped, (p_partkey + 6) // 7 AS ceiled, (p_partkey + 3) // 7 AS rounded, abs(p_retailprice - p_retailprice * (1 + 1e-13)) <= 1e-12 * abs(p_retailprice) AS close FROM part""")
def function_math(spark, sf_dir):
    price, size, key = F.col("p_retailprice"), F.col("p_size"), F.col("p_partkey")
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), size / F.lit(40.0)))
    return table(spark, sf_dir, "part").select("p_partkey", F.ceil(price / 7).alias("up"), F.floor(price / 7).alias("down"), F.abs(size - 25).alias("distance"), clamped.alias("clamped"), ceiled(key, 7).alias("ceiled"), half_up(key, 7).alias("rounded"), within(price, price * (1 + 1e-13)).alias("close"))


@query("""SELECT p_partkey, p_brand || '#impl=' || p_size || '#contract=2' AS fingerprint, printf('0x%02X', p_size % 256) AS marker, printf('%.2f', CAST(p_partkey AS DOUBLE) / 4) AS shown, string_split(p_type, ' ')[-1] AS last, trim(' ' || p_name || '  ') AS stripped, regexp_full_match(p_brand, 'Brand#[0-9]{2}') AS matches, array_to_string(list_sort(string_split(p_type, ' ')), '+') AS joined FROM part""")
def function_string(spark, sf_dir):
    words = F.split("p_type", " ")
    return table(spark, sf_dir, "part").select("p_partkey", admission.fingerprint(F.col("p_brand"), F.col("p_size"), F.lit(2)).alias("fingerprint"), F.format_string("0x%02X", (F.col("p_size") % 256).cast("int")).alias("marker"), F.format_string("%.2f", F.col("p_partkey").cast("double") / 4).alias("shown"), F.element_at(words, -1).alias("last"), F.trim(F.concat(F.lit(" "), F.col("p_name"), F.lit("  "))).alias("stripped"), F.col("p_brand").rlike("^Brand#[0-9]{2}$").alias("matches"), F.array_join(F.array_sort(words), "+").alias("joined"))


@query("""SELECT page_id, parse_filename(url) AS file, '/root/' || CASE page_id % 4 WHEN 0 THEN 'a/./b' WHEN 1 THEN 'a/../b' WHEN 2 THEN '../outside' ELSE '../root/in' END AS path, page_id % 4 <> 2 AS inside FROM pages""")
def function_path(spark, sf_dir):
    """File names, and whether a path with dot segments stays under its root."""
    path = F.concat(F.lit("/root/"), F.element_at(F.array(F.lit("a/./b"), F.lit("a/../b"), F.lit("../outside"), F.lit("../root/in")), (F.col("page_id") % 4 + 1).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", F.element_at(F.split("url", "/"), -1).alias("file"), path.alias("path"), files.contained(path, "/root").alias("inside"))


@query("""SELECT vec_id, CAST(list_sum(list_transform(q, lambda x: x * 2)) AS BIGINT) AS doubled, CAST(len(list_filter(q, lambda x: x > 128)) AS INTEGER) AS bright, list_sort(q)[1] AS darkest, list_max(list_transform(range(1, len(q)), lambda i: abs(q[i + 1] - q[i]))) AS steepest, len(list_filter(q, lambda x: x > 255)) = 0 AS bounded, list_transform(range(0, len(q), 16), lambda i: CAST(list_sum(q[i + 1:i + 16]) AS BIGINT)) AS strides
  FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(greatest(0, least(255, floor((CAST(x AS DOUBLE) + 1) * 127.5))) AS BIGINT)) AS q FROM embeddings)""")
def function_array(spark, sf_dir):
    """Map, filter, reduce, sort, zip, all-satisfy and strides over arrays."""
    zero = F.lit(0).cast("long")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(metrics.quantised(F.col("embedding")), lambda x: x.cast("long")).alias("q"))
    total = lambda a: F.aggregate(a, zero, lambda s, x: s + x)
    steps = F.zip_with(F.slice("q", 1, F.size("q") - 1), F.slice("q", F.lit(2), F.size("q") - 1), lambda a, b: F.abs(b - a))
    strides = F.transform(F.sequence(F.lit(1), F.size("q"), F.lit(16)), lambda i: total(F.slice("q", i, F.lit(16))))
    return rows.select("vec_id", total(F.transform("q", lambda x: x * 2)).alias("doubled"), F.size(F.filter("q", lambda x: x > 128)).alias("bright"), F.array_sort("q")[0].alias("darkest"), F.array_max(steps).alias("steepest"), F.forall("q", lambda x: x <= 255).alias("bounded"), strides.alias("strides"))


@query("""SELECT n_regionkey, CAST(count(*) AS INTEGER) AS entries, max(CASE WHEN n_name = 'FRANCE' THEN n_nationkey END) AS france, min(n_name) AS first_name FROM nation GROUP BY 1""")
def function_map(spark, sf_dir):
    """Rows grouped into a map of lists, and lookups in it."""
    maps = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("m"))
    return maps.select("n_regionkey", F.size("m").alias("entries"), F.try_element_at("m", F.lit("FRANCE")).alias("france"), F.array_min(F.map_keys("m")).alias("first_name"))


@query("""SELECT event_id, '{"event_type":"' || event_type || '","user_id":' || user_id || '}' AS canonical, user_id AS parsed, CASE WHEN event_id % 2 = 0 THEN event_type END AS optional FROM events""")
def function_json(spark, sf_dir):
    """Rows as JSON with sorted keys, parsed again; a key that is missing reads as null."""
    events = table(spark, sf_dir, "events")
    text = F.to_json(F.struct("event_type", "user_id"))
    without = F.to_json(F.struct("user_id"))
    rows = events.select("event_id", text.alias("canonical"), F.when(F.col("event_id") % 2 == 0, text).otherwise(without).alias("j"))
    parsed = F.from_json("j", "event_type string, user_id long")
    return rows.select("event_id", "canonical", parsed["user_id"].alias("parsed"), parsed["event_type"].alias("optional"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'first' WHEN p_partkey % 3 = 0 THEN 'second' ELSE 'other' END AS tag, coalesce(CASE WHEN p_size > 40 THEN p_size END, CASE WHEN p_size > 20 THEN 20 END, 0) AS chosen, nullif(p_size, 7) AS mapped FROM part""")
def function_conditional(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(key % 4 == 0, "first").when(key % 3 == 0, "second").otherwise("other").alias("tag"), F.coalesce(F.when(size > 40, size), F.when(size > 20, F.lit(20)), F.lit(0)).alias("chosen"), F.nullif(size, F.lit(7)).alias("mapped"))


@query("""SELECT p_partkey, to_base64(encode(p_name)) AS coded, p_name AS decoded, sha256(p_name) AS digest FROM part""")
def function_codec(spark, sf_dir):
    name = F.col("p_name").cast("binary")
    return table(spark, sf_dir, "part").select("p_partkey", F.base64(name).alias("coded"), F.unbase64(F.base64(name)).cast("string").alias("decoded"), F.sha2(name, 256).alias("digest"))


def _scratch(spark, name: str) -> str:
    """A fresh local or mounted folder that driver and executors share."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), "pixelframe-shared")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT n_nationkey, n_name, n_regionkey, 1 AS schema_version FROM nation")
def report_round_trip(spark, sf_dir):
    """Rows written as canonical JSON reports and read again by a subset schema with their version checked."""
    path = _scratch(spark, "reports")
    rows = table(spark, sf_dir, "nation").select(F.struct("n_nationkey", "n_name", "n_regionkey").alias("body"), F.lit(1).alias("schema_version"))
    named = files.canonical_json(rows.withColumn("unread", F.lit("x")))
    docs = named.select(F.concat(F.sha2("json", 256), F.lit(".json")).alias("file"), F.col("json").cast("binary").alias("content"))
    files.write_artifacts(docs, path)
    read = files.json_reports(spark, path, "schema_version int, body struct<n_nationkey: int, n_name: string, n_regionkey: int>", ("schema_version", 1))
    return read.select("body.*", "schema_version")


#: Pictures of a folder.
PICTURES = 4096


@query("""SELECT p_partkey, CAST(16 + p_partkey % 9 AS INTEGER) AS width, CAST(8 + p_size % 5 AS INTEGER) AS height, 3 AS channels, sha256(unhex(list_aggregate(list_transform(range((16 + p_partkey % 9) * (8 + p_size % 5) * 3), lambda i: printf('%02x', (i + p_partkey) % 251)), 'string_agg', ''))) AS pixels_sha256, CAST(NULL AS VARCHAR) AS failure
  FROM part WHERE octet_length(encode('P6' || chr(10) || (16 + p_partkey % 9) || ' ' || (8 + p_size % 5) || chr(10) || '255' || chr(10))) + (16 + p_partkey % 9) * (8 + p_size % 5) * 3 <= 700""")
def image_files_round_trip(spark, sf_dir):
    """Pictures written as PPM files, scanned with a cap on their length, decoded whole."""
    from ..operators.probe import decode_pnm_files

    path = _scratch(spark, "pictures")
    key = F.col("p_partkey")
    w, h = key % 9 + 16, F.col("p_size") % 5 + 8
    head = F.concat(F.lit("P6\n"), w.cast("string"), F.lit(" "), h.cast("string"), F.lit("\n255\n")).cast("binary")
    body = F.substr(F.lit(bytearray(range(251)) * 5), (F.pmod(key, F.lit(251)) + 1).cast("int"), (w * h * 3).cast("int"))  # at most 864 bytes of a cycle of 251
    file = F.concat(F.floor(key / PICTURES).cast("string"), F.lit("/"), key.cast("string"), F.lit(".ppm"))  # tasks wait for each other in one folder, and the driver lists it alone
    files.write_artifacts(spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select(file.alias("file"), F.concat(head, body).alias("content")), path)
    found = files.image_files(spark, path, cap=700, pattern="*.ppm")
    named = found.select(F.regexp_extract("path", r"([0-9]+)\.ppm$", 1).cast("long").alias("p_partkey"), "content")
    return decode_pnm_files(named, "p_partkey").select("p_partkey", "width", "height", "channels", F.sha2("pixels", 256).alias("pixels_sha256"), "failure")


@query("""SELECT n_name || '.txt' AS path, CAST(octet_length(encode(n_comment)) AS BIGINT) AS byte_count, sha256(n_comment) AS sha256, false AS executable FROM (SELECT n_name, n_name || ' ' || n_regionkey AS n_comment FROM nation)""")
def source_tree(spark, sf_dir):
    """Files of a tree: listed, hashed where they are read."""
    path = _scratch(spark, "tree")
    rows = table(spark, sf_dir, "nation").select(F.concat("n_name", F.lit(".txt")).alias("file"), F.concat("n_name", F.lit(" "), F.col("n_regionkey").cast("string")).cast("binary").alias("content"))
    files.write_artifacts(rows, path)
    return files.source_tree(spark, path)


@query("""SELECT n_name AS file, CASE n_nationkey % 4 WHEN 1 THEN 'size' WHEN 2 THEN 'content' WHEN 3 THEN 'missing' END AS failure FROM nation""")
def verified_files(spark, sf_dir):
    """A manifest of files of which some have another size or content, or aren't there."""
    path = _scratch(spark, "verified")
    key, name = F.col("n_nationkey") % 4, F.col("n_name")
    other = F.when(key == 1, F.concat(name, F.lit("x"))).when(key == 2, F.reverse(F.concat(F.lit("~"), F.substring(name, 2, 100)))).otherwise(name)
    nation = table(spark, sf_dir, "nation")
    files.write_artifacts(nation.where(key != 3).select(name.alias("file"), other.cast("binary").alias("content")), path)
    manifest = nation.select(name.alias("file"), F.octet_length(name).cast("long").alias("byteCount"), F.sha2(name.cast("binary"), 256).alias("sha256"))
    return files.verified(files.image_files(spark, path), manifest, path).select("file", "failure")


@query("""SELECT 'm' || n_regionkey AS module, 'id-' || n_nationkey AS id, 'struct' AS kind, n_name AS name FROM nation WHERE n_nationkey % 3 < 2""")
def public_symbols(spark, sf_dir):
    """Symbol documents, one for each region, of which the public symbols are read."""
    path = _scratch(spark, "symbols")
    access = F.element_at(F.array(F.lit("public"), F.lit("open"), F.lit("internal")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    symbol = F.struct(F.struct(F.concat(F.lit("id-"), F.col("n_nationkey").cast("string")).alias("precise")).alias("identifier"), F.struct(F.lit("struct").alias("identifier")).alias("kind"), F.struct(F.col("n_name").alias("title")).alias("names"), access.alias("accessLevel"))
    docs = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(symbol).alias("symbols"))
    named = docs.select(F.concat(F.lit("m"), F.col("n_regionkey").cast("string")).alias("m"), "symbols")
    files.write_artifacts(named.select(F.concat("m", F.lit(".json")).alias("file"), F.to_json(F.struct(F.struct(F.col("m").alias("name")).alias("module"), "symbols")).cast("binary").alias("content")), path)
    return files.symbols(spark, path)


@query("""SELECT l_orderkey, CAST(sum(cents) FILTER (WHERE line <= 3) AS BIGINT) AS early, CAST(count(*) FILTER (WHERE line > 3) AS BIGINT) AS late, CAST(sum(cents) * 1000000 // (count(*) * 100) AS BIGINT) AS mean_micro FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS cents FROM lineitem) GROUP BY 1""")
def conditional_sums(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    return rows.groupBy("l_orderkey").agg(F.sum(F.when(F.col("line") <= 3, F.col("cents"))).alias("early"), F.count_if(F.col("line") > 3).alias("late"), truncated(F.sum("cents") * 1_000_000, F.count(F.lit(1)) * 100).alias("mean_micro"))


@query("""SELECT user_id, min_by(v, event_id) AS baseline, max(v) AS peak, CAST(count(*) AS BIGINT) AS samples, CAST(greatest(0, max(v) - min_by(v, event_id)) AS BIGINT) AS peak_delta FROM (SELECT user_id, event_id, CAST(floor(value * 100 + 0.5) AS BIGINT) AS v FROM events) GROUP BY 1""")
def sampled_peaks(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.col("value") * 100 + 0.5).cast("long").alias("v"))
    return reports.sampled_peaks(rows, ["user_id"], "event_id", "v")


@query("""SELECT r_name AS "case", CAST(repetition AS INTEGER) AS repetition, 0 AS exit_code, r_name || '/' || repetition || chr(10) AS output FROM region, (VALUES (1), (2)) v(repetition)""")
def case_runs(spark, sf_dir):
    """A process for each case and repetition."""
    return files.case_runs(table(spark, sf_dir, "region"), "r_name", 2, ["/bin/sh", "-c", 'echo "$0/$1"'])
