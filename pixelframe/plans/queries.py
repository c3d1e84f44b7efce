"""One query for each operator that the driver's tables can exercise, with its DuckDB twin beside it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..contracts import DecodeCapabilities, DecodeLimits, EncodeCapabilities, EncodeLimits
from ..functions.numeric import ceiled, half_up, micro, ppm, saturated_product, truncated
from ..functions.pixels import encode_png
from ..operators import admission, identity, joins, metrics, policy, queueing, statistics
from ..shipping import ship, spread
from ..sources.files import table
from .registry import ORACLE_SQL, QUERIES, query

def _micros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with whole-number times: t (microseconds), service (of the value) and bytes."""
    events = table(spark, sf_dir, "events")
    cents = F.floor(F.col("value") * 100 + 0.5).cast("long")
    return events.select("event_id", "user_id", "event_type", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts AS timestamp_ntz))").alias("t"), cents.alias("cents"), (cents * 100_000).alias("service"))


_EVENTS = "(SELECT event_id, user_id, event_type, epoch_us(ts) AS t, CAST(floor(value * 100 + 0.5) AS BIGINT) AS cents, CAST(floor(value * 100 + 0.5) AS BIGINT) * 100000 AS service FROM events)"
_STATS = """CAST(count(*) AS BIGINT) AS count, min({v}) AS minimum,
  min({v}) FILTER (WHERE rn >= greatest(1, (n + 1) // 2)) AS median, min({v}) FILTER (WHERE rn >= greatest(1, (n * 9 + 9) // 10)) AS p90,
  max({v}) AS maximum, CAST(sum({v}) // count(*) AS BIGINT) AS mean"""


@query(f"""SELECT event_type, {_STATS.format(v='cents')} FROM (
  SELECT event_type, cents, row_number() OVER (PARTITION BY event_type ORDER BY cents) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM {_EVENTS}
) GROUP BY event_type""")
def nearest_rank_stats(spark, sf_dir):
    return statistics.duration_statistics(_micros(spark, sf_dir), ["event_type"], "cents")


@query("SELECT 'documents/' || doc_id AS path, CAST(octet_length(encode(text)) AS BIGINT) AS byte_count, sha256(text) AS sha256 FROM documents")
def identity_manifest(spark, sf_dir):
    return identity.manifest(table(spark, sf_dir, "documents"), F.concat(F.lit("documents/"), F.col("doc_id").cast("string")), F.col("text"))


@query("""SELECT CAST(count(*) AS BIGINT) AS file_count, sha256('{"files":[' || string_agg('{"byteCount":' || octet_length(encode(n_name)) || ',"executable":false,"path":"' || n_name || '","sha256":"' || sha256(n_name) || '"}', ',' ORDER BY n_name)
  || '],"identityID":"nations","schemaVersion":1}') AS identity_sha256 FROM nation""")
def identity_digest(spark, sf_dir):
    files = identity.manifest(table(spark, sf_dir, "nation"), F.col("n_name"), F.col("n_name")).withColumn("executable", F.lit(False))
    return identity.canonical_digest(files, "nations")


@query("""SELECT doc_id, CAST(k AS BIGINT) AS chunk_index, CAST(least(1024, n - k * 1024) AS BIGINT) AS chunk_byte_count, CAST(least(n, (k + 1) * 1024) AS BIGINT) AS cumulative_byte_count
  FROM (SELECT doc_id, n, unnest(range(0, (n + 1023) // 1024)) AS k FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents))""")
def byte_chunker_1k(spark, sf_dir):
    return identity.chunks(table(spark, sf_dir, "documents"), ["doc_id"], F.col("text"), 1024)


@query(f"""WITH s AS (SELECT *, sum(service) OVER w AS served FROM {_EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING))
  SELECT event_id, CAST(served + free - service AS BIGINT) AS start_ns, CAST(served + free AS BIGINT) AS end_ns, CAST(served + free - service - t AS BIGINT) AS queue_delay_ns
  FROM (SELECT *, max(t - (served - service)) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS free FROM s)""")
def single_server_queue(spark, sf_dir):
    rows = queueing.single_server(_micros(spark, sf_dir), ["user_id"], ["t", "event_id"], "t", "service")
    return rows.select("event_id", "start_ns", "end_ns", "queue_delay_ns")


_HOUR = 3_600_000_000


@query(f"""SELECT event_id, (t // {_HOUR} + 1) * {_HOUR} AS deadline_ns, event_id = last AS presented FROM (
  SELECT *, max_by(event_id, (t, event_id)) OVER (PARTITION BY user_id, t // {_HOUR}) AS last FROM {_EVENTS})""")
def frame_latest_wins(spark, sf_dir):
    rows = queueing.coalesced(_micros(spark, sf_dir), ["user_id"], ["t", "event_id"], "t", _HOUR)
    return rows.select("event_id", "deadline_ns", "presented")


@query(f"""WITH e AS (SELECT user_id, t, 0 AS kind, cents AS delta FROM {_EVENTS} UNION ALL SELECT user_id, t + service, 1, -cents FROM {_EVENTS})
  SELECT user_id, CAST(greatest(0, max(held)) AS BIGINT) AS peak_bytes FROM (SELECT user_id, sum(delta) OVER (PARTITION BY user_id ORDER BY t, kind, delta ROWS UNBOUNDED PRECEDING) AS held FROM e) GROUP BY user_id""")
def buffered_byte_peak(spark, sf_dir):
    rows = _micros(spark, sf_dir).withColumn("end", F.col("t") + F.col("service"))
    return queueing.buffered_peak(rows, ["user_id"], "t", "end", "cents")


def _pairs(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", metrics.quantised(F.col("embedding")).alias("v"))
    return e.select("vec_id", F.col("v").alias("reference")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("candidate")), "vec_id")


_METRICS = """(SELECT vec_id, CAST(count(*) AS BIGINT) AS channel_count, CAST(count(*) FILTER (WHERE d > 0) AS BIGINT) AS different_channel_count, max(d) AS maximum_absolute_error,
  CAST(sum(d) AS BIGINT) AS absolute_error_sum, CAST(sum(d * d) AS BIGINT) AS squared_error_sum, CAST(sum(d) * 1000000 // count(*) AS BIGINT) AS mae_micro, CAST(sum(d * d) * 1000000 // count(*) AS BIGINT) AS mse_micro,
  CASE WHEN sum(d * d) * 1000000 // count(*) = 0 THEN 999000000 ELSE CAST(floor(10.0 * log10(65025e6 / CAST(CAST(sum(d * d) * 1000000 // count(*) AS BIGINT) AS DOUBLE)) * 1e6 + 0.5) AS BIGINT) END AS psnr_micro_db,
  CAST(count(*) FILTER (WHERE d <= 8) * 1000000 // count(*) AS BIGINT) AS at_most_8_ppm, CAST(count(*) FILTER (WHERE d <= 16) * 1000000 // count(*) AS BIGINT) AS at_most_16_ppm,
  CAST(count(*) FILTER (WHERE d <= 32) * 1000000 // count(*) AS BIGINT) AS at_most_32_ppm, CAST(count(*) FILTER (WHERE d <= 64) * 1000000 // count(*) AS BIGINT) AS at_most_64_ppm
  FROM (SELECT a.vec_id, abs(a.q - b.q) AS d FROM q a JOIN q b ON b.vec_id = a.vec_id + 1 AND a.p = b.p) GROUP BY vec_id)"""
_QUANTISED = "WITH q AS (SELECT vec_id, p, CAST(greatest(0, least(255, floor((CAST(x AS DOUBLE) + 1) * 127.5))) AS BIGINT) AS q FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS p FROM embeddings))"


@query(f"{_QUANTISED} SELECT * FROM {_METRICS}")
def vector_error_metrics(spark, sf_dir):
    return metrics.error_metrics(_pairs(spark, sf_dir), ["vec_id"], "reference", "candidate")


@query(f"""{_QUANTISED} SELECT vec_id, generation, generation <= 2 AND psnr_micro_db < 25000000 AND mae_micro > 10000000 AND at_most_16_ppm < 600000 AS coarse,
  generation >= 3 AND psnr_micro_db >= 40000000 AND mae_micro <= 2000000 AND maximum_absolute_error <= 8 AND at_most_8_ppm = 1000000 AS near_final FROM (SELECT *, vec_id % 4 + 1 AS generation FROM {_METRICS})""")
def error_classification(spark, sf_dir):
    rows = metrics.error_metrics(_pairs(spark, sf_dir), ["vec_id"], "reference", "candidate").withColumn("generation", F.col("vec_id") % 4 + 1)
    coarse, near = admission.error_class(*(F.col(c) for c in ("generation", "psnr_micro_db", "mae_micro", "maximum_absolute_error", "at_most_8_ppm", "at_most_16_ppm")))
    return rows.select("vec_id", "generation", coarse.alias("coarse"), near.alias("near_final"))


@query(f"{_QUANTISED} SELECT vec_id, 'mae' AS broken FROM {_METRICS} WHERE vec_id % 7 = 0 AND absolute_error_sum > 0")
def metric_consistency(spark, sf_dir):
    rows = metrics.error_metrics(_pairs(spark, sf_dir), ["vec_id"], "reference", "candidate")
    spoiled = rows.withColumn("mae_micro", F.when((F.col("vec_id") % 7 == 0) & (F.col("absolute_error_sum") > 0), F.col("mae_micro") + 1).otherwise(F.col("mae_micro")))
    return metrics.inconsistent(spoiled, ["vec_id"])


_SUPPLY = "SELECT l_suppkey, CAST(sum(CAST(floor(l_quantity + 0.5) AS BIGINT)) AS BIGINT) AS quantity, CAST(sum(CAST(floor(l_discount * 100 + 0.5) AS BIGINT)) * 1000000 // count(*) AS BIGINT) AS discount_micro, CAST(max(l_linenumber) + count(DISTINCT l_partkey) AS BIGINT) AS variety FROM lineitem GROUP BY l_suppkey"


def _supply(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.sum(F.floor(F.col("l_quantity") + 0.5).cast("long")).alias("quantity"),
        F.sum(F.floor(F.col("l_discount") * 100 + 0.5).cast("long")).alias("_d"),
        F.count(F.lit(1)).alias("_n"),
        (F.max("l_linenumber") + F.count_distinct("l_partkey")).cast("long").alias("variety"),
    )
    return rows.select("l_suppkey", "quantity", micro(F.col("_d"), F.col("_n")).alias("discount_micro"), "variety")


@query(f"""WITH s AS ({_SUPPLY}) SELECT * FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.quantity >= a.quantity AND b.discount_micro <= a.discount_micro AND b.variety >= a.variety
  AND (b.quantity <> a.quantity OR b.discount_micro <> a.discount_micro OR b.variety <> a.variety))""")
def pareto_frontier(spark, sf_dir):
    return policy.pareto_frontier(_supply(spark, sf_dir), ["discount_micro"], ["quantity", "variety"])


@query(f"WITH s AS ({_SUPPLY}) SELECT l_suppkey, CAST(rank() OVER (ORDER BY quantity DESC) AS BIGINT) AS quantity_rank, CAST(rank() OVER (ORDER BY discount_micro) AS BIGINT) AS discount_rank FROM s")
def strict_rank(spark, sf_dir):
    ranked = policy.strict_rank(_supply(spark, sf_dir), "quantity", True, "quantity_rank")
    return policy.strict_rank(ranked, "discount_micro", False, "discount_rank").select("l_suppkey", "quantity_rank", "discount_rank")


@query(f"""WITH s AS ({_SUPPLY}) SELECT (SELECT l_suppkey FROM s ORDER BY quantity DESC, l_suppkey LIMIT 1) AS quantity_leader, (SELECT l_suppkey FROM s ORDER BY discount_micro, l_suppkey LIMIT 1) AS discount_micro_leader,
  (SELECT l_suppkey FROM s ORDER BY variety DESC, l_suppkey LIMIT 1) AS variety_leader""")
def arg_leaders(spark, sf_dir):
    return policy.leaders(_supply(spark, sf_dir), "l_suppkey", {"quantity": True, "discount_micro": False, "variety": True})


_PROBES = """(SELECT doc_id, ['png','jpeg','gif','webp'][doc_id % 4 + 1] AS format, doc_id * 37 % 20000 + 1 AS width, n_chars % 20000 + 1 AS height, doc_id % 3 AS frame_count, n_chars * 700 AS metadata_byte_count, CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS attachment_count FROM documents)"""


def _probes(spark, sf_dir) -> DataFrame:
    formats = F.array(*(F.lit(x) for x in ("png", "jpeg", "gif", "webp")))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.element_at(formats, (F.col("doc_id") % 4 + 1).cast("int")).alias("format"),
        (F.col("doc_id") * 37 % 20000 + 1).alias("width"),
        (F.col("n_chars") % 20000 + 1).alias("height"),
        (F.col("doc_id") % 3).alias("frame_count"),
        (F.col("n_chars") * 700).alias("metadata_byte_count"),
        (F.col("doc_id") % 11 == 0).cast("long").alias("attachment_count"),
    )


@query(f"""SELECT doc_id, CASE WHEN format NOT IN ('png','jpeg','gif') THEN 'unsupportedFormat' WHEN greatest(width, height) > 16384 THEN 'dimensionLimitExceeded' WHEN width * height > 100000000 THEN 'pixelLimitExceeded'
  WHEN frame_count > 1 THEN 'frameLimitExceeded' WHEN metadata_byte_count > 4194304 THEN 'metadataLimitExceeded' WHEN attachment_count > 0 THEN 'auxiliaryAttachmentLimitExceeded' END AS failure FROM {_PROBES}""")
def admission_precedence(spark, sf_dir):
    return _probes(spark, sf_dir).select("doc_id", admission.probe_failure(DecodeLimits()).alias("failure"))


@query(f"SELECT doc_id, CASE WHEN greatest(width, height) > 8192 THEN 'dimensionLimitExceeded' WHEN width * height > 9000000 THEN 'pixelLimitExceeded' END AS failure FROM {_PROBES}")
def dimension_admission(spark, sf_dir):
    limits = DecodeLimits(dimension=8192, pixel_count=9_000_000)
    return _probes(spark, sf_dir).select("doc_id", admission.dimension_failure(limits, F.col("width"), F.col("height")).alias("failure"))


@query("""SELECT y * 96 + x AS pixel, (17 * x + 3 * y + c) & 255 AS red, (5 * x + 19 * y + c // 2) & 255 AS green, (11 * x + 7 * y + 255 - c) & 255 AS blue
  FROM (SELECT x, y, CASE WHEN (x // 8 + y // 8) % 2 = 0 THEN 37 ELSE 211 END AS c FROM range(96) a(x), range(64) b(y))""")
def pattern_pixels(spark, sf_dir):
    grid = spark.range(96 * 64).select(F.col("id").alias("pixel"), (F.col("id") % 96).alias("x"), truncated(F.col("id"), 96).alias("y"))
    c = F.when((truncated(F.col("x"), 8) + truncated(F.col("y"), 8)) % 2 == 0, F.lit(37)).otherwise(F.lit(211)).cast("long")
    x, y = F.col("x"), F.col("y")
    return grid.select("pixel", (17 * x + 3 * y + c).bitwiseAND(255).alias("red"), (5 * x + 19 * y + truncated(c, 2)).bitwiseAND(255).alias("green"), (11 * x + 7 * y + 255 - c).bitwiseAND(255).alias("blue"))


@query("""WITH m AS (SELECT i, list_filter([CASE WHEN i & 1 > 0 THEN 'orientation' END, CASE WHEN i & 2 > 0 THEN 'sourceColorProfile' END, CASE WHEN i & 4 > 0 THEN 'highDynamicRange' END, CASE WHEN i & 8 > 0 THEN 'frameTiming' END], lambda x: x IS NOT NULL) AS metadata FROM range(16) r(i))
  SELECT format || '/' || delivery || '/' || track || '/' || array_to_string(metadata, '+') || '/' || dynamic_range || '/' || output || '/' || cancellation AS request,
  CASE WHEN format = 'gif' AND false THEN 'format:gif' WHEN delivery = 'progressiveGenerations' AND format <> 'jpeg' THEN 'delivery:progressiveGenerations' WHEN track <> 'primaryFrame' THEN 'track:' || track
  WHEN list_contains(metadata, 'frameTiming') THEN 'metadata:frameTiming' WHEN list_contains(metadata, 'highDynamicRange') THEN 'metadata:highDynamicRange'
  WHEN dynamic_range <> 'standard' THEN 'range:' || dynamic_range WHEN output <> 'coreGraphicsImage' THEN 'output:' || output WHEN cancellation > 0 THEN 'cancellation' END AS failure
  FROM (VALUES ('png'), ('jpeg'), ('gif')) f(format), (VALUES ('completeFrame'), ('progressiveGenerations')) d(delivery), (VALUES ('primaryFrame'), ('animatedSequence')) t(track), m,
  (VALUES ('standard'), ('high')) r(dynamic_range), (VALUES ('coreGraphicsImage'), ('pixelBuffer'), ('planarPixels')) o(output), (VALUES (0), (1)) c(cancellation)""")
def capability_domain(spark, sf_dir):
    domain = admission.capability_domain(spark, ["png", "jpeg", "gif"], ["completeFrame", "progressiveGenerations"], ["primaryFrame", "animatedSequence"], ["standard", "high"], ["coreGraphicsImage", "pixelBuffer", "planarPixels"], [0, 1])
    name = F.concat_ws("/", "format", "delivery", "track", F.array_join("metadata", "+"), "dynamic_range", "output", F.col("cancellation").cast("string"))
    return domain.select(name.alias("request"), admission.decode_support(DecodeCapabilities()).alias("failure"))


_ENCODES = """(SELECT p_partkey, ['png','jpeg','gif'][p_partkey % 3 + 1] AS format, ['lossless','lossy'][p_partkey % 2 + 1] AS compression, ['preserve','reject','flatten'][p_partkey // 2 % 3 + 1] AS alpha_policy, p_size % 2 = 0 AS has_alpha, p_size * 400 AS width, p_partkey % 1000 * 20 + 1 AS height FROM part)"""
_ENCODE_GAP = """CASE WHEN format = 'gif' THEN 'format' WHEN compression = 'lossless' AND format <> 'png' OR compression = 'lossy' AND format <> 'jpeg' THEN 'compression' WHEN alpha_policy = 'preserve' AND has_alpha AND format <> 'png' THEN 'alphaPreservation' END"""


def _encodes(spark, sf_dir) -> DataFrame:
    def pick(items, index):
        return F.element_at(F.array(*(F.lit(x) for x in items)), (index + 1).cast("int"))

    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        pick(("png", "jpeg", "gif"), key % 3).alias("format"),
        pick(("lossless", "lossy"), key % 2).alias("compression"),
        F.lit("preserveSource").alias("colour"),
        F.lit("discard").alias("metadata_policy"),
        pick(("preserve", "reject", "flatten"), truncated(key, 2) % 3).alias("alpha_policy"),
        (F.col("p_size") % 2 == 0).alias("has_alpha"),
        (F.col("p_size") * 400).alias("width"),
        (key % 1000 * 20 + 1).alias("height"),
    )


@query(f"SELECT p_partkey, {_ENCODE_GAP} AS gap FROM {_ENCODES}")
def encode_capability(spark, sf_dir):
    return _encodes(spark, sf_dir).select("p_partkey", admission.encode_support(EncodeCapabilities()).alias("gap"))


@query(f"""SELECT p_partkey, coalesce('unsupported:' || {_ENCODE_GAP}, CASE WHEN alpha_policy = 'reject' AND has_alpha THEN 'alphaRejected' WHEN greatest(width, height) > 16384 THEN 'dimensionLimitExceeded' WHEN width * height > 100000000 THEN 'pixelLimitExceeded' END) AS failure FROM {_ENCODES}""")
def encode_admission(spark, sf_dir):
    return _encodes(spark, sf_dir).select("p_partkey", admission.encode_failure(EncodeCapabilities(), EncodeLimits()).alias("failure"))


@query("""SELECT p_partkey, target, mode, CAST(greatest(1, least(greatest(w, h), floor(greatest(w, h) * s))) AS BIGINT) AS thumbnail_limit,
  CAST(2 * tw * th * 4 + least(tw, target) * least(th, target) * 4 AS BIGINT) AS working_set_bytes FROM (
  SELECT *, CAST(greatest(1, least(w, ceil(w * s))) AS BIGINT) AS tw, CAST(greatest(1, least(h, ceil(h * s))) AS BIGINT) AS th FROM (
  SELECT *, least(1.0::DOUBLE, CASE WHEN mode = 'fit' THEN least(target::DOUBLE / w, target::DOUBLE / h) ELSE greatest(target::DOUBLE / w, target::DOUBLE / h) END) AS s FROM (
  SELECT p_partkey, CAST(p_size * 64 AS BIGINT) AS w, CAST(p_partkey % 900 * 3 + 7 AS BIGINT) AS h, target, mode FROM part, (VALUES (512), (1024)) t(target), (VALUES ('fit'), ('fill')) m(mode))))""")
def working_set_estimate(spark, sf_dir):
    targets = spark.createDataFrame([(t, m) for t in (512, 1024) for m in ("fit", "fill")], "target int, mode string")
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 64).cast("long").alias("w"), (F.col("p_partkey") % 900 * 3 + 7).alias("h")).crossJoin(F.broadcast(targets))
    sizes = F.col("w"), F.col("h"), F.col("target"), F.col("target"), F.col("mode")
    return rows.select("p_partkey", "target", "mode", admission.thumbnail_limit(*sizes).alias("thumbnail_limit"), admission.working_set(*sizes).alias("working_set_bytes"))


@query("""SELECT coalesce(w.n_nationkey, h.n_nationkey) AS n_nationkey, coalesce(w.segment, h.segment) AS segment, CASE WHEN h.segment IS NULL THEN 'missing' ELSE 'unexpected' END AS status FROM
  (SELECT n_nationkey, c_mktsegment AS segment FROM nation, (SELECT DISTINCT c_mktsegment FROM customer)) w FULL JOIN
  (SELECT DISTINCT c_nationkey AS n_nationkey, c_mktsegment AS segment FROM customer) h ON w.n_nationkey = h.n_nationkey AND w.segment = h.segment WHERE w.segment IS NULL OR h.segment IS NULL""")
def cross_product_completeness(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    segments = customer.select(F.col("c_mktsegment").alias("segment")).distinct()
    expected = table(spark, sf_dir, "nation").select("n_nationkey").crossJoin(segments)
    observed = customer.select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("segment"))
    return joins.completeness(expected, observed, ["n_nationkey", "segment"])


@query("""SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey < 3 AND c_acctbal > 0""")
def star_lookup(spark, sf_dir):
    dimensions = [(table(spark, sf_dir, "customer"), "o_custkey", "c_custkey"), (table(spark, sf_dir, "nation"), "c_nationkey", "n_nationkey")]
    return joins.star_lookup(table(spark, sf_dir, "orders"), dimensions, (F.col("n_regionkey") < 3) & (F.col("c_acctbal") > 0)).select("o_orderkey", "c_name", "n_name")


_LINES = "(SELECT l_orderkey, l_suppkey % 5 AS grp, CAST(l_linenumber AS BIGINT) AS line, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS cents FROM lineitem)"


def _lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 5).alias("grp"), F.col("l_linenumber").cast("long").alias("line"), F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long").alias("cents"))


@query(f"""SELECT a.l_orderkey, a.c AS cents_a, b.c AS cents_b, b.c - a.c AS cents_change FROM (SELECT l_orderkey, max(cents) AS c FROM {_LINES} WHERE line = 1 GROUP BY 1) a JOIN (SELECT l_orderkey, max(cents) AS c FROM {_LINES} WHERE line = 2 GROUP BY 1) b USING (l_orderkey)""")
def schedule_self_join(spark, sf_dir):
    return joins.schedule_pairs(_lines(spark, sf_dir), ["l_orderkey"], "line", 1, 2, ["cents"])


@query(f"""WITH g AS (SELECT grp, line, CAST(sum(cents) // count(*) AS BIGINT) AS mean FROM {_LINES} GROUP BY 1, 2), p AS (SELECT grp, {_STATS.format(v='cents')} FROM (
  SELECT grp, cents, row_number() OVER (PARTITION BY grp ORDER BY cents) AS rn, count(*) OVER (PARTITION BY grp) AS n FROM {_LINES}) GROUP BY grp)
  SELECT grp, p.count, p.median, p.p90, p.mean, CAST(sum(g.mean) // count(*) AS BIGINT) AS mean_of_means FROM p JOIN g USING (grp) GROUP BY ALL""")
def pooled_vs_group_stats(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    means = rows.groupBy("grp", "line").agg(truncated(F.sum("cents"), F.count(F.lit(1))).alias("m")).groupBy("grp").agg(truncated(F.sum("m"), F.count(F.lit(1))).alias("mean_of_means"))
    return statistics.duration_statistics(rows, ["grp"], "cents").join(means, "grp").select("grp", "count", "median", "p90", "mean", "mean_of_means")


@query(f"""{_QUANTISED} SELECT label, position, {_STATS.format(v='value')} FROM (SELECT *, row_number() OVER (PARTITION BY label, position ORDER BY value) AS rn, count(*) OVER (PARTITION BY label, position) AS n FROM
  (SELECT label, p AS position, q AS value FROM q JOIN embeddings USING (vec_id))) GROUP BY label, position""")
def positional_aggregate(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", F.transform(metrics.quantised(F.col("embedding")), lambda x: x.cast("long")).alias("v"))
    out = statistics.positional(rows, ["label"], "v")
    return out.withColumn("position", F.col("position").cast("long"))


@query("SELECT source, CAST(count(*) AS BIGINT) AS reports, CAST(count(DISTINCT sha256(text)) AS BIGINT) AS contents, count(*) = 2 AND count(DISTINCT sha256(text)) = 1 AS deterministic FROM documents GROUP BY source")
def pair_determinism(spark, sf_dir):
    return statistics.pair_determinism(table(spark, sf_dir, "documents"), "source", F.col("text"))


@query("SELECT sha256(text) AS content, CAST(count(*) AS BIGINT) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_contents(spark, sf_dir):
    return identity.duplicates(table(spark, sf_dir, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("content")), ["content"])


@query("SELECT event_type, user_id, CAST(count(*) AS BIGINT) AS frequency FROM events GROUP BY 1, 2")
def frequency_distribution(spark, sf_dir):
    return statistics.distribution(table(spark, sf_dir, "events"), ["event_type", "user_id"])


@query("""WITH l AS (SELECT o_orderpriority, o_custkey, arg_max(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT), (o_orderdate, o_orderkey)) AS cents FROM orders GROUP BY 1, 2)
  SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS members, min(cents) AS min_cents, max(cents) AS max_cents FROM l GROUP BY 1""")
def last_row_ranges(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("cents", F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long"))
    return statistics.last_row_ranges(orders, ["o_orderpriority"], "o_custkey", ["o_orderdate", "o_orderkey"], ["cents"])


_SERIES = f"(SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) * 1000 AS off, count(*) OVER (PARTITION BY user_id) * 1000 + 500 AS total, cents * 3 AS se, 12 AS channels FROM {_EVENTS})"


@query(f"""SELECT user_id, CAST(count(*) AS BIGINT) AS generation_count, CAST((sum(se * span) * 1000000 + max(channels) * sum(span) // 2) // (max(channels) * sum(span)) AS BIGINT) AS exposure_mse_micro,
  CAST(least(1000000, max(span) * 1000000 // max(total)) AS BIGINT) AS maximum_gap_ppm FROM (SELECT *, coalesce(lead(off) OVER (PARTITION BY user_id ORDER BY off), total) - off AS span FROM {_SERIES}) GROUP BY user_id""")
def exposure_weighted_mean(spark, sf_dir):
    own = Window.partitionBy("user_id")
    rows = _micros(spark, sf_dir)
    rows = rows.select("user_id", (F.row_number().over(own.orderBy("t", "event_id")) * 1000).cast("long").alias("off"), (F.count(F.lit(1)).over(own) * 1000 + 500).alias("total"), (F.col("cents") * 3).alias("se"), F.lit(12).cast("long").alias("channels"))
    return policy.exposure(rows, ["user_id"], "off", "off", "total", "se", "channels")


@query(f"""SELECT policy, (CAST(sum(x) AS BIGINT) + count(*) // 2) // count(*) AS mean_exposure_micro, max(x) AS worst_exposure_micro, max(g) AS maximum_gap_ppm, min(q) AS minimum_last_psnr, (CAST(sum(n) AS BIGINT) * 1000000 + count(*) // 2) // count(*) AS mean_generations_micro FROM (
  SELECT user_id % 4 AS policy, CAST(count(*) AS BIGINT) AS n, CAST((sum(se * span) * 1000000 + max(channels) * sum(span) // 2) // (max(channels) * sum(span)) AS BIGINT) AS x, CAST(least(1000000, max(span) * 1000000 // max(total)) AS BIGINT) AS g, CAST(count(*) * 7 % 100 AS BIGINT) AS q
  FROM (SELECT *, coalesce(lead(off) OVER (PARTITION BY user_id ORDER BY off), total) - off AS span FROM {_SERIES}) GROUP BY user_id) GROUP BY policy""")
def policy_summary(spark, sf_dir):
    rows = exposure_weighted_mean(spark, sf_dir).withColumns({"policy": F.col("user_id") % 4, "last": F.col("generation_count") * 7 % 100})
    return policy.summary(rows, ["policy"], "last")


@query(f"""SELECT k, bool_and(cents >= 200000) AS reaches, bool_and(coalesce(cents >= p, true)) AS never_falls, max(cents) - min(cents) >= 4000000 AS spreads, bool_and(coalesce(line > s, true)) AS grows FROM (
  SELECT *, lag(cents) OVER w AS p, lag(line) OVER w AS s FROM (SELECT l_orderkey AS k, line, max(cents) AS cents FROM {_LINES} GROUP BY ALL) WINDOW w AS (PARTITION BY k ORDER BY line)) GROUP BY k""")
def quality_series(spark, sf_dir):
    rows = _lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("k"), "line").agg(F.max("cents").alias("cents"))
    return joins.quality_series(rows, ["k"], "line", "cents", "line", 200_000, 4_000_000)


@query("SELECT [1, a, b, c] AS thresholds FROM range(2, 10) x(a), range(2, 10) y(b), range(2, 10) z(c) WHERE a < b AND b < c")
def policy_enumeration(spark, sf_dir):
    return policy.enumerate_policies(spark).select(F.transform("thresholds", lambda x: x.cast("long")).alias("thresholds"))


@query("""WITH p AS (SELECT [1, a, b, c] AS th FROM range(2, 10) x(a), range(2, 10) y(b), range(2, 10) z(c) WHERE a < b AND b < c)
  SELECT l_linestatus AS series, array_to_string(th, '-') AS policy, CAST(count(*) AS BIGINT) AS emitted, CAST(sum(scan) AS BIGINT) AS scan_sum FROM (SELECT DISTINCT l_linestatus, CAST(l_linenumber AS BIGINT) AS scan FROM lineitem), p WHERE list_contains(th, scan) AND scan < 7 GROUP BY 1, 2""")
def policy_emission(spark, sf_dir):
    scans = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("series"), F.col("l_linenumber").cast("int").alias("scan")).distinct().withColumn("final", F.lit(7))
    rows = policy.emitted(policy.enumerate_policies(spark), scans, "scan", "final")
    return rows.groupBy("series", F.array_join(F.transform("thresholds", lambda x: x.cast("string")), "-").alias("policy")).agg(F.count(F.lit(1)).alias("emitted"), F.sum("scan").alias("scan_sum"))


@query("""SELECT o_custkey, CAST(count(*) AS BIGINT) AS points, CAST(count(*) FILTER (WHERE cents <= before) AS BIGINT) AS violations FROM (
  SELECT o_custkey, cents, lag(cents) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM (SELECT *, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS cents FROM orders)) GROUP BY o_custkey""")
def monotone_sequence_check(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("cents", F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long"))
    return joins.monotone(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "cents")


@query("SELECT l_orderkey, min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS contiguous FROM lineitem GROUP BY 1")
def contiguous_generations(spark, sf_dir):
    return joins.contiguous(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")


_HALVES = f"(SELECT grp || '-' || line AS k, l_orderkey % 2 AS half, CAST(sum(cents) // count(*) AS BIGINT) AS mean_cents, max(cents) AS max_cents FROM {_LINES} GROUP BY 1, 2)"


@query(f"""SELECT coalesce(o.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'no baseline' WHEN o.k IS NULL THEN 'not observed' WHEN o.mean_cents > greatest((b.mean_cents * 101 + 99) // 100, b.mean_cents + 100) THEN 'mean_cents over budget'
  WHEN o.max_cents > greatest((b.max_cents * 100 + 99) // 100, b.max_cents + 1000) THEN 'max_cents over budget' ELSE 'ok' END AS status FROM (SELECT * FROM {_HALVES} WHERE half = 0) o FULL JOIN (SELECT * FROM {_HALVES} WHERE half = 1) b ON o.k = b.k""")
def budget_regression(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    halves = rows.groupBy(F.concat(F.col("grp").cast("string"), F.lit("-"), F.col("line").cast("string")).alias("k"), (F.col("l_orderkey") % 2).alias("half")).agg(truncated(F.sum("cents"), F.count(F.lit(1))).alias("mean_cents"), F.max("cents").alias("max_cents"))
    baseline = halves.where("half = 1").select("k", statistics.budget("mean_cents", 101, 100).alias("mean_cents_budget"), statistics.budget("max_cents", 100, 1000).alias("max_cents_budget"))
    return statistics.regression_check(halves.where("half = 0"), baseline, "k", ["mean_cents", "max_cents"])


@query("""SELECT CAST(count(*) FILTER (WHERE r.k IS NULL) AS BIGINT) AS only_left, CAST(count(*) FILTER (WHERE l.k IS NULL) AS BIGINT) AS only_right, count(*) FILTER (WHERE r.k IS NULL OR l.k IS NULL) = 0 AS equal FROM (SELECT DISTINCT item_id AS k FROM benchmark) l FULL JOIN (SELECT DISTINCT doc_id AS k FROM labels) r ON l.k = r.k""")
def set_equality(spark, sf_dir):
    return identity.set_equality(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("k")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("k")), "k")


@query("(SELECT doc_id AS k, 'left' AS side FROM documents EXCEPT ALL SELECT doc_id, 'left' FROM labels) UNION ALL (SELECT doc_id, 'right' FROM labels EXCEPT ALL SELECT doc_id, 'right' FROM documents)")
def symmetric_difference(spark, sf_dir):
    return identity.symmetric_difference(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("k")), "k")


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'gif' END AS format FROM pages""")
def format_sniff(spark, sf_dir):
    head = F.element_at(F.array(F.unhex(F.lit("89504E470D0A1A0A")), F.unhex(F.lit("FFD8")), F.unhex(F.lit("474946383961")), F.unhex(F.lit(""))), (F.col("page_id") % 4 + 1).cast("int"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(head, F.col("html").cast("binary")).alias("content"))
    return pages.select("page_id", admission.sniffed_format(F.col("content")).alias("format"))


@query(f"SELECT user_id, max(t) - 2400000000000 AS lower, min(t) AS upper, max(t) - 2400000000000 < min(t) AS meets FROM {_EVENTS} GROUP BY user_id")
def interval_intersection(spark, sf_dir):
    return statistics.intervals_meet(_micros(spark, sf_dir), ["user_id"], "t", 2_400_000_000_000)


_CANCEL = 1_705_000_000_000_000


@query(f"""WITH s AS (SELECT *, sum(service) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS served FROM {_EVENTS}),
  q AS (SELECT *, served + max(t - (served - service)) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS e FROM s)
  SELECT user_id, network_bytes, decoder_bytes, greatest(0, network_bytes - decoder_bytes) AS discarded_bytes, completed_ns, completed_ns - {_CANCEL} AS blocking_ns FROM (SELECT user_id,
  CAST(coalesce(sum(cents) FILTER (WHERE t <= {_CANCEL}), 0) AS BIGINT) AS network_bytes, CAST(coalesce(sum(cents) FILTER (WHERE e - service < {_CANCEL}), 0) AS BIGINT) AS decoder_bytes,
  CAST(coalesce(min(e) FILTER (WHERE e - service < {_CANCEL} AND {_CANCEL} < e), {_CANCEL}) AS BIGINT) AS completed_ns FROM q GROUP BY user_id)""")
def cancel_fence(spark, sf_dir):
    queue = queueing.single_server(_micros(spark, sf_dir), ["user_id"], ["t", "event_id"], "t", "service").withColumnRenamed("t", "arrival_ns")
    return queueing.cancelled(queue, ["user_id"], F.lit(_CANCEL), "cents")


@query("""SELECT conv_id, turn, CAST(place - 1 AS INTEGER) AS place, statement FROM (SELECT conv_id, turn, unnest(l) AS statement, unnest(range(1, len(l) + 1)) AS place FROM (
  SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(replace(text, '.', ';') || '# end', '#[^\\n]*', '', 'g'), ';'), lambda s: regexp_replace(s, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')), lambda s: s <> '') AS l FROM conversations))""")
def scan_script_parse(spark, sf_dir):
    scripts = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.replace(F.col("text"), F.lit("."), F.lit(";")), F.lit("# end")).alias("script"))
    return joins.scan_script(scripts, ["conv_id", "turn"], "script")


@query("""SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS reports, count(DISTINCT o_orderstatus) + CAST(bool_or(o_orderstatus IS NULL) AS INTEGER) = 1 AS o_orderstatus_stable, count(DISTINCT substr(o_orderpriority, 1, 1)) = 1 AS first_stable FROM orders GROUP BY 1""")
def field_stability(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("first", F.substring("o_orderpriority", 1, 1))
    return statistics.stable(orders, ["o_orderpriority"], ["o_orderstatus", "first"])


@query(f"""SELECT grp, before, after, clean, before / after AS speed_up, clean / after AS reproduction FROM (SELECT grp, CAST(max(cents) FILTER (WHERE line = 1) AS DOUBLE) AS before, CAST(max(cents) FILTER (WHERE line = 2) AS DOUBLE) AS after, CAST(max(cents) FILTER (WHERE line = 3) AS DOUBLE) AS clean FROM {_LINES} GROUP BY grp)""")
def three_way_ratios(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("grp", F.col("line").cast("string").alias("phase"), F.col("cents").cast("double").alias("cents"))
    return joins.ratios(rows, "grp", "phase", "cents", ("1", "2", "3"))


@query(f"""SELECT event_type, CAST(count(*) FILTER (WHERE NOT low AND thermal IN ('nominal', 'fair')) AS BIGINT) AS admitted, bool_or(low) AS any_low_power, list_sort(list(DISTINCT thermal)) AS thermal_states FROM (
  SELECT event_type, cents % 7 = 0 AS low, ['nominal', 'fair', 'serious'][cents % 3 + 1] AS thermal FROM {_EVENTS}) GROUP BY 1""")
def environment_admission(spark, sf_dir):
    states = F.element_at(F.array(F.lit("nominal"), F.lit("fair"), F.lit("serious")), (F.col("cents") % 3 + 1).cast("int"))
    rows = _micros(spark, sf_dir).select("event_type", (F.col("cents") % 7 == 0).alias("low"), states.alias("thermal"))
    return rows.groupBy("event_type").agg(F.count_if(admission.environment_admitted(F.col("low"), F.col("thermal"))).alias("admitted"), F.bool_or("low").alias("any_low_power"), F.array_sort(F.collect_set("thermal")).alias("thermal_states"))


@query("SELECT s_suppkey, s_name || '#impl=' || s_nationkey || '#contract=2' AS fingerprint, CASE WHEN s_nationkey BETWEEN 1 AND 8 THEN s_nationkey ELSE 1 END AS orientation FROM supplier")
def codec_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", admission.fingerprint(F.col("s_name"), F.col("s_nationkey"), F.lit(2)).alias("fingerprint"), admission.orientation(F.col("s_nationkey")).alias("orientation"))


@query("""SELECT p_partkey, CASE WHEN CAST(p_partkey AS HUGEINT) * 5000000000 * p_size * 1000000 > 9223372036854775807 THEN 9223372036854775807 ELSE CAST(CAST(p_partkey AS HUGEINT) * 5000000000 * p_size * 1000000 AS BIGINT) END AS byte_cost,
  CAST(CASE WHEN p_size > 0 THEN least(1000000, p_partkey * 1000000 // (p_size * 40)) ELSE 0 END AS BIGINT) AS fraction_ppm, (p_partkey * 7 + p_size - 1) // p_size AS transfer, (p_partkey * 7 + p_size // 2) // p_size AS rounded FROM part""")
def fixed_point(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size").cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", saturated_product(key, F.lit(5_000_000_000), size, 1_000_000).alias("byte_cost"), ppm(key, size * 40).alias("fraction_ppm"), ceiled(key * 7, size).alias("transfer"), half_up(key * 7, size).alias("rounded"))


@query("""SELECT side, o_orderkey, o_custkey FROM ((SELECT 'left' AS side, o_orderkey, o_custkey FROM orders WHERE o_orderkey % 10 = 1) UNION ALL (SELECT 'right' AS side, o_orderkey, o_custkey + 1 FROM orders WHERE o_orderkey % 10 = 1))""")
def reconstructed_equality(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rebuilt = orders.select("o_orderkey", (F.col("o_custkey") + (F.col("o_orderkey") % 10 == 1).cast("long")).alias("o_custkey"))
    return joins.equal_tables(orders, rebuilt)


@query(f"""SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY completed) AS INTEGER) AS generation FROM (SELECT user_id, event_id, completed, (completed >= 1)::INT + (completed >= 2)::INT + (completed >= 4)::INT + (completed >= 8)::INT AS crossed, (completed > 1)::INT + (completed > 2)::INT + (completed > 4)::INT + (completed > 8)::INT AS before
  FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS completed FROM {_EVENTS})) WHERE crossed > before""")
def emission_gate(spark, sf_dir):
    from ..streaming.session import gate

    rows = _micros(spark, sf_dir).withColumn("completed", F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")))
    return gate(rows, ["user_id"], "completed", "completed").select("user_id", "event_id", "generation")


@query("""SELECT doc_id, CAST(k AS BIGINT) AS chunk_index, CASE WHEN least(n, (k + 1) * 1024) <= 4096 THEN least(1024, n - k * 1024) ELSE 0 END AS accepted FROM (SELECT doc_id, n, unnest(range(0, (n + 1023) // 1024)) AS k FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents))""")
def bounded_sink(spark, sf_dir):
    parts = identity.chunks(table(spark, sf_dir, "documents"), ["doc_id"], F.col("text"), 1024)
    return identity.bounded_writes(parts, "doc_id", "chunk_index", "chunk_byte_count", 4096).select("doc_id", "chunk_index", "accepted")


_NETWORK = "WITH n AS (SELECT * FROM (VALUES ('fast', 10000000, 80000000), ('slow', 20000000, 4000000)) v(network, delay, bps))"


@query(f"""{_NETWORK} SELECT doc_id, network, CAST(k AS BIGINT) AS chunk_index, CAST(delay + CASE WHEN k = 0 THEN 0 ELSE (k - 1) * ((1024 * 8000000000 + bps - 1) // bps) + (least(1024, n - k * 1024) * 8000000000 + bps - 1) // bps END AS BIGINT) AS arrival_ns
  FROM (SELECT doc_id, n, unnest(range(0, (n + 1023) // 1024)) AS k FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents)), n""")
def network_arrivals(spark, sf_dir):
    networks = spark.createDataFrame([("fast", 10_000_000, 80_000_000), ("slow", 20_000_000, 4_000_000)], "network string, delay long, bps long")
    parts = identity.chunks(table(spark, sf_dir, "documents"), ["doc_id"], F.col("text"), 1024).crossJoin(F.broadcast(networks))
    rows = queueing.arrivals(parts, ["doc_id", "network"], ["chunk_index"], "chunk_byte_count", F.col("delay"), F.col("bps"))
    return rows.select("doc_id", "network", "chunk_index", "arrival_ns")


_PAGE_SIZES = f"""(SELECT *, greatest(16, (n + width * 3 - 1) // (width * 3)) AS height FROM (SELECT *, 48 * greatest(1, (n + 48 * 3 * 16384 - 1) // (48 * 3 * 16384)) AS width
  FROM (SELECT page_id, CASE WHEN html IS NULL OR html = '' THEN ' ' ELSE html END AS text, octet_length(encode(CASE WHEN html IS NULL OR html = '' THEN ' ' ELSE html END)) AS n FROM pages)))"""


@query(f"""SELECT page_id, CASE WHEN ok THEN 'png' END AS format, CASE WHEN ok THEN CAST(width AS BIGINT) END AS width, CASE WHEN ok THEN CAST(height AS BIGINT) END AS height, CASE WHEN ok THEN CAST(1 AS BIGINT) END AS frame_count, CASE WHEN ok THEN 1 END AS orientation,
  CASE WHEN ok THEN CAST(6 + length(CAST(page_id AS VARCHAR)) AS BIGINT) END AS metadata_byte_count, CAST(0 AS BIGINT) AS attachment_count, CASE WHEN ok THEN 'standardSRGB' END AS source_profile, CASE WHEN NOT ok THEN 'unsupportedOrCorruptImage' END AS failure
  FROM (SELECT *, page_id % 10 <> 9 AS ok FROM {_PAGE_SIZES})""")
def container_probe(spark, sf_dir):
    """Every page as an image file: PNG pictures of all its text's bytes, some spoiled; probed and admitted."""
    from ..operators.probe import probe

    return probe(_page_images(spark, sf_dir))


@query(f"""SELECT page_id, CASE WHEN ok THEN CAST(width AS INTEGER) END AS width, CASE WHEN ok THEN CAST(height AS INTEGER) END AS height, CASE WHEN ok THEN 3 END AS channels,
  CASE WHEN ok THEN sha256(encode(text) || encode(repeat(' ', CAST(width * height * 3 - n AS BIGINT)))) END AS pixels_sha256, CASE WHEN ok THEN true END AS survives, CASE WHEN NOT ok THEN 'unsupportedOrCorruptImage' END AS failure
  FROM (SELECT *, page_id % 10 <> 9 AS ok FROM {_PAGE_SIZES})""")
def decode_and_encode(spark, sf_dir):
    """Pages' pictures decoded whole, encoded as PNG and decoded again: sizes, digests of the pixels and whether they survive."""
    from ..operators.probe import decode, encode

    whole = (DecodeLimits().dimension,) * 2
    first = decode(_page_images(spark, sf_dir), "page_id", whole).repartition("page_id")  # decoded once, and later steps get workers of their own
    again = decode(encode(first, "page_id"), "page_id", whole).select("page_id", F.col("pixels").alias("again"))
    joined = first.join(again.hint("merge"), "page_id")  # by the files' size Spark would broadcast pixels through the driver
    return joined.select("page_id", "width", "height", "channels", F.sha2("pixels", 256).alias("pixels_sha256"), (F.col("pixels") == F.col("again")).alias("survives"), "failure")


@query(f"""SELECT page_id, mode, CAST(CASE WHEN mode = 'fit' THEN least(tw, 64) ELSE least(tw, 64) END AS INTEGER) AS width, CAST(least(th, 40) AS INTEGER) AS height FROM (
  SELECT *, greatest(1, least(l, floor(width * (l::DOUBLE / greatest(width, height)) + 0.5))) AS tw, greatest(1, least(l, floor(height * (l::DOUBLE / greatest(width, height)) + 0.5))) AS th FROM (
  SELECT *, greatest(1, least(greatest(width, height), floor(greatest(width, height) * s))) AS l FROM (
  SELECT *, least(1.0::DOUBLE, CASE WHEN mode = 'fit' THEN least(64::DOUBLE / width, 40::DOUBLE / height) ELSE greatest(64::DOUBLE / width, 40::DOUBLE / height) END) AS s FROM {_PAGE_SIZES}, (VALUES ('fit'), ('fill')) m(mode) WHERE page_id % 10 <> 9)))""")
def decode_to_target(spark, sf_dir):
    """Pages' pictures decoded into 64 by 40: fit lies inside, fill is cropped."""
    from ..operators.probe import decode

    both = [decode(_page_images(spark, sf_dir), "page_id", (64, 40), mode).where("failure IS NULL").select("page_id", F.lit(mode).alias("mode"), "width", "height") for mode in ("fit", "fill")]
    return both[0].unionByName(both[1])


_SESSIONS = """(SELECT *, least(total, 7 * (c + 1)) AS received FROM (SELECT *, unnest(range(0, (total + 6) // 7)) AS c FROM (SELECT c_custkey AS k, c_custkey % 10 + 1 AS n, 17 + 13 * (c_custkey % 10 + 1) AS total, c_custkey % 13 = 0 AS baseline, c_custkey % 17 = 5 AS stops FROM customer)))"""


@query(f"""WITH s AS {_SESSIONS}, e AS (SELECT *, CASE WHEN stops AND c >= 3 THEN 'progressiveSessionCancelled' WHEN baseline AND received >= 15 THEN 'progressiveDecodingUnsupported' END AS failed,
  CASE WHEN received < total THEN (done >= 1)::INT + (done >= 2)::INT + (done >= 4)::INT + (done >= 8)::INT ELSE 0 END AS crossed FROM (SELECT *, greatest(0, least(n, (received - 17) // 13)) AS done FROM s)),
  g AS (SELECT *, coalesce(max(CASE WHEN failed IS NULL THEN crossed END) OVER (PARTITION BY k ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e),
  d AS (SELECT *, failed IS NULL AND crossed > before AS due FROM g), n AS (SELECT *, CAST(count(*) FILTER (WHERE due) OVER (PARTITION BY k ORDER BY c) AS INTEGER) AS generation FROM d),
  f AS (SELECT k, total, baseline, stops, max(received) FILTER (WHERE NOT (stops AND c >= 3)) AS last FROM s GROUP BY ALL)
  SELECT CAST(k AS VARCHAR) AS stream_id, CAST(10 * c AS BIGINT) AS seq, CASE WHEN due THEN 'generation' ELSE 'failure' END AS event, CASE WHEN due THEN generation END AS generation,
  CAST(CASE WHEN stops AND c >= 3 THEN 21 ELSE received END AS BIGINT) AS source_byte_count, failed AS failure FROM n WHERE due OR failed IS NOT NULL
  UNION ALL SELECT CAST(k AS VARCHAR), (1::BIGINT << 40) + step, CASE WHEN step = 0 AND NOT baseline AND NOT stops THEN 'final' ELSE 'failure' END, NULL, last,
  CASE WHEN stops THEN 'progressiveSessionCancelled' WHEN step = 1 THEN 'progressiveSessionFinished' WHEN baseline THEN 'unsupportedOrCorruptImage' END FROM f, (VALUES (0), (1)) t(step) WHERE step = 0 OR k % 19 = 3""")
def progressive_sessions(spark, sf_dir):
    """Synthetic progressive files, one for each customer, in chunks of 7 bytes; some are cancelled, some finished twice: generations, finals and failures."""
    from ..streaming.session import progressive_batch

    return progressive_batch(_progressive_events(spark, sf_dir))


#: Lines of which a task sorts the simulated chunks; more would be sorted on disk.
LINES_A_TASK = 500_000
_CHUNKS = f"(SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY line, bytes, append_ns) AS line, bytes, append_ns, CASE WHEN line % 2 = 1 THEN line END AS generation FROM (SELECT l_orderkey AS stream, line, cents % 30000 + 1 AS bytes, cents % 9000000 + 1 AS append_ns FROM {_LINES}))"
_FRAME = 16_666_667


@query(f"""WITH a AS (SELECT c.*, network, CAST(sum(CASE WHEN rn = 1 THEN delay ELSE (bytes * 8000000000 + bps - 1) // bps END) OVER w AS BIGINT) AS arrival FROM (
  SELECT c.*, network, delay, bps, row_number() OVER (PARTITION BY stream, network ORDER BY line) AS rn FROM {_CHUNKS} c, (VALUES ('fast', 10000000, 80000000), ('slow', 20000000, 4000000)) v(network, delay, bps)) c WINDOW w AS (PARTITION BY stream, network ORDER BY line ROWS UNBOUNDED PRECEDING)),
  s AS (SELECT *, sum(append_ns) OVER (PARTITION BY stream, network ORDER BY line ROWS UNBOUNDED PRECEDING) AS served FROM a),
  q AS (SELECT *, CAST(served + max(arrival - (served - append_ns)) OVER (PARTITION BY stream, network ORDER BY line ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ended FROM s),
  t AS (SELECT stream, network, max(arrival) AS network_complete_ns, max(ended - append_ns - arrival) AS maximum_queue_delay_ns, CAST(sum(ended - append_ns - arrival) // count(*) AS BIGINT) AS mean_queue_delay_ns,
  greatest(max(arrival), max(ended)) + 28000000 AS final_generated_ns, greatest(0, max(arrival) - max(ended)) AS idle_before_final_ns FROM q GROUP BY ALL),
  k AS (SELECT stream, network, CAST(greatest(0, max(held)) AS BIGINT) AS peak_bytes FROM (SELECT *, sum(delta) OVER (PARTITION BY stream, network ORDER BY happens, kind, delta ROWS UNBOUNDED PRECEDING) AS held FROM (
  SELECT stream, network, arrival AS happens, 0 AS kind, bytes AS delta FROM q UNION ALL SELECT stream, network, ended, 1, -bytes FROM q)) GROUP BY ALL),
  c AS (SELECT stream, network, false AS final, generation, ended + 20000 AS accepted, line AS place FROM q WHERE generation IS NOT NULL UNION ALL SELECT stream, network, true, NULL, final_generated_ns + 20000, 1000 FROM t),
  p AS (SELECT *, 'immediate' AS policy, accepted AS shown FROM c UNION ALL SELECT stream, network, final, generation, accepted, place, 'frame-coalesced-60hz', CASE WHEN row_number() OVER (PARTITION BY stream, network, accepted // {_FRAME} ORDER BY place DESC) = 1 THEN (accepted // {_FRAME} + 1) * {_FRAME} END FROM c)
  SELECT stream, network, policy, min(shown) FILTER (WHERE NOT final) AS first_preview_presented_ns, max(shown) FILTER (WHERE final) AS final_presented_ns, CAST(count(*) FILTER (WHERE NOT final) AS BIGINT) AS generated_previews, CAST(count(shown) FILTER (WHERE NOT final) AS BIGINT) AS presented_previews,
  coalesce(list(generation ORDER BY generation) FILTER (WHERE shown IS NOT NULL AND generation IS NOT NULL), []) AS presented_generations, any_value(network_complete_ns) AS network_complete_ns, any_value(maximum_queue_delay_ns) AS maximum_queue_delay_ns, any_value(mean_queue_delay_ns) AS mean_queue_delay_ns,
  any_value(final_generated_ns) AS final_generated_ns, any_value(idle_before_final_ns) AS idle_before_final_ns, any_value(peak_bytes) AS peak_bytes FROM p JOIN t USING (stream, network) JOIN k USING (stream, network) GROUP BY stream, network, policy""")
def simulation_matrix(spark, sf_dir):
    """Orders as streams, their lines as chunks, under two networks and both presentation policies."""
    chunk = F.struct(F.col("line"), (F.col("cents") % 30_000 + 1).alias("bytes"), (F.col("cents") % 9_000_000 + 1).alias("append_ns"))
    rows = _lines(spark, sf_dir)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // LINES_A_TASK))  # the count is read from the files' footers
    lines = rows.repartition(tasks, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(chunk)).alias("chunks"))
    generation = lambda line: F.when(line % 2 == 1, line).cast("int")
    numbered = F.transform("chunks", lambda c, i: F.struct((i + 1).cast("long").alias("chunk_index"), c["bytes"].alias("bytes"), c["append_ns"].alias("append_ns"), generation(c["line"]).alias("generation"), F.lit(20_000).cast("long").alias("handoff_ns")))  # line numbers may repeat
    samples = lines.withColumn("chunks", numbered).select(F.col("l_orderkey").alias("stream"), F.lit(1_000_000).cast("long").alias("finish_ns"), F.lit(27_000_000).cast("long").alias("final_decode_ns"), F.lit(20_000).cast("long").alias("final_handoff_ns"), "chunks")
    networks = spark.createDataFrame([("fast", 10_000_000, 80_000_000), ("slow", 20_000_000, 4_000_000)], "network string, first_delay_ns long, bits_per_second long")
    return queueing.simulate(samples, networks)


def _page_images(spark, sf_dir) -> DataFrame:
    """Pages as pictures of all bytes of their texts, 48 pixels wide and as high as needed (wider above the dimension limit), blanks at the end."""
    ship(spark)
    highest = DecodeLimits().dimension

    def pictures(ids: pd.Series, html: pd.Series) -> pd.Series:
        out = []
        for page, text in zip(ids, html):
            data = (text or " ").encode()
            width = 48 * max(1, -(-len(data) // (48 * 3 * highest)))
            height = max(16, -(-len(data) // (width * 3)))
            raster = np.frombuffer(data.ljust(width * height * 3), dtype=np.uint8).reshape(height, width, 3)
            blob = encode_png(raster, ((b"sRGB", b"\0"), (b"tEXt", b"Title\0" + str(page).encode())))
            out.append(blob[:-1] if page % 10 == 9 else blob)
        return pd.Series(out, dtype=object)

    make = pandas_udf(pictures, "binary")
    return spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", make("page_id", "html").alias("content"))


def _progressive_events(spark, sf_dir) -> DataFrame:
    """Files of key % 10 + 1 scans each, the frame progressive unless the key is a multiple of 13."""
    key = F.col("c_custkey")
    frame = F.when(key % 13 == 0, F.lit("FFC0")).otherwise(F.lit("FFC2"))
    scan = "FFDA000311A1B2FF00C3FFD0D4"
    body = F.unhex(F.concat(F.lit("FFD8"), frame, F.lit("000B080010001001011100"), F.repeat(F.lit(scan), (key % 10 + 1).cast("int")), F.lit("FFD9")))
    files = table(spark, sf_dir, "customer").select(key.cast("string").alias("stream_id"), body.alias("content"))
    chunks = identity.chunk_contents(files, ["stream_id"], "content", 7).select("stream_id", (F.col("chunk_index") * 10).alias("seq"), F.lit("chunk").alias("kind"), "chunk")
    none, last, number = F.lit(None).cast("binary").alias("chunk"), F.lit(1 << 40), F.col("stream_id").cast("long")
    ends = files.select("stream_id", last.alias("seq"), F.when(number % 23 == 7, F.lit("finish_if_complete")).otherwise(F.lit("finish")).alias("kind"), none)
    twice = files.where(number % 19 == 3).select("stream_id", (last + 1).alias("seq"), F.lit("finish").alias("kind"), none)
    early = files.where(number % 7 == 2).select("stream_id", F.lit(15).cast("long").alias("seq"), F.lit("finish_if_complete").alias("kind"), none)  # changes nothing
    stops = files.where(number % 17 == 5).select("stream_id", F.lit(25).cast("long").alias("seq"), F.lit("cancel").alias("kind"), none)
    return chunks.unionByName(ends).unionByName(twice).unionByName(early).unionByName(stops)


from . import document_queries, image_queries, report_queries, storage_queries, validation_queries  # noqa: E402, F401  they register their own
