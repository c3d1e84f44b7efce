"""Every registered query against its SQL twin on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from pixelframe.functions.pixels import decode
from pixelframe.plans import image_queries
from pixelframe.plans.queries import ORACLE_SQL, QUERIES, _page_images

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return value


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(plain(row[i]) for i in order)) for row in rows)


@pytest.fixture(scope="module")
def con(sf_dir):
    if not Path(sf_dir).exists():
        pytest.skip("no test tables")
    found = duckdb.connect()
    for name in TABLES:
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return found


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(name, spark, sf_dir, con):
    frame = QUERIES[name](spark, sf_dir)
    expected = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in expected.description]
    assert sorted(names) == sorted(frame.columns)
    assert canonical([tuple(r) for r in frame.collect()], frame.columns) == canonical(expected.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(name, spark, sf_dir):
    if not Path(sf_dir).exists():
        pytest.skip("no test tables")
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_page_images_hold_every_byte(spark, tmp_path):
    texts = [None, "", "short", "x" * 2304, "x" * 2304 + "y", "é" * 9000 + "end", "z" * 3_000_000 + "end"]
    spark.createDataFrame([(10 * i, t) for i, t in enumerate(texts)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    made = {r["page_id"]: decode(bytes(r["content"])) for r in _page_images(spark, str(tmp_path)).collect()}
    assert {i: p.tobytes().rstrip(b" ") for i, p in made.items()} == {10 * i: (t or "").encode() for i, t in enumerate(texts)}
    decoded = QUERIES["decode_and_encode"](spark, str(tmp_path)).collect()
    assert len(decoded) == len(texts) and all(r["failure"] is None for r in decoded)


def test_entry(spark):
    import __spark_entry__

    frame = __spark_entry__.entry(spark)
    assert frame.columns == ["event_type", "count", "minimum", "median", "p90", "maximum", "mean"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["decode_and_encode", "probe_agreement"])
def test_pictures_are_read_once(name, spark, sf_dir):
    """Both sides of a join read one exchange of what Python made of the table."""
    frame = QUERIES[name](spark, sf_dir)
    frame.collect()
    final = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final


@pytest.fixture(scope="module")
def many_parts(spark, tmp_path_factory):
    """6,000 parts whose pictures occur several times, with a key that occurs twice."""
    folder = f"{tmp_path_factory.mktemp('parts')}"
    spark.sql("SELECT id AS p_partkey, CAST(id % 7 AS INT) AS p_size FROM range(6000) UNION ALL SELECT 5, 5").coalesce(3).write.parquet(f"{folder}/part.parquet")
    return folder


@pytest.mark.parametrize("script", [None, image_queries._MEANS])
def test_equal_pictures_go_to_one_task(script, spark, many_parts):
    """Else every worker makes and decodes every picture."""
    made = image_queries._cell_files(spark, many_parts, script).select("content", F.spark_partition_id().alias("task"))
    tasks = made.groupBy("content").agg(F.count_distinct("task").alias("tasks"), F.count("*").alias("n"))
    seen = tasks.agg(F.max("tasks"), F.max("n"), F.count_distinct("content")).first()
    assert seen[0] == 1 and seen[1] > 1 and seen[2] > 1000


def test_scan_scripts_decode_each_file_once(spark, many_parts):
    """Also for a part that occurs twice, as its twin has it."""
    frame = QUERIES["scan_script_corpus"](spark, many_parts)
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2 * 4
    found = duckdb.connect()
    found.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{many_parts}/part.parquet/*.parquet')")
    expected = found.execute(ORACLE_SQL["scan_script_corpus"])
    names = [c[0] for c in expected.description]
    assert canonical([tuple(r) for r in frame.collect()], frame.columns) == canonical(expected.fetchall(), names)


def test_equal_files_are_probed_once(monkeypatch):
    """By the worker's memo, with the limits in its key."""
    from pixelframe.batches import memo
    from pixelframe.contracts import DecodeLimits
    from pixelframe.operators import probe

    calls = []
    monkeypatch.setattr(probe, "probe_bytes", lambda content, limits: calls.append(content) or {"format": "png"})
    for limits in (DecodeLimits(), DecodeLimits(), DecodeLimits(encoded_bytes=5)):
        assert [probe.probed(memo("probe", limits), c, limits) for c in (b"a", b"a", None, None, b"")] == [{"format": "png"}] * 5
    assert calls == [b"a", None, b""] * 2


def test_pages_are_dealt_in_bounded_batches(spark, sf_dir):
    assert _page_images(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != "10000"


@pytest.mark.parametrize("name", ["jpeg_round_trip", "decode_and_encode"])
def test_pixels_are_not_broadcast(name, spark, sf_dir):
    """By the small files of keys Spark took all pixels for small and sent them through the driver."""
    assert "Broadcast" not in QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_round_trip_of_repeated_keys(spark, many_parts):
    """A part that occurs twice gives two rows of each mode, as its twin has it, not four."""
    frame = QUERIES["jpeg_round_trip"](spark, many_parts)
    found = duckdb.connect()
    found.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{many_parts}/part.parquet/*.parquet')")
    expected = found.execute(ORACLE_SQL["jpeg_round_trip"])
    names = [c[0] for c in expected.description]
    assert canonical([tuple(r) for r in frame.collect()], frame.columns) == canonical(expected.fetchall(), names)


def test_simulation_is_dealt_once(spark, sf_dir):
    """Its steps were joined: lines were read, dealt and sorted again for each of them."""
    plan = QUERIES["simulation_matrix"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == 1


def test_simulated_lines_a_task_are_bounded(spark, sf_dir, monkeypatch):
    """With a fixed number of tasks, these sorted on disk what larger tables gave them."""
    from pixelframe.plans import queries

    monkeypatch.setattr(queries, "LINES_A_TASK", 100)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    plan = QUERIES["simulation_matrix"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert f", {-(-lines // 100)}), REPARTITION_BY_NUM" in plan


def test_pictures_are_dealt_over_folders(spark, sf_dir, monkeypatch, tmp_path):
    """Tasks that make files in one folder wait for each other, and the driver lists that folder alone."""
    from pixelframe.plans import report_queries

    monkeypatch.setattr(report_queries, "PICTURES", 50, raising=False)
    monkeypatch.setattr(report_queries, "_scratch", lambda spark, name: str(tmp_path / name))
    found = {r["p_partkey"] for r in QUERIES["image_files_round_trip"](spark, sf_dir).collect()}
    held = [len([f for f in folder.iterdir() if f.is_file()]) for folder in [tmp_path / "pictures", *(tmp_path / "pictures").iterdir()] if folder.is_dir()]
    assert max(held) <= 50 and sum(held) == spark.read.parquet(f"{sf_dir}/part.parquet").count() >= len(found) > 0
