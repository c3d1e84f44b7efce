"""Operators on small literal tables."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixelframe.contracts import CodecDescriptor, DecodeLimits
from pixelframe.functions import numeric
from pixelframe.functions.pixels import encode_png, encode_pnm, pattern
from pixelframe.operators import admission, identity, joins, policy, probe, queueing, statistics
from pixelframe.sources import files


def values(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_saturation_and_fixed_point(spark):
    assert one(spark, numeric.saturated_product(F.lit(1 << 62), 4)) == numeric.LONG_MAX
    assert one(spark, numeric.saturated_product(F.lit(-5), 4)) == 0
    assert one(spark, numeric.saturated_sum(F.lit(numeric.LONG_MAX), 1)) == numeric.LONG_MAX
    assert one(spark, numeric.half_up(F.lit(5), 2)) == 3 and one(spark, numeric.ceiled(F.lit(5), 2)) == 3
    assert one(spark, numeric.truncated(F.lit(5), 0)) is None and one(spark, numeric.ppm(F.lit(3), 0)) == 0
    assert one(spark, numeric.ppm(F.lit(7), 2)) == 1_000_000
    assert one(spark, numeric.micro_psnr(F.lit(0))) == 999_000_000


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=30))
def test_nearest_rank_by_definition(spark, sample):
    frame = spark.createDataFrame([("g", v) for v in sample], "g string, v long")
    found = statistics.nearest_rank(frame, ["g"], "v", {"median": (1, 2), "p90": (9, 10)}).first()
    ranked = sorted(sample)
    assert found["median"] == ranked[max(1, -(-len(ranked) // 2)) - 1]
    assert found["p90"] == ranked[max(1, -(-len(ranked) * 9 // 10)) - 1]


def test_statistics_skip_nulls_and_stay_empty(spark):
    frame = spark.createDataFrame([("a", 1), ("a", None), ("a", 4)], "g string, v long")
    assert values(statistics.duration_statistics(frame, ["g"], "v"), "g", "count", "median", "mean") == [("a", 2, 1, 2)]
    assert statistics.duration_statistics(frame.where("false"), ["g"], "v").count() == 0


def test_arrivals(spark):
    chunks = spark.createDataFrame([("s", 0, 100), ("s", 1, 200), ("s", 2, 50)], "s string, i int, n long")
    found = queueing.arrivals(chunks, ["s"], ["i"], "n", F.lit(10), F.lit(80_000_000_000))
    assert values(found, "i", "arrival_ns") == [(0, 10), (1, 30), (2, 35)]


def test_queue_equals_recursion(spark):
    rows = [(i, t, d) for i, (t, d) in enumerate([(0, 5), (2, 1), (3, 4), (30, 2), (31, 9), (31, 1)])]
    frame = spark.createDataFrame([("s", *r) for r in rows], "s string, i int, t long, d long")
    end, expected = 0, []
    for i, t, d in rows:
        start = max(t, end)
        end = start + d
        expected.append((i, start, end, start - t))
    assert values(queueing.single_server(frame, ["s"], ["i"], "t", "d"), "i", "start_ns", "end_ns", "queue_delay_ns") == expected


def test_latest_of_a_frame_is_presented(spark):
    ms = 1_000_000
    frame = spark.createDataFrame([("s", k, t * ms) for k, t in enumerate((1, 10, 20, 21))], "s string, k int, t long")
    found = queueing.coalesced(frame, ["s"], ["k"], "t")
    assert values(found.where("presented"), "k", "presented_ns") == [(1, queueing.FRAME_NS), (3, 2 * queueing.FRAME_NS)]
    fenced = queueing.coalesced(frame, ["s"], ["k"], "t", cancel=F.lit(21 * ms))
    assert values(fenced.where("presented"), "k") == [(1,)]


def test_cancel_in_flight(spark):
    frame = spark.createDataFrame([("s", 0, 10, 0, 20, 100), ("s", 1, 20, 20, 40, 100)], "s string, i int, arrival_ns long, start_ns long, end_ns long, n long")
    assert values(queueing.cancelled(frame, ["s"], F.lit(25), "n"), "completed_ns", "blocking_ns", "network_bytes", "decoder_bytes", "discarded_bytes") == [(40, 15, 200, 200, 0)]
    idle = queueing.cancelled(frame, ["s"], F.lit(50), "n")
    assert values(idle, "completed_ns", "blocking_ns") == [(50, 0)]


def test_buffered_peak_counts_arrivals_first(spark):
    frame = spark.createDataFrame([("s", 0, 10, 100), ("s", 10, 20, 70)], "s string, a long, e long, n long")
    assert values(queueing.buffered_peak(frame, ["s"], "a", "e", "n"), "peak_bytes") == [(170,)]


def test_simulation_of_one_stream(spark):
    chunk = [(0, 100, 2_000_000, 1, 0), (1, 100, 2_000_000, None, None)]
    samples = spark.createDataFrame([("s", 0, 0, 0, chunk)], "stream string, finish_ns long, final_decode_ns long, final_handoff_ns long, chunks array<struct<chunk_index: int, bytes: long, append_ns: long, generation: int, handoff_ns: long>>")
    networks = spark.createDataFrame([("n", 10_000_000, 800)], "network string, first_delay_ns long, bits_per_second long")
    found = {r["policy"]: r for r in queueing.simulate(samples, networks).collect()}
    assert found["immediate"]["peak_bytes"] == 100 and found["immediate"]["maximum_queue_delay_ns"] == 0
    assert found["immediate"]["first_preview_presented_ns"] == 12_000_000
    assert found["frame-coalesced-60hz"]["first_preview_presented_ns"] == queueing.FRAME_NS
    assert found["immediate"]["presented_generations"] == [1]


def test_working_set_golden(spark):
    def estimate(target, mode):
        size = F.lit(3072).cast("long"), F.lit(2048).cast("long"), F.lit(target[0]), F.lit(target[1]), F.lit(mode)
        return one(spark, admission.working_set(*size))

    assert estimate((3072, 2048), "fit") == 75_497_472
    assert estimate((1024, 1024), "fit") == 8_392_704
    assert estimate((512, 512), "fit") == 2_101_248
    assert estimate((1024, 1024), "fill") == 16_777_216
    assert one(spark, admission.working_set(F.lit(0).cast("long"), *(F.lit(1).cast("long"),) * 3, F.lit("fit"))) == numeric.LONG_MAX


def test_limits_clamp_or_refuse():
    assert DecodeLimits(dimension=0, frame_count=10**9, metadata_bytes=-4) == DecodeLimits(dimension=1, frame_count=4096, metadata_bytes=0)
    with pytest.raises(ValueError, match="dimension"):
        DecodeLimits.checked(dimension=0)
    assert CodecDescriptor("x", 3).fingerprint == "x#impl=3#contract=2"


def test_probe_admission_and_decode(spark):
    good = encode_png(pattern(100, 50))
    rows = [("good", good), ("cut", good[:-1]), ("null", None), ("odd", b"BM12345678"), ("wide", encode_png(pattern(300, 2)))]
    frame = spark.createDataFrame(rows, "k string, content binary")
    found = {r["k"]: r for r in probe.probe(frame, limits=DecodeLimits(dimension=256)).collect()}
    assert {k: r["failure"] for k, r in found.items()} == {"good": None, "cut": "unsupportedOrCorruptImage", "null": "unsupportedOrCorruptImage", "odd": "unsupportedFormat", "wide": "dimensionLimitExceeded"}
    assert probe.probe(frame, limits=DecodeLimits(encoded_bytes=20)).where("failure = 'encodedBytesExceeded'").count() == 3
    rasters = probe.decode(frame, "k", (20, 20))
    assert values(rasters.where("failure IS NULL AND k = 'good'"), "width", "height", "channels") == [(20, 10, 3)]
    coded = probe.encode(rasters, "k")
    assert coded.where("content IS NOT NULL").count() == 2
    again = probe.probe(coded.where("content IS NOT NULL").drop("failure"))
    assert values(again, "k", "width", "failure") == [("good", 20, None), ("wide", 20, None)]
    assert probe.probe(frame.where("false")).count() == 0


def test_parts_and_scans(spark):
    from tests.test_containers import FRAME, SCAN, jpeg

    frame = spark.createDataFrame([("j", jpeg(FRAME, SCAN, SCAN)), ("bad", b"\xff\xd8\xff")], "k string, content binary")
    kinds = [r["kind"] for r in probe.container_parts(frame, ["k"]).where("k = 'j'").orderBy("offset").collect()]
    assert kinds == ["C2", "DA", "DA", "D9"]
    assert values(probe.container_parts(frame.where("k = 'bad'"), ["k"]), "failure") == [("unsupportedOrCorruptImage",)]
    assert values(probe.scan_boundaries(frame, "k").groupBy("scan").agg(F.max("entropy_end").alias("e")), "scan") == [(1,), (2,)]


def test_pareto_by_brute_force(spark):
    import random

    random.seed(4)
    rows = [(i, random.randint(0, 9), random.randint(0, 9)) for i in range(200)]
    frame = spark.createDataFrame(rows, "k int, low int, high int").repartition(7)
    expected = sorted(r for r in rows if not any(s[1] <= r[1] and s[2] >= r[2] and (s[1], s[2]) != (r[1], r[2]) for s in rows))
    assert values(policy.pareto_frontier(frame, ["low"], ["high"]), "k", "low", "high") == expected
    assert policy.pareto_frontier(frame.where("false"), ["low"], ["high"]).count() == 0


def test_leaders_break_ties_low(spark):
    frame = spark.createDataFrame([("b", 5), ("a", 5), ("c", 1)], "k string, m int")
    assert policy.leaders(frame, "k", {"m": True}).first()["m_leader"] == "a"


def test_manifest_comparison_and_sink(spark):
    have = spark.createDataFrame([("a", b"12"), ("b", b"3")], "p string, c binary")
    want = spark.createDataFrame([("a", b"12"), ("b", b"4"), ("d", b"")], "p string, c binary")
    made = [identity.manifest(f, F.col("p"), F.col("c")) for f in (want, have.union(spark.createDataFrame([("e", b"x")], have.schema)))]
    assert values(identity.compared(*made), "path", "status") == [("b", "content"), ("d", "missing"), ("e", "extra")]
    writes = spark.createDataFrame([("s", 0, 2), ("s", 1, 3), ("s", 2, 1)], "k string, i int, n long")
    assert values(identity.bounded_writes(writes, "k", "i", "n", 4), "i", "accepted") == [(0, 2), (1, 0), (2, 0)]


def test_symbol_relations(spark):
    symbols = spark.createDataFrame([("1", "A", "public"), ("2", "B", "internal"), ("3", "P", "public")], "id string, name string, access string")
    edges = spark.createDataFrame([("1", "3", None, "conformsTo"), ("1", "9", "Other.X", "conformsTo"), ("2", "3", None, "conformsTo"), ("1", "3", None, "memberOf")], "source string, target string, target_fallback string, kind string")
    assert values(joins.relationships(symbols, edges), "source_name", "target") == [("A", "3"), ("A", "Other.X")]


def test_scripts(spark):
    frame = spark.createDataFrame([("s", "0: 0 0 0 0 ; # dc\n 1: 1 5; \n#x;y\n;")], "k string, t string")
    assert values(joins.scan_script(frame, ["k"], "t"), "statement") == [("0: 0 0 0 0",), ("1: 1 5",)]


def test_sources(spark, tmp_path):
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.ppm").write_bytes(encode_pnm(pattern(4, 4)))
    (tmp_path / "img" / "b.bin").write_bytes(b"x" * 5000)
    folder = f"file://{tmp_path}/img"
    assert files.image_files(spark, folder, cap=1000).count() == 1
    assert values(files.oversized(spark, folder, 1000), "failure") == [("encodedBytesExceeded",)]
    tree = files.source_tree(spark, str(tmp_path / "img"))
    assert values(tree, "path", "executable") == [("a.ppm", False), ("b.bin", False)]
    (tmp_path / "img" / "link").symlink_to("a.ppm")
    with pytest.raises(ValueError, match="symbolic link"):
        files.source_tree(spark, str(tmp_path / "img"))
    manifest = spark.createDataFrame([("a.ppm", 59, "0" * 64), ("none", 1, "0" * 64)], "file string, byteCount long, sha256 string")
    assert dict(values(files.verified(files.image_files(spark, folder), manifest, folder), "file", "failure"))["none"] == "missing"
    reports = tmp_path / "reports"
    reports.mkdir()
    (reports / "r.json").write_text('{\n "schemaVersion": 1,\n "caseID": "c", "extra": 2}')
    rows = files.json_reports(spark, f"file://{reports}", "schemaVersion int, caseID string", ("schemaVersion", 1))
    assert values(rows, "schemaVersion", "caseID") == [(1, "c")]
    with pytest.raises(Exception, match="unexpected schemaVersion"):
        files.json_reports(spark, f"file://{reports}", "schemaVersion int, caseID string", ("schemaVersion", 2)).collect()
    paths = spark.createDataFrame([("/r/a",), ("/r/../x",), ("/r/b/../c",), ("/rx/a",)], "p string")
    assert [r[0] for r in paths.select(files.contained(F.col("p"), "/r")).collect()] == [True, False, True, False]
    files.write_artifacts(spark.createDataFrame([("o.bin", b"abc"), ("n", None)], "file string, content binary"), f"file://{tmp_path}/out")
    assert (tmp_path / "out" / "o.bin").read_bytes() == b"abc"
    files.write_report(spark.createDataFrame([(2, 1)], "b int, a int"), f"file://{tmp_path}/report")
    assert spark.read.text(f"file://{tmp_path}/report").first()[0] == '{"a":1,"b":2}'
    assert files.runtime_facts(spark).count() == 1


def test_determinism_and_completeness(spark):
    frame = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), ("c", "x")], "k string, t string")
    assert values(statistics.pair_determinism(frame, "k", F.col("t")), "k", "deterministic") == [("a", True), ("b", False), ("c", False)]
    want = spark.createDataFrame([(1,), (2,)], "k int")
    have = spark.createDataFrame([(2,), (3,)], "k int")
    assert values(joins.completeness(want, have, ["k"]), "k", "status") == [(1, "missing"), (3, "unexpected")]


def test_command_line(spark, sf_dir, tmp_path, capsys):
    from pixelframe.__main__ import main

    assert main(["list"]) == 0 and "nearest_rank_stats" in capsys.readouterr().out.split()
    assert main(["nearest_rank_stats", sf_dir, "--out", f"file://{tmp_path}/out"]) == 0
    assert spark.read.json(f"file://{tmp_path}/out").count() == 5
    assert main(["no_such_query", sf_dir]) == 2 and main(["nearest_rank_stats"]) == 2


def test_thumbnails_from_outside(spark, tmp_path):
    import numpy as np

    from examples.thumbnails import thumbnails
    from pixelframe.functions import jpeg
    from pixelframe.functions.pixels import decode, encode_png, pattern

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.png").write_bytes(encode_png(pattern(200, 90)))
    (source / "b.jpg").write_bytes(jpeg.encode(np.full((50, 300, 3), 90, dtype=np.uint8)))
    (source / "c.bin").write_bytes(b"nothing")
    told = {r["path"].rsplit("/", 1)[1]: r["failure"] for r in thumbnails(spark, str(source), str(tmp_path / "out"), 64).collect()}
    assert told == {"a.png": None, "b.jpg": None, "c.bin": "unsupportedFormat"}
    assert decode((tmp_path / "out" / "b.jpg.png").read_bytes()).shape == (11, 64, 3)


def test_frontier_is_merged_in_parallel(spark):
    from pixelframe.operators import policy

    rows = spark.range(0, 4000, 1, 8).selectExpr("id", "id * 7919 % 4001 AS a", "id * 104729 % 3989 AS b", "9007199254740993 + id % 2 AS c")
    found = {r["id"] for r in policy.pareto_frontier(rows, ["a", "c"], ["b"]).collect()}
    data = [(r["id"], (r["a"], r["c"], -r["b"])) for r in rows.collect()]
    expected = {i for i, v in data if not any(all(x <= y for x, y in zip(w, v)) and w != v for _, w in data)}
    assert found == expected
    plan = policy.pareto_frontier(rows, ["a", "c"], ["b"])._jdf.queryExecution().toString()
    assert "Coalesce" not in plan and "Repartition 1, true" in plan


def test_large_groups_are_ranked_in_ranges(spark, monkeypatch):
    from pixelframe.operators import policy, statistics

    monkeypatch.setattr(statistics, "RANGE_ROWS", 16)
    rows = spark.range(3000).selectExpr("id % 2 AS g", "id * id % 1777 - 300 AS v").union(spark.createDataFrame([(None, 5), (None, 7), (3, None)], "g long, v long"))
    found = {r["g"]: (r["median"], r["p90"]) for r in statistics.nearest_rank(rows, ["g"], "v", {"median": (1, 2), "p90": (9, 10)}).collect()}
    groups = {}
    for r in rows.collect():
        if r["v"] is not None:
            groups.setdefault(r["g"], []).append(r["v"])
    assert found == {g: (sorted(v)[max(1, (len(v) + 1) // 2) - 1], sorted(v)[max(1, (9 * len(v) + 9) // 10) - 1]) for g, v in groups.items()}
    values = [v for g in groups.values() for v in g]
    for descending in (False, True):
        ranked = policy.strict_rank(rows.where("v IS NOT NULL"), "v", descending).collect()
        assert len(ranked) == len(values)
        assert all(r["rank"] == 1 + sum(x > r["v"] if descending else x < r["v"] for x in values) for r in ranked[::97])


def test_code_reaches_workers_from_another_folder(tmp_path):
    """A program that has the package on its own path only."""
    import subprocess
    import sys
    from pathlib import Path

    program = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from pixelframe.operators import policy
print("rows", policy.pareto_frontier(spark.range(10), ["id"], []).count())
"""
    done = subprocess.run([sys.executable, "-c", program], cwd=tmp_path, capture_output=True, text=True, timeout=300, check=False)
    assert "rows 1" in done.stdout, done.stderr[-500:]


def test_artifact_names_stay_in_their_folder(spark, tmp_path):
    from pixelframe.sources import files

    bad = spark.createDataFrame([("../x", bytearray(b"1"))], "file string, content binary")
    with pytest.raises(Exception, match="not a file name"):
        files.write_artifacts(bad, str(tmp_path / "a"))
    assert not (tmp_path / "x").exists()


def test_store_is_bounded(spark):
    from pixelframe.operators import prepared

    events = [("s", i, "insert", f"t{i}") for i in range(6)] + [("s", 6, "take", "t0"), ("s", 7, "take", "t0"), ("s", 8, "insert", "t9"), ("s", 9, "remove", "t5")]
    found = {r["seq"]: r["accepted"] for r in prepared.store(spark.createDataFrame(events, "store string, seq long, kind string, token string"), 4).collect()}
    assert [found[i] for i in range(10)] == [True] * 4 + [False] * 2 + [True, False, True, False]
