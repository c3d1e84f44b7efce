"""Rules over whole reports: hostile documents, empty tables, groups."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pixelframe.operators import validation
from pixelframe.plans import queries, validation_queries  # noqa: F401  queries first: it imports the others

VALIDATORS = {"photo": validation.PHOTO_CASE, "scans": validation.SCAN_CHECKPOINTS, "process": validation.PROCESS_TIMELINE, "campaign": validation.CAMPAIGN}
HUGE = 2**63 - 1
ENVELOPE = {"schemaVersion": 1, "evidenceVersion": "v", "benchmarkVersion": "b", "buildConfiguration": "release", "manifestSHA256": "m", "caseID": "a", "chunkSizeBytes": 1024, "encodedSHA256": "d" * 64, "finalPixelRGBSHA256": "d" * 64}


def expected(name: str) -> dict:
    size = F.lit(1024).cast("long")
    return {"evidence": F.lit("v"), "manifest": F.lit("m"), "benchmark": F.lit("b"), "chunk_sizes": F.array(size) if name == "photo" else F.create_map(F.lit("a"), size)}


def broken(spark, name: str, documents: list) -> list:
    rows = [(i, d if d is None or isinstance(d, str) else json.dumps(d), "x") for i, d in enumerate(documents)]
    found = validation.failures(spark.createDataFrame(rows, "id int, document string, r string").repartition(2), "id", "document", VALIDATORS[name], expected(name)).collect()
    return [b for _, b in sorted((r["id"], r["broken"]) for r in found)]


@pytest.mark.parametrize("name", VALIDATORS)
def test_what_is_no_report(spark, name):
    found = broken(spark, name, [None, "", "[1]", "{", "null", "17", '"text"', {}, {"schemaVersion": "one"}, {"schemaVersion": 2, "scans": 7}])
    assert found[:7] == ["json"] * 7 and found[7:] == ["schema"] * 3
    assert validation.failures(spark.createDataFrame([], "id int, document string"), "id", "document", VALIDATORS[name], expected(name)).count() == 0


def test_numbers_that_overflow(spark):
    metrics = {f: HUGE for f in validation._METRICS_FIELDS}
    case = ENVELOPE | {"encodedByteCount": HUGE, "chunkCount": HUGE // 1024 + 1, "outputPixelWidth": HUGE, "outputPixelHeight": HUGE, "generations": [{"generation": 1, "sourceByteCount": HUGE, "encodedByteFractionPPM": 1_000_000, "pixelRGBSHA256": "d" * 64, "metricsAgainstFinal": metrics}]}
    small = case | {"encodedByteCount": 1024, "chunkCount": 1, "generations": [case["generations"][0] | {"sourceByteCount": 1024}]}
    zero = small | {"outputPixelWidth": 1, "outputPixelHeight": 1, "generations": [small["generations"][0] | {"metricsAgainstFinal": dict.fromkeys(metrics, 0)}]}
    assert broken(spark, "photo", [case, small, zero, small | {"generations": []}, small | {"generations": None}, small | {"generations": [None]}]) == ["chunk count", "channel count", "channel count", "generation count", "generation count", "generation numbers"]


def test_equal_pixels_have_999_decibels(spark):
    metrics = dict.fromkeys(validation._METRICS_FIELDS, 0) | {"channelCount": 3, "psnrMicrodecibels": 999_000_000}
    good = ENVELOPE | {"encodedByteCount": 1000, "chunkCount": 1, "outputPixelWidth": 1, "outputPixelHeight": 1, "generations": [{"generation": 1, "sourceByteCount": 1000, "encodedByteFractionPPM": 1_000_000, "pixelRGBSHA256": "d" * 64, "metricsAgainstFinal": metrics}]}
    wrong = good | {"generations": [good["generations"][0] | {"metricsAgainstFinal": metrics | {"psnrMicrodecibels": 998_999_999}}]}
    assert broken(spark, "photo", [good, wrong, good | {"more": [1]}]) == [None, "psnr", None]


def test_empty_timelines(spark):
    base = ENVELOPE | {"warmupIterations": 2, "iterations": 1, "source": {"encodedByteCount": 10, "encodedSHA256": "x"}, "output": {"w": 1}, "summary": None}
    sample = {"generations": [], "finishElapsedNanoseconds": 1, "totalElapsedNanoseconds": 1}
    one = sample | {"generations": [{"generation": 1, "sourceByteCount": 1, "elapsedNanoseconds": 1}]}
    assert broken(spark, "process", [base | {"samples": []}, base | {"samples": [sample]}, base | {"samples": [one]}, base | {"samples": [None]}]) == ["sample count", "generation times", "sample shapes", "generation times"]


def test_no_scans_and_hidden_rasters(spark):
    base = ENVELOPE | {"encodedByteCount": 9, "outputPixelWidth": 1, "outputPixelHeight": 1}
    hidden = {"sourceStatusRawValue": 0, "frameStatusRawValue": 0, "propertiesAvailable": False, "rasterAvailable": False}
    point = {"offset": 3, "labels": ["entropy-end-before-marker"], "encodedByteFractionPPM": 333_333, "freshSource": hidden, "sequentialSource": hidden}
    scan = {"scan": 1, "entropyStartOffset": 1, "entropyEndMarkerStartOffset": 3, "terminatingMarkerCodeEndOffset": 5, "immediateFollowingSegmentEndOffset": 5, "terminatingMarkerHex": "ffd9", "checkpoints": [point]}
    reports = [base | {"declaredScanCount": 0, "scans": []}, base | {"declaredScanCount": 1, "scans": [scan]}, base | {"declaredScanCount": 1, "scans": [scan | {"checkpoints": [point | {"labels": ["elsewhere"]}]}]}, base | {"declaredScanCount": 1, "scans": [scan | {"checkpoints": []}]}]
    assert broken(spark, "scans", reports) == [None, "pixels within a scan", "labels", "checkpoint offsets"]


def test_groups_of_reports(spark):
    rows = [("a", {"caseID": "x"}), ("a", {"caseID": "x", "chunkCount": 1}), ("b", {"caseID": "x"}), ("c", {"caseID": "x"}), ("c", {"caseID": "y"}), (None, {"caseID": "x"}), (None, {"caseID": "x"})]
    frame = spark.createDataFrame([(g, json.dumps(d)) for g, d in rows], "g string, document string").repartition(3)
    found = validation.group_failures(frame, ["g"], "document", validation.PHOTO_CASE, ["caseID", "chunkCount"], 2).collect()
    assert {r["g"]: r["broken"] for r in found} == {"a": "chunkCount", "b": "reports", "c": "caseID", None: None}


def test_reports_are_dealt_over_tasks(spark, sf_dir):
    """A small table's reports are far more work than its one task should do."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    assert orders.rdd.getNumPartitions() == 1
    made = validation_queries._documents(orders, "o_orderkey", validation_queries._SCANS)
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
