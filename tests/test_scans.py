"""Segmented scans against plain loops, with streams cut in many segments."""

import random

import pytest
from pyspark.sql import functions as F

from pixelframe.operators import queueing, scans


@pytest.fixture(scope="module")
def streams(spark):
    rng = random.Random(4)
    rows = []
    for stream, n in (("hot", 5000), ("warm", 700), (None, 900), ("cold", 5), ("one", 1)):
        t = 0
        for i in range(n):
            t += rng.choice([0, 0, 1, 50, 900])
            rows.append((stream, t, i, rng.randint(0, 90), rng.randint(1, 9)))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "stream string, t long, i long, service long, size long").repartition(4)


@pytest.mark.parametrize("size", [None, 100_000, 300, 41])
def test_scans_by_loop(streams, size):
    rows, frame = streams
    sums, ends, free, total = {}, {}, {}, {}
    for stream, t, i, service, _ in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        total[stream] = sums[stream, i] = total.get(stream, 0) + service
        free[stream] = ends[stream, i] = max(t, free.get(stream, 0)) + service
    keys, order = ["stream"], ["t", "i"]
    found = scans.running_sum(frame, keys, order, "service", "s", size).collect()
    assert {(r["stream"], r["i"]): r["s"] for r in found} == sums and found[0].asDict().keys() == {"stream", "t", "i", "service", "size", "s"}
    queue = queueing.single_server(frame, keys, order, "t", "service", size)
    found = queue.collect()
    assert {(r["stream"], r["i"]): r["end_ns"] for r in found} == ends and len(found) == len(rows)
    assert all(r["start_ns"] == r["end_ns"] - r["service"] and r["queue_delay_ns"] == r["start_ns"] - r["t"] for r in found)
    events, peaks = [], {}
    for stream, t, i, service, held in rows:
        events += [(stream, t, 0, held), (stream, ends[stream, i], 1, -held)]
    level = {}
    for stream, _, _, delta in sorted(events, key=lambda e: (e[0] or "", *e[1:])):
        level[stream] = level.get(stream, 0) + delta
        peaks[stream] = max(peaks.get(stream, 0), level[stream])
    assert {r["stream"]: r["peak_bytes"] for r in queueing.buffered_peak(queue, keys, "t", "end_ns", "size", size).collect()} == peaks


@pytest.mark.parametrize("size", [None, 41])
def test_arrivals_by_loop(streams, size):
    rows, frame = streams
    expected, last = {}, {}
    for stream, t, i, _, held in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        step = 1000 if stream not in last else -(-held * 8_000_000_000 // 7_000_000)
        last[stream] = expected[stream, i] = last.get(stream, 0) + step
    found = queueing.arrivals(frame, ["stream"], ["t", "i"], "size", F.lit(1000), F.lit(7_000_000), size)
    assert {(r["stream"], r["i"]): r["arrival_ns"] for r in found.collect()} == expected


def test_a_hot_stream_is_spread(spark):
    """No task of the cut scan gets much more than a segment of the one stream."""
    frame = spark.range(200_000).select(F.lit("all").alias("k"), F.col("id").alias("t"), (F.col("id") % 7).alias("service"))
    cut, several = scans.segmented(frame, ["k"], ["t"], 10_000)
    sizes = [r["count"] for r in cut.groupBy(scans.SEGMENT).count().collect()]
    assert several and len(sizes) >= 15 and max(sizes) < 30_000 and sum(sizes) == 200_000
    spans = cut.groupBy(scans.SEGMENT).agg(F.min("t").alias("a"), F.max("t").alias("b")).orderBy(scans.SEGMENT).collect()
    assert all(x["b"] < y["a"] for x, y in zip(spans, spans[1:]))


def test_no_rows(spark):
    frame = spark.createDataFrame([], "k string, t long, service long")
    assert scans.queue_ends(frame, ["k"], ["t"], "t", "service", "e").count() == 0
    assert scans.highest_sum(frame, ["k"], ["t"], "service", "e").count() == 0
