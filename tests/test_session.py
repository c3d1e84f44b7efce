"""Progressive sessions: the reader, the gate, failures, and stream against batch."""

import pytest

from pixelframe.functions.containers import Corrupt
from pixelframe.streaming.session import MarkerReader, Session, progressive_batch, progressive_stream
from tests.test_containers import FRAME, SCAN, jpeg, segment

BODY = jpeg(FRAME, *[SCAN] * 10)


@pytest.fixture(autouse=True)
def _batches_end(request):
    """Timers ask for batches without rows, which a run over what is available would repeat without end."""
    if "spark" in request.fixturenames:
        request.getfixturevalue("spark").conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def generations(body: bytes, size: int) -> list[tuple[int, int]]:
    session, out = Session(), []
    for at in range(0, len(body), size):
        found = session.append(body[at : at + size])
        if found:
            out.append((found, session.received))
    return out


def failure(call) -> str:
    with pytest.raises(Corrupt) as e:
        call()
    return e.value.failure


def test_gate_byte_by_byte():
    found = generations(BODY, 1)
    assert [g for g, _ in found] == [1, 2, 3, 4]
    starts = [i for i in range(len(BODY)) if BODY.startswith(SCAN, i)]
    assert [n for _, n in found] == [starts[k] + 2 for k in (1, 2, 4, 8)]  # known once the marker behind the scan is


@pytest.mark.parametrize("size", [5, 20, 39, 60, 1000])
def test_chunks_decide_how_many(size):
    starts = [i for i in range(len(BODY)) if BODY.startswith(SCAN, i)]
    known = [starts[k] + 2 for k in (1, 2, 4, 8)]
    expected, before = [], 0
    for end in range(size, len(BODY) + size, size):
        crossed = sum(k <= end for k in known)
        if crossed > before and end < len(BODY):  # none once the end marker is in
            expected.append(min(end, len(BODY)))
            before = crossed
    assert [n for _, n in generations(BODY, size)] == expected


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50, 1000])
def test_reader_doesnt_depend_on_chunks(size):
    reader = MarkerReader()
    for at in range(size, len(BODY) + size, size):
        reader.read(BODY[:at])
    assert (reader.completed, reader.ended, reader.frame) == (10, True, "progressive")


def test_failures_and_states():
    session = Session()
    assert session.append(b"") is None
    assert failure(lambda: Session().append(b"ab")) == "formatMismatch"
    assert failure(lambda: Session().append(b"\xff\xd8\xff\xd8")) == "unsupportedOrCorruptImage"
    assert failure(lambda: Session(maximum_bytes=8).append(BODY)) == "encodedBytesExceeded"
    baseline = segment(0xC0, b"\x08\x00\x0d\x00\x17\x01\x01\x11\x00")
    assert failure(lambda: Session().append(jpeg(baseline, SCAN))) == "progressiveDecodingUnsupported"
    session.append(BODY[:40])
    assert session.finish_if_complete() is None
    session.append(BODY[40:])
    assert session.finish_if_complete() == len(BODY)
    assert failure(session.finish) == "progressiveSessionFinished"
    session.cancel()
    session.cancel()
    assert failure(lambda: session.append(b"x")) == "progressiveSessionCancelled"
    trailing = Session()
    trailing.append(BODY + b"\0")
    assert failure(trailing.finish) == "unsupportedOrCorruptImage"
    cut = Session()
    cut.append(BODY[:-2])
    assert failure(cut.finish) == "unsupportedOrCorruptImage"


def rows():
    out = []
    for name, body in (("a", BODY), ("b", BODY[:-2]), ("c", b"nonsense")):
        parts = [body[i : i + 13] for i in range(0, len(body), 13)]
        out += [(name, i, "chunk", part) for i, part in enumerate(parts)]
        out.append((name, len(parts), "finish", None))
    out += [("d", 0, "chunk", BODY[:20]), ("d", 1, "cancel", None), ("d", 2, "chunk", BODY[20:])]
    return out


def test_stream_equals_batch(spark, tmp_path):
    schema = "stream_id string, seq long, kind string, chunk binary"
    frame = spark.createDataFrame(rows(), schema)
    batch = sorted(map(str, progressive_batch(frame).collect()))
    source, marks = str(tmp_path / "in"), str(tmp_path / "marks")
    for low in (0, 4, 9, 1000):
        high = {0: 4, 4: 9, 9: 1000, 1000: 10**9}[low]
        frame.where(f"seq >= {low} AND seq < {high}").coalesce(1).write.mode("append").parquet(source)
        stream = progressive_stream(spark.readStream.schema(schema).parquet(source))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
    streamed = sorted(map(str, spark.read.schema("stream_id string, seq long, event string, generation int, source_byte_count long, failure string").parquet(str(tmp_path / "out")).collect()))
    assert streamed == batch
    assert any("progressiveSessionCancelled" in r for r in batch) and any("'final'" in r for r in batch)


SCHEMA = "stream_id string, seq long, kind string, chunk binary"


def fed(spark, tmp_path, batch, **limits):
    """One run of the stream over rows that are new in its folder; gives all output so far."""
    source, marks, out = str(tmp_path / "in"), str(tmp_path / "marks"), str(tmp_path / "out")
    spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = progressive_stream(spark.readStream.schema(SCHEMA).parquet(source), **limits)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    return spark.read.parquet(out).collect()


def kept(spark, tmp_path, name, **options):
    reader = spark.read.format("statestore").option("stateVarName", name)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(str(tmp_path / "marks"))


def test_state_grows_by_new_bytes_and_ends(spark, tmp_path):
    parts = [BODY[i : i + 50] for i in range(0, len(BODY), 50)]
    for i, part in enumerate(parts[:3]):
        fed(spark, tmp_path, [("a", i, "chunk", part), ("b", i, "chunk", part)])
        held = [bytes(r["list_element"]["data"]) for r in kept(spark, tmp_path, "chunks").where("key.stream_id = 'a'").collect()]
        assert held == parts[: i + 1]  # each batch has added its own chunk
        value = kept(spark, tmp_path, "session").where("key.stream_id = 'a'").first()["value"]
        assert len(value["tail"]) < 30 and len(value["fields"]) < 250
    fed(spark, tmp_path, [("a", 9, "cancel", None), *(("b", 3 + i, "chunk", p) for i, p in enumerate(parts[3:])), ("b", 99, "finish", None)])
    assert kept(spark, tmp_path, "chunks").count() == 0 and kept(spark, tmp_path, "session").count() == 2
    found = fed(spark, tmp_path, [("a", 10, "chunk", b"x"), ("b", 100, "finish", None)])
    assert {(r["stream_id"], r["failure"]) for r in found if r["failure"]} == {("a", "progressiveSessionCancelled"), ("b", "progressiveSessionFinished")}
    assert [r["source_byte_count"] for r in found if r["event"] == "final"] == [len(BODY)]


def test_idle_sessions_and_fences_go(spark, tmp_path):
    limits = {"idle_ms": 1, "fence_ms": 10**9}
    fed(spark, tmp_path, [("idle", 0, "chunk", BODY[:60])], **limits)
    fed(spark, tmp_path, [("other", 0, "chunk", BODY[:60])], **limits)  # by now the first is overdue
    assert kept(spark, tmp_path, "chunks").where("key.stream_id = 'idle'").count() == 0
    found = fed(spark, tmp_path, [("idle", 1, "chunk", BODY[60:])], **limits)
    assert [(r["seq"], r["failure"]) for r in found if r["stream_id"] == "idle" and r["failure"]] == [(1, "progressiveSessionCancelled")]


def test_fences_expire(spark, tmp_path):
    limits = {"idle_ms": 10**9, "fence_ms": 1}
    fed(spark, tmp_path, [("a", 0, "cancel", None)], **limits)
    fed(spark, tmp_path, [("b", 0, "chunk", BODY[:10])], **limits)
    assert [r["key"]["stream_id"] for r in kept(spark, tmp_path, "session").collect()] == ["b"]
    found = fed(spark, tmp_path, [("a", 1, "chunk", BODY), ("a", 2, "finish", None)], **limits)
    assert [(r["event"], r["source_byte_count"]) for r in found if r["event"] == "final"] == [("final", len(BODY))]


def test_tails_are_short():
    session, longest = Session(), 0
    for at in range(0, len(BODY), 3):
        session.append(BODY[at : at + 3])
        longest = max(longest, len(session.tail))
    assert longest < 30 and b"".join(session.fresh) == BODY
