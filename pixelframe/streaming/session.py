"""Progressive JPEG sessions: chunks in, preview generations out.

One session is one image. A resumable parser reads markers as bytes arrive; a preview is due when
1, 2, 4 or 8 scans are complete, at most one a chunk, and none after the end marker. The session runs as a
Structured Streaming stateful processor, and as a grouped batch operator with the same results.

Input rows: stream_id, seq, kind ('chunk', 'finish', 'finish_if_complete' or 'cancel'), chunk. Output rows: stream_id, seq,
event ('generation', 'final' or 'failure'), generation, source_byte_count, failure. Rows are handled in the order of
seq within a micro-batch.

A stream's state is a list of the chunks received, to which a micro-batch only adds its own, and a small value: where the reader is and the bytes
that it can't settle yet (a marker or segment that isn't complete, 64 KiB at most but for padding). Once a session is finished or cancelled its chunks go and the
value stays as a fence, which refuses what comes later. A session that gets nothing for ``idle_ms`` is cancelled; a fence goes ``fence_ms`` after the last row of its stream, and
rows that come after that begin a new session.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.containers import Corrupt, inspect
from ..shipping import ship

#: Completed scans at which a preview is due.
THRESHOLDS = (1, 2, 4, 8)
MAXIMUM_BYTES = 64 << 20
OUTPUT = "stream_id string, seq long, event string, generation int, source_byte_count long, failure string"
#: Milliseconds without a row after which an open session is cancelled, and after which a closed one's fence goes.
IDLE_MS, FENCE_MS = 3_600_000, 24 * 3_600_000
_RESTARTS = range(0xD0, 0xD8)


class MarkerReader:
    """Reads as far as the bytes go; ``at`` never passes what later bytes could change, and bytes before it aren't needed again."""

    def __init__(self, at: int = 0, in_scan: bool = False, frame: str = "", completed: int = 0, ended: bool = False, begun: bool = False):
        self.at, self.in_scan, self.frame, self.completed, self.ended, self.begun = at, in_scan, frame, completed, ended, begun

    def _marker(self, data: bytes | bytearray) -> tuple[int, int, int] | None:
        """(first FF, value, offset behind) of the next marker, or None until its value has come."""
        start = data.find(b"\xff", self.at)
        if start < 0:
            self.at = len(data)
            return None
        end = start + 1
        while end < len(data) and data[end] == 0xFF:
            end += 1
        if end == len(data):
            self.at = start
            return None
        return start, data[end], end + 1

    def read(self, data: bytes | bytearray) -> None:
        if not self.begun:
            if len(data) < 2:
                return
            if data[:2] != b"\xff\xd8":
                raise Corrupt("formatMismatch")
            self.at, self.begun = 2, True
        while self.at < len(data) and not self.ended:
            found = self._marker(data)
            if found is None:
                return
            start, value, behind = found
            if value == 0 or self.in_scan and value in _RESTARTS:
                self.at = behind
            elif self.in_scan:
                self.completed, self.in_scan, self.at = self.completed + 1, False, start
            elif value == 0xD8:
                raise Corrupt
            elif value == 0xD9:
                self.ended, self.at = True, behind
            elif value == 0x01 or value in _RESTARTS:
                self.at = behind
            else:
                length = int.from_bytes(data[behind : behind + 2], "big")
                if behind + 2 > len(data) or length < 2 or behind + length > len(data):
                    self.at = start
                    return
                self.frame = {0xC0: "baseline", 0xC2: "progressive"}.get(value, self.frame)
                self.at, self.in_scan = behind + length, value == 0xDA


class Session:
    """``tail`` are the bytes from the reader on, ``fresh`` the chunks since the session was made; ``earlier`` gives those before."""

    def __init__(self, maximum_bytes: int = MAXIMUM_BYTES, fields: dict | None = None, tail: bytes = b"", earlier: Callable[[], list[bytes]] = list):
        f = fields or {}
        self.maximum_bytes, self.tail, self.fresh, self.earlier = maximum_bytes, bytearray(tail), [], earlier
        self.reader = MarkerReader(*f.get("reader", ()))
        self.next_threshold, self.generation, self.received = f.get("next_threshold", 0), f.get("generation", 0), f.get("received", 0)
        self.finished, self.cancelled = f.get("finished", False), f.get("cancelled", False)

    def fields(self) -> dict:
        r = self.reader
        return {"reader": [r.at, r.in_scan, r.frame, r.completed, r.ended, r.begun], "next_threshold": self.next_threshold, "generation": self.generation, "received": self.received, "finished": self.finished, "cancelled": self.cancelled}

    @property
    def closed(self) -> bool:
        return self.finished or self.cancelled

    def _drop(self) -> None:
        self.tail, self.fresh, self.earlier = bytearray(), [], list

    def _read(self) -> None:
        self.reader.read(self.tail)
        if self.reader.begun:
            del self.tail[: self.reader.at]
            self.reader.at = 0

    def _open(self) -> None:
        if self.cancelled:
            raise Corrupt("progressiveSessionCancelled")
        if self.finished:
            raise Corrupt("progressiveSessionFinished")

    def append(self, chunk: bytes) -> int | None:
        """The generation that this chunk makes due, if any."""
        self._open()
        if not chunk:
            return None
        if self.received + len(chunk) > self.maximum_bytes:
            raise Corrupt("encodedBytesExceeded")
        self.tail += chunk
        self.fresh.append(chunk)
        self.received += len(chunk)
        self._read()
        if self.reader.frame == "baseline":
            raise Corrupt("progressiveDecodingUnsupported")
        if self.reader.frame != "progressive" or self.reader.ended:
            return None
        crossed = sum(t <= self.reader.completed for t in THRESHOLDS)
        if crossed <= self.next_threshold:
            return None
        self.next_threshold = crossed
        self.generation += 1
        return self.generation

    def finish(self) -> int:
        """Ends the session; the whole body must be a sound progressive image. Gives its length."""
        self._open()
        self.finished = True
        body = b"".join([*self.earlier(), *self.fresh])
        try:
            self._read()
        finally:
            self._drop()
        if self.reader.frame != "progressive" or not self.reader.ended:
            raise Corrupt
        inspect(body, MAXIMUM_BYTES)  # refuses what follows the end marker
        return self.received

    def finish_if_complete(self) -> int | None:
        """As :meth:`finish` once the end marker has come; before that nothing changes."""
        self._open()
        self._read()
        return self.finish() if self.reader.ended else None

    def cancel(self) -> None:
        self.cancelled = True
        self._drop()

    def handle(self, kind: str, chunk: bytes | None) -> tuple[str, int | None, int | None, str | None] | None:
        """(event, generation, source_byte_count, failure) of one row, if it has any."""
        try:
            if kind == "cancel":
                self.cancel()
                return None
            if kind == "chunk":
                generation = self.append(bytes(chunk or b""))
                return generation and ("generation", generation, self.received, None)
            count = self.finish() if kind == "finish" else self.finish_if_complete()
            return count and ("final", None, count, None)
        except Corrupt as e:
            return "failure", None, self.received, e.failure


def _run(stream_id: str, session: Session, frame: pd.DataFrame) -> pd.DataFrame:
    out = []
    for row in frame.sort_values("seq", kind="stable").itertuples():
        found = session.handle(row.kind, row.chunk)
        if found:
            out.append((stream_id, row.seq, *found))
    made = pd.DataFrame(out, columns=["stream_id", "seq", "event", "generation", "source_byte_count", "failure"])
    return made.astype({"generation": "Int32", "source_byte_count": "Int64", "seq": "int64"})


class SessionProcessor(StatefulProcessor):
    """Keeps a session for each key; a timer closes it when it is idle, and removes what is left of it later."""

    def __init__(self, maximum_bytes: int, idle_ms: int, fence_ms: int):
        self.maximum_bytes, self.idle_ms, self.fence_ms = maximum_bytes, idle_ms, fence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("session", "fields string, tail binary")
        self.chunks = handle.getListState("chunks", "data binary")

    def _session(self) -> Session:
        fields, tail = self.value.get() if self.value.exists() else ("{}", b"")
        return Session(self.maximum_bytes, json.loads(fields), bytes(tail or b""), lambda: [bytes(c[0]) for c in self.chunks.get()])

    def _keep(self, session: Session, now: int) -> None:
        if session.closed:
            self.chunks.clear()
        elif session.fresh:
            self.chunks.appendList([(c,) for c in session.fresh])
        self.value.update((json.dumps(session.fields()), bytes(session.tail)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + (self.fence_ms if session.closed else self.idle_ms))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        session = self._session()
        out = _run(key[0], session, pd.concat(list(rows), ignore_index=True))
        self._keep(session, timerValues.getCurrentProcessingTimeInMs())
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        session = self._session()
        if session.closed:
            self.value.clear()
            self.chunks.clear()
        else:
            session.cancel()
            self._keep(session, timerValues.getCurrentProcessingTimeInMs())
        yield _run(key[0], session, pd.DataFrame({"seq": [], "kind": [], "chunk": []}))

    def close(self) -> None:
        pass


def progressive_stream(events: DataFrame, maximum_bytes: int = MAXIMUM_BYTES, idle_ms: int = IDLE_MS, fence_ms: int = FENCE_MS) -> DataFrame:
    """The sessions of a streaming DataFrame, by stream_id. Needs the RocksDB state store, whose commits write changes only; both are set for the session.

    Timers fire in batches without rows too. A run over what is available (``availableNow``) would repeat those without end: set
    ``spark.sql.streaming.noDataMicroBatches.enabled`` to false there, and timers fire with the next batch that has rows.
    """
    spark = ship(events.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return events.groupBy("stream_id").transformWithStateInPandas(SessionProcessor(maximum_bytes, idle_ms, fence_ms), OUTPUT, "Append", "ProcessingTime")


def progressive_batch(events: DataFrame, maximum_bytes: int = MAXIMUM_BYTES) -> DataFrame:
    """The same for a table of all rows: streams are dealt out, and a task walks each one's rows in order, holding one session at a time."""
    schema = pa.schema([("stream_id", pa.string()), ("seq", pa.int64()), ("event", pa.string()), ("generation", pa.int32()), ("source_byte_count", pa.int64()), ("failure", pa.string())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, session = None, Session(maximum_bytes)
        for batch in batches:
            out = []
            for own, seq, kind, chunk in zip(*(batch.column(c).to_pylist() for c in ("stream_id", "seq", "kind", "chunk"))):
                if own != stream:
                    stream, session = own, Session(maximum_bytes)
                found = session.handle(kind, chunk)
                if found:
                    out.append((own, seq, *found))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out) if out else [[]] * len(schema), schema)], schema=schema)

    ship(events.sparkSession)
    rows = events.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("seq").cast("long").alias("seq"), "kind", F.col("chunk").cast("binary").alias("chunk"))
    return rows.repartition("stream_id").sortWithinPartitions("stream_id", "seq").mapInArrow(walk, OUTPUT)


def gate(scans: DataFrame, keys: list[str], order: str, completed: str) -> DataFrame:
    """Relational form of the emission gate: rows at which the number of crossed thresholds rises, numbered from 1."""
    from pyspark.sql import Window

    window = Window.partitionBy(*keys).orderBy(order)
    crossed = sum((F.col(completed) >= t).cast("int") for t in THRESHOLDS)
    risen = scans.withColumn("_crossed", crossed).withColumn("_before", F.coalesce(F.max("_crossed").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    emitted = risen.where("_crossed > _before")
    return emitted.withColumn("generation", F.row_number().over(window)).drop("_crossed", "_before")
