"""Simple-8b word-aligned coding of token ids, and the shard files that hold a corpus.

A 64-bit word has a 4-bit selector on top and 60 bits of payload. Selectors 1 to 15 pack a fixed
count of values of a fixed width; selector 0 is the escape: its payload is unused and the next
word is one verbatim 64-bit value, for values of more than 60 bits. Blocks of BLOCK values are
coded on their own; a shard holds the word offset and the number of escapes of every block, so a
block, or all blocks at once, can be decoded with array operations.

Shard layout, little-endian: magic ``PFS8``, version u32, documents u64, values u64, blocks u64;
then doc ids i64, null flags u8, lengths u64 (one each per document), block offsets u64 (blocks + 1),
escapes u32 (one per block), words u64.

Null texts count as empty (the end id alone). Documents come in ascending doc_id order, null ids
first; rows that share a doc_id come in order of their text's bytes, so repeated rows are kept and
stand side by side. An empty table writes no shard and reads back as no rows. Other columns of the
input are ignored. A very long text is one document of its shard, whatever its length.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import Rows, Workspace, identified_texts, prepare, raw_rows
from .tokenizing import default_path, encoder, with_end

END_ID = 2
BLOCK = 16_384
#: Values after which a shard is closed.
SHARD_VALUES = 1_000_000
#: Bytes of text of a task.
TASK_BYTES = 32 << 20

# Fixed values of the format: (values in a word, bits of each) by selector, from 1 on.
SELECTORS = ((120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
_BY_COUNT = {count: selector for selector, (count, _) in enumerate(SELECTORS, 1)}
_BITS16 = np.array([i.bit_length() for i in range(1 << 16)], dtype=np.uint8)
_HEAD = struct.Struct("<4sIQQQ")
_LOW60 = np.uint64((1 << 60) - 1)


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    if values.max() < 1 << 16:
        return _BITS16[values.astype(np.int64)]
    bits, rest = np.zeros(len(values), dtype=np.uint8), values
    for step in range(4):
        part = _BITS16[(rest & np.uint64(0xFFFF)).astype(np.int64)]
        bits = np.where(part > 0, part + np.uint8(16 * step), bits)
        rest = rest >> np.uint64(16)
        if not rest.any():
            break
    return bits


def encode_block(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Words of one block of unsigned 64-bit values, and the number of escapes among them."""
    n = len(values)
    if not n:
        return np.empty(0, dtype="<u8"), 0
    bits = _bit_lengths(values)
    best = np.ones(n, dtype=np.uint8)
    windows = {1: bits}  # maximum over windows of a power-of-two length

    def window(count: int) -> np.ndarray:
        power = 1 << (count.bit_length() - 1)
        if power not in windows:
            half = window(power // 2)
            windows[power] = np.maximum(half[: n - power + 1], half[power // 2 :])
        whole = windows[power]
        return whole if power == count else np.maximum(whole[: n - count + 1], whole[count - power :])

    narrow = np.cumsum(np.bincount(bits, minlength=65))  # values of at most so many bits
    for count, width in reversed(SELECTORS):
        if 1 < count <= n and narrow[width] >= count:
            fits = window(count) <= width
            best[: n - count + 1][fits] = count
    counts, starts, at = best.tolist(), [], 0
    while at < n:
        starts.append(at)
        at += counts[at]
    starts = np.array(starts, dtype=np.int64)
    chosen = best[starts]
    escaped = (chosen == 1) & (bits[starts] > 60)
    place = np.arange(len(starts)) + np.concatenate(([0], np.cumsum(escaped)[:-1]))
    words = np.zeros(len(starts) + int(escaped.sum()), dtype=np.uint64)
    for count, width in SELECTORS:
        picked = np.flatnonzero((chosen == count) & ~escaped)
        if not len(picked):
            continue
        word = np.full(len(picked), _BY_COUNT[count] << 60, dtype=np.uint64)
        if width:
            for k in range(count):
                word |= values[starts[picked] + k] << np.uint64(k * width)
        words[place[picked]] = word
    words[place[escaped] + 1] = values[starts[escaped]]
    return words, int(escaped.sum())


def decode_words(words: np.ndarray, escapes: int = 0) -> np.ndarray:
    """The values of a block's words, or of several blocks' words without escapes."""
    raw = np.empty(0, dtype=np.int64)
    if escapes:
        at, found = 0, []
        selectors = (words >> np.uint64(60)).tolist()
        while at < len(selectors):
            if selectors[at] == 0:
                found.append(at)
                at += 1
            at += 1
        raw = np.array(found, dtype=np.int64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    selector[raw] = len(SELECTORS)  # an escape yields one value, its second word none
    counts = np.array([0, *(count for count, _ in SELECTORS)])[selector]
    counts[raw + 1] = 0
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    starts = ends - counts
    live = np.ones(len(words), dtype=bool)
    live[raw] = live[raw + 1] = False
    for number, (count, width) in enumerate(SELECTORS, 1):
        picked = np.flatnonzero((selector == number) & live)
        if width and len(picked):
            mask, base, word = np.uint64((1 << width) - 1), starts[picked], words[picked] & _LOW60
            for k in range(count):
                out[base + k] = word >> np.uint64(k * width) & mask
    out[starts[raw]] = words[raw + 1]
    return out


def pack_shard(doc_ids: list[int | None], lengths: list[int], values: np.ndarray) -> bytes:
    offsets, escapes, parts, total = [0], [], [], 0
    for at in range(0, len(values), BLOCK):
        words, escaped = encode_block(values[at : at + BLOCK].astype(np.uint64))
        total += len(words)
        offsets.append(total)
        escapes.append(escaped)
        parts.append(words)
    ids = np.array([0 if i is None else i for i in doc_ids], dtype="<i8")
    nulls = np.array([i is None for i in doc_ids], dtype=np.uint8)
    head = _HEAD.pack(b"PFS8", 1, len(doc_ids), len(values), len(escapes))
    return b"".join([head, ids.tobytes(), nulls.tobytes(), np.array(lengths, dtype="<u8").tobytes(), np.array(offsets, dtype="<u8").tobytes(), np.array(escapes, dtype="<u4").tobytes(), *(p.astype("<u8").tobytes() for p in parts)])


def unpack_shard(blob: bytes) -> tuple[list[int | None], list[int], np.ndarray]:
    magic, version, n_docs, n_values, n_blocks = _HEAD.unpack_from(blob)
    if magic != b"PFS8" or version != 1:
        raise ValueError("not a Simple-8b shard")
    at = _HEAD.size

    def take(dtype: str, n: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(blob, dtype=dtype, count=n, offset=at)
        at += found.nbytes
        return found

    ids, nulls, lengths = take("<i8", n_docs).tolist(), take("u1", n_docs).tolist(), take("<u8", n_docs).tolist()
    offsets, escapes = take("<u8", n_blocks + 1).astype(np.int64), take("<u4", n_blocks)
    words = take("<u8", int(offsets[-1])).astype(np.uint64)
    if not escapes.any():
        values = decode_words(words)
    else:
        values = np.concatenate([decode_words(words[a:b], int(e)) for a, b, e in zip(offsets[:-1], offsets[1:], escapes)])
    if len(values) != n_values:
        raise ValueError("a shard's values don't match its header")
    return [None if null else i for i, null in zip(ids, nulls)], lengths, values


_SHARD = pa.schema([("part", pa.int32()), ("ids_before", pa.int64()), ("n_ids", pa.int64()), ("shard", pa.binary())])


def write_corpus(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = END_ID) -> None:
    """Encode ``docs`` in ascending doc_id order into shards under ``path``.

    One range shuffle of the texts, in stretches of about TASK_BYTES; small stretches of ids share a task (TASK_BYTES, but no fewer tasks than cores). A task codes
    each of its stretches in bounded shards and notes how many ids of that stretch stand before each.
    """
    spark = prepare(docs.sparkSession)
    tokenizer = tokenizer_path or default_path()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, rows = encoder(tokenizer).encode, Rows(_SHARD)
        part, before, doc_ids, texts, size = None, 0, [], [], 0

        def close() -> None:
            nonlocal before, size
            if doc_ids:
                rows.add(part, before, size, pack_shard(doc_ids, [len(t) // 4 for t in texts], np.frombuffer(b"".join(texts), dtype="<u4")), size=3 * size)
                before += size
                size = 0
                doc_ids.clear()
                texts.clear()

        for batch in batches:
            stretches = batch.column("part").to_pylist()
            for ids, raws in raw_rows(iter([batch])):
                for own, doc_id, coded in zip(stretches, ids, encode(raws)):
                    if own != part:
                        close()
                        part, before = own, 0
                    doc_ids.append(doc_id)
                    texts.append(with_end(coded, end_id))
                    size += len(texts[-1]) // 4
                    if size >= SHARD_VALUES:
                        close()
            if rows.full:
                yield rows.batch()
        close()
        if rows:
            yield rows.batch()

    texts = identified_texts(docs)
    total = texts.agg(F.coalesce(F.sum(F.octet_length("raw")), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, total // TASK_BYTES)
    # The texts' first bytes let rows of one id, null among them, stand in several stretches, in the same order.
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tasks)  # named, so that a stretch doesn't grow with the table
    stretches = texts.repartitionByRange(ranges, "doc_id", F.substring("raw", 1, 16)).withColumn("part", F.spark_partition_id())
    ordered = stretches.coalesce(tasks).sortWithinPartitions("part", "doc_id", "raw")
    ordered.mapInArrow(code, "part int, ids_before long, n_ids long, shard binary").write.mode("overwrite").option("compression", "none").parquet(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of every document in the shards."""
    prepare(spark)
    shards = spark.read.schema("part int, ids_before long, n_ids long, shard binary").parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("total"))
    # One row for each range partition of the writer: its number bounds what is broadcast.
    bases = totals.selectExpr("part", "sum(total) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - total AS base")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(schema)
        for batch in batches:
            for first, blob in zip(batch.column("first").to_pylist(), batch.column("shard")):
                doc_ids, lengths, values = unpack_shard(blob.as_py())
                flat, place = values.astype("<u4"), 0
                for doc_id, n in zip(doc_ids, lengths):
                    rows.add(doc_id, first + place, n, flat[place : place + n].tobytes(), size=4 * n + 32)
                    place += n
                    if rows.full:
                        yield rows.batch()
        if rows:
            yield rows.batch()

    placed = shards.join(F.broadcast(bases), "part").select((F.col("base") + F.col("ids_before")).alias("first"), "shard")
    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Write ``docs`` to shards in shared storage and read them back."""
    spark = prepare(docs.sparkSession)
    path = Workspace(spark, "simple8b").new_path("shards")
    write_corpus(docs, path, tokenizer_path)
    return read_corpus(spark, path)


def digest(read: DataFrame) -> DataFrame:
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
