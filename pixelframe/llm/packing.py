"""Packing by power-of-two decomposition: no sequence crosses documents and none is padded.

A document of n ids is cut into as many full sequences of ``seq_len`` as fit and the binary
decomposition of the rest, longest piece first. Every piece is a sequence of its own; pieces of
equal length share a bucket, so that batches drawn from one bucket have one shape.

Very long texts are cut like any other, in as many full sequences as it takes. Null texts count as empty and give the end id alone. Repeated rows are packed once each; a null
doc_id stays null. An empty table gives no pieces. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Rows, identified_texts, prepare, raw_rows
from .tokenizing import default_path, encoder, with_end

SEQ_LEN, END_ID = 4096, 2
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("bucket", pa.int32()), ("ids", pa.binary())])
_DDL = "doc_id long, start long, length long, doc_tokens long, bucket int, ids binary"


def piece_lengths(n: int, seq_len: int = SEQ_LEN) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids; all are powers of two up to ``seq_len``."""
    full, rest = divmod(n, seq_len)
    return [seq_len] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer_path: str | None = None, seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, bucket (log2 of the length), ids, sequence_id, offset.

    ``ids`` holds little-endian unsigned 32-bit values. No shuffle: pieces depend on their own
    document only, and sequence ids are made of the partition and the row's place in it.
    """
    if seq_len < 1 or seq_len & (seq_len - 1):
        raise ValueError("seq_len must be a power of two")
    prepare(docs.sparkSession)
    path = tokenizer_path or default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, rows = encoder(path).encode, Rows(_SCHEMA)
        for doc_ids, raws in raw_rows(batches):
            for doc_id, ids in zip(doc_ids, encode(raws)):
                ids = with_end(ids, end_id)
                n, start = len(ids) // 4, 0
                for length in piece_lengths(n, seq_len):
                    rows.add(doc_id, start, length, n, length.bit_length() - 1, ids[4 * start : 4 * (start + length)], size=4 * length + 48)
                    start += length
                if rows.full:
                    yield rows.batch()
        if rows:
            yield rows.batch()

    return identified_texts(docs).mapInArrow(cut, _DDL).withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(pieces: DataFrame, path: str) -> DataFrame:
    """Write pieces with those of equal length side by side, a folder for each of the log2(seq_len) + 1 lengths, and read them back.

    Every task writes its own file of each length, so no length has to fit in one task, and a reader of one folder gets sequences of one shape.
    """
    pieces.write.mode("overwrite").partitionBy("bucket").parquet(path)
    return pieces.sparkSession.read.schema(pieces.schema).parquet(path)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
