"""BPE encoding by content-defined chunk reuse, and decoding.

Texts are cut where a rolling hash of the last eight bytes meets a mask, so equal passages of
different documents yield equal chunks. A chunk is encoded once per Python worker and remembered
(bounded memo). A chunk edge may lie inside a word: the ids of the unfinished words at both
sides of a join are dropped and a window around the join is encoded again by the library, from a finished word of the
one chunk to a finished word of the other. The join is repaired once the window's first and last ids are
exactly those that the two chunks have for these words; until then the window grows, over the whole text if need be. The tokenizer's tokens
never cross blanks, so agreement over a whole word at each side settles all ids of the window. Files
of tokenizers for which that isn't known, and texts that may spell an added token, go to the library whole.

Null texts count as empty (no ids, decoded text empty). Repeated rows are encoded once each, null
doc_ids stay null, other columns are ignored, an empty table gives no rows. Very long texts are encoded whole, in time
that grows with their length; a stretch without blanks is one window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Rows, identified_texts, prepare, raw_rows
from .tokenizing import _FOLD, WordEncoder, default_path, encoder

#: Mean chunk length is two to this power; a longer stretch without a cut is cut at MAX_CHUNK.
CHUNK_BITS, MAX_CHUNK = 8, 2048
#: Entries of a worker's chunk memo; beyond it the memo starts anew.
MEMO_CHUNKS = 75_000
_WINDOW = 8
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
_DDL = "doc_id long, n_tokens long, ids binary, decoded string"


def cut_points(raw: bytes, bits: int = CHUNK_BITS, longest: int = MAX_CHUNK) -> list[int]:
    """Ends of the chunks of a UTF-8 text; each lies between characters."""
    n = len(raw)
    if n <= _WINDOW:
        return [n] if n else []
    data = np.frombuffer(raw, dtype=np.uint8)
    window = np.lib.stride_tricks.as_strided(np.frombuffer(raw, dtype="<u8", count=1), shape=(n - _WINDOW + 1,), strides=(1,))
    hit = np.flatnonzero(window * _MULTIPLIER >> np.uint64(64 - bits) == 0) + _WINDOW
    ends = hit.tolist()
    if not ends or ends[-1] != n:
        ends.append(n)
    out, last = [], 0
    for end in ends:
        while end - last > longest:
            last = _character_start(data, last + longest, n)
            out.append(last)
        end = _character_start(data, end, n)
        if end > last:
            out.append(end)
            last = end
    return out


def _character_start(data: np.ndarray, at: int, n: int) -> int:
    while at < n and data[at] & 0xC0 == 0x80:
        at += 1
    return at


class ChunkEncoder:
    """``reused``, ``encoded``: chunks met again and for the first time; ``grown``: windows that didn't agree at once."""

    def __init__(self, words: WordEncoder, memo_chunks: int = MEMO_CHUNKS):
        self.words, self.memo_chunks, self.memo = words, memo_chunks, {}
        self.reused = self.encoded = self.grown = 0

    def _learn(self, chunks: set[bytes]) -> None:
        """Encode chunks: (unfinished word at the start, ids of the finished words, unfinished word at the end); no finished word: (chunk, None, b"")."""
        missing = [c for c in chunks if c not in self.memo]
        if len(self.memo) + len(missing) > self.memo_chunks:
            self.memo, missing = {}, list(chunks)
        self.encoded += len(missing)
        find = self.words.find()
        for chunk in missing:
            words = chunk.split(b" ")
            self.memo[chunk] = (words[0], b"".join(map(find, words[1:-1])), words[-1]) if any(words[1:-1]) else (chunk, None, b"")

    def encode(self, raws: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        group, size = [], 0
        for raw in raws:
            group.append(raw)
            size += len(raw)
            if size >= 1 << 20:
                out += self._group(group)
                group, size = [], 0
        return out + self._group(group)

    def _group(self, raws: list[bytes]) -> list[bytes]:
        cut: list[list[bytes] | None] = []
        for raw in raws:
            if self.words.whole(raw):
                cut.append(None)
                continue
            folded, start, chunks = raw.translate(_FOLD), 0, []
            for end in cut_points(folded):
                chunks.append(folded[start:end])
                start = end
            cut.append(chunks)
        wanted = set().union(*(c for c in cut if c is not None))
        self.reused += sum(len(c) for c in cut if c is not None) - len(wanted)
        self._learn(wanted)
        plans = [None if chunks is None else self._plan(chunks) for chunks in cut]
        repaired = self._repaired([plan for plan in plans if plan is not None])
        return [self.words.library_batch([raw])[0] if plan is None else next(repaired) for raw, plan in zip(raws, plans)]

    def _plan(self, chunks: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        """(joins, chunks with finished words): a join lies before, between and behind the chunks."""
        joins, known, open_parts, find = [], [], [], self.memo.__getitem__
        for chunk in chunks:
            head, ids, tail = find(chunk)
            open_parts.append(head)
            if ids is not None:
                joins.append(b"".join(open_parts))
                known.append(chunk)
                open_parts = [tail]
        joins.append(b"".join(open_parts))
        return joins, known

    def _edge(self, chunk: bytes | None, count: int, last: bool) -> tuple[bytes, bytes, bool]:
        """(text, ids) of a chunk's first or last ``count`` finished words, and whether these are all; nothing at a text's edge."""
        if chunk is None:
            return b"", b"", True
        words = [w for w in chunk.split(b" ")[1:-1] if w]
        own = words[-count:] if last else words[:count]
        return b" ".join(own), b"".join(map(self.words.find(), own)), count >= len(words)

    def _repaired(self, plans: list[tuple[list[bytes], list[bytes]]]):
        """The ids of each text: joins are encoded in windows, all of one size together, until they agree with their chunks."""
        fixed: dict[tuple[int, int], bytes] = {}
        whole: dict[int, bytes] = {}
        open_joins = [(i, k) for i, (joins, _) in enumerate(plans) for k, join in enumerate(joins) if join]
        count = 1
        while open_joins:
            windows, edges = [], []
            for i, k in open_joins:
                joins, known = plans[i]
                left, right = self._edge(known[k - 1] if k else None, count, True), self._edge(known[k] if k < len(known) else None, count, False)
                windows.append(b" ".join(filter(None, (left[0], joins[k], right[0]))))
                edges.append((left, right))
            still = []
            for place, window, (left, right) in zip(open_joins, self.words.library_batch(windows), edges):
                if len(window) >= len(left[1]) + len(right[1]) and window.startswith(left[1]) and window.endswith(right[1]):
                    fixed[place] = window[len(left[1]) : len(window) - len(right[1])]
                elif left[2] and right[2]:  # both chunks are in the window: the text itself is the next
                    joins, known = plans[place[0]]
                    parts = [joins[0]]
                    for chunk, join in zip(known, joins[1:]):
                        parts += [b" ".join(chunk.split(b" ")[1:-1]), join]
                    whole[place[0]] = self.words.library_batch([b" ".join(parts)])[0]
                else:
                    still.append(place)
            self.grown += len(still) + len(whole)
            open_joins, count = [p for p in still if p[0] not in whole], 4 * count
        for i, (joins, known) in enumerate(plans):
            parts = [fixed.get((i, 0), b"")]
            for k, chunk in enumerate(known, 1):
                parts += [self.memo[chunk][1], fixed.get((i, k), b"")]
            yield whole.get(i) or b"".join(parts)


_encoders: dict[str, ChunkEncoder] = {}


def chunk_encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(encoder(path))
    return _encoders[path]


def encode_and_decode(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the decoded text of every document."""
    prepare(docs.sparkSession)
    path = tokenizer_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunked, rows = chunk_encoder(path), Rows(_SCHEMA)
        for doc_ids, raws in raw_rows(batches):
            for doc_id, ids in zip(doc_ids, chunked.encode(raws)):
                text = chunked.words.decode(np.frombuffer(ids, dtype="<u4"))
                rows.add(doc_id, len(ids) // 4, ids, text, size=len(ids) + len(text) + 48)
                if rows.full:
                    yield rows.batch()
        if rows:
            yield rows.batch()

    return identified_texts(docs).mapInArrow(run, _DDL)


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
