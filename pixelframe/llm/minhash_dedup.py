"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

A text is read as words (as in the license scan) and weighted shingles of five words: a text of
fewer words is one shingle. The weight is the count in the text times ln(1 + N / df),
df being the number of documents with the shingle, which is counted exactly for every shingle. Those in
more than HEAVY of all documents are found in two passes: every task gives the shingles that
are frequent among its own documents, which by the pigeonhole principle misses none, and then all
documents are counted for the candidates. Their number is bounded by the mean number of shingles of a
document over half of HEAVY, whatever the number of documents. All others meet by ranges of their hash: texts
are cut into blocks, a block sends its shingles of each range to that range's task, and they come back with their counts.

Improved consistent weighted sampling draws SAMPLES samples (shingle, step) whose chance to agree is the
weighted Jaccard similarity that links are verified by; gamma and uniform variates come from a hash of the shingle through
quantile tables. Samples are banded into buckets. In each bucket all members are first
compared to one pivot; buckets that still hold several components then compare all pairs across
components, in blocks, each in the first bucket that it shares. Every link is verified
by weighted Jaccard similarity of the whole texts, with the idf damped. Equal texts are one class.

Very long texts are read whole, shingled and sampled piece by piece; what meets is bounded in bytes.
Null and empty texts and texts without words link with nothing but equal texts (null counts as
empty). Rows with a null doc_id are no part of any group: their component is null and they are kept.
Rows that repeat doc_id and text share a row's result. An empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .licenses import _WORDS
from .linkage import across_components, bucket_pivots, components, least_by_root, mix, mixed_members, run_ends, whole_runs
from .runtime import Rows, Workspace, prepare

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 12, 4
SAMPLES = BANDS * ROWS
#: Share of documents from which on a shingle's document frequency is broadcast; rarer shingles meet to be counted.
HEAVY = 1e-3
#: Power of the idf in the weights that samples are drawn and links verified by, unless a caller gives another; 1 is plain TF-IDF. A large group of near copies makes its own shingles frequent;
#: at full strength its members' few rare shingles would outweigh all that they share.
DAMPING = 0.125
#: Shingles that a counting task holds at most, and bytes of text that it reads.
HELD, TASK_BYTES = 8_000_000, 256 << 20
#: Shingles and rows that a block of texts holds at least when it is handed over, and bytes of text whose shingles a range of hashes holds on average.
BLOCK_SHINGLES, BLOCK_ROWS, RANGE_BYTES = 1_000_000, 1 << 16, 16 << 20
SEED = 77

_BASE = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 18


def _powers() -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up = np.full(_PIECE + 1, _BASE, dtype=np.uint64)
    down = np.full(_PIECE + 1, inverse, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_UP, _DOWN = _powers()


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word of a text, from differences of a running polynomial of its bytes."""
    text, found, at = raw.translate(_WORDS), [], 0
    while at < len(text):
        end = len(text)
        if end - at > _PIECE:  # cut at a blank, or inside a word that fills the piece
            end = text.rfind(b" ", at, at + _PIECE) + 1
            end = end if end > at else at + _PIECE
        data = np.frombuffer(text, dtype=np.uint8, count=end - at, offset=at)
        inside = np.concatenate(([False], data != 32, [False]))
        change = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = change[::2], change[1::2]
        running = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[: len(data)])))
        found.append(mix((running[ends] - running[starts]) * _DOWN[starts]))
        at = end
    return np.concatenate(found) if found else np.empty(0, dtype=np.uint64)


def shingles(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (ascending hashes) and their counts."""
    words = word_hashes(raw)
    if not len(words):
        return words, np.empty(0, dtype=np.int64)
    size = min(SHINGLE, len(words))
    value = words[: len(words) - size + 1].copy()
    for k in range(1, size):
        value = value * _BASE + words[k : len(words) - size + 1 + k]
    value = mix(value + np.uint64(size))
    value.sort()
    first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    return value[first], np.diff(np.append(first, len(value)))


def weigh(counts: np.ndarray, frequency: np.ndarray, documents: int, damping: float) -> np.ndarray:
    """The weights that samples are drawn and links verified by, of shingles' counts in a text and document frequencies."""
    return counts * np.log1p(documents / frequency) ** damping


class Weights:
    """Document frequencies of heavy shingles and the weights that follow; shingles beside them count as those of one document."""

    def __init__(self, heavy: np.ndarray, frequency: np.ndarray, documents: int, damping: float = DAMPING):
        self.heavy, self.frequency, self.documents, self.damping = heavy, np.maximum(frequency, 1), documents, damping
        self.idf = np.log1p(documents / self.frequency)

    def known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which are heavy, document frequencies of these)."""
        if not len(self.heavy) or not len(hashes):
            return np.zeros(len(hashes), dtype=bool), np.empty(0)
        place = np.minimum(np.searchsorted(self.heavy, hashes), len(self.heavy) - 1)
        hit = self.heavy[place] == hashes
        return hit, self.frequency[place[hit]]

    def damped(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        frequency = np.ones(len(hashes))
        hit, found = self.known(hashes)
        frequency[hit] = found
        return weigh(counts, frequency, self.documents, self.damping)


def _gamma_quantiles() -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2 in the middle of 2**16 equal steps."""
    grid = np.concatenate((np.linspace(0, 0.1, 200_000)[1:], np.linspace(0.1, 40, 800_000)))
    return np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), 1 - (1 + grid) * np.exp(-grid), grid).astype(np.float32)


class Sampler:
    def __init__(self, samples: int = SAMPLES, seed: int = SEED):
        gamma = _gamma_quantiles()
        self.r, self.inverse_r, self.log_c = gamma, 1 / gamma, np.log(gamma)
        random = np.random.default_rng(seed)
        self.factors = random.integers(1, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.samples = samples

    def __call__(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """A 64-bit name of the sample (shingle, step) of each of the hash functions."""
        log_w = np.log(weights).astype(np.float32)
        best = np.full(self.samples, np.inf, dtype=np.float32)
        name = np.zeros(self.samples, dtype=np.uint64)
        for at in range(0, len(hashes), 4096):
            own = hashes[at : at + 4096]
            bits = own[:, None] * self.factors
            bits ^= bits >> np.uint64(29)
            bits *= np.uint64(0x7FB5D329728EA185)
            fields = bits.view(np.uint16).reshape(len(own), self.samples, 4)
            at_r = fields[:, :, 3]
            beta = fields[:, :, 1].astype(np.float32)
            beta += np.float32(0.5)
            beta *= np.float32(1 / 65536)
            r = self.r[at_r]
            step = self.inverse_r[at_r]
            step *= log_w[at : at + 4096, None]
            step += beta
            np.floor(step, out=step)
            value = step - beta
            value += np.float32(1)
            value *= r
            np.subtract(self.log_c[fields[:, :, 2]], value, out=value)  # ln c - r (t - beta) - r
            low = value.argmin(axis=0)
            column = np.arange(self.samples)
            smaller = value[low, column] < best
            best = np.where(smaller, value[low, column], best)
            name = np.where(smaller, mix(own[low] + (step[low, column].astype(np.int64).astype(np.uint64) << np.uint64(1))), name)
        return name


def bands(names: np.ndarray) -> np.ndarray:
    """Buckets of a document, one for each band."""
    rows = names.reshape(BANDS, ROWS)
    value = np.arange(1, BANDS + 1).astype(np.uint64)
    for k in range(ROWS):
        value = mix(value * _BASE + rows[:, k])
    return value.view(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two texts' (ascending hashes, weights); 0 if both are empty."""
    place = np.searchsorted(b[0], a[0])
    hit = place < len(b[0])
    hit[hit] = b[0][place[hit]] == a[0][hit]
    both = np.minimum(a[1][hit], b[1][place[hit]]).sum(dtype=np.float64)
    total = a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - both
    return float(both / total) if total > 0 else 0.0


def _numbers(frame: DataFrame, name: str) -> np.ndarray:
    return frame.toArrow().column(name).to_numpy()


def heavy_shingles(docs: DataFrame, total: int, size: int, damping: float = DAMPING) -> Weights:
    """Exact document frequencies of all shingles in more than HEAVY of the ``total`` documents (of ``size`` bytes) and in two at least.

    A task counts its documents' shingles and leaves out what is rare among them, as long as that loses less than ``least`` of
    its documents for any shingle; so what is in HEAVY of all documents still shows.
    """
    least = HEAVY / 2
    tasks = max(1, int(least * total / 4), size // TASK_BYTES)
    raw = docs.select("raw").coalesce(tasks) if tasks < docs.rdd.getNumPartitions() else docs.select("raw")

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen, lost = [], 0, 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, lost
            value = np.concatenate(held) if held else np.empty(0, dtype=np.uint64)
            held = []
            value.sort()
            first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))) if size else np.empty(0, dtype=np.int64)
            count = np.diff(np.append(first, size))
            rare = math.ceil(least * seen - lost) - 1  # counts up to this may go
            lost += rare
            kept = np.flatnonzero(count > rare)
            for at in range(0, len(kept), 1 << 17):
                part = kept[at : at + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(value[first[part]].view(np.int64)), pa.array(count[part])], names=["shingle", "n"])
            size = 0

        for batch in batches:
            for text in batch.column("raw"):
                found = shingles(text.as_py())[0]
                held.append(found)
                size, seen = size + len(found), seen + 1
                if size >= HELD:
                    yield from flush()
        if seen:
            yield from flush()

    told = raw.mapInArrow(frequent, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, least * total))
    candidates = np.sort(_numbers(told.select("shingle"), "shingle").view(np.uint64))
    if not len(candidates):
        return Weights(candidates, np.empty(0), total, damping)
    shared = docs.sparkSession.sparkContext.broadcast(candidates)  # at most mean shingles of a document over half of HEAVY

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        sums = np.zeros(len(wanted), dtype=np.int64)
        for batch in batches:
            for text in batch.column("raw"):
                found = shingles(text.as_py())[0]
                if len(found):
                    place = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
                    sums[place[wanted[place] == found]] += 1
        kept = sums > 0
        if kept.any():
            yield pa.RecordBatch.from_arrays([pa.array(wanted[kept].view(np.int64)), pa.array(sums[kept])], names=["shingle", "n"])

    counted = docs.select("raw").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") > max(1, HEAVY * total)).toArrow()  # all others are counted by ranges
    shingle, n = found.column("shingle").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(shingle)
    return Weights(shingle[order], n[order].astype(np.float64), total, damping)


def _profile(hashes: np.ndarray, weights: np.ndarray) -> bytes:
    return hashes.tobytes() + weights.astype("<f4").tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 12
    return np.frombuffer(blob, dtype="<u8", count=n), np.frombuffer(blob, dtype="<f4", count=n, offset=8 * n)


def _squeeze(values: np.ndarray) -> bytes:
    """Numbers by byte planes, each compressed alone: most planes of counts and of differences of sorted hashes hold little."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    packed = [pa.compress(plane.tobytes(), codec="zstd", asbytes=True) if plane.any() else b"" for plane in planes] if len(values) else []
    return b"".join(len(p).to_bytes(4, "little") + p for p in packed)


def _widen(blob: bytes, n: int, kind: str) -> np.ndarray:
    planes, at = np.zeros((n, np.dtype(kind).itemsize), dtype=np.uint8), 0
    for k in range(planes.shape[1] if n else 0):
        size = int.from_bytes(blob[at : at + 4], "little")
        if size:
            planes[:, k] = np.frombuffer(pa.decompress(blob[at + 4 : at + 4 + size], n, codec="zstd"), dtype=np.uint8)
        at += 4 + size
    return planes.view(kind).ravel()


#: Some shingles of a block, ascending: of the range ``part``, or those whose frequency is known, which come with the block's rows (doc_id, t1, t2, number of the text) as ``part`` -1.
_PIECES = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("hashes", pa.binary()), ("texts", pa.binary()), ("counts", pa.binary()), ("times", pa.binary()), ("frequency", pa.binary()), ("rows", pa.int64()), ("owners", pa.binary())])
_PIECES_DDL = "block long, part long, n long, hashes binary, texts binary, counts binary, times binary, frequency binary, rows long, owners binary"


def _pieces(docs: DataFrame, weights: Weights, size: int) -> DataFrame:
    """The shingles of all texts in blocks, cut by range of hash."""
    shared, parts = docs.sparkSession.sparkContext.broadcast(weights), 1 + size // RANGE_BYTES

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, out, number = shared.value, Rows(_PIECES), 0
        texts: dict[tuple[int, int], int] = {}  # equal texts of a block are one
        held, times, owners, size = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            block = TaskContext.get().partitionId() << 32 | number
            hashes, counts = (np.concatenate(side) for side in zip(*held))
            text = np.repeat(np.arange(len(held), dtype="<u4"), [len(h) for h, _ in held])
            order = np.argsort(hashes)
            hashes, counts, text = hashes[order], counts[order].astype("<u4"), text[order]
            heavy, frequency = weights.known(hashes)
            own = _squeeze(np.array(owners, dtype="<i8").ravel())
            out.add(block, -1, len(frequency), _squeeze(np.diff(hashes[heavy], prepend=np.uint64(0))), _squeeze(text[heavy]), _squeeze(counts[heavy]), b"", _squeeze(frequency.astype("<u4")), len(owners), own, size=100 + len(own) + 8 * len(frequency))
            hashes, counts, text = hashes[~heavy], counts[~heavy], text[~heavy]
            time = np.array(times, dtype="<u4")[text]
            ends = np.searchsorted((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
            for part in np.flatnonzero(np.diff(ends)).tolist():
                at = slice(ends[part], ends[part + 1])
                out.add(block, part, int(ends[part + 1] - ends[part]), _squeeze(np.diff(hashes[at], prepend=np.uint64(0))), _squeeze(text[at]), _squeeze(counts[at]), _squeeze(time[at]), b"", 0, b"", size=100 + 8 * int(ends[part + 1] - ends[part]))
                if out.full:
                    yield out.batch()
            if out:
                yield out.batch()

        for batch in batches:
            for doc_id, t1, t2, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "t1", "t2", "raw"))):
                at = texts.setdefault((t1, t2), len(texts))
                if at == len(held):
                    held.append(shingles(raw))
                    times.append(0)
                    size += len(held[-1][0])
                times[at] += 1
                owners.append((doc_id, t1, t2, at))
                if size >= BLOCK_SHINGLES or len(owners) >= BLOCK_ROWS:
                    yield from flush()
                    number += 1
                    texts, held, times, owners, size = {}, [], [], [], 0
        if owners:
            yield from flush()

    return docs.mapInArrow(cut, _PIECES_DDL)


def _hashes(table: pa.Table) -> np.ndarray:
    return np.concatenate([np.cumsum(_widen(h, n, "<u8"), dtype=np.uint64) for h, n in zip(table.column("hashes").to_pylist(), table.column("n").to_pylist())])


def _numbers_of(table: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([_widen(blob, n, "<u4") for blob, n in zip(table.column(name).to_pylist(), table.column("n").to_pylist())])


def _with_frequencies(pieces: DataFrame) -> DataFrame:
    """``pieces`` with the document frequency of every shingle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ("part",)):
            known = table.column("part").to_numpy() < 0
            yield from table.filter(pa.array(known)).to_batches()
            table = table.filter(pa.array(~known))
            if not table.num_rows:
                continue
            hashes, times = _hashes(table), _numbers_of(table, "times")
            order = np.argsort(hashes)
            ordered = hashes[order]
            first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
            frequency = np.empty(len(hashes), dtype="<u4")
            frequency[order] = np.repeat(np.add.reduceat(times[order], first, dtype=np.int64), np.diff(np.append(first, len(hashes))))
            ends = np.cumsum(table.column("n").to_numpy())
            blobs = [_squeeze(part) for part in np.split(frequency, ends[:-1])]
            table = table.set_column(table.column_names.index("frequency"), "frequency", pa.array(blobs, pa.binary()))
            yield from table.set_column(table.column_names.index("times"), "times", pa.array([b""] * len(blobs), pa.binary())).to_batches()

    # What is known already goes anywhere: by its block.
    spread = F.when(F.col("part") < 0, -1 - F.col("block")).otherwise(F.col("part"))
    return pieces.withColumn("part", spread).repartition("part").sortWithinPartitions("part").mapInArrow(count, _PIECES_DDL)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("bands", pa.list_(pa.int64())), ("packed", pa.binary()), ("bytes", pa.int64()), ("frequency", pa.binary())])
_SIGNED_DDL = "doc_id long, t1 long, t2 long, bands array<long>, packed binary, bytes long, frequency binary"
#: Signatures that a worker remembers, so that many copies of a text are sampled once.
REMEMBERED = 20_000


def _signed(docs: DataFrame, weights: Weights, size: int) -> DataFrame:
    """Buckets of every row's text, and the document frequencies of its shingles (ascending)."""
    documents, damping = weights.documents, weights.damping
    pieces = _with_frequencies(_pieces(docs, weights, size)).repartition("block").sortWithinPartitions("block", "part")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, rows = Sampler(), Rows(_SIGNED)
        memo: dict[tuple[int, int], tuple[list[int], bytes, int, bytes]] = {}
        for run in whole_runs(batches, ("block",)):
            start = 0
            for end in np.unique(run_ends(run.column("block").to_numpy())).tolist():
                block, start = run.slice(start, end - start), end
                text, hashes = _numbers_of(block, "texts"), _hashes(block)
                counts, frequency = _numbers_of(block, "counts"), _numbers_of(block, "frequency")
                order = np.lexsort((hashes, text))
                text, hashes, counts, frequency = text[order], hashes[order], counts[order], frequency[order]
                owners = np.concatenate([_widen(blob, 4 * n, "<i8").reshape(-1, 4) for blob, n in zip(block.column("owners").to_pylist(), block.column("rows").to_pylist()) if n])
                # All at once and in the type of ``text``: a search by another type converts the whole block.
                ends = np.searchsorted(text, np.arange(owners[:, 3].max() + 2, dtype=text.dtype)).tolist()
                for doc_id, t1, t2, number in owners.tolist():
                    found = memo.get((t1, t2))
                    if found is None:
                        own = slice(ends[number], ends[number + 1])
                        if own.start < own.stop:
                            names = bands(sampler(hashes[own], weigh(counts[own], frequency[own], documents, damping)))
                            found = (names.tolist(), names.astype("<i8").tobytes(), 8 * BANDS + 12 * (own.stop - own.start), _squeeze(frequency[own]))
                        else:
                            found = ([], b"", 0, b"")
                        if len(memo) >= REMEMBERED:
                            memo = {}
                        memo[t1, t2] = found
                    rows.add(doc_id, t1, t2, *found, size=256 + len(found[3]))
                    if rows.full:
                        yield rows.batch()
        if rows:
            yield rows.batch()

    return pieces.mapInArrow(sign, _SIGNED_DDL)


def _profiles(docs: DataFrame, classes: DataFrame, nodes: DataFrame, weights: Weights) -> DataFrame:
    """(node, profile) of the classes of ``nodes``: whole texts as weighted shingles."""
    documents, damping = weights.documents, weights.damping
    wanted = classes.select("node", F.col("rep").alias("doc_id"), "t1", "t2", "frequency").join(nodes, "node")
    texts = docs.join(wanted, ["doc_id", "t1", "t2"]).dropDuplicates(["doc_id", "t1", "t2"]).select("node", "raw", "frequency")

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(pa.schema([("node", pa.int64()), ("profile", pa.binary())]))
        for batch in batches:
            for node, raw, frequency in zip(*(batch.column(c).to_pylist() for c in ("node", "raw", "frequency"))):
                hashes, counts = shingles(raw)
                blob = _profile(hashes, weigh(counts, _widen(frequency, len(hashes), "<u4"), documents, damping))
                rows.add(node, blob, size=len(blob))
                if rows.full:
                    yield rows.batch()
        if rows:
            yield rows.batch()

    return texts.mapInArrow(profile, "node long, profile binary")


def _verified(pairs: DataFrame, profiles: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts are similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [weighted_jaccard(_unpack(x), _unpack(y)) >= similarity for x, y in zip(batch.column("pa").to_pylist(), batch.column("pb").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    sides = pairs.join(profiles.toDF("a", "pa"), "a").join(profiles.toDF("b", "pb"), "b")
    return sides.select("a", "b", "pa", "pb").mapInArrow(compare, "a long, b long")


class _Met:
    """Members of meetings: buckets and profiles."""

    def __init__(self, payloads: list[bytes]):
        fixed = 8 * BANDS
        self.bands = np.frombuffer(b"".join(p[:fixed] for p in payloads), dtype="<i8").reshape(-1, BANDS)
        self.profiles = [_unpack(memoryview(p)[fixed:]) for p in payloads]
        self.sizes = np.array([len(h) for h, _ in self.profiles])
        self.total = np.array([w.sum(dtype=np.float64) for _, w in self.profiles])

    def similarities(self, left: int, right: np.ndarray) -> np.ndarray:
        """Weighted Jaccard similarity of one member to others."""
        hashes, weights = self.profiles[left]
        own = np.concatenate([self.profiles[r][0] for r in right])
        place = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        both = np.where(hashes[place] == own, np.minimum(weights[place], np.concatenate([self.profiles[r][1] for r in right])), 0.0)
        starts = np.concatenate(([0], np.cumsum(self.sizes[right])[:-1]))
        common = np.add.reduceat(both, starts, dtype=np.float64)
        return common / (self.total[left] + self.total[right] - common)


def _linked(similarity: float):
    def linked(met: _Met, buckets: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        # What two texts have in common weighs no more than the lighter one.
        at = np.flatnonzero(np.minimum(met.total[left], met.total[right]) >= similarity * (1 - 1e-6) * np.maximum(met.total[left], met.total[right]))
        first = (met.bands[left[at]] == met.bands[right[at]]).argmax(axis=1)
        at = at[met.bands[left[at], first] == buckets[left[at]]]  # a pair is compared in its first bucket only
        out = np.zeros(len(left), dtype=bool)
        for run in np.split(at, np.flatnonzero(np.diff(left[at])) + 1) if len(at) else ():
            out[run] = met.similarities(left[run[0]], right[run]) >= similarity
        return out

    return linked


def _grouped(documents: DataFrame, similarity: float, damping: float) -> DataFrame:
    """doc_id, t1, t2 (hashes of the text), component_id, kept and n_copies of every row with a doc_id."""
    work = Workspace(prepare(documents.sparkSession), "minhash")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _raw().alias("raw")).where("doc_id IS NOT NULL")
    docs = docs.select("doc_id", *_text_key("raw"), "raw")
    total, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("raw")), F.lit(0))).first()
    weights = heavy_shingles(docs, total, size, damping)
    signed = work.write(_signed(docs, weights, size), "signed")
    work.release()  # every shingle was shuffled twice
    grouped = signed.groupBy("t1", "t2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.first("bands").alias("bands"), F.first("packed").alias("packed"), F.first("bytes").alias("bytes"), F.first("frequency").alias("frequency"))
    classes = work.write(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")  # written once, so a class keeps its number
    buckets = classes.select(F.explode("bands").alias("bucket"), "node", "bytes")
    members, pairs = bucket_pivots(work, [buckets])
    profiles = work.write(_profiles(docs, classes, members.select("node").distinct(), weights), "profiles")
    links = work.write(_verified(pairs, profiles, similarity), "links")
    rest = mixed_members(work, members, components(work, links)).join(profiles, "node").join(classes.select("node", "packed"), "node")
    payload = F.concat("packed", "profile")
    more = work.write(across_components(rest.select("bucket", "node", "comp", "blocks", payload.alias("payload")), _Met, _linked(similarity)), "more")
    work.drop(profiles)
    roots = components(work, links.union(more)).select(F.col("id").alias("node"), "root")
    named = work.write(classes.select("t1", "t2", "node", "rep", "n_copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    own = F.struct("rep", "t1", "t2")
    named = least_by_root(work, named, own, "chosen").select("t1", "t2", "n_copies", "rep", F.col("chosen.rep").alias("component_id"), (own == F.col("chosen")).alias("first"))
    named = work.write(named, "groups")
    work.keep_only(signed, named)
    found = signed.select("doc_id", "t1", "t2").join(named, ["t1", "t2"])
    return found.select("doc_id", "t1", "t2", "component_id", (F.col("first") & (F.col("doc_id") == F.col("rep"))).alias("kept"), "n_copies")


def _raw():
    return F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")


def _text_key(raw) -> list:
    return [F.xxhash64(raw).alias("t1"), F.xxhash64(F.lit(1), raw).alias("t2")]


def near_duplicates(documents: DataFrame, similarity: float = SIMILARITY, damping: float = DAMPING) -> DataFrame:
    """doc_id, component_id (smallest doc_id of the group), kept, n_copies (rows of equal text) of every row; ``damping`` 1 is plain TF-IDF."""
    known = _grouped(documents, similarity, damping).drop("t1", "t2")
    lone = documents.where(F.col("doc_id").cast("long").isNull())
    return known.union(lone.select(F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(True), F.lit(1).cast("long")))


def deduplicate(documents: DataFrame, similarity: float = SIMILARITY, damping: float = DAMPING) -> DataFrame:
    """The rows of ``documents``, with all their columns, of which one of each group stays; rows without a doc_id all stay."""
    fresh = [f"_{uuid.uuid4().hex}" for _ in range(3)]  # no column of any input
    own = dict(zip(fresh, (F.col("doc_id").cast("long"), *_text_key(_raw()))))
    kept = _grouped(documents, similarity, damping).where("kept").select(*(F.col(c).alias(k) for c, k in zip(("doc_id", "t1", "t2"), fresh))).distinct()
    keyed = documents.withColumns(own)
    known = keyed.where(F.col(fresh[0]).isNotNull()).join(kept, fresh, "left_semi").dropDuplicates(fresh)
    return known.unionByName(keyed.where(F.col(fresh[0]).isNull())).drop(*fresh)
