"""Hashed text features and the bounded training samples that the classifiers share.

A text becomes a set of feature numbers below DIMENSIONS: every distinct word and its prefixes
(inflected and compound forms share them), and how large a share of the blank-separated tokens has
a given shape (letters, capitals, digits and marks) or repeats the one before, on a logarithmic ladder.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Rows, Workspace, held_out, identified_texts, prepare, raw_rows

DIMENSIONS = 1 << 18
PREFIXES = (3, 4, 5, 6, 8)
#: Steps of the ladder of shares: 1/2, 1/4, ... of all tokens.
SHARE_STEPS = 7
#: Label values that a sample is drawn of at most; more are refused.
MOST_CLASSES = 64
#: Entries of a worker's memo, and the bytes of a word up to which it is remembered.
MEMO_WORDS, MEMO_WORD_BYTES = 100_000, 256

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_SHAPE = bytes(ord("A") if 65 <= c <= 90 else ord("a") if c >= 128 or 97 <= c <= 122 else ord("0") if 48 <= c <= 57 else c for c in range(256))


def _number(kind: bytes, value: bytes) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(kind + b"\0" + value) % DIMENSIONS


def word_features(word: bytes) -> tuple[int, ...]:
    text = word.decode("utf-8", "replace").lower()
    return (_number(b"w", text.encode()), *(_number(b"p%d" % n, text[:n].encode()) for n in PREFIXES if len(text) > n))


def _collapsed(shape: bytes) -> bytes:
    return bytes(c for i, c in enumerate(shape) if i == 0 or c != shape[i - 1])[:12]


class Featurizer:
    """words, and with ``shapes`` also the shares of token shapes, of a UTF-8 text."""

    def __init__(self, shapes: bool):
        self.shapes, self.memo, self.collapsed = shapes, {}, {}

    def words(self, raw: bytes) -> set[bytes]:
        return set(raw.translate(_WORDS).split())

    def shares(self, raw: bytes) -> list[int]:
        words = raw.split()
        counts = Counter(raw.translate(_SHAPE).split())
        total, shapes = sum(counts.values()), Counter({b"": sum(map(eq, words, words[1:]))})
        if len(self.collapsed) > MEMO_WORDS:
            self.collapsed = {}
        for shape, n in counts.items():
            short = self.collapsed.get(shape)
            if short is None:
                short = _collapsed(shape)
                if len(shape) <= MEMO_WORD_BYTES:
                    self.collapsed[shape] = short
            shapes[short] += n
        return [_number(b"s%d" % k, shape) for shape, n in shapes.items() for k in range(1, SHARE_STEPS + 1) if n and n << k >= total]

    def __call__(self, raw: bytes) -> np.ndarray:
        found: list[int] = []
        if len(self.memo) > MEMO_WORDS // 4:  # entries hold all of a word's features
            self.memo = {}
        for word in self.words(raw):
            features = self.memo.get(word)
            if features is None:
                features = word_features(word)
                if len(word) <= MEMO_WORD_BYTES:
                    self.memo[word] = features
            found += features
        if self.shapes:
            found += self.shares(raw)
        return np.unique(np.array(found, dtype=np.int32))


class LinearScorer:
    """Sum of the weights of a text's features (each counts once); words whose features all have weight 0 cost a lookup."""

    def __init__(self, weights: np.ndarray, shapes: bool):
        self.weights, self.features, self.memo = weights, Featurizer(shapes), {}

    def __call__(self, raw: bytes) -> float:
        if len(self.memo) > MEMO_WORDS:
            self.memo = {}
        live: set[int] = set()
        for word in self.features.words(raw):
            numbers = self.memo.get(word)
            if numbers is None:
                numbers = tuple(i for i in word_features(word) if self.weights[i])
                if len(word) <= MEMO_WORD_BYTES:
                    self.memo[word] = numbers
            if numbers:
                live.update(numbers)
        if self.features.shapes:
            live.update(self.features.shares(raw))
        return float(self.weights[sorted(live)].sum()) if live else 0.0


class Sparse:
    """Rows of feature numbers with weight 1 (or given values), for training; products go through AT_ONCE entries at a time."""

    AT_ONCE = 1 << 19

    def __init__(self, rows: list[np.ndarray], values: list[np.ndarray] | None = None):
        self.sizes = np.array([len(r) for r in rows], dtype=np.int64)
        self.index, at = np.empty(int(self.sizes.sum()), dtype=np.int32), 0
        for row in rows:
            self.index[at : at + len(row)] = row
            at += len(row)
        self.values = None if values is None else np.concatenate(values)
        self.n, self.ends = len(rows), np.cumsum(self.sizes)

    def _parts(self):
        """(rows, entries) as slices."""
        row = 0
        while row < self.n:
            at = int(self.ends[row] - self.sizes[row])
            to = max(row + 1, int(np.searchsorted(self.ends, at + self.AT_ONCE, side="right")))
            yield slice(row, to), slice(at, int(self.ends[to - 1]))
            row = to

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for rows, entries in self._parts():
            part = w[self.index[entries]]
            if self.values is not None:
                part *= self.values[entries]
            filled = np.flatnonzero(self.sizes[rows])
            if len(filled):
                out[rows][filled] = np.add.reduceat(part, (self.ends[rows] - self.sizes[rows])[filled] - entries.start)
        return out

    def transposed_dot(self, g: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size)
        for rows, entries in self._parts():
            part = np.repeat(g[rows], self.sizes[rows])
            if self.values is not None:
                part *= self.values[entries]
            out += np.bincount(self.index[entries], weights=part, minlength=size)
        return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Offset:
    """A bias that takes plain gradient steps beside the weights."""

    def __init__(self, value: float, step: float = 2.0):
        self.value, self.step = float(value), step

    def move(self, gradient: float) -> None:
        self.value -= self.step * float(gradient)


def proximal(rows: list[np.ndarray], weight: np.ndarray, slope, l1: float, steps: int, pairs=(), pair_weight: float = 0.0) -> np.ndarray:
    """Weights for all DIMENSIONS by accelerated proximal gradient steps with an l1 penalty.

    ``slope`` maps the rows' scores to the loss' derivatives by them. ``pairs`` are sparse
    difference rows (numbers, values) whose mean squared score is penalised by ``pair_weight``.
    Features of fewer than three rows get no weight, unless a pair needs them.
    """
    seen = np.zeros(DIMENSIONS, dtype=np.int64)
    for row in rows:
        seen[row] += 1  # a row holds a feature once
    known = seen >= 3
    for index, _ in pairs:
        known[index] = True
    live = np.flatnonzero(known)
    weights = np.zeros(DIMENSIONS)
    if not len(live):
        slope(np.zeros(len(rows)))
        return weights
    at = np.full(DIMENSIONS, -1, dtype=np.int32)
    at[live] = np.arange(len(live))
    x = Sparse([at[f[known[f]]] for f in rows])
    d = Sparse([at[i] for i, _ in pairs], [v for _, v in pairs]) if pairs else None
    # Steps by feature: the curvature along a feature, times how many features share a row.
    curve = x.transposed_dot(0.25 * weight * np.sqrt(np.maximum(1, x.sizes)), len(live)) / len(rows) * np.sqrt(max(1.0, x.sizes.mean()))
    if d is not None:
        curve += 2 * pair_weight / d.n * int(d.sizes.max()) * np.bincount(d.index, minlength=len(live))
    step = 1.0 / (curve + 1e-3)
    w = look = np.zeros(len(live))
    t = 1.0
    for _ in range(steps):
        gradient = x.transposed_dot(slope(x.dot(look)), len(live))
        if d is not None:
            gradient += 2 * pair_weight / d.n * d.transposed_dot(d.dot(look), len(live))
        moved = look - step * gradient
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
        if float(((look - new) * (new - w)).sum()) > 0:
            t, look = 1.0, new  # the momentum points uphill: start it anew
        else:
            t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
            look, t = new + (t - 1) / t_next * (new - w), t_next
        w = new
    weights[live] = w
    return weights


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("features", pa.binary())])


#: Bytes of features that a sample brings to the driver at most, and the shares of ids that are left out where they'd be more.
SAMPLE_BYTES, SLOTS = 128 << 20, 1 << 16
#: Steps in which a class's share of rows is told, so that a few rows of many billions can be.
RANKS = 1 << 62


def shares_within(sizes: dict[int, int], most: int) -> int:
    """The first share that is left out, so that those before it have at most ``most`` bytes, or only one of them has any."""
    total = 0
    for slot in sorted(sizes):
        if total and total + sizes[slot] > most:
            return slot
        total += sizes[slot]
    return SLOTS


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows_per_class: int, shapes: bool, sample_bytes: int = SAMPLE_BYTES) -> list[tuple[int, int, np.ndarray, float]]:
    """(doc_id, label, features, weight) of a bounded sample of labelled documents that aren't held out.

    At most about ``rows_per_class`` rows of each label value, chosen by a hash of the id alone and
    weighted so that the classes keep their share. Whole texts are read. What the driver gets is at most ``sample_bytes`` of
    features (or those of the first of SLOTS shares of ids): beyond that whole shares of ids are left
    out, whatever their label. More than MOST_CLASSES label values are refused by ValueError. Rows without an id or
    label are skipped; of several labels of an id the largest counts, of several texts the first in the order of bytes.
    """
    spark = prepare(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().limit(MOST_CLASSES + 1).collect()}
    if not counts:
        return []
    if len(counts) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} values of {label}: not a graded label")
    rank = F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(RANKS))
    limit = F.coalesce(*(F.when(F.col("label") == value, F.lit(min(RANKS, RANKS * rows_per_class // n))) for value, n in counts.items()))
    chosen = known.where(rank < limit)
    picked = identified_texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("raw").alias("raw"))  # about rows_per_class rows a class

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, rows = Featurizer(shapes), Rows(_SCHEMA)
        for doc_ids, raws in raw_rows(batches):
            for doc_id, raw in zip(doc_ids, raws):
                found = features(raw).astype("<i4").tobytes()
                rows.add(doc_id, found, size=len(found) + 32)
                if rows.full:
                    yield rows.batch()
        if rows:
            yield rows.batch()

    of = {r["doc_id"]: r["label"] for r in chosen.collect()}
    work = Workspace(spark, "sample")
    featured = work.write(picked.select("doc_id", "raw").mapInArrow(run, "doc_id long, features binary"), "features")
    slot = F.pmod(F.xxhash64("doc_id", F.lit("share")), F.lit(SLOTS))
    sizes = featured.groupBy(slot.alias("slot")).agg(F.sum(F.octet_length("features") + 8).alias("size")).collect()
    found = featured.where(slot < shares_within({r["slot"]: r["size"] for r in sizes}, sample_bytes)).toArrow()
    work.drop(featured)
    ids = found.column("doc_id").to_pylist()
    sampled = Counter(of[i] for i in ids)
    scale = {value: counts[value] / n for value, n in sampled.items()}
    mean = sum(scale[of[i]] for i in ids) / max(1, len(ids))
    rows = ((i, of[i], np.frombuffer(f.as_py(), dtype="<i4"), scale[of[i]] / mean) for i, f in zip(ids, found.column("features")))
    return sorted(rows, key=lambda x: (x[0], x[1], len(x[2])))
