"""Counterfactual-regularised toxicity classifier.

A sparse logistic model over hashed words and word prefixes. For every labelled text that names an
identity term, the same text with another term of that group in its place should score alike: the
squared change of the log-odds over all such swaps is part of the objective, next to an l1 penalty
that leaves rare chance words without weight.

The sample is bounded (``rows_per_class`` rows of each label, ROWS_PER_CLASS by default, and ``sample_bytes`` of features); scoring
covers whole texts of all documents, very long ones too. Null and empty texts get the base rate. With no usable label
every score is LOW_RATE. Repeated rows are scored
once each, null doc_ids stay null and aren't held out, other columns are ignored, an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .hashed_text import DIMENSIONS, SAMPLE_BYTES, LinearScorer, Offset, proximal, sigmoid, training_sample, word_features
from .runtime import Rows, held_out, identified_texts, prepare, raw_rows

ROWS_PER_CLASS = 5000
THRESHOLD = 0.3
LOW_RATE = 0.005
L1, COUNTERFACTUAL, STEPS = 2e-4, 1.0, 200

# Identity terms, by groups within which they are swapped.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("old", "young", "elderly"),
    ("blind", "deaf", "disabled"),
)


def swaps(features: np.ndarray, groups=IDENTITY_GROUPS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(feature numbers, +1 or -1) of the text minus each of its counterfactuals, where these differ."""
    present, out = set(features.tolist()), []
    for group in groups:
        of = [word_features(term.encode()) for term in group]
        for a, own in enumerate(of):
            if own[0] not in present:
                continue
            for b, other in enumerate(of):
                gone, come = set(own) - set(other), set(other) - present
                if a != b and (gone or come):
                    out.append((np.array([*gone, *come]), np.array([1.0] * len(gone) + [-1.0] * len(come))))
    return out


def fit(sample, counterfactual: float = COUNTERFACTUAL, l1: float = L1, steps: int = STEPS, groups=IDENTITY_GROUPS) -> tuple[np.ndarray, float]:
    """Weights and bias of a training sample."""
    if not sample:
        return np.zeros(DIMENSIONS), float(np.log(LOW_RATE / (1 - LOW_RATE)))
    y = np.array([float(label > 0) for _, label, _, _ in sample])
    weight = np.array([w for *_, w in sample])
    rate = float(np.clip((weight * y).sum() / weight.sum(), LOW_RATE, 1 - LOW_RATE))
    offset = Offset(np.log(rate / (1 - rate)))
    pairs = [p for _, _, f, _ in sample for p in swaps(f, groups)]

    def slope(scores: np.ndarray) -> np.ndarray:
        residual = weight * (sigmoid(scores + offset.value) - y) / len(y)
        offset.move(residual.sum())
        return residual

    return proximal([f for _, _, f, _ in sample], weight, slope, l1, steps, pairs, counterfactual), float(offset.value)


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> tuple[np.ndarray, float]:
    return fit(training_sample(docs, labels, "toxic", rows_per_class, shapes=False, sample_bytes=sample_bytes))


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score (probability of label 1) of every document."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast((model[0].astype(np.float32), model[1]))  # DIMENSIONS numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        linear, rows = LinearScorer(weights, shapes=False), Rows(_SCHEMA)
        for doc_ids, raws in raw_rows(batches):
            for doc_id, raw in zip(doc_ids, raws):
                rows.add(doc_id, float(sigmoid(linear(raw) + bias)))
            yield rows.batch()

    return identified_texts(docs).mapInArrow(run, "doc_id long, score double")


def scorer(spark, model: tuple[np.ndarray, float]):
    """A column function of a text column, for filters that keep all columns."""
    shared = spark.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    @pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = shared.value
        linear = LinearScorer(weights, shapes=False)
        for texts in batches:
            yield pd.Series([float(sigmoid(linear((t or "").encode("utf-8", "replace")) + bias)) for t in texts], dtype="float64")

    return toxicity


def predictions(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
