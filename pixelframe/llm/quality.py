"""Ordinal cumulative-link regression on graded ratings.

One hashed-text score is shared by all grades; ordered thresholds turn it into probabilities of
reaching each grade: P(grade > k) = logistic(score - threshold k). Given are the expected grade and
the probability of reaching the top grades, by which documents are selected.

The sample is bounded (``rows_per_class`` rows of each grade, ROWS_PER_CLASS by default, and ``sample_bytes`` of features) and spares
held-out documents; scoring covers whole texts of all documents, very long ones too. Null and empty texts get the score
of no features, like any other text. With fewer than two grades there is nothing to tell apart:
every document is selected with probability 1. Repeated rows are scored once each, null doc_ids
stay null, other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .hashed_text import DIMENSIONS, SAMPLE_BYTES, LinearScorer, proximal, sigmoid, training_sample
from .runtime import Rows, held_out, identified_texts, prepare, raw_rows

ROWS_PER_CLASS = 5000
#: A document is selected if it reaches the upper half of the grades with this probability.
SELECT_AT = 0.5
L1, STEPS = 4e-4, 200


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: tuple[float, ...]  # ascending, one less than grades
    grades: tuple[int, ...]  # ascending

    def reach(self, score: float) -> np.ndarray:
        """Probabilities of exceeding each grade but the last."""
        return sigmoid(score - np.array(self.thresholds))

    def expected(self, score: float) -> float:
        return float(self.grades[0] + (np.diff(self.grades) * self.reach(score)).sum()) if self.grades else 0.0

    def tail(self, score: float) -> float:
        """Probability of a grade in the upper half."""
        return float(self.reach(score)[(len(self.grades) - 1) // 2]) if self.thresholds else 1.0


def fit(sample, l1: float = L1, steps: int = STEPS) -> OrdinalModel:
    grades = tuple(sorted({grade for _, grade, _, _ in sample}))
    if len(grades) < 2:
        return OrdinalModel(np.zeros(DIMENSIONS), (), grades)
    level = np.searchsorted(grades, [grade for _, grade, _, _ in sample])
    weight = np.array([w for *_, w in sample])
    share = np.array([weight[level <= k].sum() for k in range(len(grades) - 1)]) / weight.sum()
    thresholds = np.log(share / (1 - share))

    def slope(scores: np.ndarray) -> np.ndarray:
        nonlocal thresholds
        padded = np.concatenate(([-np.inf], thresholds, [np.inf]))
        upper, lower = sigmoid(padded[level + 1] - scores), sigmoid(padded[level] - scores)
        mass = np.maximum(upper - lower, 1e-12)
        rise = np.bincount(level, weights=weight * upper * (1 - upper) / mass, minlength=len(grades))[:-1]
        fall = np.bincount(level, weights=weight * lower * (1 - lower) / mass, minlength=len(grades))[1:]
        thresholds = np.maximum.accumulate(thresholds + 2.0 * (rise - fall) / len(level) + 1e-9 * np.arange(len(thresholds)))
        return weight * (1 - upper - lower) / len(level)

    weights = proximal([f for _, _, f, _ in sample], weight, slope, l1, steps)
    return OrdinalModel(weights, tuple(thresholds.tolist()), grades)


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> OrdinalModel:
    return fit(training_sample(docs, labels, "quality", rows_per_class, shapes=True, sample_bytes=sample_bytes))


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("tail_probability", pa.float64())])


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, expected_grade and tail_probability of every document."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(OrdinalModel(model.weights.astype(np.float32), model.thresholds, model.grades))  # DIMENSIONS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linear, rows = LinearScorer(shared.value.weights, shapes=True), Rows(_SCHEMA)
        for doc_ids, raws in raw_rows(batches):
            for doc_id, raw in zip(doc_ids, raws):
                value = linear(raw)
                rows.add(doc_id, shared.value.expected(value), shared.value.tail(value))
            yield rows.batch()

    return identified_texts(docs).mapInArrow(run, "doc_id long, expected_grade double, tail_probability double")


def scorer(spark, model: OrdinalModel):
    """The tail probability as a column function of a text column, for filters that keep all columns."""
    shared = spark.sparkContext.broadcast(OrdinalModel(model.weights.astype(np.float32), model.thresholds, model.grades))

    @pandas_udf("double")
    def tail_probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        linear = LinearScorer(shared.value.weights, shapes=True)
        for texts in batches:
            yield pd.Series([shared.value.tail(linear((t or "").encode("utf-8", "replace"))) for t in texts], dtype="float64")

    return tail_probability


def selections(scored: DataFrame, at: float = SELECT_AT) -> DataFrame:
    return scored.select("doc_id", held_out().alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= at).alias("selected"))
