"""Language identification by rank-order profiles of letter n-grams.

A text is lower-cased and reduced to its letters, with one blank for every stretch of anything
else; its n-grams of one to three characters (none spans a blank) are ranked by count. The
distance to a language's profile is the sum over the document's PROFILE most frequent n-grams of
how far each is out of place; an n-gram that a profile lacks costs PROFILE. Ties in counts go to the
smaller code points, ties in distance to the smaller language name.

Profiles are learnt from a bounded sample (about ``rows_per_language`` documents of each language,
ROWS_PER_LANGUAGE by default, chosen by a hash of the id) of documents that aren't held out and have
a lang; predictions read whole texts, very long ones in pieces, and nothing else. Texts that are null or have no letter get
``und`` and score 0, as does everything if nothing could be learnt. Repeated rows are predicted once
each, null doc_ids stay null and aren't held out, an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Rows, held_out, identified_texts, prepare, raw_rows

PROFILE = 300
ROWS_PER_LANGUAGE = 2000
UNDETERMINED = "und"
_BLANK = 32
#: Characters counted at a time, which bounds the memory that a very long text takes.
PIECE = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def letters_of(raw: bytes) -> np.ndarray:
    """Code points of the lower-cased letters, blanks between words and at both ends; empty if there is no letter."""
    text = raw.decode("utf-8", "replace").lower()
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
    kept = _letters()[points]
    if not kept.any():
        return np.empty(0, dtype=np.int64)
    points = np.concatenate(([_BLANK], np.where(kept, points, _BLANK), [_BLANK]))
    blank = points == _BLANK
    return points[~(blank & np.concatenate(([False], blank[:-1])))]


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys)))


def ngrams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, 21 bits a character, and their counts."""
    found, counts = [], []
    for at in range(0, max(1, len(points) - 2), PIECE):
        p = points[at : at + PIECE + 2]
        last = at + PIECE + 2 >= len(points)
        own = len(p) if last else PIECE  # n-grams that start here
        blank = p == _BLANK
        ones = p[:own][~blank[:own]]
        two = (p[:-1] << 21 | p[1:])[:own]
        three = (p[:-2] << 42 | p[1:-1] << 21 | p[2:])[:own][~blank[1:-1][:own]]
        keys, n = _counted(np.concatenate((ones, two, three)))
        found.append(keys)
        counts.append(n)
    if len(found) == 1:
        return found[0], counts[0]
    keys, inverse = np.unique(np.concatenate(found), return_inverse=True)
    return keys, np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, by falling count, then by code points."""
    return keys[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.languages, self.size = sorted(profiles), size
        self.keys = np.unique(np.concatenate([np.array(profiles[x], dtype=np.int64) for x in self.languages])) if profiles else np.empty(0, dtype=np.int64)
        self.ranks = np.full((len(self.keys) + 1, len(self.languages)), -1, dtype=np.int64)  # the last row: in no profile
        for column, language in enumerate(self.languages):
            own = np.array(profiles[language], dtype=np.int64)
            self.ranks[np.searchsorted(self.keys, own), column] = np.arange(len(own))

    def predict(self, raw: bytes) -> tuple[str, float]:
        points = letters_of(raw)
        if not len(points) or not self.languages:
            return UNDETERMINED, 0.0
        top = ranked(*ngrams(points), self.size)
        place = np.searchsorted(self.keys, top)
        place[self.keys[np.minimum(place, len(self.keys) - 1)] != top] = len(self.keys)
        ranks = self.ranks[place]
        distance = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(top))[:, None])).sum(axis=0)
        best = int(distance.argmin())
        return self.languages[best], float(1 - distance[best] / (self.size * len(top)))


def learn(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, size: int = PROFILE) -> dict[str, list[int]]:
    """Profile of each language: its ``size`` most frequent n-grams in order (languages times ``size`` numbers in all)."""
    spark = prepare(docs.sparkSession)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.where(F.col("lang").isNotNull() & ~held_out())
    counts = known.groupBy("lang").count()
    share = counts.select("lang", F.least(F.lit(1.0), rows_per_language / F.col("count")).alias("share"))
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    sample = known.join(F.broadcast(share), "lang").where(rank < F.col("share"))  # one row a language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
        for batch in batches:
            own: dict[str, list] = defaultdict(list)
            for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("raw").to_pylist()):
                if len(points := letters_of(raw)):
                    own[lang].append(ngrams(points))
            for lang, parts in own.items():
                keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                n = np.bincount(inverse, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], schema=schema)

    raw = sample.select("lang", F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    totals = raw.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = totals.selectExpr("lang", "gram", "row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS place").where(F.col("place") <= size)
    profiles: dict[str, list[int]] = defaultdict(list)
    for row in sorted(top.collect(), key=lambda r: (r["lang"], r["place"])):
        profiles[row["lang"]].append(row["gram"])
    return dict(profiles)


def identify(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred and score (1: every n-gram in its place) of every document."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(profiles)  # languages times ``size`` numbers
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rows = Profiles(shared.value, size), Rows(schema)
        for doc_ids, raws in raw_rows(batches):
            for doc_id, raw in zip(doc_ids, raws):
                rows.add(doc_id, *known.predict(raw))
            yield rows.batch()

    return identified_texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def predictions(identified: DataFrame) -> DataFrame:
    return identified.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
