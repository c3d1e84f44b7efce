"""License scan: exact phrases, and short notices with a few edits.

A text is lower-cased (ASCII letters only) and read as words: runs of digits, letters and
non-ASCII characters. Base labels need a phrase's words to stand consecutively. Fuzzy notices
allow ``edits`` character edits in the blank-joined words: by the pigeonhole principle one of
``edits + 1`` pieces of a notice must occur exactly, so an automaton over all pieces finds the
places worth a look, and the regex library's bounded-error matching verifies the edits there and
gives the span. What tells one license from another in a notice (``fixed``) takes no edits and, where it is a word, must be one. Each seed is looked at in a window of its own, so the work grows with the seeds and
not with how they crowd. Of overlapping matches of a notice the one with the fewest edits, then the
first, is reported; what it leaves free of a window is searched again, so every match overlaps a
reported span.

Null texts count as empty: no words, no labels, score 0. Repeated rows are scanned once each, null
doc_ids stay null, other columns are ignored, an empty table gives no rows. Very long texts are
scanned whole, in time that grows with their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import Rows, identified_texts, prepare, raw_rows

# The phrases of the base scan with their labels.
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    edits: int
    fixed: tuple[str, ...] = ()

    def parts(self) -> list[tuple[int, int, bool]]:
        """(begin, end, whether fixed) of the notice's parts in order."""
        out, at = [], 0
        for part in self.fixed:
            begin = self.text.index(part, at)
            out += [(at, begin, False)] * (begin > at) + [(begin, begin + len(part), True)]
            at = begin + len(part)
        return out + [(at, len(self.text), False)] * (at < len(self.text))

    def pattern(self) -> str:
        """Fixed parts as they are, with blanks or an end beside them where the notice has such; the others with bounded edits."""
        out = []
        for begin, end, fixed in self.parts():
            plain = self.text[begin:end].replace(" ", "[ ]")  # notices hold nothing else that a pattern reads otherwise
            before, after = begin == 0 or self.text[begin - 1] == " ", end == len(self.text) or self.text[end] == " "
            out.append(f"{'(?<![^ ])' * before}{plain}{'(?![^ ])' * after}" if fixed else f"(?:{plain}){{e<={self.edits}}}")
        return "(?b)" + "".join(out)


#: Short notices of the fuzzy scan, in normalised words.
NOTICES = (
    Notice("under the mit license", "mit", 2, ("mit",)),
    Notice("permission is hereby granted free of charge", "mit", 4),
    Notice("apache license version 2", "apache-2", 2, ("2",)),
    Notice("licensed under cc by nc", "cc-by-nc", 2, ("nc",)),
    Notice("creative commons attribution noncommercial", "cc-by-nc", 4, ("non",)),
    Notice("gnu general public license", "gpl", 3, ("gnu",)),
    Notice("gnu lesser general public license", "lgpl", 3, ("lesser",)),
    Notice("mozilla public license", "mpl", 2),
    Notice("redistribution and use in source and binary forms", "bsd", 4),
    Notice("all rights reserved", "all-rights-reserved", 2),
)

#: ASCII capitals to lower case; ASCII that is neither a digit nor a letter to a blank.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

#: Window texts that a scanner remembers, with the match in each.
REMEMBERED = 50_000

_SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("text", pa.string())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("base_starts", pa.list_(pa.int64())), ("base_labels", pa.list_(pa.string())), ("spans", pa.list_(_SPAN))])
_DDL = "doc_id long, n_words long, base_starts array<long>, base_labels array<string>, spans array<struct<label: string, start: long, end: long, edits: int, text: string>>"


def pieces(text: str, count: int) -> list[tuple[int, str]]:
    """``count`` pieces of a notice of nearly equal length, each with its place."""
    cuts = [i * len(text) // count for i in range(count + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    def __init__(self, notices=NOTICES, phrases=BASE_PHRASES):
        import ahocorasick
        import regex

        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in phrases]
        self.notices = notices
        self.patterns = [regex.compile(n.pattern()) for n in notices]
        self.seen: dict[tuple[int, str, bool, bool], tuple[int, int, int] | None] = {}
        seeds: dict[str, list[tuple[int, int, int]]] = {}
        for number, notice in enumerate(notices):
            for place, piece in pieces(notice.text, notice.edits + 1):
                before, after = place + notice.edits, len(notice.text) - place + notice.edits
                seeds.setdefault(piece, []).append((number, before, after))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def base(self, joined: bytes) -> tuple[list[int], set[str]]:
        """Word places of all phrases in ``joined``, the blank-joined words with a blank at both ends."""
        starts, labels = [], set()
        for phrase, label in self.phrases:
            at, last, words = joined.find(phrase), 0, 0
            while at >= 0:
                words, last = words + joined.count(b" ", last, at), at
                starts.append(words)
                labels.add(label)
                at = joined.find(phrase, at + 1)
        return starts, labels

    def fuzzy(self, text: str) -> list[tuple[str, int, int, int, str]]:
        """(label, start, end, edits, matched text) of every notice in the blank-joined words."""
        windows: dict[int, set[tuple[int, int]]] = {}
        for last, (length, uses) in self.automaton.iter(text):
            begin = last + 1 - length
            for number, before, after in uses:
                windows.setdefault(number, set()).add((max(0, begin - before), min(len(text), begin + after)))
        return [(self.notices[number].label, start, end, edits, text[start:end]) for number, own in sorted(windows.items()) for start, end, edits in self._spans(number, text, own)]

    def _best(self, number: int, text: str, low: int, high: int) -> tuple[int, int, int, int, int] | None:
        """(edits, start, end, low, high) of the best match in a window."""
        window = text[low:high]
        key = number, window, low == 0 or text[low - 1] == " ", high == len(text) or text[high] == " "
        if key not in self.seen:
            if len(self.seen) >= REMEMBERED:
                self.seen = {}
            self.seen[key] = self._search(*key)
        found = self.seen[key]
        return found and (found[0], low + found[1], low + found[2], low, high)

    def _search(self, number: int, window: str, open_left: bool, open_right: bool) -> tuple[int, int, int] | None:
        """(edits, start, end) in a window, given whether it lies between blanks."""
        notice = self.notices[number]
        padded, last = (" " if open_left else "x") + window, len(window) + 1
        while match := self.patterns[number].search(padded, 1, last):
            after = open_right if last == len(padded) else padded[last] == " "
            if match.end() < last or after or not notice.fixed or not notice.text.endswith(notice.fixed[-1]):
                edits = sum(match.fuzzy_counts)
                return (edits, match.start() - 1, match.end() - 1) if edits <= notice.edits else None
            last -= 1  # a fixed word at the end that isn't a whole one here
        return None

    def _spans(self, number: int, text: str, windows: set[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """Spans (start, end, edits) in ascending order; none overlap."""
        notice = self.notices[number]
        shortest, longest = len(notice.text) - notice.edits, len(notice.text) + notice.edits
        waiting = [found for low, high in windows if (found := self._best(number, text, low, high))]
        heapify(waiting)
        cells: dict[int, list[tuple[int, int, int]]] = {}  # spans by start // longest
        while waiting:
            edits, start, end, low, high = heappop(waiting)
            near = [s for cell in range(low // longest - 1, high // longest + 1) for s in cells.get(cell, ()) if s[0] < high and s[1] > low]
            if not any(s[0] < end and s[1] > start for s in near):
                cells.setdefault(start // longest, []).append((start, end, edits))
                continue
            edges = [low, *(edge for s in sorted(near) for edge in s[:2]), high]
            for a, b in zip(edges[::2], edges[1::2]):  # what the spans leave free
                if b - a >= shortest and (found := self._best(number, text, a, b)):
                    heappush(waiting, found)
        return sorted(s for cell in cells.values() for s in cell)


_scanners: dict[tuple, Scanner] = {}


def scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """doc_id, n_words, base_starts (word places), base_labels and spans (fuzzy matches in the blank-joined words)."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanners.setdefault(notices, None) or Scanner(notices)
        _scanners[notices] = scanner
        rows = Rows(_SCHEMA)
        for doc_ids, raws in raw_rows(batches):
            for doc_id, raw in zip(doc_ids, raws):
                words = raw.translate(_WORDS).split()
                joined = b" ".join(words)
                starts, labels = scanner.base(b" " + joined + b" ")
                spans = [dict(zip(("label", "start", "end", "edits", "text"), s)) for s in scanner.fuzzy(joined.decode("utf-8", "replace"))]
                rows.add(doc_id, len(words), starts, sorted(labels), spans, size=64 + 8 * len(starts) + 160 * len(spans))
                if rows.full:
                    yield rows.batch()
        if rows:
            yield rows.batch()

    return identified_texts(docs).mapInArrow(run, _DDL)


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and joined labels; the score is 1 for an exact phrase, else the share of the best fuzzy match that is unedited."""
    return scanned.selectExpr(
        "doc_id",
        "n_words",
        "cast(size(base_starts) as long) AS n_base",
        "array_min(base_starts) AS first_word",
        "array_max(base_starts) AS last_word",
        "array_join(base_labels, ',') AS base_labels",
        "array_join(array_sort(array_union(base_labels, transform(spans, s -> s.label))), ',') AS labels",
        "CASE WHEN size(base_starts) > 0 THEN 1D ELSE coalesce(array_max(transform(spans, s -> greatest(0D, 1D - s.edits / cast(length(s.text) as double)))), 0D) END AS score",
        "cast(size(spans) as long) AS n_fuzzy",
    )
