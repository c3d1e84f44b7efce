"""Byte-level BPE by a rank file: the tokenizers library over Arrow batches, bytes spelled as characters.

The library's BPE works on characters, so each byte gets a character of its own and a text's bytes are spelled with these
inside the library. A rank file says which byte strings are tokens and which comes first; every split of a token into two
tokens becomes a merge, in the order of ranks, and a match that is a token is taken whole, so that the library merges
just what the ranks merge. Distinct matches of the pattern are given to the library's model once and remembered in a bounded memo; texts with
characters that Python's Unicode tables don't know, which the pattern may class otherwise in the library, go through its whole chain. Decoding looks up each id's characters, turns them back into bytes and joins these before they
are read as UTF-8: a token may hold part of a character.

Spans are told from the tokens' lengths: they cover the text's bytes without gaps, and a byte's place in the text tells
its character. A token with part of a character spans the whole character.

Null texts count as empty and give no ids. Very long texts are encoded in stretches cut where a letter is followed by a blank
and a letter, which no match of the pattern crosses. Repeated rows give the same ids, null doc_ids stay null, an empty
table gives no rows, other columns are ignored. Special tokens don't exist: their spelling is ordinary text.
"""

from __future__ import annotations

import base64
import codecs
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Rows, identified_texts, prepare, raw_rows
from .tokenizing import _Memo

#: Distinct matches of a worker's memo; beyond it a new generation begins, and matches of the one before move over as they come up.
MEMO_WORDS = 100_000
#: Bytes of a stretch of a longer text.
STRETCH_BYTES = 1 << 19
_CUT = re.compile(rb"[A-Za-z](?= [A-Za-z])")
_ENCODED = "doc_id long, n_tokens long, n_split long, ids array<int>"
_SPANS = ", byte_ends array<int>, char_starts array<int>, char_ends array<int>"
_INTS = pa.list_(pa.int32())


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def byte_characters() -> list[str]:
    """The character of each byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in shown else next(others)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file by id; ids must count from 0."""
    with open(path, "rb") as lines:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}
    if sorted(found) != list(range(len(found))) or len(set(found.values())) != len(found):
        raise ValueError(f"{path}: ranks must count from 0 without gaps, and tokens must differ")
    return [found[i] for i in range(len(found))]


class ByteCodec:
    """Encodes and decodes with the ranks of one file; one for each Python process."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the machine already
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        self.tokens = read_ranks(path)
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.spelling = byte_characters()
        self.byte_of = {c: b for b, c in enumerate(self.spelling)}
        spelled = ["".join(map(self.spelling.__getitem__, t)) for t in self.tokens]
        ids = {s: i for i, s in enumerate(spelled)}
        merges = [(s[:k], s[k:]) for s in spelled for k in range(1, len(s)) if s[:k] in ids and s[k:] in ids]
        self.library = Tokenizer(models.BPE(vocab=ids, merges=merges, ignore_merges=True))
        self.library.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ])
        self.tokenize = self.library.model.tokenize
        self.matches = regex.compile(pattern).findall
        self.standard = pattern == default_pattern()
        self.alphabet = dict(enumerate(self.spelling))
        self.whole = {t: i.to_bytes(4, "little") for i, t in enumerate(self.tokens)}
        self.memo, self.older, self.known = _Memo(self._match), {}, set()
        #: Each token's bytes, by way of the library's own spelling of it.
        self.bytes = [bytes(map(self.byte_of.__getitem__, self.library.id_to_token(i))) for i in range(len(self.tokens))]
        self.blob = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.places = np.cumsum(self.lengths) - self.lengths

    def stretches(self, raw: bytes) -> Iterator[bytes]:
        at = 0
        while self.standard and len(raw) - at > STRETCH_BYTES:
            cut = _CUT.search(raw, at + STRETCH_BYTES)
            if not cut:
                break
            yield raw[at : cut.end()]
            at = cut.end()
        yield raw[at:] if at else raw

    def _match(self, match: str) -> bytes:
        """Ids of one match; of bytes that are a token its own."""
        ids = self.older.get(match)
        if ids is None:
            raw = match.encode()
            ids = self.whole.get(raw) or b"".join([t.id.to_bytes(4, "little") for t in self.tokenize(raw.decode("latin-1").translate(self.alphabet))])
        return ids

    def _ordinary(self, text: str) -> bool:
        """Whether the pattern is the standard one and finds the same matches here as in the library."""
        if not self.standard:
            return False
        if not text.isascii() and not self.known.issuperset(own := set(text)):
            self.known |= {c for c in own if unicodedata.category(c) != "Cn"}
            return self.known.issuperset(own)
        return True

    def _ids(self, raw: bytes) -> bytes:
        text = raw.decode("utf-8", "replace")
        if self._ordinary(text):
            return b"".join(map(self.memo.__getitem__, self.matches(text)))
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<i4").tobytes()

    def encode(self, raws: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of each UTF-8 text, in order."""
        for raw in raws:
            parts = []
            for stretch in self.stretches(raw):
                if len(self.memo) > MEMO_WORDS:
                    self.older, self.memo = self.memo, _Memo(self._match)
                parts.append(self._ids(stretch))
            yield np.frombuffer(b"".join(parts), dtype="<i4")

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """The byte after each token."""
        return np.cumsum(self.lengths[ids])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all tokens in a row, as numbers."""
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.bytes):
            raise ValueError("an id is no token of the rank file")
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        return self.blob[np.repeat(self.places[ids] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]

    def pieces(self, ids) -> list[str]:
        """Each token's text; a character that several tokens share goes to the one that completes it, what never is one becomes U+FFFD."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        return [reader.decode(self.bytes[i], final=k == len(ids)) for k, i in enumerate(ids, 1)]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteCodec:
    return ByteCodec(path, pattern)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, spans: bool = False) -> DataFrame:
    """doc_id, n_tokens, n_split (tokens that end inside a character) and ids of every document.

    With ``spans`` also byte_ends, char_starts and char_ends: the places of every token in the text.
    """
    prepare(docs.sparkSession)
    path, pattern = path or default_path(), pattern or default_pattern()
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_split", pa.int64()), ("ids", _INTS)] + [(c, _INTS) for c in ("byte_ends", "char_starts", "char_ends") if spans]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = codec(path, pattern), Rows(schema)
        for doc_ids, raws in raw_rows(batches):
            raws = [raw.decode("utf-8", "replace").encode() for raw in raws]  # bytes that are no text become U+FFFD, as they do in the ids
            for doc_id, raw, ids in zip(doc_ids, raws, own.encode(raws)):
                ends = own.ends(ids)
                heads = (np.frombuffer(raw + b"\0", dtype=np.uint8) & 0xC0) != 0x80  # a character's first byte, and the end
                places = []
                if spans:
                    characters = np.cumsum(heads)
                    starts = np.concatenate([ends[:1] * 0, ends[:-1]])
                    places = [ends.astype(np.int32), (characters[starts] - 1).astype(np.int32), characters[ends - 1].astype(np.int32)]
                rows.add(doc_id, len(ids), int(len(ends) - heads[ends].sum()), ids, *places, size=4 * len(ids) * (1 + len(places)) + 64)
                if rows.full:
                    yield rows.batch()
        if rows:
            yield rows.batch()

    return identified_texts(docs).mapInArrow(run, _ENCODED + _SPANS * spans)


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None, pieces: bool = False) -> DataFrame:
    """``encoded`` with raw (the decoded bytes) and decoded (these as text, bytes that are no text as U+FFFD), with ``pieces`` also each token's text.

    Null ids give null. A null among the ids, or an id that the ranks don't have, raises an error.
    """
    path, pattern = path or default_path(), pattern or default_pattern()
    kept = [c for c in encoded.columns if c not in ("raw", "decoded", "pieces")]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name in kept) + ", raw binary" + ", pieces array<string>" * pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            sizes = np.diff(batch.column("ids").offsets.to_numpy())
            for part in parts(batch, np.cumsum(8 * sizes.astype(np.int64)) + 8 * np.arange(len(sizes))):
                ids = part.column("ids")
                values = ids.flatten()
                if values.null_count:
                    raise ValueError("an id is null")
                values = values.to_numpy()
                data = own.decode(values)
                counts = np.where(ids.is_valid(), ids.value_lengths().fill_null(0), 0)
                ends = np.concatenate([[0], np.cumsum(own.lengths[values])])[np.concatenate([[0], np.cumsum(counts)])] if len(values) else np.zeros(part.num_rows + 1, dtype=np.int64)
                raw = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
                raw = pc.if_else(ids.is_valid(), raw.cast(pa.binary()), pa.scalar(None, pa.binary()))
                columns = [*(part.column(c) for c in kept), raw]
                if pieces:
                    columns.append(pa.array([None if i is None else own.pieces(i) for i in ids.to_pylist()], pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "raw", *["pieces"] * pieces])

    return encoded.mapInArrow(run, ddl).withColumn("decoded", F.expr("make_valid_utf8(cast(raw AS string))"))


def parts(batch: pa.RecordBatch, ends: np.ndarray, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most`` bytes, given the bytes up to the end of each row; a row is never cut."""
    at = 0
    while at < batch.num_rows:
        begun = ends[at - 1] if at else 0
        until = max(at + 1, int(np.searchsorted(ends, begun + most)))
        yield batch.slice(at, until - at)
        at = until


def digest(decoded: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary")
    return decoded.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"), "n_split")
