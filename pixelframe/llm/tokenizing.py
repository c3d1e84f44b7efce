"""Exact encoding of whole texts with a word-end BPE tokenizer file, one distinct word at a time.

The tokenizer files that this is for (KNOWN) drop white space and never let a token cross it, so the ids of a text are
the ids of its blank-separated words in order. With any other file whole texts go to the library. Distinct words are encoded by the tokenizers
library once per Python worker and remembered in a bounded memo. Plain words (lower-case Latin
letters in composed form, then ASCII marks) can't be changed by the normaliser nor cut otherwise
by the splitter, so their letters go straight to the library's BPE model; all others, and texts
that spell an added token, go through its whole chain.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache

import numpy as np

# The steps around the model that a file must have for words to be encoded on their own.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "decoder": None,
}
#: Entries of a worker's word memo; beyond it a new generation begins, and words of the one before move over as they come up.
MEMO_WORDS = 250_000
#: Longer words, in bytes, are encoded each time, so that entries stay small.
MEMO_WORD_BYTES = 256
#: ASCII capitals to lower case and ASCII white space to a blank: what the normaliser does too.
_FOLD = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_ADDED_MARK = b"<|"
#: Marks that may end a plain word.
_MARKS = b".,;:!?#$%&*|()-"


def _byte_characters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from 256 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in kept)
    return {b: b for b in kept} | {b: 256 + i for i, b in enumerate(others)}


_BYTE_CHARACTERS = _byte_characters()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache(maxsize=8)
def words_stand_alone(path: str) -> bool:
    """Whether a file's steps are such that words may be encoded on their own."""
    with open(path, encoding="utf-8") as f:
        steps = json.load(f)
    marked = all(t["content"].encode().startswith(_ADDED_MARK) and not t["normalized"] for t in steps["added_tokens"])
    return marked and all(steps[name] == value for name, value in KNOWN.items()) and steps["model"]["type"] == "BPE" and not steps["model"]["dropout"]


class _Memo(dict):
    """Ids by word; a word that isn't known yet is encoded when it is asked for."""

    def __init__(self, make):
        super().__init__({b"": b""})
        self.make = make

    def __missing__(self, word: bytes) -> bytes:
        ids = self.make(word)
        if len(word) <= MEMO_WORD_BYTES:
            self[word] = ids
        return ids


class WordEncoder:
    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        self.tokenizer = _tokenizer(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.by_word = words_stand_alone(path)
        self.memo_words, self.memo, self.older = memo_words, _Memo(self._word), {}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self._coded = [i.to_bytes(4, "little") for i in range(size)]
        self._tokens = [self.tokenizer.id_to_token(i) or "" for i in range(size)]

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def library_batch(self, texts: list[bytes]) -> list[bytes]:
        """Ids of UTF-8 texts by the library's whole chain."""
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def whole(self, raw: bytes) -> bool:
        """Whether a text must go to the library whole: it may spell an added token, or words can't be told apart."""
        return not self.by_word or _ADDED_MARK in raw

    def find(self):
        """The ids of a word, as a function; good for a few thousand texts, then ask again."""
        if len(self.memo) > self.memo_words:
            self.older, self.memo = self.memo, _Memo(self._word)
        return self.memo.__getitem__

    def _word(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is not None:
            return ids
        letters = word.rstrip(_MARKS)
        if len(letters) != len(word):
            # The letters of a plain word, then its marks, which are a word of their own.
            if letters and self._is_plain(letters):
                return self.memo[letters] + self.memo[word[len(letters) :]]
            return self._library(word.decode("utf-8", "replace"))
        if letters.isalpha():  # ASCII
            text = letters.decode()
        elif self._is_plain(letters):
            text = letters.decode("latin-1").translate(_BYTE_CHARACTERS)
        else:
            return self._library(word.decode("utf-8", "replace"))
        coded = self._coded
        return b"".join([coded[t.id] for t in self.tokenize(text)])

    @staticmethod
    def _is_plain(letters: bytes) -> bool:
        if letters.isalpha():
            return True
        if letters.isascii():
            return False
        text = letters.decode("utf-8", "replace")
        return text.isalpha() and max(text) < "\u0180" and text.islower() and unicodedata.is_normalized("NFC", text)

    @staticmethod
    def words(raw: bytes) -> list[bytes]:
        return raw.translate(_FOLD).split(b" ")

    def encode(self, raws: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out = []
        for at, raw in enumerate(raws):
            if at % 64 == 0:
                find = self.find()
            out.append(self._library(raw.decode("utf-8", "replace")) if self.whole(raw) else b"".join(map(find, self.words(raw))))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """As the library decodes; without a decoder that is token strings joined by blanks."""
        if not self.by_word:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        return " ".join(map(self._tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    """The encoder of this Python process."""
    return WordEncoder(path)


def with_end(ids: bytes, end_id: int) -> bytes:
    return ids + int(end_id).to_bytes(4, "little")


__all__ = ["WordEncoder", "default_path", "encoder", "with_end"]
