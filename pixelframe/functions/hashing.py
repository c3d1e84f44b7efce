"""SHA-256 that can be put down and taken up elsewhere: its state is bytes."""

from __future__ import annotations

import ctypes
from functools import lru_cache

#: Bytes of the state: eight words of hash, two of length, sixteen of a block not yet full, two numbers.
STATE_BYTES = 112


@lru_cache(maxsize=1)
def _library():
    """The library behind Python's own hashes; its state is a plain structure that holds no pointers."""
    import _hashlib

    found = ctypes.CDLL(_hashlib.__file__)
    found.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
    return found


def started() -> bytes:
    state = ctypes.create_string_buffer(STATE_BYTES)
    _library().SHA256_Init(state)
    return state.raw


def updated(state: bytes, data: bytes) -> bytes:
    held = ctypes.create_string_buffer(state, STATE_BYTES)
    _library().SHA256_Update(held, data, len(data))
    return held.raw


def finished(state: bytes) -> str:
    held, digest = ctypes.create_string_buffer(state, STATE_BYTES), ctypes.create_string_buffer(32)
    _library().SHA256_Final(digest, held)
    return digest.raw.hex()
