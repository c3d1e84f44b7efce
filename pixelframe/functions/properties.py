"""Size of the properties that an image's EXIF blocks and multi-picture index hold, and the pictures attached to it.

Both are directories of fields that point into one block. Fields may share bytes, so a small block can
stand for properties far larger than itself: a field's value is counted wherever it is named, never
copied. A directory that is reached twice, is cut off or points beyond its block can't be measured;
neither can a block that isn't one, or more than DIRECTORIES of them.
"""

from __future__ import annotations

from typing import NamedTuple

from . import containers

#: The size of what can't be measured: more than every limit.
UNMEASURABLE = 2**63 - 1
DIRECTORIES = 64

# Fixed values of the formats.
EXIF_TAG, MPF_TAG = b"Exif\0\0", b"MPF\0"
_WIDTHS = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
_SUB_IFDS, _EXIF_IFD, _GPS_IFD, _INTEROP_IFD = 0x014A, 0x8769, 0x8825, 0xA005
_PICTURES, _PICTURE_INDEX, _PICTURE_ENTRY = 0xB001, 0xB002, 16


class Unmeasurable(ValueError):
    pass


class Field(NamedTuple):
    directory: int
    tag: int
    kind: int
    count: int
    at: int
    length: int


class Properties(NamedTuple):
    size: int
    attachments: int


def fields(block: bytes, most: int = UNMEASURABLE) -> tuple[list[Field], int]:
    """The fields of all directories of a block, and the bytes they'd take if each held a value of its own.

    Ends as soon as that is more than ``most``. A field of an unknown type counts its entry alone, as
    readers must skip it.
    """
    order = {b"II*\0": "little", b"MM\0*": "big"}.get(block[:4])
    if order is None or len(block) < 8:
        raise Unmeasurable

    def number(at: int, size: int) -> int:
        if at + size > len(block):
            raise Unmeasurable
        return int.from_bytes(block[at : at + size], order)

    found, size, seen, waiting = [], 8, set(), [number(4, 4)]
    while waiting and size <= most:
        start = waiting.pop()
        if start < 8 or start in seen or len(seen) == DIRECTORIES:
            raise Unmeasurable
        seen.add(start)
        entries = number(start, 2)
        after = number(start + 2 + 12 * entries, 4)
        size += 6 + 12 * entries
        if after:
            waiting.append(after)
        for at in range(start + 2, start + 2 + 12 * entries, 12):
            tag, kind, count = number(at, 2), number(at + 2, 2), number(at + 4, 4)
            length = _WIDTHS.get(kind, 0) * count
            value = at + 8
            if length > 4:
                value = number(at + 8, 4)
                size += length
                if value + length > len(block):
                    raise Unmeasurable
            found.append(Field(start, tag, kind, count, value, length))
            if tag in (_SUB_IFDS, _EXIF_IFD, _GPS_IFD, _INTEROP_IFD) and kind in (4, 13):
                if len(seen) + len(waiting) + count > DIRECTORIES:
                    raise Unmeasurable
                waiting += [number(value + 4 * i, 4) for i in range(count)]
            if size > most:
                break
    return found, size


def pictures(block: bytes, most: int = UNMEASURABLE) -> tuple[int, int]:
    """The pictures that a multi-picture index lists, its own among them, and its size."""
    found, size = fields(block, most)
    if size > most:
        return 0, size
    order = "little" if block[:2] == b"II" else "big"
    counts = [int.from_bytes(block[f.at : f.at + 4], order) for f in found if f.tag == _PICTURES and (f.kind, f.count) == (4, 1)]
    indexes = [f.length for f in found if f.tag == _PICTURE_INDEX]
    if len(counts) != 1 or not counts[0] or indexes != [counts[0] * _PICTURE_ENTRY]:
        raise Unmeasurable
    return counts[0], size


def properties(content: bytes, most: int = UNMEASURABLE) -> Properties:
    """Of a whole container: the sizes of its EXIF blocks and indexes together (UNMEASURABLE if one can't be measured) and its pictures besides the first.

    Blocks are read until their size is more than ``most``; attachments are then those counted so far.
    """
    format = containers.sniff(content)
    size = attachments = 0
    for part in containers.parts(content):
        block = content[part.payload : part.payload + part.length]
        try:
            if format == "png" and part.kind == "eXIf":
                size += fields(block, most)[1]
            elif format == "jpeg" and part.kind == "E1" and block.startswith(EXIF_TAG):
                size += fields(block[len(EXIF_TAG) :], most)[1]
            elif format == "jpeg" and part.kind == "E2" and block.startswith(MPF_TAG):
                listed, bytes_ = pictures(block[len(MPF_TAG) :], most)
                size += bytes_
                attachments += max(0, listed - 1)
        except Unmeasurable:
            return Properties(UNMEASURABLE, attachments)
        if size > most:
            break
    return Properties(size, attachments)
