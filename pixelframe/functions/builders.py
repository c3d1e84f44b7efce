"""Encoded images and byte fields as Column expressions: JVM-side builders of synthetic containers, and big-endian reads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def big_endian(value, size: int) -> Column:
    """The lowest ``size`` bytes of a number, most significant first."""
    return F.unhex(F.lpad(F.right(F.hex(_column(value).cast("long")), F.lit(2 * size)), 2 * size, "0"))


def little_endian(value, size: int) -> Column:
    """The lowest ``size`` bytes of a number, least significant first. The value is named once, so that nested builders stay small plans."""
    digits = F.lpad(F.substring(F.hex(_column(value).cast("long")), -2 * size, 2 * size), 2 * size, "0")
    return F.unhex(F.regexp_replace(F.reverse(digits), "(.)(.)", "$2$1"))


def read_big_endian(content, at, size: int) -> Column:
    """The unsigned number in ``size`` bytes from the 0-based offset ``at``; null where they aren't all there."""
    part = F.substring(_column(content), (_column(at) + 1).cast("int"), F.lit(size))
    return F.when(F.octet_length(part) == size, F.conv(F.hex(part), 16, 10).cast("long"))


def has_prefix_at(content, at, prefix: bytes) -> Column:
    return F.substring(_column(content), (_column(at) + 1).cast("int"), F.lit(len(prefix))) == F.unhex(F.lit(prefix.hex()))


def filled(count, byte: str = "00") -> Column:
    """``count`` equal bytes."""
    return F.unhex(F.repeat(F.lit(byte), _column(count).cast("int")))


def exif_block(orientation) -> Column:
    """A TIFF block whose only field is the orientation."""
    return F.concat(F.unhex(F.lit("49492A0008000000010012010300" + "01000000")), little_endian(orientation, 2), F.unhex(F.lit("000000000000")))


def directory(count, *entries: Column, after=0) -> Column:
    """A directory of ``count`` little-endian entries, given in one or more columns, and the place of the next."""
    return F.concat(little_endian(count, 2), *entries, little_endian(after, 4))


def entry(tag, kind: int, count, value) -> Column:
    return F.concat(little_endian(tag, 2), little_endian(kind, 2), little_endian(count, 4), little_endian(value, 4))


def repeated(content: Column, times) -> Column:
    return F.unhex(F.repeat(F.hex(content), _column(times).cast("int")))


def tiff_block(*rest: Column) -> Column:
    """A little-endian block whose first directory follows its header."""
    return F.concat(F.unhex(F.lit("49492A0008000000")), *rest)


def png_chunk(kind: str, payload) -> Column:
    body = F.concat(F.lit(kind).cast("binary"), _column(payload))
    return F.concat(big_endian(F.octet_length(_column(payload)), 4), body, big_endian(F.crc32(body), 4))


def png_file(width, height, *chunks: Column) -> Column:
    """An 8-bit RGB picture's header, the given chunks and the end."""
    head = F.concat(big_endian(width, 4), big_endian(height, 4), F.unhex(F.lit("0802000000")))
    return F.concat(F.unhex(F.lit("89504E470D0A1A0A")), png_chunk("IHDR", head), *chunks, png_chunk("IEND", F.unhex(F.lit(""))))


def jpeg_segment(marker: str, payload) -> Column:
    return F.concat(F.unhex(F.lit("FF" + marker)), big_endian(F.octet_length(_column(payload)) + 2, 2), _column(payload))


def jpeg_frame(marker: str, width, height) -> Column:
    """The frame header of a grey picture."""
    return jpeg_segment(marker, F.concat(F.unhex(F.lit("08")), big_endian(height, 2), big_endian(width, 2), F.unhex(F.lit("01011100"))))


#: A scan of a grey picture: its header, and entropy-coded bytes with a stuffed FF and a restart marker.
SCAN_HEADER, SCAN_DATA = "FFDA0008010100000000", "A1B2FF00C3FFD0D4"


def jpeg_file(*segments: Column, scans=1, end: str = "FFD9") -> Column:
    return F.concat(F.unhex(F.lit("FFD8")), *segments, F.unhex(F.repeat(F.lit(SCAN_HEADER + SCAN_DATA), _column(scans).cast("int"))), F.unhex(F.lit(end)))


def gif_file(width, height, frames, comment) -> Column:
    """Frames without colour tables, and a comment of up to 255 bytes."""
    text = F.concat(F.unhex(F.lit("21FE")), big_endian(F.octet_length(_column(comment)), 1), _column(comment), F.unhex(F.lit("00")))
    frame = "2C" + "00" * 9 + "0202AABB00"
    return F.concat(F.lit("GIF89a").cast("binary"), little_endian(width, 2), little_endian(height, 2), F.unhex(F.lit("000000")), text, F.unhex(F.repeat(F.lit(frame), _column(frames).cast("int"))), F.unhex(F.lit("3B")))
