"""Walks over PNG, JPEG and GIF bytes that never decode pixels.

Each walk yields parts (kind, offset, payload offset, payload length) and ends in Corrupt if the
container breaks its own rules. What the parts mean for limits and colour is decided above them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

# Fixed values of the formats.
PNG_MAGIC, JPEG_MAGIC = b"\x89PNG\r\n\x1a\n", b"\xff\xd8"
GIF_MAGICS = (b"GIF87a", b"GIF89a")
ICC_TAG = b"ICC_PROFILE\0"
PNG_METADATA = ("iCCP", "eXIf", "iTXt", "tEXt", "zTXt")
_SOI, _EOI, _SOS, _TEM, _COM, _APP2 = 0xD8, 0xD9, 0xDA, 0x01, 0xFE, 0xE2
_RESTARTS = range(0xD0, 0xD8)


class Corrupt(ValueError):
    """Carries the stable failure name."""

    def __init__(self, failure: str = "unsupportedOrCorruptImage"):
        super().__init__(failure)
        self.failure = failure


class Part(NamedTuple):
    kind: str
    offset: int
    payload: int
    length: int


def sniff(content: bytes) -> str | None:
    if content.startswith(PNG_MAGIC):
        return "png"
    if content.startswith(JPEG_MAGIC):
        return "jpeg"
    return "gif" if content.startswith(GIF_MAGICS) else None


def png_parts(content: bytes) -> Iterator[Part]:
    at, size = len(PNG_MAGIC), len(content)
    while at + 8 <= size:
        length = int.from_bytes(content[at : at + 4], "big")
        kind = content[at + 4 : at + 8].decode("latin-1")
        end = at + 12 + length
        if end > size:
            raise Corrupt
        yield Part(kind, at, at + 8, length)
        if kind == "IEND":
            if end != size:
                raise Corrupt
            return
        at = end
    raise Corrupt


def _marker_after_scan(content: bytes, at: int) -> tuple[int, int]:
    """(marker, offset behind it) of the marker that ends entropy-coded data."""
    while (at := content.find(b"\xff", at)) >= 0:
        while at < len(content) and content[at] == 0xFF:
            at += 1
        if at == len(content):
            break
        value = content[at]
        at += 1
        if value and value not in _RESTARTS:
            return value, at
    raise Corrupt


def _marker_here(content: bytes, at: int) -> tuple[int, int]:
    start = at
    while at < len(content) and content[at] == 0xFF:
        at += 1
    if at == start or at == len(content) or not content[at]:
        raise Corrupt
    return content[at], at + 1


def jpeg_parts(content: bytes) -> Iterator[Part]:
    """Segments by two hexadecimal digits of their marker; D9 ends them. The part's offset is its marker code's."""
    at, in_scan = 2, False
    while at < len(content):
        marker, at = (_marker_after_scan if in_scan else _marker_here)(content, at)
        in_scan = False
        if marker == _EOI:
            if at != len(content):
                raise Corrupt
            yield Part("D9", at - 1, at, 0)
            return
        if marker == _SOI or marker in _RESTARTS:
            raise Corrupt
        if marker == _TEM:
            continue
        length = int.from_bytes(content[at : at + 2], "big") if at + 2 <= len(content) else 0
        if length < 2 or at + length > len(content):
            raise Corrupt
        yield Part(f"{marker:02X}", at - 1, at + 2, length - 2)
        at += length
        in_scan = marker == _SOS
    raise Corrupt


def gif_parts(content: bytes) -> Iterator[Part]:
    """Extensions (21), images (2C) and the trailer (3B); an extension's length is that of its data."""
    size = len(content)
    if size < 13:
        raise Corrupt

    def table(flags: int) -> int:
        return 3 << (flags & 7) + 1 if flags & 0x80 else 0

    def data(at: int) -> tuple[int, int]:
        total = 0
        while at < size:
            length = content[at]
            at += 1
            if not length:
                return at, total
            at, total = at + length, total + length
            if at > size:
                break
        raise Corrupt

    at = 13 + table(content[10])
    while at < size:
        kind, start = content[at], at
        at += 1
        if kind == 0x3B:
            if at != size:
                raise Corrupt
            yield Part("3B", start, at, 0)
            return
        if kind == 0x21 and at < size:
            end, total = data(at + 1)
            yield Part("21", start, at + 1, total)
            at = end
        elif kind == 0x2C and at + 9 <= size:
            body = at + 9 + table(content[at + 8]) + 1
            if body > size:
                raise Corrupt
            end, total = data(body)
            yield Part("2C", start, body, total)
            at = end
        else:
            raise Corrupt
    raise Corrupt


_WALKS = {"png": png_parts, "jpeg": jpeg_parts, "gif": gif_parts}


def parts(content: bytes) -> Iterator[Part]:
    found = sniff(content)
    if found is None:
        raise Corrupt("unsupportedFormat")
    yield from _WALKS[found](content)


def is_metadata(format: str, kind: str) -> bool:
    if format == "png":
        return kind in PNG_METADATA
    if format == "gif":
        return kind == "21"
    return "E0" <= kind <= "EF" or kind == f"{_COM:02X}"


class IccChunks:
    """Collects the profile chunks of APP2 segments."""

    def __init__(self, content: bytes):
        self.content, self.count, self.chunks = content, None, {}

    def take(self, part: Part) -> None:
        body = self.content[part.payload : part.payload + part.length]
        if not body.startswith(ICC_TAG):
            return
        header = body[len(ICC_TAG) :]
        if len(header) < 2:
            raise Corrupt
        number, count = header[0], header[1]
        if not 1 <= number <= count or number in self.chunks or self.count not in (None, count):
            raise Corrupt
        self.count, self.chunks[number] = count, header[2:]

    def profile(self, most: int) -> bytes | None:
        if self.count is None:
            return None
        if len(self.chunks) != self.count:
            raise Corrupt
        whole = b"".join(self.chunks[i] for i in sorted(self.chunks))
        if not whole or len(whole) > most:
            raise Corrupt("metadataLimitExceeded")
        return whole


class Inspection(NamedTuple):
    format: str
    metadata_bytes: int
    profile: str
    icc: bytes | None


def inspect(content: bytes, most_metadata: int) -> Inspection:
    """The whole container's format, metadata size and colour profile, or Corrupt at the first rule it breaks in byte order."""
    format = sniff(content)
    total, profile, icc = 0, "absent", IccChunks(content)
    for part in parts(content):
        if is_metadata(format, part.kind):
            total += part.length
            if total > most_metadata:
                raise Corrupt("metadataLimitExceeded")
        if format == "png" and part.kind == "iCCP":
            profile = "embeddedICC"
        elif format == "png" and part.kind == "sRGB" and profile == "absent":
            profile = "standardSRGB"
        elif format == "jpeg" and part.kind == "E2":
            icc.take(part)
    whole = icc.profile(most_metadata)
    return Inspection(format, total, "embeddedICC" if whole is not None else profile, whole)


def exif_orientation(content: bytes) -> int:
    """Orientation of the first EXIF block of a JPEG or PNG; 1 if there is none or it isn't 1 to 8."""
    format = sniff(content)
    for part in parts(content):
        body = content[part.payload : part.payload + part.length]
        if format == "jpeg" and part.kind == "E1" and body.startswith(b"Exif\0\0"):
            return _tiff_orientation(body[6:])
        if format == "png" and part.kind == "eXIf":
            return _tiff_orientation(body)
    return 1


def _tiff_orientation(block: bytes) -> int:
    order = {b"II": "little", b"MM": "big"}.get(block[:2])
    if order is None:
        return 1
    at = int.from_bytes(block[4:8], order)
    for entry in range(int.from_bytes(block[at : at + 2], order)):
        field = block[at + 2 + 12 * entry : at + 14 + 12 * entry]
        if int.from_bytes(field[:2], order) == 0x0112:
            value = int.from_bytes(field[8:10], order)
            return value if 1 <= value <= 8 else 1
    return 1


def dimensions(content: bytes) -> tuple[int, int, int] | None:
    """(width, height, frames) as the container declares them, before orientation."""
    format = sniff(content)
    size, frames = None, 0
    for part in parts(content):
        body = content[part.payload : part.payload + part.length]
        if format == "png" and part.kind == "IHDR" and len(body) >= 8:
            size, frames = (int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big")), 1
        elif format == "jpeg" and part.kind in _FRAMES and len(body) >= 5 and size is None:
            size, frames = (int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big")), 1
        elif format == "gif" and part.kind == "2C":
            frames += 1
            size = int.from_bytes(content[6:8], "little"), int.from_bytes(content[8:10], "little")
    return None if size is None or not frames else (*size, frames)


_FRAMES = tuple(f"{m:02X}" for m in range(0xC0, 0xD0) if m not in (0xC4, 0xC8, 0xCC))


class Scan(NamedTuple):
    scan: int
    entropy_start: int
    entropy_end: int
    marker: str
    marker_end: int
    segment_end: int
    next_start: int | None


def jpeg_scans(content: bytes) -> list[Scan]:
    """Boundaries of each scan's entropy-coded data, from consecutive parts."""
    if sniff(content) != "jpeg":
        raise Corrupt
    out: list[Scan] = []
    open_start: int | None = None
    number = 0
    for part in jpeg_parts(content):
        end = part.payload + part.length
        if open_start is not None:
            start = part.offset
            while start > open_start and content[start - 1] == 0xFF:
                start -= 1
            out.append(Scan(number, open_start, start, part.kind, part.offset + 1, end, None))
            open_start = None
        if part.kind in ("DA", "D9") and out and out[-1].next_start is None:
            out[-1] = out[-1]._replace(next_start=end)
        if part.kind == "DA":
            number, open_start = number + 1, end
    return out


def checkpoints(scan: Scan, total: int) -> list[tuple[int, list[str]]]:
    """Distinct prefix lengths worth decoding around the end of a scan, with their sorted labels."""
    labelled = (
        (scan.entropy_end, "entropy-end-before-marker"),
        (scan.marker_end, "terminating-marker-code-end"),
        (scan.segment_end, "immediate-following-segment-end"),
        (scan.next_start, "next-scan-entropy-start"),
    )
    offsets = sorted({o for o, _ in labelled if o is not None and 0 < o <= total})
    return [(offset, sorted(label for o, label in labelled if o == offset)) for offset in offsets]


def jpeg_structure(content: bytes) -> dict:
    """Frame header and quantisation tables up to the first scan."""
    import hashlib

    tables, found = hashlib.sha256(), None
    for part in jpeg_parts(content):
        body = content[part.payload : part.payload + part.length]
        if part.kind == "DB":
            tables.update(body)
        elif part.kind in ("C0", "C2"):
            found = {
                "frame_marker": part.kind,
                "sample_precision": body[0],
                "height": int.from_bytes(body[1:3], "big"),
                "width": int.from_bytes(body[3:5], "big"),
                "components": [{"identifier": c[0], "horizontal": c[1] >> 4, "vertical": c[1] & 15, "table": c[2]} for c in (body[6 + 3 * i : 9 + 3 * i] for i in range(body[5])) if len(c) == 3],
            }
        elif part.kind == "DA":
            break
    if found is None:
        raise Corrupt
    return found | {"quantization_sha256": tables.hexdigest()}
