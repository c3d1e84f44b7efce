"""Container walks, inspection rules and scan boundaries on hand-made bytes."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from pixelframe.contracts import DecodeLimits
from pixelframe.functions import containers as c
from pixelframe.functions import properties as held
from pixelframe.functions.pixels import chunk, encode_png, pattern
from pixelframe.operators.probe import probe_bytes


def segment(marker: int, payload: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(payload) + 2).to_bytes(2, "big") + payload


def jpeg(*parts: bytes) -> bytes:
    return b"\xff\xd8" + b"".join(parts) + b"\xff\xd9"


FRAME = segment(0xC2, b"\x08\x00\x0d\x00\x17\x01\x01\x11\x00")
SCAN = segment(0xDA, b"\x01") + b"\x11\xff\x00\x33\xff\xd0\x44"
GIF = b"GIF89a\x01\x00\x01\x00\x00\x00\x00" + b"\x2c\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x01\x00\x00" + b"\x3b"


def failure(content: bytes, most: int = 1 << 20) -> str | None:
    try:
        c.inspect(content, most)
    except c.Corrupt as e:
        return e.failure
    return None


def test_png_rules():
    good = encode_png(pattern(17, 9), ((b"sRGB", b"\0"), (b"tEXt", b"k\0" + b"x" * 126)))
    seen = c.inspect(good, 128)
    assert (seen.format, seen.metadata_bytes, seen.profile) == ("png", 128, "standardSRGB")
    assert failure(good, 127) == "metadataLimitExceeded"
    assert failure(good[:-1]) == failure(good + b"\0") == "unsupportedOrCorruptImage"
    spoiled = bytearray(good)
    spoiled[-1] ^= 1  # checksums aren't looked at
    assert failure(bytes(spoiled)) is None
    both = encode_png(pattern(3, 3), ((b"iCCP", b"p\0\0x"), (b"sRGB", b"\0")))
    assert c.inspect(both, 1000).profile == "embeddedICC"
    assert c.dimensions(good) == (17, 9, 1)


@pytest.mark.parametrize("content", [b"", b"BM", b"GIF88a"])
def test_unknown_formats(content):
    assert failure(content) == "unsupportedFormat"


def test_jpeg_rules():
    assert failure(jpeg(FRAME, SCAN)) is None
    assert failure(jpeg(FRAME, SCAN)[:-2]) == "unsupportedOrCorruptImage"
    assert failure(jpeg(FRAME, SCAN) + b"\0") == "unsupportedOrCorruptImage"
    assert failure(jpeg(b"\xff\xd8", FRAME)) == "unsupportedOrCorruptImage"
    assert failure(jpeg(b"\xff\xd1", FRAME)) == "unsupportedOrCorruptImage"
    assert failure(jpeg(b"\0", FRAME)) == "unsupportedOrCorruptImage"
    late = jpeg(FRAME, SCAN, segment(0xE3, b"A" * 128))
    assert c.inspect(late, 128).metadata_bytes == 128
    assert failure(late, 127) == "metadataLimitExceeded"
    assert c.dimensions(jpeg(FRAME, SCAN)) == (23, 13, 1)


def icc(number: int, count: int, data: bytes = b"ab") -> bytes:
    return segment(0xE2, c.ICC_TAG + bytes([number, count]) + data)


def test_icc_chunks():
    found = c.inspect(jpeg(icc(2, 2, b"cd"), icc(1, 2), FRAME, SCAN), 1000)
    assert (found.profile, found.icc) == ("embeddedICC", b"abcd")
    for wrong in ([icc(1, 2)], [icc(1, 1), icc(1, 1)], [icc(1, 2), icc(2, 3)], [icc(0, 1)], [icc(2, 1)], [icc(1, 0)]):
        assert failure(jpeg(*wrong, FRAME, SCAN)) == "unsupportedOrCorruptImage"
    assert failure(jpeg(icc(1, 1, b""), FRAME)) == "metadataLimitExceeded"


def test_gif_rules():
    assert failure(GIF) is None
    assert failure(GIF + b"\0") == failure(GIF[:-1]) == "unsupportedOrCorruptImage"
    two = GIF[:13] + b"\x21\xfe\x05hello\x00" + GIF[13:-1] * 2 + b"\x3b"
    assert c.inspect(two, 5).metadata_bytes == 5
    assert failure(two, 4) == "metadataLimitExceeded"
    assert c.dimensions(two)[2] == 2


def test_orientation():
    tiff = b"II*\0\x08\0\0\0\x01\0\x12\x01\x03\0\x01\0\0\0\x06\0\0\0\0\0\0\0"
    assert c.exif_orientation(jpeg(segment(0xE1, b"Exif\0\0" + tiff), FRAME, SCAN)) == 6
    assert c.exif_orientation(jpeg(segment(0xE1, b"Exif\0\0" + tiff.replace(b"\x06", b"\x09")), FRAME)) == 1
    assert c.exif_orientation(encode_png(pattern(2, 2), ((b"eXIf", tiff),))) == 6


def test_scan_boundaries_and_checkpoints():
    table = segment(0xC4, b"xx")
    content = jpeg(FRAME, SCAN, table, SCAN)
    first, second = c.jpeg_scans(content)
    at = content.index(SCAN)
    assert first.entropy_start == at + 5 and first.entropy_end == at + len(SCAN)
    assert (first.marker, first.marker_end, first.segment_end) == ("C4", first.entropy_end + 2, first.entropy_end + len(table))
    assert first.next_start == second.entropy_start
    assert (second.marker, second.segment_end, second.next_start) == ("D9", len(content), len(content))
    points = c.checkpoints(second, len(content))
    assert [o for o, _ in points] == [second.entropy_end, len(content)]
    assert points[1][1] == ["immediate-following-segment-end", "next-scan-entropy-start", "terminating-marker-code-end"]
    assert [o for o, _ in c.checkpoints(first, len(content))] == [first.entropy_end, first.marker_end, first.segment_end, first.next_start]


def test_structure():
    found = c.jpeg_structure(jpeg(segment(0xDB, b"q" * 65), FRAME, SCAN))
    assert (found["frame_marker"], found["width"], found["height"], len(found["components"])) == ("C2", 23, 13, 1)
    with pytest.raises(c.Corrupt):
        c.jpeg_structure(jpeg(SCAN))


def test_chunk_helper_has_checksum():
    assert chunk(b"IEND", b"").hex() == "0000000049454e44ae426082"


def tiff(*directories: bytes, order: str = "little") -> bytes:
    return (b"II*\0" if order == "little" else b"MM\0*") + (8).to_bytes(4, order) + b"".join(directories)


def directory(*entries: tuple[int, int, int, int], after: int = 0, order: str = "little") -> bytes:
    body = b"".join(t.to_bytes(2, order) + k.to_bytes(2, order) + n.to_bytes(4, order) + v.to_bytes(4, order) for t, k, n, v in entries)
    return len(entries).to_bytes(2, order) + body + after.to_bytes(4, order)


@pytest.mark.parametrize("order", ["little", "big"])
def test_fields_that_share_bytes_count_each_time(order):
    block = tiff(directory(*[(0x9286, 7, 100, 8 + 6 + 36)] * 3, order=order), b"x" * 100, order=order)
    found, size = held.fields(block)
    assert [f.length for f in found] == [100] * 3 and size == 8 + 6 + 36 + 300 > len(block)
    assert held.properties(encode_png(pattern(2, 2), ((b"eXIf", block),))) == (size, 0)
    both = jpeg(segment(0xE1, b"Exif\0\0" + block), segment(0xE1, b"Exif\0\0" + block), FRAME)
    assert held.properties(both) == (2 * size, 0)
    bomb = tiff(directory(*[(0x9286, 7, 60_000, 8 + 6 + 12 * 5_000)] * 5_000, order=order), b"x" * 60_000, order=order)
    assert held.fields(bomb)[1] == 8 + 6 + 12 * 5_000 + 5_000 * 60_000
    assert len(held.fields(bomb, 1 << 20)[0]) < 20


def test_directories_are_followed_once():
    inner = directory((1, 3, 1, 7))
    assert held.fields(tiff(directory((0x8769, 4, 1, 26)), inner))[1] == 8 + 18 + 18
    assert held.fields(tiff(directory((1, 3, 1, 7), after=26), inner))[1] == 8 + 18 + 18
    two = directory((0x014A, 4, 2, 26)), (34).to_bytes(4, "little") + (52).to_bytes(4, "little"), inner, inner
    assert held.fields(tiff(*two))[1] == 8 + 18 + 8 + 18 + 18
    assert held.fields(tiff(directory((1, 99, 1 << 30, 7))))[1] == 26  # an unknown type is skipped
    assert held.fields(tiff(directory()))[1] == 14


@pytest.mark.parametrize(
    "block",
    [
        b"",
        b"II*\0",
        b"XX*\0" + bytes(30),
        tiff(),
        tiff(directory((1, 3, 1, 7)))[:-1],
        tiff(directory((1, 3, 1, 7), after=8)),
        tiff(directory((1, 3, 1, 7), after=4)),
        tiff(directory((1, 3, 1, 7), after=999)),
        tiff(directory((0x8769, 4, 1, 8))),
        tiff(directory((0x8769, 4, 1, 26), (0x8825, 4, 1, 26)), directory()),
        tiff(directory((1, 2, 5, 22))),
        tiff(directory((0x014A, 4, 1 << 29, 8))),
        tiff(*(directory(after=8 + 6 * (i + 1)) for i in range(held.DIRECTORIES)), directory()),
    ],
)
def test_what_cannot_be_measured_fails_closed(block):
    with pytest.raises(held.Unmeasurable):
        held.fields(block)
    image = jpeg(segment(0xE1, b"Exif\0\0" + block), FRAME)
    assert held.properties(image).size == held.UNMEASURABLE
    assert probe_bytes(image, DecodeLimits())["container_failure"] == "metadataLimitExceeded"


def test_attachments_come_from_the_index():
    def index(listed: int, stored: int) -> bytes:
        return jpeg(segment(0xE2, b"MPF\0" + tiff(directory((0xB001, 4, 1, listed), (0xB002, 7, 16 * stored, 38)), bytes(16 * stored))), FRAME)

    assert held.properties(index(1, 1)) == (8 + 6 + 24 + 16, 0)
    assert held.properties(index(4, 4)) == (8 + 6 + 24 + 64, 3)
    for listed, stored in ((3, 4), (4, 3), (0, 1)):
        assert held.properties(index(listed, stored)).size == held.UNMEASURABLE
    assert held.properties(jpeg(segment(0xE2, b"MPF\0" + tiff(directory((1, 3, 1, 7)))), FRAME)).size == held.UNMEASURABLE
    assert probe_bytes(index(4, 4), DecodeLimits())["container_failure"] == "auxiliaryAttachmentLimitExceeded"
    seen = probe_bytes(index(4, 4), DecodeLimits(attachments=3))
    assert (seen["container_failure"], seen["attachment_count"], seen["metadata_byte_count"]) == (None, 3, 106)
    assert held.properties(GIF) == held.properties(jpeg(FRAME)) == (0, 0)


@given(st.binary(max_size=200), st.booleans())
def test_any_block_is_measured_or_refused(body, little):
    block = (b"II*\0\x08\0\0\0" if little else b"MM\0*\0\0\0\x08") + body
    try:
        found, size = held.fields(block)
    except held.Unmeasurable:
        return
    directories = {f.directory for f in found}
    assert size >= 8 + 12 * len(found) + 6 * len(directories) + sum(f.length for f in found if f.length > 4)
    assert all(f.at + f.length <= len(block) for f in found)
