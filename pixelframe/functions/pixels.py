"""Pixel buffers: PNG, GIF and PPM codecs, geometry, compositing and error metrics, on numpy arrays (height, width, channels).

Undecodable content raises PixelError; the column functions built on these turn it into a failure
value, never into an exception of a plan.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
#: Channels by PNG colour type.
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Decoded bytes of one image that a task takes on.
MAXIMUM_DECODED = 1 << 29


class PixelError(ValueError):
    pass


def png_chunks(content: bytes):
    """(type, payload) of each chunk up to IEND; checksums aren't looked at."""
    at = len(PNG_MAGIC)
    while at + 12 <= len(content):
        (length,) = struct.unpack_from(">I", content, at)
        kind = content[at + 4 : at + 8]
        if at + 12 + length > len(content):
            break
        yield kind, content[at + 8 : at + 8 + length]
        at += 12 + length
        if kind == b"IEND":
            return
    raise PixelError("the chunks don't end with IEND")


def _unfilter(rows: np.ndarray, filters: np.ndarray, step: int) -> np.ndarray:
    out = np.zeros_like(rows)
    above = np.zeros(rows.shape[1], dtype=np.uint8)
    for y, kind in enumerate(filters.tolist()):
        line = rows[y]
        if kind == 0:
            done = line
        elif kind == 1:
            done = line.reshape(-1, step).cumsum(axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            done = line + above
        elif kind in (3, 4):
            left, corner = [0] * step, [0] * step
            values, ups = line.tolist(), above.tolist()
            done = [0] * len(values)
            for i, value in enumerate(values):
                a, b, c = left[i % step], ups[i], corner[i % step]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    p = a + b - c
                    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if da <= db and da <= dc else b if db <= dc else c
                done[i] = left[i % step] = (value + guess) & 255
                corner[i % step] = b
            done = np.array(done, dtype=np.uint8)
        else:
            raise PixelError("unknown filter")
        out[y] = above = done
    return out


#: Row and column a pass starts at, and its steps, of an interlaced PNG.
_PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


def _samples(flat: np.ndarray, width: int, height: int, channels: int, depth: int) -> np.ndarray:
    """Samples of filtered rows as they were written, 16-bit ones by their upper byte."""
    stride = (width * channels * depth + 7) // 8
    lines = flat.reshape(height, stride + 1)
    rows = _unfilter(lines[:, 1:], lines[:, 0], max(1, channels * depth // 8))
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        rows = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8)[:, : width * channels]
    return rows.reshape(height, width, channels)


def decode_png(content: bytes) -> np.ndarray:
    """PNG of any depth and interlacing to an 8-bit array of 1 to 4 channels."""
    if not content.startswith(PNG_MAGIC):
        raise PixelError("not a PNG")
    head = palette = transparency = None
    data = []
    for kind, payload in png_chunks(content):
        if kind == b"IHDR" and len(payload) == 13:
            head = struct.unpack(">IIBBBBB", payload)
        elif kind == b"PLTE" and len(payload) % 3 == 0:
            palette = np.frombuffer(payload, dtype=np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            transparency = payload
        elif kind == b"IDAT":
            data.append(payload)
    if head is None:
        raise PixelError("no header")
    width, height, depth, colour, _, _, interlace = head
    if colour not in _CHANNELS or depth not in (8, 16, *((1, 2, 4) if colour in (0, 3) else ())) or (colour, depth) == (3, 16) or interlace > 1 or not width or not height:
        raise PixelError("unsupported layout")
    channels = _CHANNELS[colour]
    parts = [(-(-(height - y) // dy), -(-(width - x) // dx), y, x, dy, dx) for y, x, dy, dx in (_PASSES if interlace else ((0, 0, 1, 1),)) if y < height and x < width]
    sizes = [h * ((w * channels * depth + 7) // 8 + 1) for h, w, *_ in parts]
    if sum(sizes) > MAXIMUM_DECODED:
        raise PixelError("too large")
    try:
        flat = zlib.decompressobj().decompress(b"".join(data), sum(sizes))
    except zlib.error as e:
        raise PixelError(str(e)) from e
    if len(flat) != sum(sizes):
        raise PixelError("short pixel data")
    whole, at = np.frombuffer(flat, dtype=np.uint8), 0
    pixels = np.zeros((height, width, channels), dtype=np.uint8)
    for (h, w, y, x, dy, dx), size in zip(parts, sizes):
        pixels[y::dy, x::dx] = _samples(whole[at : at + size], w, h, channels, depth)
        at += size
    if colour == 3:
        if palette is None or int(pixels.max()) >= len(palette):
            raise PixelError("bad palette")
        index = pixels[:, :, 0]
        pixels = palette[index]
        if transparency is not None:
            alpha = np.full(len(palette), 255, dtype=np.uint8)
            alpha[: len(transparency)] = np.frombuffer(transparency, dtype=np.uint8)[: len(palette)]
            pixels = np.concatenate((pixels, alpha[index][:, :, None]), axis=2)
    elif depth < 8:
        pixels = pixels * np.uint8(255 // ((1 << depth) - 1))
    return pixels


def chunk(kind: bytes, payload: bytes) -> bytes:
    return struct.pack(">I", len(payload)) + kind + payload + struct.pack(">I", zlib.crc32(kind + payload))


def encode_png(pixels: np.ndarray, extra: tuple[tuple[bytes, bytes], ...] = ()) -> bytes:
    """PNG of an array of 1 to 4 channels; ``extra`` chunks come before the pixel data."""
    height, width, channels = pixels.shape
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    lines = np.zeros((height, width * channels + 1), dtype=np.uint8)
    lines[:, 1:] = pixels.reshape(height, -1)
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return b"".join((PNG_MAGIC, chunk(b"IHDR", head), *(chunk(k, p) for k, p in extra), chunk(b"IDAT", zlib.compress(lines.tobytes(), 9)), chunk(b"IEND", b"")))


def decode_pnm(content: bytes) -> np.ndarray:
    """Binary PPM or PGM with a maximum of 255, comments in the header, and exactly the pixels it declares."""
    if content[:2] not in (b"P5", b"P6"):
        raise PixelError("not a binary PNM")
    fields, at = [], 2
    while len(fields) < 3:
        while at < len(content) and content[at : at + 1].isspace():
            at += 1
        if content[at : at + 1] == b"#":
            end = content.find(b"\n", at)
            at = len(content) if end < 0 else end + 1
            continue
        end = at
        while end < len(content) and content[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise PixelError("bad header")
        fields.append(int(content[at:end]))
        at = end
    width, height, most = fields
    channels = 3 if content[:2] == b"P6" else 1
    body = content[at + 1 :]
    if most != 255 or not width or not height or not content[at : at + 1].isspace() or len(body) != width * height * channels:
        raise PixelError("bad PNM")
    return np.frombuffer(body, dtype=np.uint8).reshape(height, width, channels)


def encode_pnm(pixels: np.ndarray) -> bytes:
    height, width, channels = pixels.shape
    if channels not in (1, 3):
        raise PixelError("PNM has 1 or 3 channels")
    return b"P%d\n%d %d\n255\n" % (6 if channels == 3 else 5, width, height) + np.ascontiguousarray(pixels, dtype=np.uint8).tobytes()


def decode_gif(content: bytes) -> np.ndarray:
    """The first frame of a GIF on its logical screen: RGB, or RGBA where pixels are transparent or outside the frame."""
    if content[:6] not in (b"GIF87a", b"GIF89a") or len(content) < 13:
        raise PixelError("not a GIF")
    width, height, flags = *struct.unpack_from("<HH", content, 6), content[10]
    if not width or not height or width * height * 4 > MAXIMUM_DECODED:
        raise PixelError("unsupported size")
    at, clear = 13, None

    def table(flags: int, at: int) -> tuple[np.ndarray | None, int]:
        if not flags & 0x80:
            return None, at
        size = 3 << (flags & 7) + 1
        if at + size > len(content):
            raise PixelError("short colour table")
        return np.frombuffer(content, dtype=np.uint8, count=size, offset=at).reshape(-1, 3), at + size

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(content) and content[at]:
            parts.append(content[at + 1 : at + 1 + content[at]])
            at += 1 + content[at]
        return b"".join(parts), at + 1

    shared, at = table(flags, at)
    while at < len(content):
        kind = content[at]
        if kind == 0x21 and at + 2 < len(content):
            body, end = blocks(at + 2)
            if content[at + 1] == 0xF9 and len(body) >= 4 and body[0] & 1:
                clear = body[3]
            at = end
        elif kind == 0x2C and at + 10 <= len(content):
            left, top, w, h, own = struct.unpack_from("<HHHHB", content, at + 1)
            colours, at = table(own, at + 10)
            colours = shared if colours is None else colours
            if colours is None or not w or not h or left + w > width or top + h > height or at >= len(content):
                raise PixelError("unsupported frame")
            coded, _ = blocks(at + 1)
            index = _lzw(coded, content[at], w * h).reshape(h, w)
            if own & 0x40:  # rows come in four passes
                order = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
                index = index[np.argsort(order, kind="stable")]
            if int(index.max()) >= len(colours):
                raise PixelError("bad colour")
            if clear is None and (w, h) == (width, height):
                return colours[index]
            out = np.zeros((height, width, 4), dtype=np.uint8)
            frame = np.concatenate((colours[index], np.where(index == (-1 if clear is None else clear), 0, 255).astype(np.uint8)[:, :, None]), axis=2)
            out[top : top + h, left : left + w] = frame
            return out
        else:
            break
    raise PixelError("no frame")


def _lzw(data: bytes, least: int, wanted: int) -> np.ndarray:
    if not 2 <= least <= 8:
        raise PixelError("bad code size")
    clear, end = 1 << least, (1 << least) + 1
    known = [bytes([i]) for i in range(clear)] + [b"", b""]
    out, size, previous, held, count, got = [], least + 1, b"", 0, 0, 0
    for byte in data:
        held |= byte << count
        count += 8
        while count >= size:
            code, held, count = held & ((1 << size) - 1), held >> size, count - size
            if code == clear:
                del known[end + 1 :]
                size, previous = least + 1, b""
                continue
            if code == end or got >= wanted:
                break
            if code < len(known):
                entry = known[code]
            elif code == len(known) and previous:
                entry = previous + previous[:1]
            else:
                raise PixelError("bad code")
            out.append(entry)
            got += len(entry)
            if previous and len(known) < 4096:
                known.append(previous + entry[:1])
                if len(known) == 1 << size and size < 12:
                    size += 1
            previous = entry
    flat = b"".join(out)[:wanted]
    if len(flat) != wanted:
        raise PixelError("short pixel data")
    return np.frombuffer(flat, dtype=np.uint8).astype(np.int64)


def decode(content: bytes) -> np.ndarray:
    if content.startswith(PNG_MAGIC):
        return decode_png(content)
    if content.startswith(b"\xff\xd8"):
        from . import jpeg

        return jpeg.decode(content)
    if content.startswith(b"GIF8"):
        return decode_gif(content)
    return decode_pnm(content)


def oriented(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """The image as meant to be seen under EXIF orientation 1 to 8; anything else counts as 1."""
    if orientation in (5, 6, 7, 8):
        pixels = pixels.transpose(1, 0, 2)
    if orientation in (2, 3, 6, 7):
        pixels = pixels[:, ::-1]
    if orientation in (3, 4, 7, 8):
        pixels = pixels[::-1]
    return np.ascontiguousarray(pixels)


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Area average: every output pixel is the mean of the input area it covers."""

    def weights(old: int, new: int) -> np.ndarray:
        edges = np.linspace(0, old, new + 1)
        low = np.maximum(edges[:-1, None], np.arange(old)[None])
        high = np.minimum(edges[1:, None], np.arange(1, old + 1)[None])
        part = np.maximum(0, high - low)
        return part / part.sum(axis=1, keepdims=True)

    turned = np.einsum("yh,hwc->ywc", weights(pixels.shape[0], height), pixels.astype(np.float64))
    out = np.einsum("xw,ywc->yxc", weights(pixels.shape[1], width), turned)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def thumbnail_limit(width: int, height: int, target_width: int, target_height: int, mode: str) -> int:
    """Longest side after decoding for a target; never enlarges."""
    ratios = target_width / width, target_height / height
    scale = min(1.0, min(ratios) if mode == "fit" else max(ratios))
    longest = max(width, height)
    return max(1, min(longest, math.floor(longest * scale)))


def rendered(pixels: np.ndarray, target_width: int, target_height: int, mode: str) -> np.ndarray:
    """Decode geometry: fit lies inside the target, fill is cropped to it around the centre."""
    height, width = pixels.shape[:2]
    limit = thumbnail_limit(width, height, target_width, target_height, mode)
    scale = limit / max(width, height)
    new = max(1, min(limit, math.floor(width * scale + 0.5))), max(1, min(limit, math.floor(height * scale + 0.5)))
    if mode == "fit":
        new = min(new[0], target_width), min(new[1], target_height)
    out = pixels if new == (width, height) else resized(pixels, *new)
    if mode == "fill":
        crop = min(target_width, out.shape[1]), min(target_height, out.shape[0])
        left, top = (out.shape[1] - crop[0]) // 2, (out.shape[0] - crop[1]) // 2
        out = out[top : top + crop[1], left : left + crop[0]]
    return np.ascontiguousarray(out)


def flattened(pixels: np.ndarray, background: tuple[int, int, int]) -> np.ndarray:
    """Straight alpha laid over an opaque background."""
    if pixels.shape[2] not in (2, 4):
        return pixels
    alpha = pixels[:, :, -1:].astype(np.int64)
    colour = pixels[:, :, :-1].astype(np.int64)
    if colour.shape[2] == 1:
        colour = np.repeat(colour, 3, axis=2)
    mixed = (colour * alpha + np.array(background, dtype=np.int64) * (255 - alpha) + 127) // 255
    return mixed.astype(np.uint8)


def as_rgb(pixels: np.ndarray) -> np.ndarray:
    """Packed 8-bit RGB, alpha laid over black."""
    flat = flattened(pixels, (0, 0, 0))
    return np.repeat(flat, 3, axis=2) if flat.shape[2] == 1 else flat


def pattern(width: int, height: int, cell: int = 8) -> np.ndarray:
    """The synthetic test image: a closed form of the coordinates."""
    y, x = np.mgrid[:height, :width].astype(np.int64)
    checker = np.where((x // cell + y // cell) % 2 == 0, 37, 211)
    red = (17 * x + 3 * y + checker) & 255
    green = (5 * x + 19 * y + checker // 2) & 255
    blue = (11 * x + 7 * y + 255 - checker) & 255
    return np.stack((red, green, blue), axis=2).astype(np.uint8)


#: Absolute errors up to which coverage is told.
COVERAGE = (8, 16, 32, 64)


def micro_psnr(squared_micro: float) -> int:
    """Micro-decibels of a mean squared error; 999 dB if there is none."""
    if squared_micro == 0:
        return 999_000_000
    return math.floor(1e6 * 10 * math.log10(255 * 255 / squared_micro) + 0.5)


def error_metrics(reference: bytes, candidate: bytes) -> dict[str, int]:
    """Integer error metrics of two buffers of equal, positive length."""
    if len(reference) != len(candidate) or not reference:
        raise PixelError("buffers differ in length or are empty")
    difference = np.abs(np.frombuffer(reference, dtype=np.uint8).astype(np.int64) - np.frombuffer(candidate, dtype=np.uint8))
    n, total, squared = len(difference), int(difference.sum()), int((difference * difference).sum())
    out = {
        "channel_count": n,
        "different_channel_count": int(np.count_nonzero(difference)),
        "maximum_absolute_error": int(difference.max()),
        "absolute_error_sum": total,
        "squared_error_sum": squared,
        "mean_absolute_error_micro": total * 1_000_000 // n,
        "mean_squared_error_micro": squared * 1_000_000 // n,
        "psnr_micro_db": micro_psnr(squared / n),
    }
    for most in COVERAGE:
        out[f"at_most_{most}_ppm"] = int(np.count_nonzero(difference <= most)) * 1_000_000 // n
    return out
