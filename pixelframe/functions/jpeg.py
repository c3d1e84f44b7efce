"""A JPEG codec on numpy arrays: baseline and progressive Huffman coding of 8-bit samples.

Decoding goes as far as the bytes do: a prefix of a progressive file gives the picture of the scans, or parts of
scans, that it holds. Encoding builds its Huffman tables from the picture.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np

from .pixels import MAXIMUM_DECODED, PixelError

_SOF = {0xC0: False, 0xC1: False, 0xC2: True}


def zigzag() -> list[int]:
    """Natural place (row times 8 plus column) of each coefficient in coding order: diagonals, by turns up and down."""
    cells = [(y, x) for y in range(8) for x in range(8)]
    return [8 * y + x for y, x in sorted(cells, key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))]


_NATURAL = zigzag()
_COSINES = np.array([[(math.sqrt(0.125) if u == 0 else 0.5) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)])


class _Ended(Exception):
    """The bytes of a scan are used up."""


class _Bits:
    """Bits of one stretch between restart markers; a few zeros may follow the end, as the last code may be padded."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.count, self.spent = data, 0, 0, 0, 0

    def fill(self) -> None:
        while self.count < 25:
            if self.at < len(self.data):
                self.held = (self.held << 8 | self.data[self.at]) & 0xFFFFFFFFFF
                self.at += 1
            else:
                self.held = self.held << 8 & 0xFFFFFFFFFF
                self.spent += 8
            self.count += 8

    def take(self, n: int) -> int:
        if not n:
            return 0
        if self.count < n:
            self.fill()
        self.count -= n
        if self.count < self.spent:
            raise _Ended
        return self.held >> self.count & ((1 << n) - 1)

    def symbol(self, table: tuple[int, list[int]]) -> int:
        if self.count < 16:
            self.fill()
        longest, entries = table
        entry = entries[self.held >> (self.count - longest) & (1 << longest) - 1]
        if not entry:
            raise PixelError("unknown code")
        self.count -= entry >> 8
        if self.count < self.spent:
            raise _Ended
        return entry & 255

    def value(self, size: int) -> int:
        """A signed number of ``size`` bits."""
        raw = self.take(size)
        return raw if not size or raw >> (size - 1) else raw - (1 << size) + 1


@lru_cache(maxsize=16)
def _lookup(counts: bytes, symbols: bytes) -> tuple[int, list[int]]:
    """The longest code's length, and for each so many bits ahead: the code's length times 256 plus its symbol."""
    longest = max((n for n in range(1, 17) if counts[n - 1]), default=1)
    table, code, k = [0] * (1 << longest), 0, 0
    for length in range(1, longest + 1):
        for _ in range(counts[length - 1]):
            if k >= len(symbols) or code >= 1 << length:
                raise PixelError("bad code table")
            table[code << (longest - length) : (code + 1) << (longest - length)] = [length << 8 | symbols[k]] * (1 << (longest - length))
            code, k = code + 1, k + 1
        code <<= 1
    return longest, table


class _Component:
    def __init__(self, identifier: int, horizontal: int, vertical: int, table: int):
        self.identifier, self.horizontal, self.vertical, self.table = identifier, horizontal, vertical, table

    def size(self, width: int, height: int, most_h: int, most_v: int) -> None:
        self.wide = -(-width * self.horizontal // (most_h * 8))  # blocks that hold samples
        self.high = -(-height * self.vertical // (most_v * 8))
        self.stride = -(-width // (most_h * 8)) * self.horizontal  # blocks in whole units
        self.rows = -(-height // (most_v * 8)) * self.vertical
        self.blocks = [0] * (64 * self.stride * self.rows)
        self.previous = 0


class Decoder:
    """``complete``: the end marker was met and every scan was whole; ``scans``: scans that were begun."""

    def __init__(self, content: bytes):
        self.content, self.quantisers, self.codes = content, {}, {}
        self.components: list[_Component] = []
        self.interval = self.scans = self.width = self.height = 0
        self.progressive = self.complete = False
        self.transform: int | None = None
        self._walk()

    def _walk(self) -> None:
        data, at = self.content, 2
        if data[:2] != b"\xff\xd8":
            raise PixelError("not a JPEG")
        whole = True
        while at + 1 < len(data):
            if data[at] != 0xFF:
                raise PixelError("no marker")
            marker, at = data[at + 1], at + 1
            if marker == 0xFF:
                continue
            at += 1
            if marker == 0xD9:
                self.complete = whole
                return
            length = int.from_bytes(data[at : at + 2], "big")
            body = data[at + 2 : at + length]
            if at + length > len(data) or length < 2:
                return
            at += length
            if marker == 0xDB:
                self._quantisers(body)
            elif marker == 0xC4:
                self._codes(body)
            elif marker in _SOF:
                self._frame(body, _SOF[marker])
            elif marker == 0xDD:
                self.interval = int.from_bytes(body[:2], "big")
            elif marker == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
                self.transform = body[11]
            elif marker in (0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                raise PixelError("unsupported coding")
            elif marker == 0xDA:
                parts, at = self._stretches(at)
                whole &= self._scan(body, parts)

    def _stretches(self, at: int) -> tuple[list[bytes], int]:
        """The entropy-coded bytes up to the next marker, between restarts, without stuffing."""
        data, start, parts = self.content, at, []
        while True:
            at = data.find(b"\xff", at)
            if at < 0 or at + 1 >= len(data):
                return [*parts, data[start : len(data) if at < 0 else at].replace(b"\xff\0", b"\xff")], len(data)
            if data[at + 1] == 0:
                at += 2
            elif 0xD0 <= data[at + 1] <= 0xD7:
                parts.append(data[start:at].replace(b"\xff\0", b"\xff"))
                start = at = at + 2
            else:
                return [*parts, data[start:at].replace(b"\xff\0", b"\xff")], at

    def _quantisers(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            size = 2 if body[at] >> 4 else 1
            self.quantisers[body[at] & 15] = np.frombuffer(body, dtype=f">u{size}", count=64, offset=at + 1).astype(np.int64) if at + 1 + 64 * size <= len(body) else None
            at += 1 + 64 * size

    def _codes(self, body: bytes) -> None:
        at = 0
        while at + 17 <= len(body):
            counts = body[at + 1 : at + 17]
            n = sum(counts)
            self.codes[body[at]] = _lookup(counts, body[at + 17 : at + 17 + n])
            at += 17 + n

    def _frame(self, body: bytes, progressive: bool) -> None:
        if self.components or len(body) < 6 or body[0] != 8:
            raise PixelError("unsupported frame")
        self.progressive = progressive
        self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        n = body[5]
        if n not in (1, 3, 4) or len(body) < 6 + 3 * n or not self.width or not self.height or self.width * self.height * n * 8 > MAXIMUM_DECODED:
            raise PixelError("unsupported frame")
        made = [_Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        if any(not 1 <= c.horizontal <= 4 or not 1 <= c.vertical <= 4 for c in made):
            raise PixelError("bad sampling")
        most = max(c.horizontal for c in made), max(c.vertical for c in made)
        for c in made:
            c.size(self.width, self.height, *most)
        self.components, self.most = made, most

    def _scan(self, body: bytes, parts: list[bytes]) -> bool:
        n = body[0] if body else 0
        if not self.components or len(body) < 4 + 2 * n or not n:
            raise PixelError("bad scan")
        chosen = []
        for i in range(n):
            found = [c for c in self.components if c.identifier == body[1 + 2 * i]]
            if not found:
                raise PixelError("unknown component")
            chosen.append((found[0], body[2 + 2 * i] >> 4, 16 | body[2 + 2 * i] & 15))
        first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        if not self.progressive:
            first, last, high, low = 0, 63, 0, 0
        if last > 63 or first > last:
            raise PixelError("bad band")
        self.scans += 1
        if n == 1:
            c = chosen[0][0]
            units = [[(chosen[0], 64 * (y * c.stride + x))] for y in range(c.high) for x in range(c.wide)]
        else:
            across, down = -(-self.width // (8 * self.most[0])), -(-self.height // (8 * self.most[1]))
            units = [
                [(own, 64 * ((y * own[0].vertical + v) * own[0].stride + x * own[0].horizontal + h)) for own in chosen for v in range(own[0].vertical) for h in range(own[0].horizontal)]
                for y in range(down) for x in range(across)
            ]
        step = self.interval or len(units)
        try:
            for k, at in enumerate(range(0, len(units), step)):
                if k >= len(parts):
                    return False
                self._stretch(_Bits(parts[k]), units[at : at + step], chosen, first, last, high, low)
        except _Ended:
            return False
        return True

    def _stretch(self, bits: _Bits, units, chosen, first: int, last: int, high: int, low: int) -> None:
        for c, _, _ in chosen:
            c.previous = 0
        self.run = 0
        for unit in units:
            for (c, dc, ac), at in unit:
                if not self.progressive:
                    self._dc(bits, c, dc, at, 0)
                    self._whole_band(bits, c, ac, at)
                elif first == 0:
                    if high:
                        if bits.take(1):
                            c.blocks[at] |= 1 << low
                    else:
                        self._dc(bits, c, dc, at, low)
                elif high:
                    self._refined_band(bits, c, ac, at, first, last, low)
                else:
                    self._first_band(bits, c, ac, at, first, last, low)

    def _table(self, number: int) -> tuple[int, list[int]]:
        if number not in self.codes:
            raise PixelError("no code table")
        return self.codes[number]

    def _dc(self, bits: _Bits, c: _Component, table: int, at: int, low: int) -> None:
        c.previous += bits.value(bits.symbol(self._table(table)) & 15)
        c.blocks[at] = c.previous << low

    def _whole_band(self, bits: _Bits, c: _Component, table: int, at: int) -> None:
        codes, k = self._table(table), 1
        while k < 64:
            symbol = bits.symbol(codes)
            size = symbol & 15
            if not size:
                if symbol != 0xF0:
                    return
                k += 16
                continue
            k += symbol >> 4
            if k > 63:
                raise PixelError("band overrun")
            c.blocks[at + k] = bits.value(size)
            k += 1

    def _first_band(self, bits: _Bits, c: _Component, table: int, at: int, first: int, last: int, low: int) -> None:
        if self.run:
            self.run -= 1
            return
        codes, k = self._table(table), first
        while k <= last:
            symbol = bits.symbol(codes)
            zeros, size = symbol >> 4, symbol & 15
            if not size:
                if zeros < 15:
                    self.run = (1 << zeros) - 1 + bits.take(zeros)
                    return
                k += 16
                continue
            k += zeros
            if k > last:
                raise PixelError("band overrun")
            c.blocks[at + k] = bits.value(size) << low
            k += 1

    def _refined_band(self, bits: _Bits, c: _Component, table: int, at: int, first: int, last: int, low: int) -> None:
        codes, k, blocks, one = self._table(table), first, c.blocks, 1 << low

        def correct(place: int) -> None:
            value = blocks[place]
            if bits.take(1) and not abs(value) & one:
                blocks[place] = value + one if value > 0 else value - one

        if not self.run:
            while k <= last:
                symbol = bits.symbol(codes)
                zeros, size = symbol >> 4, symbol & 15
                made = 0
                if size:
                    made = one if bits.take(1) else -one
                elif zeros < 15:
                    self.run = (1 << zeros) + bits.take(zeros)
                    break
                while k <= last:
                    if blocks[at + k]:
                        correct(at + k)
                    elif zeros:
                        zeros -= 1
                    else:
                        if made:
                            blocks[at + k] = made
                        k += 1
                        break
                    k += 1
        if self.run:
            for place in range(k, last + 1):
                if blocks[at + place]:
                    correct(at + place)
            self.run -= 1

    def pixels(self) -> np.ndarray:
        """The picture so far: one channel, or RGB."""
        if not self.components or not self.scans:
            raise PixelError("no picture data")
        planes = []
        for c in self.components:
            quantiser = self.quantisers.get(c.table)
            if quantiser is None:
                raise PixelError("no quantiser")
            coded = np.array(c.blocks, dtype=np.int64).reshape(-1, 64) * quantiser
            natural = np.zeros_like(coded)
            natural[:, _NATURAL] = coded
            samples = _COSINES.T @ natural.reshape(-1, 8, 8) @ _COSINES
            plane = samples.reshape(c.rows, c.stride, 8, 8).swapaxes(1, 2).reshape(c.rows * 8, c.stride * 8) + 128
            plane = np.clip(np.floor(plane + 0.5), 0, 255)
            up = self.most[1] // c.vertical, self.most[0] // c.horizontal
            plane = np.repeat(np.repeat(plane, up[0], axis=0), up[1], axis=1)
            planes.append(plane[: self.height, : self.width])
        if len(planes) == 1:
            found = planes[0][:, :, None]
        elif len(planes) == 3:
            found = np.stack(planes, axis=2) if self.transform == 0 else _to_rgb(*planes)
        else:  # inverted CMYK, as Adobe writes it, its first three by way of luminance if so marked
            cmy = _to_rgb(*planes[:3]) if self.transform == 2 else np.stack(planes[:3], axis=2)
            found = np.clip(cmy, 0, 255) * planes[3][:, :, None] / 255
        return np.clip(np.floor(found + 0.5), 0, 255).astype(np.uint8)


def _to_rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    cb, cr = cb - 128, cr - 128
    return np.stack((y + 1.402 * cr, y - 0.344136286 * cb - 0.714136286 * cr, y + 1.772 * cb), axis=2)


def decode(content: bytes) -> np.ndarray:
    """The whole picture; a file without its end, or with a scan cut short, is refused."""
    found = Decoder(content)
    if not found.complete:
        raise PixelError("incomplete")
    return found.pixels()


def decode_prefix(content: bytes) -> tuple[np.ndarray | None, int, bool]:
    """(picture of what the bytes hold or None, scans begun, whether the file is complete)."""
    try:
        found = Decoder(content)
        return found.pixels(), found.scans, found.complete
    except PixelError:
        return None, 0, False


@lru_cache(maxsize=16)
def quantiser(quality: float, chroma: bool) -> np.ndarray:
    """Steps in coding order: all 1 at quality 1, growing with frequency and with lower quality."""
    order = np.array([sum(divmod(n, 8)) for n in _NATURAL])
    base = (12 if not chroma else 16) + (5 if not chroma else 9) * order
    scale = (1 - min(1.0, max(0.0, quality))) * 4
    steps = np.clip(np.round(base * scale), 1, 255).astype(np.int64)
    steps.setflags(write=False)  # one array for all callers
    return steps


def _code_lengths(counts: Counter) -> list[tuple[int, int]]:
    """(length, symbol), by length, of a prefix code of at most 16 bits that doesn't use the code of ones only."""
    heap = [(n, i, (s,)) for i, (s, n) in enumerate(sorted(counts.items()))]
    heap.append((0, len(heap), (-1,)))  # takes the longest code
    length = dict.fromkeys([*counts, -1], 0)
    heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        (a, _, left), (b, _, right) = heappop(heap), heappop(heap)
        for s in left + right:
            length[s] += 1
        heappush(heap, (a + b, made, left + right))
        made += 1
    if max(length.values()) > 16:  # as the counts are flattened, the code gets shorter
        return _code_lengths(Counter({s: 1 + n // 2 for s, n in counts.items()}))
    ordered = sorted((n, s) for s, n in length.items() if s >= 0)
    if not any(n == max(length.values()) for n, _ in ordered) and len(ordered) == 1:
        return [(1, ordered[0][1])]
    return ordered


class _Scan:
    """Tokens (table, symbol or None, bits) of one scan; its code tables follow from them."""

    def __init__(self):
        self.tokens: list[tuple[int, int | None, str]] = []

    def put(self, table: int, symbol: int, bits: str = "") -> None:
        self.tokens.append((table, symbol, bits))

    def raw(self, bits: str) -> None:
        if bits:
            self.tokens.append((0, None, bits))

    def written(self) -> tuple[bytes, bytes]:
        """(code table segments, entropy-coded bytes)."""
        codes, segments = {}, b""
        for table in sorted({t for t, s, _ in self.tokens if s is not None}):
            lengths = _code_lengths(Counter(s for t, s, _ in self.tokens if t == table and s is not None))
            counts, code, last, own = [0] * 16, 0, 0, {}
            for n, s in lengths:
                code <<= n - last
                own[s], last = format(code, f"0{n}b"), n
                code += 1
                counts[n - 1] += 1
            codes[table] = own
            body = bytes([table, *counts, *(s for _, s in lengths)])
            segments += b"\xff\xc4" + (len(body) + 2).to_bytes(2, "big") + body
        bits = "".join((codes[t][s] if s is not None else "") + b for t, s, b in self.tokens)
        bits += "1" * (-len(bits) % 8)
        data = int(bits, 2).to_bytes(len(bits) // 8, "big") if bits else b""
        return segments, data.replace(b"\xff", b"\xff\0")


def _signed(value: int) -> tuple[int, str]:
    size = abs(value).bit_length()
    return size, format(value if value > 0 else value + (1 << size) - 1, f"0{size}b") if size else ""


def _band(scan: _Scan, table: int, block: list[int], first: int, last: int, low: int) -> None:
    zeros = 0
    for k in range(first, last + 1):
        value = abs(block[k]) >> low
        if not value:
            zeros += 1
            continue
        while zeros > 15:
            scan.put(table, 0xF0)
            zeros -= 16
        size, bits = _signed(value if block[k] > 0 else -value)
        scan.put(table, zeros << 4 | size, bits)
        zeros = 0
    if zeros:
        scan.put(table, 0)


def _refined(scan: _Scan, table: int, block: list[int], first: int, last: int, low: int) -> None:
    sizes = [abs(v) >> low for v in block]
    newest = max((k for k in range(first, last + 1) if sizes[k] == 1), default=-1)
    zeros, waiting = 0, ""
    for k in range(first, last + 1):
        if not sizes[k]:
            zeros += 1
            continue
        while zeros > 15 and k <= newest:
            scan.put(table, 0xF0, waiting)
            zeros, waiting = zeros - 16, ""
        if sizes[k] > 1:
            waiting += str(sizes[k] & 1)
            continue
        scan.put(table, zeros << 4 | 1, ("1" if block[k] > 0 else "0") + waiting)
        zeros, waiting = 0, ""
    if zeros or waiting:
        scan.put(table, 0, waiting)


#: (components or None for all, first, last, bits already sent or 0, bits left out) of each scan of a progressive file.
PROGRESSIVE = ((None, 0, 0, 0, 1), (0, 1, 5, 0, 2), (2, 1, 63, 0, 1), (1, 1, 63, 0, 1), (0, 6, 63, 0, 2), (0, 1, 63, 2, 1), (None, 0, 0, 1, 0), (2, 1, 63, 1, 0), (1, 1, 63, 1, 0), (0, 1, 63, 1, 0))


def encode(pixels: np.ndarray, quality: float = 0.9, script=None, extra: bytes = b"") -> bytes:
    """Baseline JPEG, or progressive by a ``script`` of scans; ``extra`` segments follow the start. Four channels are inverted CMYK and marked so."""
    height, width, channels = pixels.shape
    if channels not in (1, 3, 4) or not 0 < width < 65_536 or not 0 < height < 65_536:
        raise PixelError("JPEG takes one, three or four channels of up to 65,535 pixels a side")
    planes = [pixels[:, :, c].astype(np.float64) for c in range(channels)]
    own_table = [0] * channels
    if channels == 3:
        r, g, b = planes
        own_table = [0, 1, 1]
        planes = [0.299 * r + 0.587 * g + 0.114 * b, -0.168735892 * r - 0.331264108 * g + 0.5 * b + 128, 0.5 * r - 0.418687589 * g - 0.081312411 * b + 128]
    high, wide = -(-height // 8), -(-width // 8)
    steps = [quantiser(quality, False), quantiser(quality, True)][: 1 + max(own_table)]
    blocks = []
    for c, plane in enumerate(planes):
        padded = np.pad(plane, ((0, high * 8 - height), (0, wide * 8 - width)), mode="edge") - 128
        cells = padded.reshape(high, 8, wide, 8).swapaxes(1, 2).reshape(-1, 8, 8)
        turned = (_COSINES @ cells @ _COSINES.T).reshape(-1, 64)[:, _NATURAL]
        blocks.append(np.round(turned / steps[own_table[c]]).astype(np.int64).tolist())
    adobe = b"\xff\xee\0\x0eAdobe\0\x64\0\0\0\0\0" if channels == 4 else b""
    out = [b"\xff\xd8", extra, adobe]
    for i, own in enumerate(steps):
        out.append(b"\xff\xdb" + (67).to_bytes(2, "big") + bytes([i, *own.tolist()]))
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([channels]) + b"".join(bytes([c + 1, 0x11, own_table[c]]) for c in range(channels))
    out.append((b"\xff\xc2" if script else b"\xff\xc0") + (len(frame) + 2).to_bytes(2, "big") + frame)
    for chosen, first, last, sent, low in script or ((None, 0, 63, 0, 0),):
        own = [c for c in range(channels) if chosen is None or c == chosen]
        if not own:
            continue
        scan, previous = _Scan(), [0] * channels
        for k in range(high * wide):
            for c in own:
                block = blocks[c][k]
                if first == 0:
                    if sent:
                        scan.raw(str(block[0] >> low & 1))
                    else:
                        size, bits = _signed((block[0] >> low) - previous[c])
                        scan.put(own_table[c], size, bits)
                        previous[c] = block[0] >> low
                if last > 0:
                    (_refined if sent else _band)(scan, 16 | own_table[c], block, max(1, first), last, low)
        segments, data = scan.written()
        head = bytes([len(own)]) + b"".join(bytes([c + 1, own_table[c] * 17]) for c in own) + bytes([first, last, sent << 4 | low])
        out += [segments, b"\xff\xda" + (len(head) + 2).to_bytes(2, "big") + head, data]
    return b"".join([*out, b"\xff\xd9"])
