"""Copies of images by local descriptors.

Corners (Harris response) are taken at several scales, from native resolution down by averaged halvings, the
strongest of each region, each turned to the direction of its intensity
centroid and described by binary tests between smoothed pixels of its patch. Pictures larger than a region
are also described at the size of one, whatever their own. Descriptors are cut into
pieces of 40 bits that serve as hash-table keys. Images that have COMMON keys in common, of whichever
descriptors, are compared: matched descriptors (nearest both ways, within
MATCH_BITS) vote for a similarity transform, and a link needs enough matches that agree with one of
them. So crops, turned, rescaled, brightened and slightly edited copies are found.

In each bucket all images first meet one pivot; in buckets that still hold several components all
images of different components meet, in blocks, by twice as many keys; no bucket is cut, however many images it holds. Their pairs may
so grow with the square of a bucket: they are counted and verified in rounds, which bounds memory and disk, not the time.
Common keys are counted on pairs of numbers, and every pair that has enough is verified once. Equal files are one class.

Null, empty and undecodable images link with nothing, nor do images with too few corners, but equal
files are copies all the same. Large pictures are looked at in strips and regions, whole. Rows with a null image_id keep a null component and are kept. Repeated
rows share a result, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelframe.functions.pixels import PixelError, as_rgb, decode, encode_pnm

from .linkage import bucket_pivots, components, least_by_root, mix, shared_pairs, shrink, whole_meetings
from .runtime import Rows, Workspace, prepare

#: Strongest corners described of a region of an image, over the scales of an octave.
CORNERS = 48
SCALES = (1.0, 0.8, 0.64, 0.5)
RADIUS, BITS, PIECE_BYTES = 7, 256, 5
#: Keys that two images must share to be compared, and members of a bucket that meet at once.
COMMON, MEET = 2, 256
#: Bytes by which longer keys of a piece grow, step by step.
LONGER = (2, 2, 3, 4)
#: Pairs a picture that are verified at once, that meet at once, and parts of the buckets that are shuffled one after the other.
ROUND, MET, PARTS = 4, 128, 2
#: Bits that matched descriptors may differ in, pixels that a match may be off, places that must agree, and their width.
MATCH_BITS, OFF, AGREE, PLACE = 48, 3.0, 6, 8
SEED = 4_711
#: Side of a region; images with a longer side have several, and are averaged down by halves to one.
LONGEST = 256
#: Rows that corners are sought in at once, rows that these look beyond their own, and cells of a matrix of matches held at once.
STRIP, MARGIN, CELLS = 512, 16, 1 << 21


def _smooth(a: np.ndarray, times: int = 1) -> np.ndarray:
    """Means weighted 1, 2, 1 both ways; the border is repeated. Added in place, since copies with a border cost more than the sums."""
    for _ in range(times):
        for turned in (False, True):
            own = a.T if turned else a
            total = own + own
            total[1:] += own[:-1]
            total[0] += own[0]
            total[:-1] += own[1:]
            total[-1] += own[-1]
            total *= 0.25
            a = total.T if turned else total
    return a


def _scaled(a: np.ndarray, factor: float) -> np.ndarray:
    """Bilinear samples of a smoothed image."""
    h, w = max(1, int(a.shape[0] * factor)), max(1, int(a.shape[1] * factor))
    y, x = (np.arange(h) + 0.5) / factor - 0.5, (np.arange(w) + 0.5) / factor - 0.5
    a = _smooth(a) if factor < 0.9 else a
    return np.concatenate([_at(a, y[at : at + STRIP, None], x[None]) for at in range(0, h, STRIP)])


def _halved(a: np.ndarray) -> np.ndarray:
    """Means of two by two pixels; an odd last row or column is repeated."""
    a = np.pad(a, ((0, a.shape[0] % 2), (0, a.shape[1] % 2)), mode="edge")
    return (a[::2, ::2] + a[1::2, ::2] + a[::2, 1::2] + a[1::2, 1::2]) / 4


def _at(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    y, x = np.clip(y, 0, a.shape[0] - 1), np.clip(x, 0, a.shape[1] - 1)
    y0, x0 = np.minimum(y.astype(int), max(0, a.shape[0] - 2)), np.minimum(x.astype(int), max(0, a.shape[1] - 2))
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    fy, fx = y - y0, x - x0
    return (a[y0, x0] * (1 - fx) + a[y0, x1] * fx) * (1 - fy) + (a[y1, x0] * (1 - fx) + a[y1, x1] * fx) * fy


def _nearest(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    y, x = np.clip(np.rint(y), 0, a.shape[0] - 1), np.clip(np.rint(x), 0, a.shape[1] - 1)
    return a.ravel()[(y * a.shape[1] + x).astype(np.int64)]


_random = np.random.default_rng(SEED)
_TESTS = np.clip(_random.normal(0, RADIUS / 2.2, size=(BITS, 4)), 1 - RADIUS, RADIUS - 1)
_OFFSETS = np.array([(y, x) for y in range(-RADIUS, RADIUS + 1) for x in range(-RADIUS, RADIUS + 1) if y * y + x * x <= RADIUS * RADIUS])


def corners(grey: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, x, response) of local maxima of the Harris response, far enough from the border."""
    gy, gx = np.gradient(_smooth(grey))
    xx, yy, xy = _smooth(gx * gx, 2), _smooth(gy * gy, 2), _smooth(gx * gy, 2)
    response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    inner = response[1:-1, 1:-1]
    y, x = np.nonzero((inner > 1.0) & (inner > response[:-2, 1:-1]) & (inner >= response[2:, 1:-1]))
    y, x = y + 1, x + 1
    own, peak = response[y, x], np.ones(len(y), dtype=bool)
    for dy in (-1, 0, 1):
        for dx in (-1, 1):
            other = response[y + dy, x + dx]
            peak &= own > other if (dy, dx) < (0, 0) else own >= other
    y, x = y[peak], x[peak]
    far = (y >= 4) & (x >= 4) & (y < grey.shape[0] - 4) & (x < grey.shape[1] - 4)
    return y[far], x[far], response[y[far], x[far]]


def _all_corners(grey: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``corners`` gives, sought in strips."""
    found = []
    for top in range(0, len(grey), STRIP):
        above = max(0, top - MARGIN)
        y, x, response = corners(grey[above : top + STRIP + MARGIN])
        own = (y + above >= top) & (y + above < top + STRIP)
        found.append((y[own] + above, x[own], response[own]))
    return tuple(np.concatenate(part) for part in zip(*found))


def _strongest(order: np.ndarray, region: np.ndarray) -> np.ndarray:
    """The first CORNERS of each region in ``order``."""
    own = region[order]
    by_region = np.argsort(own, kind="stable")
    starts = np.searchsorted(own[by_region], own[by_region])
    kept = np.zeros(len(order), dtype=bool)
    kept[by_region] = np.arange(len(order)) - starts < CORNERS
    return order[kept]


def _octave(grey: np.ndarray, scales: tuple[float, ...], shrink: float) -> tuple[np.ndarray, np.ndarray]:
    """Features of a picture that is ``shrink`` times the full image, at ``scales`` of its own size."""
    found = []
    for scale in scales:
        level = grey if scale == 1 else _scaled(grey, scale)
        if min(level.shape) < 2 * RADIUS:
            continue
        y, x, response = _all_corners(level)
        found.append((y, x, response * scale, np.full(len(y), scale), _smooth(level, 2)))
    if not found:
        return np.empty((0, 4)), np.empty((0, BITS // 64), dtype=np.uint64)
    response = np.concatenate([f[2] for f in found])
    level = np.concatenate([np.full(len(f[0]), i) for i, f in enumerate(found)])
    y, x, scale = (np.concatenate([f[k] for f in found]).astype(np.float64) for k in (0, 1, 3))
    down, right = ((side + 0.5) / scale // LONGEST for side in (y, x))
    order = _strongest(np.lexsort((x, y, level, -response)), down * (grey.shape[1] // LONGEST + 2) + right)
    y, x, scale, level = y[order], x[order], scale[order], level[order]
    angle = np.zeros(len(order))
    bits = np.zeros((len(order), BITS), dtype=bool)
    for i, f in enumerate(found):
        places = np.flatnonzero(level == i)
        for at in range(0, len(places), 1024):
            own = places[at : at + 1024]
            patch = _nearest(f[4], y[own, None] + _OFFSETS[None, :, 0], x[own, None] + _OFFSETS[None, :, 1])
            patch = patch - patch.mean(axis=1, keepdims=True)
            angle[own] = np.arctan2((patch * _OFFSETS[:, 0]).sum(axis=1), (patch * _OFFSETS[:, 1]).sum(axis=1))
            cos, sin = np.cos(angle[own])[:, None], np.sin(angle[own])[:, None]
            ends = []
            for a in (0, 2):
                ty, tx = _TESTS[None, :, a], _TESTS[None, :, a + 1]
                ends.append(_nearest(f[4], y[own, None] + cos * ty + sin * tx, x[own, None] + cos * tx - sin * ty))
            bits[own] = ends[0] < ends[1]
    words = np.packbits(bits, axis=1).view("<u8")
    full = scale * shrink
    return np.stack(((y + 0.5) / full, (x + 0.5) / full, 1 / full, angle), axis=1), words


def features(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places (n, 4): y, x, scale, angle in the full image; descriptors (n, BITS / 64) as 64-bit words)."""
    grey, shrink = as_rgb(pixels).astype(np.float64) @ np.array([0.299, 0.587, 0.114]), 1.0
    found = []
    while (longest := max(grey.shape)) > LONGEST:
        found.append(_octave(grey, SCALES[:-1], shrink))  # the next octave has the last scale
        if longest <= 2 * LONGEST:
            found.append(_octave(_scaled(grey, LONGEST / longest), SCALES, shrink * LONGEST / longest))
        grey, shrink = _halved(grey), shrink / 2
    found.append(_octave(grey, SCALES, shrink))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _matches(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of descriptors that are each other's nearest, within MATCH_BITS."""
    step = max(1, CELLS // len(b))
    nearest, least = np.zeros(len(b), dtype=np.int64), np.full(len(b), 255)
    j, bits = np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=np.int64)
    for at in range(0, len(a), step):
        distance = np.bitwise_count(a[at : at + step, None] ^ b[None]).sum(axis=2)
        j[at : at + step], bits[at : at + step] = distance.argmin(axis=1), distance.min(axis=1)
        closer = distance.min(axis=0) < least
        nearest[closer], least[closer] = at + distance.argmin(axis=0)[closer], distance.min(axis=0)[closer]
    i = np.flatnonzero((nearest[j] == np.arange(len(a))) & (bits <= MATCH_BITS))
    return i, j[i]


def _best_proposal(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which matches agree with the transform that the most agree with; each match proposes one that takes its own place to its counterpart's."""
    best, step = np.zeros(len(p), dtype=bool), max(1, CELLS // 8 // len(p))
    scale, turn = q[:, 2] / p[:, 2], q[:, 3] - p[:, 3]
    cos, sin = scale * np.cos(turn), scale * np.sin(turn)
    for at in range(0, len(p), step):
        own = slice(at, at + step)
        dy, dx = p[None, :, 0] - p[own, None, 0], p[None, :, 1] - p[own, None, 1]
        y = q[own, None, 0] + cos[own, None] * dy + sin[own, None] * dx
        x = q[own, None, 1] + cos[own, None] * dx - sin[own, None] * dy
        # A proposal's own angle and scale are coarse: what it may be off grows with the distance.
        reach = OFF * np.maximum(1, q[None, :, 2]) + 0.12 * np.hypot(dy, dx) * scale[own, None]
        alike = np.abs(np.angle(np.exp(1j * (turn[None] - turn[own, None])))) < 0.5
        proposed = (np.hypot(y - q[None, :, 0], x - q[None, :, 1]) <= reach) & alike
        found = proposed[proposed.sum(axis=1).argmax()]
        if found.sum() > best.sum():
            best = found
    return best


def agreeing(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Distinct places of matches of two images that agree with one similarity transform."""
    if len(a[1]) < AGREE or len(b[1]) < AGREE:
        return 0
    i, j = _matches(a[1], b[1])
    p, q = a[0][i], b[0][j]
    if len(p) < AGREE:
        return 0
    inliers = _best_proposal(p, q)
    # The best proposal's matches give a transform by least squares, which all matches are held against.
    source, target = p[:, 1] + 1j * p[:, 0], q[:, 1] + 1j * q[:, 0]
    for _ in range(3):
        if inliers.sum() < AGREE:
            return 0
        s, t = source[inliers], target[inliers]
        spread = (np.abs(s - s.mean()) ** 2).sum()
        if spread == 0:
            return 0
        factor = (np.conj(s - s.mean()) * (t - t.mean())).sum() / spread
        off = np.abs(factor * (source - s.mean()) + t.mean() - target)
        inliers = off <= OFF * q[:, 2] * 0.6
    # One place may be a corner at several scales: it counts once, on either side.
    places = [len(np.unique((side[inliers, :2] // PLACE), axis=0)) for side in (p, q)]
    return min(places) if 0.2 < abs(factor) < 5 else 0


#: Keys are of the bits in their own order and, for pairs that no pivot links, in another.
_ORDERS = (np.arange(BITS), np.random.default_rng(SEED + 1).permutation(BITS))


def _pieces(descriptors: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets (n, pieces), the bytes (n, pieces, sum of LONGER) that lengthen each piece's key): the piece's number and its bits, spread."""
    own, count = np.ascontiguousarray(descriptors).view(np.uint8).reshape(len(descriptors), BITS // 8), BITS // 8 // PIECE_BYTES
    if order:
        own = np.packbits(np.unpackbits(own, axis=1)[:, _ORDERS[order]], axis=1)
    pieces = own[:, : count * PIECE_BYTES].reshape(len(own), count, PIECE_BYTES).astype(np.uint64)
    value = (pieces << (8 * np.arange(PIECE_BYTES, dtype=np.uint64))).sum(axis=2, dtype=np.uint64)
    value += np.arange(order * count + 1, (order + 1) * count + 1, dtype=np.uint64) << np.uint64(8 * PIECE_BYTES)
    after = (PIECE_BYTES * np.arange(1, count + 1)[:, None] + np.arange(sum(LONGER))[None]) % (BITS // 8)
    return mix(value).view(np.int64), own[:, after]


def keys(descriptors: np.ndarray, order: int = 0) -> np.ndarray:
    """Distinct buckets of an image's descriptors."""
    return np.unique(_pieces(descriptors, order)[0])


def long_keys(descriptors: np.ndarray, order: int = 0, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (buckets (m,), numbers (m, steps) that tell which part of its bucket a key falls in at each step), of the ``wanted`` buckets or all."""
    buckets, more = _pieces(descriptors, order)
    if wanted is not None:
        chosen = np.isin(buckets, wanted)
        buckets, more = buckets[chosen], more[chosen]
    steps, at = np.zeros((*buckets.shape, len(LONGER)), dtype=np.int64), 0
    for step, size in enumerate(LONGER):
        for byte in range(at, at + size):
            steps[..., step] = steps[..., step] << 8 | more[..., byte]
        at += size
    rows = np.unique(np.concatenate((buckets[..., None], steps), axis=-1).reshape(-1, 1 + len(LONGER)), axis=0)
    return rows[:, 0], rows[:, 1:]


def _pack(places: np.ndarray, descriptors: np.ndarray) -> bytes:
    return places.astype("<f4").tobytes() + np.ascontiguousarray(descriptors).tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // (16 + BITS // 8)
    return np.frombuffer(blob, dtype="<f4", count=4 * n).reshape(n, 4).astype(np.float64), np.frombuffer(blob, dtype="<u8", offset=16 * n).reshape(n, -1)


def copies(images: DataFrame) -> DataFrame:
    """image_id, n_corners, component_id (smallest image_id of the group) and kept of every row (image_id, image: PNG, PGM or PPM bytes)."""
    work = Workspace(prepare(images.sparkSession), "images")
    content = F.coalesce(F.col("image").cast("binary"), F.lit(b""))
    rows = images.select(F.col("image_id").cast("long").alias("image_id"), content.alias("image"))
    known = rows.where("image_id IS NOT NULL").select("image_id", F.xxhash64("image").alias("t1"), F.xxhash64(F.lit(1), "image").alias("t2"), "image")
    schema = pa.schema([("image_id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("n_corners", pa.int64()), ("payload", pa.binary())])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for batch in batches:
            for image_id, t1, t2, blob in zip(*(batch.column(c).to_pylist() for c in ("image_id", "t1", "t2", "image"))):
                try:
                    places, words = features(decode(blob))
                except PixelError:
                    places, words = np.empty((0, 4)), np.empty((0, BITS // 64), dtype=np.uint64)
                out.add(image_id, t1, t2, len(words), _pack(places, words), size=100 + 48 * len(words))
            if out.full:
                yield out.batch()
        if out:
            yield out.batch()

    numbered = known.mapInArrow(describe, "image_id long, t1 long, t2 long, n_corners long, payload binary").withColumn("node", F.monotonically_increasing_id())
    described = work.write(numbered, "described")  # written once, so a row keeps its number
    # A class goes by the number of one of its rows: what describes it stays where it is written, and isn't written again.
    classes = work.write(described.groupBy("t1", "t2").agg(F.min("image_id").alias("rep"), F.min("node").alias("node")), "classes")
    payload = described.select("node", "payload")
    lone_payload = payload.join(classes.select("node"), "node", "left_semi")
    images_known = described.count()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [agreeing(_unpack(x), _unpack(y)) >= AGREE for x, y in zip(batch.column("pa").to_pylist(), batch.column("pb").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def verified(distinct: DataFrame, label: str) -> DataFrame:
        """Links among the pairs, in parts of about ROUND pairs a picture: each pair's payload is shuffled, so that this bounds the disk by the input."""
        work.release()
        parts, found = max(1, math.ceil(distinct.count() / max(1, ROUND * images_known))), []
        for part in range(parts):
            own = distinct.where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == part)
            sides = own.join(payload.toDF("a", "pa"), "a").join(payload.toDF("b", "pb"), "b").select("a", "b", "pa", "pb")
            found.append(work.write(sides.mapInArrow(verify, "a long, b long"), f"{label}-{part}"))
            del sides
            work.release()
        work.drop(distinct)
        return work.union(found)

    key_schema = pa.schema([("bucket", pa.int64()), ("node", pa.int64())])

    def keyed(order: int, part: int) -> DataFrame:
        """(bucket, node) of the part of the buckets; keys are made anew for each, since that costs less than to hold them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = []
                for blob in batch.column("payload").to_pylist():
                    found = keys(_unpack(blob)[1], order) if len(blob) >= AGREE * (16 + BITS // 8) else np.empty(0, dtype=np.int64)
                    own.append(found[found % PARTS == part])
                node = np.repeat(batch.column("node").to_numpy(), np.array([len(found) for found in own], dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, dtype=np.int64), *own])), pa.array(node)], schema=key_schema)

        return lone_payload.mapInArrow(run, "bucket long, node long")

    members, pairs = bucket_pivots(work, [keyed(0, part).withColumn("bytes", F.lit(0)) for part in range(PARTS)], COMMON)  # pairs meet without payloads
    links = verified(pairs, "links")
    linked = components(work, links)
    # Members with a bucket of the second order in common meet as those of the first do.
    meetings = whole_meetings(work, [members.select("bucket", "node"), *(keyed(1, part) for part in range(PARTS))], linked, MEET)
    work.drop(members)
    for pairs in shared_pairs(work, meetings, COMMON, MET * images_known):
        found = verified(pairs, "across")
        newer = work.write(shrink(links.union(found)), "links")  # a forest in their place, so that links don't grow with the rounds
        work.drop(links, found)
        links = newer
    roots = components(work, links).select(F.col("id").alias("node"), "root")
    named = work.write(classes.select("t1", "t2", "node", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    named = work.write(least_by_root(work, named, F.col("rep"), "component_id").select("t1", "t2", "component_id"), "groups")
    work.keep_only(described, named)
    found = described.select("image_id", "n_corners", "t1", "t2").join(named, ["t1", "t2"])
    found = found.select("image_id", "n_corners", "component_id", (F.col("image_id") == F.col("component_id")).alias("kept"))
    lone = rows.where("image_id IS NULL").select(F.lit(None).cast("long"), F.lit(0).cast("long"), F.lit(None).cast("long"), F.lit(True))
    return found.union(lone)


#: Pixels of a side of a rendered vector.
SIDE = 80


def rendering(vector: np.ndarray) -> np.ndarray:
    """A vector as a grey picture: its components are the amplitudes of as many two-dimensional waves."""
    order = int(np.ceil(np.sqrt(len(vector))))
    grid = np.zeros(order * order)
    grid[: len(vector)] = vector
    waves = np.cos(np.pi * (3 + 3 * np.arange(order)[:, None]) * (np.arange(SIDE)[None] + 0.5) / SIDE)
    field = waves.T @ grid.reshape(order, order) @ waves
    spread = 3 * field.std()
    field = field / spread if spread > 0 else field
    return np.clip(np.round(field * 127 + 128), 0, 255).astype(np.uint8)[:, :, None]


def rendered_embeddings(embeddings: DataFrame) -> DataFrame:
    """The tables hold no pictures, so each vector becomes one: image_id (its vec_id) and image (PGM bytes; null where a vector isn't finite)."""
    prepare(embeddings.sparkSession)
    schema = pa.schema([("image_id", pa.int64()), ("image", pa.binary())])

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for batch in batches:
            for vec_id, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()):
                fine = vector and all(v is not None and np.isfinite(v) for v in vector)
                out.add(vec_id, encode_pnm(rendering(np.array(vector, dtype=np.float64))) if fine else None, size=8192)
                if out.full:
                    yield out.batch()
        if out:
            yield out.batch()

    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(render, "image_id long, image binary")
