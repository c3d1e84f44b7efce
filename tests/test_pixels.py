"""Pixel codecs, geometry and metrics."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelframe.functions import jpeg
from pixelframe.functions import pixels as p
from pixelframe.functions.containers import jpeg_scans
from pixelframe.functions.pixels import PixelError, as_rgb, chunk, decode, pattern
from pixelframe.sources import files


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_png_round_trip(channels):
    image = np.random.default_rng(channels).integers(0, 256, (13, 7, channels), dtype=np.uint8)
    assert np.array_equal(p.decode(p.encode_png(image)), image)


def filtered(image: np.ndarray, kind: int) -> bytes:
    """A PNG whose lines all use one filter, made pixel by pixel."""
    import struct
    import zlib

    h, w, c = image.shape
    flat = image.reshape(h, w * c).astype(int)
    lines = []
    for y in range(h):
        line = [kind]
        for i in range(w * c):
            a = flat[y, i - c] if i >= c else 0
            b = flat[y - 1, i] if y else 0
            d = flat[y - 1, i - c] if y and i >= c else 0
            q = a + b - d
            near = min((abs(q - a), 0, a), (abs(q - b), 1, b), (abs(q - d), 2, d))[2]
            line.append((flat[y, i] - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        lines.append(bytes(line))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[c], 0, 0, 0)
    return p.PNG_MAGIC + p.chunk(b"IHDR", head) + p.chunk(b"IDAT", zlib.compress(b"".join(lines))) + p.chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    image = p.pattern(9, 6)
    assert np.array_equal(p.decode_png(filtered(image, kind)), image)


def test_bad_images():
    good = p.encode_png(p.pattern(4, 4))
    for bad in (b"", b"xx", good[:40], good.replace(b"IHDR", b"IHDX"), b"P6\n2 2\n255\nabc", b"P6\n2 2\n65535\n" + b"a" * 24, b"P6\n1 1\n255\nabcd"):
        with pytest.raises(p.PixelError):
            p.decode(bad)


def test_pnm():
    image = p.pattern(5, 3)
    assert np.array_equal(p.decode_pnm(b"P6 # comment\n5 # w\n3\n255\n" + image.tobytes()), image)
    assert np.array_equal(p.decode(p.encode_pnm(image[:, :, :1])), image[:, :, :1])


@pytest.mark.parametrize(("target", "mode", "size"), [((20, 20), "fit", (20, 10)), ((200, 20), "fit", (40, 20)), ((20, 20), "fill", (20, 20)), ((500, 500), "fit", (100, 50)), ((1, 1), "fit", (1, 1))])
def test_geometry(target, mode, size):
    made = p.rendered(np.full((50, 100, 3), 77, dtype=np.uint8), *target, mode)
    assert (made.shape[1], made.shape[0]) == size
    assert (made == 77).all()


def test_orientations_undo():
    image = p.pattern(5, 3)
    assert np.array_equal(p.oriented(p.oriented(image, 6), 8), image)
    assert np.array_equal(p.oriented(p.oriented(image, 3), 3), image)
    assert p.oriented(image, 5).shape == (5, 3, 3) and np.array_equal(p.oriented(image, 9), image)
    assert np.array_equal(p.oriented(image, 6)[0, -1], image[0, 0])  # turned clockwise, the first pixel is top right


def test_flatten():
    image = np.array([[[200, 100, 0, 0], [200, 100, 0, 255], [200, 100, 0, 128]]], dtype=np.uint8)
    assert p.flattened(image, (10, 20, 30)).tolist() == [[[10, 20, 30], [200, 100, 0], [105, 60, 15]]]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 255), st.integers(0, 255)), min_size=1, max_size=60))
def test_metrics_against_definition(pairs):
    a, b = bytes(x for x, _ in pairs), bytes(y for _, y in pairs)
    found = p.error_metrics(a, b)
    d = [abs(x - y) for x, y in pairs]
    assert found["absolute_error_sum"] == sum(d) and found["squared_error_sum"] == sum(x * x for x in d)
    assert found["mean_absolute_error_micro"] == sum(d) * 10**6 // len(d)
    assert found["at_most_16_ppm"] == sum(x <= 16 for x in d) * 10**6 // len(d)
    assert (found["psnr_micro_db"] == 999_000_000) == (a == b)


def smooth(height=45, width=70):
    y, x = np.mgrid[:height, :width]
    return np.stack((128 + 60 * np.sin(x / 9) + 40 * np.cos(y / 7), 128 + 50 * np.cos(x / 11 + y / 13), 100 + 20 * np.sin(y / 5)), axis=2).clip(0, 255).astype(np.uint8)


@pytest.mark.parametrize("script", [None, jpeg.PROGRESSIVE])
def test_jpeg_files_agree_with_another_decoder(spark, tmp_path, script):
    """The JVM's own reader draws the same pictures, up to the rounding of its arithmetic."""
    rng = np.random.default_rng(3)
    pictures = {"smooth": smooth(), "grey": smooth()[:, :, :1], "noise": rng.integers(0, 256, (19, 33, 3), dtype=np.uint8), "flat": np.full((8, 8, 1), 200, dtype=np.uint8), "one": np.full((1, 1, 3), 77, dtype=np.uint8)}
    jfif = b"\xff\xe0\0\x10JFIF\0\1\1\0\0\1\0\1\0\0"
    coded = {f"{n}{q}": (p, jpeg.encode(p, q, script, jfif)) for n, p in pictures.items() for q in (1.0, 0.8, 0.3)}
    for name, (_, blob) in coded.items():
        (tmp_path / f"{name}.jpg").write_bytes(blob)
    for row in files.decoded_files(spark, str(tmp_path)).collect():
        name = row["path"].rsplit("/", 1)[1].removesuffix(".jpg")
        other = np.frombuffer(row["pixels"], dtype=np.uint8).reshape(row["height"], row["width"], row["channels"])[:, :, ::-1].astype(int)
        mine = as_rgb(jpeg.decode(coded[name][1])).astype(int) if row["channels"] == 3 else jpeg.decode(coded[name][1]).astype(int)
        assert np.abs(mine - other).max() <= 3, name
        if name.endswith("1.0"):
            assert np.abs(jpeg.decode(coded[name][1]).astype(int) - coded[name][0]).max() <= 3


def test_jpeg_with_subsampling_and_restarts(spark, tmp_path):
    """Files of the JVM's writer, which halves the colour planes."""
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(37, 29, 1)
    y, x = np.mgrid[:29, :37]
    for i, j in zip(y.ravel().tolist(), x.ravel().tolist()):
        image.setRGB(j, i, (4 * i + 3 * j) << 16 | (200 - 3 * j) << 8 | 90)
    path = tmp_path / "other.jpg"
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(path)))
    blob = path.read_bytes()
    other = files.decoded_files(spark, str(path)).first()
    expected = np.frombuffer(other["pixels"], dtype=np.uint8).reshape(29, 37, 3)[:, :, ::-1].astype(int)
    difference = np.abs(jpeg.decode(blob).astype(int) - expected)
    assert difference.mean() < 4 and difference.max() < 40  # colours of neighbours are mixed otherwise


def test_jpeg_prefixes():
    blob = jpeg.encode(smooth(), 0.9, jpeg.PROGRESSIVE)
    whole, errors = jpeg.decode(blob).astype(int), []
    for scan in jpeg_scans(blob):
        made, scans, complete = jpeg.decode_prefix(blob[: scan.entropy_end])
        assert scans == scan.scan and not complete
        errors.append(((made - whole) ** 2).mean())
    assert errors[-1] == 0 and errors[0] > errors[3] > errors[-2]
    assert jpeg.decode_prefix(blob) [2] and jpeg.decode_prefix(blob[:20]) == (None, 0, False)
    with pytest.raises(PixelError):
        jpeg.decode(blob[:-2])
    for at in range(2, len(blob), 7):  # whatever is broken, nothing but PixelError comes out
        for broken in (blob[:at], blob[:at] + b"\xff" + blob[at + 1 :], blob[:at] + b"\0\0" + blob[at + 2 :]):
            try:
                jpeg.decode(broken)
            except PixelError:
                pass


def test_scan_of_coefficients_in_their_order():
    order = jpeg.zigzag()
    assert order[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and order[-3:] == [55, 62, 63] and sorted(order) == list(range(64))


@pytest.mark.parametrize("kind", ["png", "gif"])
def test_other_files_of_the_jvm(spark, tmp_path, kind):
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(21, 17, 13 if kind == "gif" else 11)  # indexed, or 16-bit grey
    raster = image.getRaster()
    for i in range(17):
        for j in range(21):
            raster.setSample(j, i, 0, (i * 13 + j * 7) % 200 if kind == "gif" else (i * 1300 + j * 700))
    path = tmp_path / f"x.{kind}"
    assert jvm.javax.imageio.ImageIO.write(image, kind, jvm.java.io.File(str(path)))
    mine = as_rgb(decode(path.read_bytes()))
    if kind == "png":
        assert mine[:, :, 0].tolist() == [[(i * 1300 + j * 700) >> 8 for j in range(21)] for i in range(17)]
    else:
        other = files.decoded_files(spark, str(path)).first()
        shape = other["height"], other["width"], other["channels"]
        assert np.array_equal(mine, np.frombuffer(other["pixels"], dtype=np.uint8).reshape(shape)[:, :, 2::-1])


def test_interlaced_and_small_depths():
    import struct
    import zlib

    from pixelframe.functions import pixels as px

    picture = pattern(13, 11)
    passes = []
    for y, x, dy, dx in px._PASSES:
        part = picture[y::dy, x::dx]
        if part.size:
            passes.append(b"".join(b"\0" + row.tobytes() for row in part))
    head = struct.pack(">IIBBBBB", 13, 11, 8, 2, 0, 0, 1)
    blob = px.PNG_MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(passes))) + chunk(b"IEND", b"")
    assert np.array_equal(decode(blob), picture)
    bits = np.arange(30).reshape(5, 6) % 4
    rows = b"".join(b"\0" + np.packbits(np.unpackbits(row.astype(np.uint8)[:, None], axis=1)[:, 6:].ravel()).tobytes() for row in bits)
    head = struct.pack(">IIBBBBB", 6, 5, 2, 0, 0, 0, 0)
    blob = px.PNG_MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert np.array_equal(decode(blob)[:, :, 0], bits * 85)


def test_code_tables_are_as_long_as_their_longest_code():
    counts, symbols = bytes([0, 2, 1, *[0] * 13]), bytes([7, 8, 9])
    longest, entries = jpeg._lookup(counts, symbols)
    assert (longest, entries) == (3, [2 << 8 | 7] * 2 + [2 << 8 | 8] * 2 + [3 << 8 | 9] + [0] * 3)
    with pytest.raises(PixelError):
        jpeg._lookup(bytes([3, *[0] * 15]), bytes([1, 2, 3]))


def test_small_files_are_dealt_over_tasks_and_equal_ones_decoded_once(spark, sf_dir, monkeypatch):
    from pixelframe import batches
    from pixelframe.plans import image_queries

    assert image_queries._cell_files(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    made, known = [], batches.Memo()
    for key in (1, 2, 1, 1):
        assert known.get(key, lambda: made.append(key) or (key,), lambda r: 10) == (key,)
    assert made == [1, 2]
    monkeypatch.setattr(batches, "MEMO_BYTES", 4_000)
    for key in range(100):
        known.get(("x", key), lambda: (key,), lambda r: 500)
    assert known.bytes <= 4_000
