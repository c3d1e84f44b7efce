"""Probing and decoding of encoded images held in binary columns.

Failures are values: ``failure`` is null or the stable name of the first rule that an image breaks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..batches import Memo, Output, memo
from ..contracts import DecodeLimits, EncodeCapabilities, EncodeLimits
from ..functions import containers, jpeg, pixels, properties
from ..shipping import ship, spread
from .admission import first_failure, probe_failure

_PROBE = pa.schema([
    ("format", pa.string()), ("width", pa.int64()), ("height", pa.int64()), ("frame_count", pa.int64()), ("orientation", pa.int32()),
    ("metadata_byte_count", pa.int64()), ("attachment_count", pa.int64()), ("source_profile", pa.string()), ("container_failure", pa.string()),
])
_PROBE_DDL = "format string, width long, height long, frame_count long, orientation int, metadata_byte_count long, attachment_count long, source_profile string, container_failure string"


def probe_bytes(content: bytes | None, limits: DecodeLimits) -> dict:
    """Probe of one image; sizes are as seen after orientation. A null content is corrupt.

    The metadata count is the container's or that of the properties its blocks stand for, whichever is
    larger, and null where a limit ends the count; properties that can't be measured are beyond every limit.
    """
    out: dict = dict.fromkeys(_PROBE.names)
    out["attachment_count"] = 0
    try:
        if content is None:
            raise containers.Corrupt
        if len(content) > limits.encoded_bytes:
            raise containers.Corrupt("encodedBytesExceeded")
        seen = containers.inspect(content, limits.metadata_bytes)
        out |= {"format": seen.format, "metadata_byte_count": seen.metadata_bytes, "source_profile": seen.profile}
        size = containers.dimensions(content)
        if size is None:
            raise containers.Corrupt
        held = properties.properties(content, limits.metadata_bytes)
        if held.size > limits.metadata_bytes:
            out["metadata_byte_count"] = None
            raise containers.Corrupt("metadataLimitExceeded")
        out |= {"metadata_byte_count": max(seen.metadata_bytes, held.size), "attachment_count": held.attachments}
        if held.attachments > limits.attachments:
            raise containers.Corrupt("auxiliaryAttachmentLimitExceeded")
        turned = containers.exif_orientation(content)
        width, height, frames = size
        if turned >= 5:
            width, height = height, width
        out |= {"width": width, "height": height, "frame_count": frames, "orientation": turned}
        if seen.icc is not None and seen.icc[16:20] not in (b"RGB ", b""):
            raise containers.Corrupt
    except containers.Corrupt as e:
        out["container_failure"] = e.failure
    return out


def probed(known: Memo, content: bytes | None, limits: DecodeLimits) -> dict:
    """:func:`probe_bytes`, once for equal files of a worker."""
    return known.get(content, lambda: probe_bytes(content, limits), lambda _: 1_000 + len(content or b""))


def probe(images: DataFrame, content: str = "content", limits: DecodeLimits | None = None) -> DataFrame:
    """``images`` with ``probe`` columns and ``failure``: the container's own failure, else the first limit it breaks. Columns of these names are replaced."""
    limits = limits or DecodeLimits()
    ship(images.sparkSession)
    others = [f for f in images.schema.fields if f.name != content and f.name not in (*_PROBE.names, "failure")]
    names = [f.name for f in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = memo("probe", limits)
        for batch in batches:
            rows = [probed(known, c, limits) for c in batch.column("_content").to_pylist()]
            made = pa.RecordBatch.from_pylist(rows, schema=_PROBE)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *made.columns], names=[*names, *_PROBE.names])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), _PROBE_DDL])
    walked = images.select(*names, F.col(content).cast("binary").alias("_content")).mapInArrow(run, ddl)
    sized = F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False))
    own = F.coalesce(F.col("container_failure"), F.when(~sized, F.lit("unsupportedOrCorruptImage")))
    return walked.withColumn("failure", F.coalesce(own, probe_failure(limits))).drop("container_failure")


def container_parts(images: DataFrame, key: list[str], content: str = "content") -> DataFrame:
    """One row for each chunk, segment or block up to the first corruption: kind, offset, payload_length, is_metadata; corrupt on the last row if the walk failed."""
    schema = pa.schema([("kind", pa.string()), ("offset", pa.int64()), ("payload_length", pa.int64()), ("is_metadata", pa.bool_()), ("failure", pa.string())])
    fields = [images.schema[k] for k in key]
    ship(images.sparkSession)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, index = [], []
            for i, blob in enumerate(batch.column("_content").to_pylist()):
                blob = blob or b""
                format = containers.sniff(blob)
                try:
                    for part in containers.parts(blob):
                        rows.append((part.kind, part.offset, part.length, containers.is_metadata(format, part.kind), None))
                        index.append(i)
                except containers.Corrupt as e:
                    rows.append((None, None, None, None, e.failure))
                    index.append(i)
            columns = [pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, schema)]
            taken = pa.array(index, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(taken) for k in key), *columns], names=[*key, *schema.names])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "kind string, offset long, payload_length long, is_metadata boolean, failure string"])
    return images.select(*key, F.col(content).cast("binary").alias("_content")).mapInArrow(walk, ddl)


def scan_boundaries(images: DataFrame, key: str, content: str = "content") -> DataFrame:
    """One row for each scan of a JPEG and each prefix worth decoding around its end; corrupt images have none."""
    ship(images.sparkSession)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "scan", "entropy_start", "entropy_end", "terminating_marker", "offset", "labels"]
        for batch in batches:
            rows = []
            for name, blob in zip(batch.column(key).to_pylist(), batch.column("_content").to_pylist()):
                try:
                    found = containers.jpeg_scans(blob or b"")
                except containers.Corrupt:
                    continue
                for scan in found:
                    rows += [(name, scan.scan, scan.entropy_start, scan.entropy_end, scan.marker, offset, labels) for offset, labels in containers.checkpoints(scan, len(blob))]
            types = [batch.schema.field(key).type, pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names=names)

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, F.col(content).cast("binary").alias("_content")).mapInArrow(walk, f"`{key}` {kind}, scan int, entropy_start long, entropy_end long, terminating_marker string, offset long, labels array<string>")


def jpeg_structures(images: DataFrame, key: str, content: str = "content") -> DataFrame:
    """Frame header, scan count and the digest of the quantisation tables of each JPEG, and whether it is progressive; corrupt images have nulls and a failure."""
    ship(images.sparkSession)
    schema = pa.schema([("frame_marker", pa.string()), ("sample_precision", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("component_count", pa.int32()), ("quantization_sha256", pa.string()), ("scan_count", pa.int32()), ("failure", pa.string())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for blob in batch.column("_content").to_pylist():
                row = dict.fromkeys(schema.names)
                try:
                    found = containers.jpeg_structure(blob or b"")
                    row |= {k: found[k] for k in ("frame_marker", "sample_precision", "width", "height", "quantization_sha256")}
                    row |= {"component_count": len(found["components"]), "scan_count": len(containers.jpeg_scans(blob))}
                except containers.Corrupt as e:
                    row = dict.fromkeys(schema.names) | {"failure": e.failure}
                rows.append(row)
            made = pa.RecordBatch.from_pylist(rows, schema=schema)
            yield pa.RecordBatch.from_arrays([batch.column(key), *made.columns], names=[key, *schema.names])

    kind = images.schema[key].dataType.simpleString()
    ddl = f"`{key}` {kind}, frame_marker string, sample_precision int, width int, height int, component_count int, quantization_sha256 string, scan_count int, failure string"
    found = images.select(key, F.col(content).cast("binary").alias("_content")).mapInArrow(walk, ddl)
    return found.withColumn("progressive", F.col("frame_marker") == "C2")


def prefix_decodes(images: DataFrame, key: str, content: str = "content") -> DataFrame:
    """One row for each prefix worth decoding around the end of each scan of a JPEG: key, scan, offset, labels, available, pixels_sha256, is_final (equal to the whole file's pixels) and mse_micro against them.

    Each prefix is decoded on its own, as if the file ended there. Corrupt images, and those that don't decode, have no rows.
    """
    import hashlib

    ship(images.sparkSession)
    kind = images.schema[key].dataType.simpleString()
    fields = [("scan", pa.int32()), ("offset", pa.int64()), ("labels", pa.list_(pa.string())), ("available", pa.bool_()), ("pixels_sha256", pa.string()), ("is_final", pa.bool_()), ("mse_micro", pa.int64())]

    def prefixes(blob: bytes) -> list[tuple]:
        try:
            scans, whole = containers.jpeg_scans(blob), jpeg.decode(blob).tobytes()
        except (containers.Corrupt, pixels.PixelError):
            return []
        rows = []
        for scan in scans:
            for offset, labels in containers.checkpoints(scan, len(blob)):
                made, _, _ = jpeg.decode_prefix(blob[:offset])
                if made is None:
                    rows.append((scan.scan, offset, labels, False, None, False, None))
                    continue
                error = pixels.error_metrics(whole, made.tobytes())["mean_squared_error_micro"]
                rows.append((scan.scan, offset, labels, True, hashlib.sha256(made.tobytes()).hexdigest(), error == 0, error))
        return rows

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = memo("prefixes")
        for batch in batches:
            out = Output(pa.schema([(key, batch.schema.field(key).type), *fields]))
            for name, blob in zip(batch.column(key).to_pylist(), batch.column("_content").to_pylist()):
                blob = blob or b""
                for row in known.get(blob, lambda: prefixes(blob), lambda made: len(blob) + 400 * len(made)):
                    out.add((name, *row), 200)
                if out.full:
                    yield out.batch()
            yield out.batch()

    return images.select(key, F.col(content).cast("binary").alias("_content")).mapInArrow(walk, f"`{key}` {kind}, scan int, offset long, labels array<string>, available boolean, pixels_sha256 string, is_final boolean, mse_micro long")


def previews(images: DataFrame, key: str, thresholds: tuple[int, ...] = (1, 2, 4, 8), content: str = "content") -> DataFrame:
    """The pictures that a progressive session shows: one row for each threshold of completed scans before the last (generation, scan), and the final one (generation null), with width, height, pixels and failure.

    A preview that can't be drawn isn't shown; a file that isn't a whole progressive JPEG gives one row with its failure.
    """
    ship(images.sparkSession)
    kind = images.schema[key].dataType.simpleString()
    fields = [("generation", pa.int32()), ("scan", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary()), ("failure", pa.string())]

    def shown(blob: bytes) -> list[tuple]:
        try:
            scans, progressive = containers.jpeg_scans(blob), containers.jpeg_structure(blob)["frame_marker"] == "C2"
            whole = jpeg.decode(blob)
        except containers.Corrupt as e:
            return [(None, None, None, None, None, e.failure)]
        except pixels.PixelError:
            return [(None, None, None, None, None, "decodeFailed")]
        if not progressive:
            return [(None, None, None, None, None, "progressiveDecodingUnsupported")]
        rows = []
        for scan in scans[:-1]:
            if scan.scan in thresholds:
                made, _, _ = jpeg.decode_prefix(blob[: scan.entropy_end])
                if made is not None:
                    rows.append((len(rows) + 1, scan.scan, made.shape[1], made.shape[0], made.tobytes(), None))
        return [*rows, (None, len(scans), whole.shape[1], whole.shape[0], whole.tobytes(), None)]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = memo("previews", thresholds)
        for batch in batches:
            out = Output(pa.schema([(key, batch.schema.field(key).type), *fields]))
            for name, blob in zip(batch.column(key).to_pylist(), batch.column("_content").to_pylist()):
                blob = blob or b""
                for row in known.get(blob, lambda: shown(blob), lambda made: len(blob) + sum(200 + len(r[4] or b"") for r in made)):
                    out.add((name, *row), len(row[4] or b""))
                if out.full:
                    yield out.batch()
            yield out.batch()

    return images.select(key, F.col(content).cast("binary").alias("_content")).mapInArrow(walk, f"`{key}` {kind}, generation int, scan int, width int, height int, pixels binary, failure string")


def decode(images: DataFrame, key: str, target: tuple[int, int], mode: str = "fit", content: str = "content", limits: DecodeLimits | None = None, diagnostics: bool = False) -> DataFrame:
    """key, width, height, channels, pixels (packed rows) and failure: probed, admitted, decoded, oriented, scaled to the target.

    With ``diagnostics`` also decode_ns and render_ns, by a clock that never goes back; all else is the same.

    PNG, JPEG (baseline and progressive), a GIF's first frame and PNM are decoded; what can't be gives decodeFailed.
    """
    limits = limits or DecodeLimits()
    kind = images.schema[key].dataType.simpleString()

    timed = ["decode_ns", "render_ns"] if diagnostics else []
    fields = [("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("pixels", pa.binary()), ("failure", pa.string()), *((t, pa.int64()) for t in timed)]

    def made(blob: bytes, turned: int) -> tuple:
        from time import perf_counter_ns

        spent = [None, None]
        began = perf_counter_ns()
        try:
            raw = pixels.decode(blob)
            spent[0] = perf_counter_ns() - began
            drawn = pixels.rendered(pixels.oriented(raw, turned), *target, mode)
            spent[1] = perf_counter_ns() - began - spent[0]
            if mode == "fit" and (drawn.shape[1] > target[0] or drawn.shape[0] > target[1]):
                raise pixels.PixelError("outside the target")
            return (drawn.shape[1], drawn.shape[0], drawn.shape[2], drawn.tobytes(), None, *spent[: len(timed)])
        except pixels.PixelError:
            return (None, None, None, None, "decodeFailed", *spent[: len(timed)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = memo("decode", target, mode)
        for batch in batches:
            out = Output(pa.schema([(key, batch.schema.field(key).type), *fields]))
            for at, (name, turned, failure) in enumerate(zip(*(batch.column(c).to_pylist() for c in (key, "orientation", "failure")))):
                if failure is not None:
                    out.add((name, None, None, None, None, failure, *(None for _ in timed)))
                    continue
                blob = batch.column("_content")[at].as_py()
                # What is timed is decoded for each row, so that times are of that row.
                row = made(blob, turned) if timed else known.get((blob, turned), lambda: made(blob, turned), lambda r: len(blob) + len(r[3] or b""))
                out.add((name, *row), len(row[3] or b""))
                if out.full:
                    yield out.batch()
            yield out.batch()

    probed = probe(images.select(key, content, F.col(content).alias("_copy")), content, limits)
    return probed.select(key, F.col("_copy").cast("binary").alias("_content"), "orientation", "failure").mapInArrow(run, f"`{key}` {kind}, width int, height int, channels int, pixels binary, failure string" + "".join(f", {t} long" for t in timed))


def decode_pnm_files(images: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key, width, height, channels, pixels and failure of binary PGM and PPM images, as they are."""
    ship(images.sparkSession)
    kind = images.schema[key].dataType.simpleString()
    names = [key, "width", "height", "channels", "pixels", "failure"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, blob in zip(batch.column(key).to_pylist(), batch.column("_content").to_pylist()):
                try:
                    made = pixels.decode_pnm(blob or b"")
                    rows.append((name, made.shape[1], made.shape[0], made.shape[2], made.tobytes(), None))
                except pixels.PixelError:
                    rows.append((name, None, None, None, None, "decodeFailed"))
            types = [batch.schema.field(key).type, pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)], names=names)

    return images.select(key, F.col(content).cast("binary").alias("_content")).mapInArrow(run, f"`{key}` {kind}, width int, height int, channels int, pixels binary, failure string")


def encode(rasters: DataFrame, key: str, background: tuple[int, int, int] | None = None, limits: EncodeLimits | None = None, have: EncodeCapabilities | None = None, format: str = "png", quality: float = 0.9, progressive: bool = False) -> DataFrame:
    """key, content (PNG, or JPEG of a quality) and failure of decoded rows (width, height, channels, pixels); alpha is kept in a PNG, or laid over ``background``.

    A JPEG of pixels with alpha needs a background, else the row fails with unsupported:alphaPreservation.
    """
    if not 0 <= quality <= 1:
        raise ValueError("quality must be 0 to 1")
    limits, have = limits or EncodeLimits(), have or EncodeCapabilities()
    ship(rasters.sparkSession)
    kind = rasters.schema[key].dataType.simpleString()
    admitted = first_failure(
        (F.lit(format in have.formats and format in limits.formats), "formatNotAllowed"),
        (F.lit(format == "png" or background is not None) | F.col("channels").isin(1, 3), "unsupported:alphaPreservation"),
        ((F.least("width", "height") > 0) & (F.greatest("width", "height") <= limits.dimension), "dimensionLimitExceeded"),
        (F.col("width").cast("long") * F.col("height") <= limits.pixel_count, "pixelLimitExceeded"),
    )

    def made(data: bytes | None, width: int, height: int, channels: int) -> tuple[bytes | None, str | None]:
        import numpy as np

        if data is None or len(data) != width * height * channels:
            return None, "encodeFailed"
        raster = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
        raster = pixels.flattened(raster, background) if background else raster
        blob = pixels.encode_png(raster) if format == "png" else jpeg.encode(raster, quality, jpeg.PROGRESSIVE if progressive else None)
        return (None, "encodedBytesExceeded") if len(blob) > limits.encoded_bytes else (blob, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = memo("encode", background, limits, format, quality, progressive)
        for batch in batches:
            out = Output(pa.schema([(key, batch.schema.field(key).type), ("content", pa.binary()), ("failure", pa.string())]))
            for at, (name, width, height, channels, failure) in enumerate(zip(*(batch.column(c).to_pylist() for c in (key, "width", "height", "channels", "failure")))):
                blob = None
                if failure is None:
                    data = batch.column("pixels")[at].as_py()
                    blob, failure = known.get((data, width, height, channels), lambda: made(data, width, height, channels), lambda r: len(data or b"") + len(r[0] or b""))
                out.add((name, blob, failure), len(blob or b""))
                if out.full:
                    yield out.batch()
            yield out.batch()

    return rasters.select(key, "width", "height", "channels", "pixels", F.coalesce("failure", admitted).alias("failure")).mapInArrow(run, f"`{key}` {kind}, content binary, failure string")


def decoded_again(decoded: DataFrame, by: list[str], **encoding) -> DataFrame:
    """Decoded rows with ``again``: the pixels after their picture is encoded and decoded once more. Rows equal in ``by`` are of one task, whose workers make equal pictures once.

    A row travels with its picture: joined to it instead, all pixels would be broadcast through the driver where the table's files are small.
    """
    dealt = spread(decoded, *(F.col(c) for c in by)).withColumn("_row", F.struct(*decoded.columns))
    made = decode(encode(dealt, "_row", **encoding), "_row", (DecodeLimits().dimension,) * 2)
    return made.select("_row.*", F.col("pixels").alias("again"))
