"""Admission and negotiation: ordered checks whose first failure is a column, and the sizes they rest on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import METADATA, DecodeCapabilities, DecodeLimits, EncodeCapabilities, EncodeLimits
from ..functions.numeric import saturated_product, saturated_sum


def first_failure(*checks: tuple[Column, str | Column]) -> Column:
    """The name of the first check whose condition isn't true; null if all hold."""
    out = F.lit(None).cast("string")
    for holds, failure in reversed(checks):
        out = F.when(F.coalesce(holds, F.lit(False)), out).otherwise(failure if isinstance(failure, Column) else F.lit(failure))
    return out


def one_of(x: Column, values) -> Column:
    return x.isin(*values) if values else F.lit(False)


def probe_failure(limits: DecodeLimits, format="format", width="width", height="height", frames="frame_count", metadata="metadata_byte_count", attachments="attachment_count") -> Column:
    """Re-validation of a probe: format, dimensions, pixels, frames, metadata, attachments."""
    w, h = F.col(width).cast("long"), F.col(height).cast("long")
    return first_failure(
        (one_of(F.col(format), limits.formats), "unsupportedFormat"),
        (F.greatest(w, h) <= limits.dimension, "dimensionLimitExceeded"),
        (saturated_product(w, h) <= limits.pixel_count, "pixelLimitExceeded"),
        (F.col(frames) <= limits.frame_count, "frameLimitExceeded"),
        (F.col(metadata) <= limits.metadata_bytes, "metadataLimitExceeded"),
        (F.col(attachments) <= limits.attachments, "auxiliaryAttachmentLimitExceeded"),
    )


def dimension_failure(limits: DecodeLimits, width: Column, height: Column) -> Column:
    return first_failure(
        ((width > 0) & (height > 0), "unsupportedOrCorruptImage"),
        (F.greatest(width, height) <= limits.dimension, "dimensionLimitExceeded"),
        (saturated_product(width, height) <= limits.pixel_count, "pixelLimitExceeded"),
    )


def decode_support(have: DecodeCapabilities) -> Column:
    """First gap of a request row (format, delivery, track, metadata array, dynamic_range, output, cancellation), or null."""
    missing = F.array_min(F.array_except("metadata", _strings(have.metadata)))
    progressive = (F.col("delivery") != "progressiveGenerations") | one_of(F.col("format"), have.progressive_formats)
    return first_failure(
        (one_of(F.col("format"), have.formats), F.concat(F.lit("format:"), F.col("format"))),
        (one_of(F.col("delivery"), have.delivery), F.concat(F.lit("delivery:"), F.col("delivery"))),
        (progressive, F.concat(F.lit("delivery:"), F.col("delivery"))),
        (one_of(F.col("track"), have.tracks), F.concat(F.lit("track:"), F.col("track"))),
        (missing.isNull(), F.concat(F.lit("metadata:"), missing)),
        (one_of(F.col("dynamic_range"), have.ranges), F.concat(F.lit("range:"), F.col("dynamic_range"))),
        (one_of(F.col("output"), have.outputs), F.concat(F.lit("output:"), F.col("output"))),
        (F.col("cancellation") <= have.cancellation, F.lit("cancellation")),
    )


def capability_domain(spark: SparkSession, formats, deliveries, tracks, ranges, outputs, cancellations) -> DataFrame:
    """Every request over finite domains, with all subsets of the metadata kinds."""

    bits = F.transform(F.sequence(F.lit(0), F.lit(len(METADATA) - 1)), lambda i: F.when(F.call_function("shiftright", F.col("m"), i).bitwiseAND(1) == 1, F.element_at(_strings(METADATA), i + 1)))
    out = spark.range(1 << len(METADATA)).select(F.col("id").cast("int").alias("m")).select(F.filter(bits, lambda x: x.isNotNull()).alias("metadata"))
    for name, items in (("format", formats), ("delivery", deliveries), ("track", tracks), ("dynamic_range", ranges), ("output", outputs), ("cancellation", cancellations)):
        out = out.withColumn(name, F.explode(F.array(*(F.lit(x) for x in items))))
    return out


def _strings(items) -> Column:
    return F.array(*(F.lit(x) for x in items)).cast("array<string>")


def encode_support(have: EncodeCapabilities) -> Column:
    """First gap of an encode request row (format, compression, colour, metadata_policy, alpha_policy, has_alpha), or null. Rejecting alpha is no capability."""
    format, alpha = F.col("format"), F.col("alpha_policy")
    compression = F.when(F.col("compression") == "lossless", one_of(format, have.lossless)).otherwise(one_of(format, have.lossy))
    return first_failure(
        (one_of(format, have.formats), "format"),
        (compression, "compression"),
        (one_of(F.col("colour"), have.colours), "colorPolicy"),
        (one_of(F.col("metadata_policy"), have.metadata), "metadataPolicy"),
        ((alpha != "preserve") | ~F.col("has_alpha") | one_of(format, have.alpha_preserving), "alphaPreservation"),
        ((alpha != "flatten") | one_of(format, have.alpha_flattening), "alphaFlattening"),
    )


def encode_failure(have: EncodeCapabilities, limits: EncodeLimits) -> Column:
    """Capabilities, then allowed formats, rejected alpha, dimensions and pixels."""
    gap = encode_support(have)
    w, h = F.col("width").cast("long"), F.col("height").cast("long")
    return first_failure(
        (gap.isNull(), F.concat(F.lit("unsupported:"), gap)),
        (one_of(F.col("format"), limits.formats), "formatNotAllowed"),
        (~((F.col("alpha_policy") == "reject") & F.col("has_alpha")), "alphaRejected"),
        ((F.least(w, h) > 0) & (F.greatest(w, h) <= limits.dimension), "dimensionLimitExceeded"),
        (saturated_product(w, h) <= limits.pixel_count, "pixelLimitExceeded"),
    )


def _scale(width: Column, height: Column, target_width: Column, target_height: Column, mode: Column) -> Column:
    a, b = target_width.cast("double") / width.cast("double"), target_height.cast("double") / height.cast("double")
    return F.least(F.lit(1.0), F.when(mode == "fit", F.least(a, b)).otherwise(F.greatest(a, b)))


def thumbnail_limit(width: Column, height: Column, target_width: Column, target_height: Column, mode: Column) -> Column:
    """Longest side a decode for a target asks for: floored, at least 1, never enlarged."""
    longest = F.greatest(width, height)
    return F.greatest(F.lit(1).cast("long"), F.least(longest, F.floor(longest.cast("double") * _scale(width, height, target_width, target_height, mode))).cast("long"))


def working_set(width: Column, height: Column, target_width: Column, target_height: Column, mode: Column, bytes_per_pixel: int = 4) -> Column:
    """Bytes for two thumbnail surfaces and the output, saturating; sides are rounded up here."""
    scale = F.greatest(F.lit(0.0), _scale(width, height, target_width, target_height, mode))

    def side(x: Column) -> Column:
        return F.greatest(F.lit(1).cast("long"), F.least(x, F.ceil(x.cast("double") * scale).cast("long")))

    thumb = saturated_product(side(width), side(height), bytes_per_pixel)
    out = saturated_product(F.least(side(width), target_width), F.least(side(height), target_height), bytes_per_pixel)
    return F.when((width > 0) & (height > 0), saturated_sum(thumb, thumb, out)).otherwise(F.lit(9223372036854775807))


def conservative(generic: Column, backend: Column) -> Column:
    """The larger of two estimates; null unless both are positive."""
    return F.when((generic > 0) & (backend > 0), F.greatest(generic, backend))


def orientation(x: Column) -> Column:
    return F.when(x.between(1, 8), x).otherwise(F.lit(1))


def fingerprint(identifier: Column, implementation: Column, contract: Column) -> Column:
    return F.concat(identifier, F.lit("#impl="), implementation.cast("string"), F.lit("#contract="), contract.cast("string"))


def sniffed_format(content: Column) -> Column:
    """Container format by leading bytes, JVM-side; null if unknown."""
    head = F.hex(F.substring(content.cast("binary"), 1, 8))
    return F.when(head == "89504E470D0A1A0A", "png").when(head.startswith("FFD8"), "jpeg").when(head.startswith("474946383761") | head.startswith("474946383961"), "gif")


def error_class(generation: Column, psnr: Column, mae: Column, most: Column, at_most_8: Column, at_most_16: Column) -> tuple[Column, Column]:
    """(coarse, near final) of a preview's error metrics."""
    coarse = (generation <= 2) & (psnr < 25_000_000) & (mae > 10_000_000) & (at_most_16 < 600_000)
    near = (generation >= 3) & (psnr >= 40_000_000) & (mae <= 2_000_000) & (most <= 8) & (at_most_8 == 1_000_000)
    return coarse, near


def environment_admitted(low_power: Column, thermal: Column) -> Column:
    return ~low_power & thermal.isin("nominal", "fair")
