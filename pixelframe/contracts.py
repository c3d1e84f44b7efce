"""Limits, capabilities and requests as plain values; operators turn them into Column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

FORMATS = ("png", "jpeg", "gif")
METADATA = ("orientation", "sourceColorProfile", "highDynamicRange", "frameTiming")

# The largest limit that is supported for each field.
DECODE_CEILINGS = {
    "encoded_bytes": 1 << 30,
    "dimension": 65_536,
    "pixel_count": 1_000_000_000,
    "frame_count": 4_096,
    "metadata_bytes": 64 << 20,
    "attachments": 1_024,
}
_FLOORS = {"metadata_bytes": 0, "attachments": 0}


@dataclass(frozen=True)
class DecodeLimits:
    """Values outside the supported range are clamped; see :meth:`checked` for the strict form."""

    encoded_bytes: int = 64 << 20
    dimension: int = 16_384
    pixel_count: int = 100_000_000
    frame_count: int = 1
    metadata_bytes: int = 4 << 20
    attachments: int = 0
    formats: tuple[str, ...] = FORMATS

    def __post_init__(self):
        for name, most in DECODE_CEILINGS.items():
            object.__setattr__(self, name, min(most, max(_FLOORS.get(name, 1), getattr(self, name))))

    @classmethod
    def checked(cls, **values) -> DecodeLimits:
        """As read from a document: out-of-range values are refused instead of clamped."""
        made = cls(**values)
        wrong = [name for name, value in values.items() if name in DECODE_CEILINGS and getattr(made, name) != value]
        if wrong:
            raise ValueError(f"out of range: {', '.join(wrong)}")
        return made


@dataclass(frozen=True)
class EncodeLimits:
    dimension: int = 16_384
    pixel_count: int = 100_000_000
    encoded_bytes: int = 64 << 20
    formats: tuple[str, ...] = ("png", "jpeg")


@dataclass(frozen=True)
class DecodeCapabilities:
    formats: tuple[str, ...] = FORMATS
    delivery: tuple[str, ...] = ("completeFrame", "progressiveGenerations")
    progressive_formats: tuple[str, ...] = ("jpeg",)
    tracks: tuple[str, ...] = ("primaryFrame",)
    metadata: tuple[str, ...] = ("orientation", "sourceColorProfile")
    ranges: tuple[str, ...] = ("standard",)
    outputs: tuple[str, ...] = ("coreGraphicsImage",)
    cancellation: int = 0


@dataclass(frozen=True)
class EncodeCapabilities:
    formats: tuple[str, ...] = ("png", "jpeg")
    lossless: tuple[str, ...] = ("png",)
    lossy: tuple[str, ...] = ("jpeg",)
    colours: tuple[str, ...] = ("preserveSource", "convertToSRGB")
    metadata: tuple[str, ...] = ("discard", "preserveRecognized")
    alpha_preserving: tuple[str, ...] = ("png",)
    alpha_flattening: tuple[str, ...] = ("png", "jpeg")


@dataclass(frozen=True)
class CodecDescriptor:
    identifier: str
    implementation_version: int
    contract_version: int = 2
    capabilities: DecodeCapabilities = field(default_factory=DecodeCapabilities)

    @property
    def fingerprint(self) -> str:
        return f"{self.identifier}#impl={self.implementation_version}#contract={self.contract_version}"
