"""Integer and fixed-point conventions as Column builders; none throws on overflow or a zero denominator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_MAX = 9223372036854775807


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def truncated(n, d) -> Column:
    """Integer division that truncates; null for a zero denominator."""
    return F.call_function("div", _column(n).cast("long"), F.nullif(_column(d).cast("long"), F.lit(0).cast("long")))


def ceiled(n, d) -> Column:
    return truncated(_column(n) + _column(d) - 1, d)


def half_up(n, d) -> Column:
    return truncated(_column(n) + truncated(d, 2), d)


def micro(n, d) -> Column:
    """n / d in millionths, truncated."""
    return truncated(_column(n).cast("long") * F.lit(1_000_000).cast("long"), d)


def ppm(n, d) -> Column:
    """A fraction in parts per million, at most one million; 0 where the denominator isn't positive."""
    return F.when(_column(d) > 0, F.least(F.lit(1_000_000).cast("long"), micro(n, d))).otherwise(F.lit(0).cast("long"))


def saturated_product(*factors) -> Column:
    """Product of the factors, negative ones counting as 0, that stops at the largest long."""
    out = F.lit(1).cast("long")
    for factor in factors:
        out = F.coalesce(F.try_multiply(out, F.greatest(F.lit(0), _column(factor)).cast("long")), F.lit(LONG_MAX))
    return out


def saturated_sum(*terms) -> Column:
    out = F.lit(0).cast("long")
    for term in terms:
        out = F.coalesce(F.try_add(out, _column(term).cast("long")), F.lit(LONG_MAX))
    return out


def clamped(x, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _column(x)))


def micro_psnr(squared_micro) -> Column:
    """Micro-decibels of a mean squared error in millionths; 999 dB where it is 0."""
    psnr = F.lit(10.0) * F.log10(F.lit(255.0 * 255.0 * 1e6) / _column(squared_micro).cast("double"))
    return F.when(_column(squared_micro) == 0, F.lit(999_000_000).cast("long")).otherwise(F.floor(psnr * 1e6 + 0.5).cast("long"))


def within(a, b, relative: float = 1e-12) -> Column:
    """Equal up to a relative tolerance."""
    return F.abs(a - b) <= relative * F.greatest(F.abs(a), F.abs(b))
