"""Pixel error metrics between paired byte arrays, JVM-side, and checks of recorded metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import micro, micro_psnr

COVERAGE = (8, 16, 32, 64)


def quantised(values: Column) -> Column:
    """Numbers of -1..1 as 0..255."""
    return F.transform(values, lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 1) * 127.5))).cast("int"))


def _at_most(most: int):
    return lambda x: x <= most


def error_metrics(rows: DataFrame, keys: list[str], reference: str, candidate: str) -> DataFrame:
    """Counts, sums and fixed-point metrics of two arrays of equal length per row; no shuffle. Rows of unequal or zero length are out."""
    difference = F.zip_with(reference, candidate, lambda a, b: F.abs(a - b).cast("long"))
    fits = (F.size(reference) == F.size(candidate)) & (F.size(reference) > 0)
    d = rows.where(fits).select(*keys, difference.alias("_d"))
    zero = F.lit(0).cast("long")
    d = d.select(
        *keys,
        F.size("_d").cast("long").alias("channel_count"),
        F.size(F.filter("_d", lambda x: x > 0)).cast("long").alias("different_channel_count"),
        F.array_max("_d").alias("maximum_absolute_error"),
        F.aggregate("_d", zero, lambda s, x: s + x).alias("absolute_error_sum"),
        F.aggregate("_d", zero, lambda s, x: s + x * x).alias("squared_error_sum"),
        *(F.size(F.filter("_d", _at_most(m))).cast("long").alias(f"_le{m}") for m in COVERAGE),
    )
    n = F.col("channel_count")
    mse = micro(F.col("squared_error_sum"), n)
    return d.select(
        *keys, "channel_count", "different_channel_count", "maximum_absolute_error", "absolute_error_sum", "squared_error_sum",
        micro(F.col("absolute_error_sum"), n).alias("mae_micro"), mse.alias("mse_micro"), micro_psnr(mse).alias("psnr_micro_db"),
        *(micro(F.col(f"_le{m}"), n).alias(f"at_most_{m}_ppm") for m in COVERAGE),
    )


def inconsistent(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose recorded metrics contradict their own sums, with the first rule they break."""
    n = F.col("channel_count")
    rules = {
        "mae": F.col("mae_micro") == micro(F.col("absolute_error_sum"), n),
        "mse": F.col("mse_micro") == micro(F.col("squared_error_sum"), n),
        "coverage": F.lit(True),
        "maximum": F.col("maximum_absolute_error") <= F.col("absolute_error_sum"),
    }
    for low, high in zip(COVERAGE, COVERAGE[1:]):
        rules["coverage"] = rules["coverage"] & (F.col(f"at_most_{low}_ppm") <= F.col(f"at_most_{high}_ppm"))
    broken = F.coalesce(*(F.when(~ok, F.lit(name)) for name, ok in rules.items()))
    return rows.select(*keys, broken.alias("broken")).where("broken IS NOT NULL")
