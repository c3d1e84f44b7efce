"""Checks of whole reports, summaries of optional fields, and values with a domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import micro
from .statistics import duration_statistics, nearest_rank


def first_broken(rules: dict[str, Column]) -> Column:
    """Name of the first rule that doesn't hold (a null doesn't), or null."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()))


def quality_report_rules(cases: dict[str, int], schema_version: int, generations: int = 4, width: int = 512, height: int = 341) -> dict[str, Column]:
    """What a quality report must fulfil, in order. ``cases``: chunk size by case id.

    Columns: schema_version, build, case_id, chunk_size, runtime, fingerprint, low_power, thermal, encoded_bytes, encoded_sha256,
    final_sha256, width, height, generations array<struct<generation, source_bytes, fraction_ppm, sha256>>.
    """
    sizes = F.create_map(*(F.lit(x) for pair in cases.items() for x in pair))
    series = F.transform("generations", lambda g: g["source_bytes"])
    return {
        "schema": F.col("schema_version") == schema_version,
        "build": F.col("build") == "release",
        "case": F.col("case_id").isin(*cases),
        "chunk size": F.col("chunk_size") == sizes[F.col("case_id")],
        "runtime": (F.col("runtime") != "") & (F.col("fingerprint") != ""),
        "low power": ~F.coalesce(F.col("low_power"), F.lit(False)),
        "thermal state": F.col("thermal").isin("nominal", "fair"),
        "encoded bytes": F.col("encoded_bytes") > 0,
        "digests": (F.col("encoded_sha256") != "") & (F.col("final_sha256") != ""),
        "output": (F.col("width") == width) & (F.col("height") == height),
        "generation count": F.size("generations") == generations,
        "generation numbers": F.transform("generations", lambda g: g["generation"].cast("long")) == F.sequence(F.lit(1).cast("long"), F.lit(generations).cast("long")),
        "source bytes": (series == F.array_sort(series)) & (F.size(F.array_distinct(series)) == generations),
        "fractions": F.forall("generations", lambda g: g["fraction_ppm"] == micro(g["source_bytes"], F.col("encoded_bytes"))),
        "generation digests": F.forall("generations", lambda g: g["sha256"] != ""),
    }


def count_statistics(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """count, minimum, median, p90, maximum and the mean in millionths, truncated."""
    return duration_statistics(rows, groups, value, 1_000_000).withColumnRenamed("mean", "mean_micro")


def memory_statistics(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Per group (one case's reports, a handful): its deltas in order, their nearest-rank median and maximum."""
    listed = rows.groupBy(*groups).agg(F.array_sort(F.collect_list(value)).alias("deltas"), F.max(value).alias("maximum"))
    return listed.join(nearest_rank(rows, groups, value, {"median": (1, 2)}), groups)


def optional_summary(rows: DataFrame, groups: list[str], fields: list[str]) -> DataFrame:
    """One row for each group and field that has values: duration statistics over those; null and missing fields are left out."""
    long = rows.select(*groups, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("long").alias("value")) for f in fields))).alias("f")).select(*groups, "f.*")
    return duration_statistics(long.where("value IS NOT NULL"), [*groups, "field"], "value")


def subset(left: Column, right: Column) -> Column:
    """Whether every element of an array is in another one."""
    return F.size(F.array_except(left, right)) == 0


def conservative_maximum(generic: Column, backend: Column) -> Column:
    """The larger of two positive estimates; null if either isn't positive."""
    return F.when((generic > 0) & (backend > 0), F.greatest(generic, backend))


def quality_failure(quality: Column) -> Column:
    return F.when(~F.coalesce(~F.isnan(quality) & quality.between(0, 1), F.lit(False)), F.lit("invalidQuality"))


def orientation_failure(orientation: Column, metadata_policy: Column) -> Column:
    """An orientation must be 1 to 8, and one other than null needs metadata that is kept."""
    wrong = ~orientation.between(1, 8)
    return F.when(orientation.isNotNull() & wrong, F.lit("invalidOrientation")).when(orientation.isNotNull() & (metadata_policy != "preserveRecognized"), F.lit("orientationNeedsMetadata"))


def sampled_peaks(samples: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Per run the first sample, the largest, and by how much that exceeds the first."""
    out = samples.groupBy(*keys).agg(F.min_by(value, order).alias("baseline"), F.max(value).alias("peak"), F.count(F.lit(1)).alias("samples"))
    return out.withColumn("peak_delta", F.greatest(F.lit(0).cast("long"), (F.col("peak") - F.col("baseline")).cast("long")))
