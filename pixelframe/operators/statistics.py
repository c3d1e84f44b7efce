"""Nearest-rank statistics, pooled and positional aggregation, distributions, budgets and ranges."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.documents import canonical
from ..functions.numeric import truncated
from ..shipping import ship

#: Ranges that a group's distinct values are cut into, and how many values a range should have at least.
RANGES, RANGE_ROWS = 256, 4096


def running_counts(counted: DataFrame, groups: list[str], value: str, count: str, descending: bool = False) -> DataFrame:
    """``counted`` (one row for each value of a group) with _upto, the sum of ``count`` up to the value, and _all, the group's sum.

    No task orders a whole group: quantiles, which needn't be exact, cut a large group's values into ranges,
    sums by range give what stands before each, and windows run inside ranges.
    """
    n = F.least(F.lit(RANGES), F.floor(F.count(F.lit(1)) / RANGE_ROWS)).cast("int")
    quantiles = F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 4 * RANGES)
    cuts = counted.groupBy(*groups).agg(n.alias("_ranges"), quantiles.alias("_q")).select(*groups, F.when(F.col("_ranges") > 1, F.array_distinct("_q")).alias("_cuts"))
    known = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)]
    cuts = cuts.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), "_cuts", F.filter("_cuts", lambda _, i: i % 16 == 15).alias("_coarse")).where("_cuts IS NOT NULL")
    # A row for each group of more than RANGE_ROWS values.
    placed = counted.join(cuts, reduce(and_, known) if known else F.lit(True), "left").drop(*(f"_g{i}" for i in range(len(groups))))
    # Two steps: every sixteenth cut, then those in between.
    coarse = F.size(F.filter("_coarse", lambda c: c < F.col(value)))
    placed = placed.withColumn("_at", coarse * 16)
    below = F.col("_at") + F.size(F.filter(F.slice("_cuts", F.col("_at") + 1, F.lit(16)), lambda c: c < F.col(value)))
    placed = placed.withColumn("_range", F.coalesce(-below if descending else below, F.lit(0))).drop("_cuts", "_coarse", "_at")
    sums = placed.groupBy(*groups, "_range").agg(F.sum(count).alias("_sum"))
    own = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_sum").over(own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), F.col("_range").alias("_r"), before.alias("_before"), F.sum("_sum").over(own).alias("_all"))
    order = F.col(value).desc() if descending else F.col(value)
    upto = Window.partitionBy(*groups, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = placed.join(sums, reduce(and_, [*known, F.col("_range") == F.col("_r")]))
    return joined.select(*counted.columns, (F.sum(count).over(upto) + F.col("_before")).alias("_upto"), "_all")


def nearest_rank(rows: DataFrame, groups: list[str], value: str, names: dict[str, tuple[int, int]]) -> DataFrame:
    """Nearest-rank percentiles (numerator, denominator) per group, exactly.

    Equal values are counted before they are ordered, so what is shuffled is a row for
    each distinct value of a group; a large group's values are ordered in ranges.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_counts(counted, groups, value, "_n")

    def rank(numerator: int, denominator: int) -> Column:
        wanted = F.greatest(F.lit(1).cast("long"), truncated(F.col("_all") * numerator + (denominator - 1), denominator))
        return F.min(F.when(F.col("_upto") >= wanted, F.col(value)))

    return placed.groupBy(*groups).agg(*(rank(*p).alias(name) for name, p in names.items()))


def duration_statistics(rows: DataFrame, groups: list[str], value: str, scale: int = 1) -> DataFrame:
    """count, minimum, median, p90, maximum and truncated mean (in 1 / ``scale``) per group."""
    plain = rows.groupBy(*groups).agg(F.count(value).alias("count"), F.min(value).alias("minimum"), F.max(value).alias("maximum"), F.sum(value).alias("_sum"))
    ranks = nearest_rank(rows, groups, value, {"median": (1, 2), "p90": (9, 10)})
    return plain.join(ranks, groups).select(*groups, "count", "minimum", "median", "p90", "maximum", truncated(F.col("_sum") * scale, F.col("count")).alias("mean"))


def positional(rows: DataFrame, groups: list[str], array: str) -> DataFrame:
    """Index-wise statistics of arrays: one row for each group and position."""
    long = rows.select(*groups, F.posexplode(array).alias("position", "value"))
    return duration_statistics(long, [*groups, "position"], "value")


def distribution(rows: DataFrame, groups: list[str]) -> DataFrame:
    return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("frequency"))


def stable(rows: DataFrame, groups: list[str], fields: list[str]) -> DataFrame:
    """Per group, whether each field has one value (null is a value of its own)."""
    values = {f: F.count_distinct(F.col(f).cast("string")) + F.max(F.col(f).isNull().cast("int")) for f in fields}
    return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("reports"), *((n == 1).alias(f"{f}_stable") for f, n in values.items()))


def pair_determinism(rows: DataFrame, key: str, content: Column, expected: int = 2, documents: bool = False) -> DataFrame:
    """Per key: number of reports, of distinct contents, and whether there are exactly the expected ones and all are equal.

    With ``documents`` contents are JSON and compared in canonical form; one that isn't JSON leaves a key undetermined.
    """
    compared = canonical(content.cast("string")) if documents else content
    if documents:
        ship(rows.sparkSession)
    hashed = rows.select(key, F.sha2(compared.cast("binary"), 256).alias("_h"))
    counted = hashed.groupBy(key).agg(F.count(F.lit(1)).alias("reports"), F.count_distinct("_h").alias("contents"), F.count("_h").alias("_read"))
    return counted.withColumn("deterministic", (F.col("reports") == expected) & (F.col("contents") == 1) & (F.col("_read") == F.col("reports"))).drop("_read")


def budget(value, factor_percent: int, additive: int) -> Column:
    """max(value * factor, value + additive), rounded up."""
    product = truncated(F.col(value) * factor_percent + 99, 100)
    return F.greatest(product, (F.col(value) + additive).cast("long"))


def regression_check(observed: DataFrame, baseline: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Full join on ``key``: what is missing on either side, and which metric is over its budget column ``<metric>_budget``."""
    both = observed.select(key, *metrics).join(baseline.select(key, *(f"{m}_budget" for m in metrics)).withColumn("_b", F.lit(True)), key, "full_outer")
    over = [F.when(F.col(m) > F.col(f"{m}_budget"), F.lit(m)) for m in metrics]
    status = F.when(F.col("_b").isNull(), F.lit("no baseline")).when(F.col(metrics[0]).isNull(), F.lit("not observed")).otherwise(F.coalesce(*(F.concat(o, F.lit(" over budget")) for o in over), F.lit("ok")))
    return both.select(key, status.alias("status"))


def last_row_ranges(rows: DataFrame, groups: list[str], member: str, order: list[str], values: list[str]) -> DataFrame:
    """Range over members of the values in each member's last row."""
    last = rows.groupBy(*groups, member).agg(F.max(F.struct(*order, *values)).alias("_last"))
    return last.groupBy(*groups).agg(F.count(F.lit(1)).alias("members"), *(x for v in values for x in (F.min(f"_last.{v}").alias(f"min_{v}"), F.max(f"_last.{v}").alias(f"max_{v}"))))


def intervals_meet(rows: DataFrame, groups: list[str], upper: str, width: int) -> DataFrame:
    """Intersection of the half-open intervals (upper - width, upper]: its bounds, and whether it holds a point."""
    out = rows.groupBy(*groups).agg((F.max(upper) - width).alias("lower"), F.min(upper).alias("upper"))
    return out.withColumn("meets", F.col("lower") < F.col("upper"))
