"""Scans along long streams in parallel: running sums, running maxima and the queue recursion over segments of a stream.

A window over a stream runs in one task. Streams of more than ``SEGMENT_ROWS`` rows are cut by range of their order into segments of about that many
rows; each segment is scanned on its own, summed up in one row, and the few summary rows of a stream are scanned to tell what each segment
starts from. What is combined is associative: sums add up, prefix maxima shift by the sum before them, and the queue's step
end = max(arrival, end before) + service is a pair (sum of service, latest end from an empty queue) in max-plus algebra.

Rows that agree in keys and order stay in one segment, so ``order`` should tell a stream's rows apart. Shorter streams have one segment and cost what a window does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import held

#: Rows of a stream from which on it is cut.
SEGMENT_ROWS = 1_000_000
SEGMENT = "_segment"


def _joined(left: DataFrame, right: DataFrame, names: list[str], how: str) -> DataFrame:
    """A join on columns of which nulls are equal too; the right side is a summary and brings its other columns."""
    told = right.withColumnsRenamed({n: f"_r_{n}" for n in names})
    on = reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.col(f"_r_{n}")) for n in names))
    return left.join(told, on, how).drop(*(f"_r_{n}" for n in names))


def segmented(rows: DataFrame, keys: list[str], order: list[str], size: int | None = SEGMENT_ROWS) -> tuple[DataFrame, bool]:
    """``rows`` with their segment, numbered along each stream's order, and whether any stream has more than one.

    The keys of long streams are broadcast: there is at most one for every ``size`` rows. With ``size`` None streams are known to be short.
    """
    whole = rows.withColumn(SEGMENT, F.lit(0))
    if size is None:
        return whole, False
    long = held(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > size))
    total = long.agg(F.sum("_rows")).first()[0]
    if not total:
        return whole, False
    long = F.broadcast(long.drop("_rows"))
    cut = _joined(rows, long, keys, "left_semi").repartitionByRange(-(-total // size) + 1, *keys, *order).withColumn(SEGMENT, F.spark_partition_id())
    return held(cut).unionByName(_joined(whole, long, keys, "left_anti")), True


def _upto(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys, SEGMENT).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)


def running_sum(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str, size: int | None = SEGMENT_ROWS) -> DataFrame:
    """``rows`` with the sum of ``value`` up to each of them along their stream."""
    parts, several = segmented(rows, keys, order, size)
    local = parts.withColumn(out, F.sum(value).over(_upto(keys, order)))
    if several:
        totals = parts.groupBy(*keys, SEGMENT).agg(F.sum(value).alias("_sum")).withColumn("_base", F.sum("_sum").over(_before(keys))).drop("_sum")
        local = _joined(local, totals, [*keys, SEGMENT], "left").withColumn(out, F.coalesce(F.col(out) + F.col("_base"), F.col(out), F.col("_base"))).drop("_base")
    return local.drop(SEGMENT)


def highest_sum(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str, size: int | None = SEGMENT_ROWS) -> DataFrame:
    """One row for each stream: the highest of its running sums."""
    parts, _ = segmented(rows, keys, order, size)
    local = parts.withColumn("_sum", F.sum(value).over(_upto(keys, order)))
    peaks = local.groupBy(*keys, SEGMENT).agg(F.max("_sum").alias("_top"), F.sum(value).alias("_total"))
    based = peaks.withColumn("_top", F.col("_top") + F.coalesce(F.sum("_total").over(_before(keys)), F.lit(0)))
    return based.groupBy(*keys).agg(F.max("_top").alias(out))


def queue_ends(rows: DataFrame, keys: list[str], order: list[str], arrival: str, service: str, out: str, size: int | None = SEGMENT_ROWS) -> DataFrame:
    """``rows`` with the time at which a first-come server is done with each: max(arrival, the end before) + service.

    Unrolled that is served + max over the rows so far of (arrival - served before), where served is the running service time.
    """
    parts, several = segmented(rows, keys, order, size)
    window = _upto(keys, order)
    local = parts.withColumn("_served", F.sum(service).over(window)).withColumn("_free", F.col(arrival) - (F.col("_served") - F.col(service)))
    if several:
        totals = local.groupBy(*keys, SEGMENT).agg(F.sum(service).alias("_sum"), F.max("_free").alias("_top")).withColumn("_base", F.coalesce(F.sum("_sum").over(_before(keys)), F.lit(0)))
        totals = totals.withColumn("_earlier", F.max(F.col("_top") - F.col("_base")).over(_before(keys))).drop("_sum", "_top")
        free = F.max("_free").over(window)
        local = _joined(local.withColumn("_free", free), totals, [*keys, SEGMENT], "left").withColumn(out, F.col("_served") + F.col("_base") + F.greatest(F.col("_free") - F.col("_base"), F.col("_earlier")))
        return local.drop("_served", "_free", "_base", "_earlier", SEGMENT)
    return local.withColumn(out, F.col("_served") + F.max("_free").over(window)).drop("_served", "_free", SEGMENT)
