"""Preview policies: enumeration, exposure, gaps, ranks, leaders and the Pareto frontier."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_up, ppm
from ..shipping import ship
from .statistics import running_counts


def enumerate_policies(spark: SparkSession, low: int = 2, high: int = 9) -> DataFrame:
    """All policies of threshold 1 and three more of low..high, ascending."""
    numbers = spark.range(low, high + 1)
    a, b, c = (numbers.select(F.col("id").cast("int").alias(x)) for x in "abc")
    return a.join(b, F.col("a") < F.col("b")).join(c, F.col("b") < F.col("c")).select(F.array(F.lit(1), "a", "b", "c").alias("thresholds"))


def exposure(rows: DataFrame, keys: list[str], order: str, offset: str, total: str, squared_error: str, channels: str) -> DataFrame:
    """Per series of emitted previews: mean squared error weighted by the bytes it is seen for, in millionths (half up), and the largest gap.

    A preview is seen from its offset to the next one's or to the end.
    """
    upto = F.coalesce(F.lead(offset).over(Window.partitionBy(*keys).orderBy(order)), F.col(total))
    spans = rows.withColumn("_span", upto - F.col(offset))
    per = spans.groupBy(*keys).agg(F.sum(F.col(squared_error) * F.col("_span")).alias("_area"), F.sum("_span").alias("_seen"), F.max("_span").alias("_gap"), F.max(total).alias("_total"), F.max(channels).alias("_channels"), F.count(F.lit(1)).alias("generation_count"))
    return per.select(*keys, "generation_count", half_up(F.col("_area") * F.lit(1_000_000), F.col("_channels") * F.col("_seen")).alias("exposure_mse_micro"), ppm(F.col("_gap"), F.col("_total")).alias("maximum_gap_ppm"))


def summary(per_series: DataFrame, keys: list[str], last_psnr: str) -> DataFrame:
    """Per policy over its series: mean and worst exposure, largest gap, lowest last quality, mean number of previews in millionths."""
    n = F.count(F.lit(1))
    return per_series.groupBy(*keys).agg(
        half_up(F.sum("exposure_mse_micro"), n).alias("mean_exposure_micro"),
        F.max("exposure_mse_micro").alias("worst_exposure_micro"),
        F.max("maximum_gap_ppm").alias("maximum_gap_ppm"),
        F.min(last_psnr).alias("minimum_last_psnr"),
        half_up(F.sum("generation_count") * 1_000_000, n).alias("mean_generations_micro"),
    )


def emitted(policies: DataFrame, scans: DataFrame, scan: str, final: str) -> DataFrame:
    """Scans at which a policy emits: those of its thresholds that come before the final scan. Policies are a bounded enumeration."""
    return scans.crossJoin(F.broadcast(policies)).where(F.array_contains("thresholds", F.col(scan)) & (F.col(scan) < F.col(final)))


def _ranks(frame: pd.DataFrame, measures: list[tuple[str, int]]) -> np.ndarray:
    """Dense ranks of the measures, lower is better: exact for any ordered type."""
    return np.column_stack([np.unique(frame[c].to_numpy(), return_inverse=True)[1] * s for c, s in measures])


def _skyline(values: np.ndarray) -> np.ndarray:
    """Rows that no other row dominates (no worse anywhere, better somewhere); lower is better.

    In lexicographic order only rows that come before can dominate one; they are looked at in blocks.
    """
    order = np.lexsort(values.T[::-1])
    kept = np.empty(len(values), dtype=np.int64)
    n = 0
    for at in range(0, len(order), 256):
        block = order[at : at + 256]
        alive = np.ones(len(block), dtype=bool)
        for low in range(0, n, 4096):
            known = values[kept[low : min(n, low + 4096)], None]
            alive &= ~((known <= values[block]).all(axis=2) & (known < values[block]).any(axis=2)).any(axis=0)
        own = values[block]
        alive &= ~((own[:, None] <= own).all(axis=2) & (own[:, None] < own).any(axis=2)).any(axis=0)
        found = block[alive]
        kept[n : n + len(found)] = found
        n += len(found)
    return np.sort(kept[:n])


def pareto_frontier(rows: DataFrame, minimize: list[str], maximize: list[str]) -> DataFrame:
    """Rows that no row dominates; equal rows don't dominate each other. Rows with a null measure are out.

    Every task of the scan keeps its own frontier; these are dealt out anew to ever fewer tasks, so nothing but
    frontier rows is moved and no pair of all rows is formed. The last task holds the frontier itself.
    """
    measures = [*((c, 1) for c in minimize), *((c, -1) for c in maximize)]
    schema = rows.schema

    def own(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, waiting, size = None, [], 0

        def merged():
            both = pd.concat(waiting if held is None else [held, *waiting], ignore_index=True)
            return both.iloc[_skyline(_ranks(both, measures))].reset_index(drop=True)

        for frame in frames:
            waiting.append(frame)
            size += len(frame)
            if size >= 50_000:
                held, waiting, size = merged(), [], 0
        if waiting:
            held = merged()
        if held is not None and len(held):
            yield held

    spark = ship(rows.sparkSession)
    found = rows.dropna(subset=[c for c, _ in measures]).mapInPandas(own, schema)
    tasks = spark.sparkContext.defaultParallelism
    while tasks > 1:
        tasks = (tasks + 3) // 4
        found = found.repartition(tasks).mapInPandas(own, schema)
    return found


def strict_rank(rows: DataFrame, value: str, descending: bool = False, name: str = "rank") -> DataFrame:
    """1 + the number of rows that are strictly better, by joining each distinct value's rank.

    Values are counted first; distinct values are ordered in ranges, each in a task of its own.
    """
    counts = rows.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_counts(counts, [], value, "_n", descending)
    return rows.join(ranked.select(value, (F.col("_upto") - F.col("_n") + 1).alias(name)), value)


def leaders(rows: DataFrame, key: str, metrics: dict[str, bool]) -> DataFrame:
    """Best key of each metric (True: the largest wins); ties go to the smallest key."""
    best: list[Column] = []
    for metric, largest in metrics.items():
        signed = -F.col(metric) if largest else F.col(metric)
        best.append(F.min(F.struct(signed.alias("m"), F.col(key).alias("k")))["k"].alias(f"{metric}_leader"))
    return rows.agg(*best)
