"""Lookups, completeness, schedule pairs, comparisons and sequence checks between report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def star_lookup(facts: DataFrame, dimensions: list[tuple[DataFrame, str, str]], agrees: Column) -> DataFrame:
    """Facts with each dimension (frame, fact key, dimension key) joined in, as far as ``agrees`` holds."""
    joined = reduce(lambda left, d: left.join(d[0], F.col(d[1]) == F.col(d[2])), dimensions, facts)
    return joined.where(agrees)


def completeness(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Combinations that are expected but missing, or observed but unexpected."""
    want, have = expected.select(*keys).distinct().withColumn("_w", F.lit(1)), observed.select(*keys).distinct().withColumn("_h", F.lit(1))
    both = want.join(have, keys, "full_outer").where("_w IS NULL OR _h IS NULL")
    return both.select(*keys, F.when(F.col("_h").isNull(), "missing").otherwise("unexpected").alias("status"))


def schedule_pairs(rows: DataFrame, keys: list[str], schedule: str, first, second, values: list[str]) -> DataFrame:
    """Rows of two schedules side by side on their common keys, with the change of each value; one aggregate, no self-join."""
    picked = rows.where(F.col(schedule).isin(first, second))

    def of(s, v):
        return F.max(F.when(F.col(schedule) == s, F.col(v)))

    wide = picked.groupBy(*keys).agg(*(of(s, v).alias(f"{v}_{tag}") for v in values for s, tag in ((first, "a"), (second, "b"))), F.count_distinct(schedule).alias("_n")).where("_n = 2")
    return wide.select(*keys, *(c for v in values for c in (f"{v}_a", f"{v}_b", (F.col(f"{v}_b") - F.col(f"{v}_a")).alias(f"{v}_change"))))


def ratios(rows: DataFrame, key: str, phase: str, value: str, phases: tuple[str, str, str]) -> DataFrame:
    """Before, after and clean values per key, the speed-up and how well the clean run reproduces it."""
    before, after, clean = (F.max(F.when(F.col(phase) == p, F.col(value))).alias(n) for p, n in zip(phases, ("before", "after", "clean")))
    wide = rows.groupBy(key).agg(before, after, clean).dropna()
    return wide.withColumns({"speed_up": F.col("before") / F.col("after"), "reproduction": F.col("clean") / F.col("after")})


def monotone(rows: DataFrame, keys: list[str], order: list[str], value: str, strict: bool = True) -> DataFrame:
    """Per series: number of rows and of steps against the order."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    wrong = F.col(value) <= before if strict else F.col(value) < before
    return rows.withColumn("_wrong", F.coalesce(wrong, F.lit(False))).groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), F.count_if("_wrong").alias("violations"))


def contiguous(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Per series, whether numbers are exactly 1..n."""
    return rows.groupBy(*keys).agg(((F.min(number) == 1) & (F.max(number) == F.count(F.lit(1))) & (F.count_distinct(number) == F.count(F.lit(1)))).alias("contiguous"))


def quality_series(rows: DataFrame, keys: list[str], order: str, psnr: str, size: str, least: float, spread: float) -> DataFrame:
    """Per series of rising quality settings: whether every PSNR reaches ``least``, none falls, their range is at least ``spread`` and sizes strictly rise."""
    window = Window.partitionBy(*keys).orderBy(order)
    steps = rows.withColumns({"_p": F.lag(psnr).over(window), "_s": F.lag(size).over(window)})
    return steps.groupBy(*keys).agg(
        F.bool_and(F.col(psnr) >= least).alias("reaches"),
        F.bool_and(F.coalesce(F.col(psnr) >= F.col("_p"), F.lit(True))).alias("never_falls"),
        (F.max(psnr) - F.min(psnr) >= spread).alias("spreads"),
        F.bool_and(F.coalesce(F.col(size) > F.col("_s"), F.lit(True))).alias("grows"),
    )


def equal_tables(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (with multiplicity) that only one of two tables of one schema holds."""
    a = left.exceptAll(right).withColumn("side", F.lit("left"))
    return a.unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


#: Kinds of relations that are part of an interface.
RELATIONS = ("conformsTo", "inheritsFrom")


def relationships(symbols: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = RELATIONS) -> DataFrame:
    """Relations of public symbols (symbols: id, name, access; edges: source, target, target_fallback, kind), of the given kinds, by source, kind and target.

    The target is its fallback name, where it has one, else its identifier.
    """
    public = symbols.where("access IN ('public', 'open')").select(F.col("id").alias("source"), F.col("name").alias("source_name"))
    own = edges.where(F.col("kind").isin(*kinds)).join(public, "source")
    named = own.select("source_name", "kind", F.coalesce(F.nullif(F.col("target_fallback"), F.lit("")), F.col("target")).alias("target"))
    return named.orderBy("source_name", "kind", "target")


def scan_script(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """Statements of scripts with # comments and ; separators: place and trimmed statement."""
    bare = F.regexp_replace(F.col(text), r"#[^\n]*", "")
    listed = F.filter(F.transform(F.split(bare, ";"), lambda s: F.regexp_replace(s, r"^[ \t\r\n]+|[ \t\r\n]+$", "")), lambda s: s != "")
    return rows.select(*key, F.posexplode(listed).alias("place", "statement"))


def attempts_equal(rows: DataFrame, keys: list[str], fresh: str, sequential: str) -> DataFrame:
    """Per group, whether every row's two attempts (structs of available and digest) agree, and whether all available fresh ones have one digest."""
    agree = F.col(f"{fresh}.available").eqNullSafe(F.col(f"{sequential}.available")) & F.col(f"{fresh}.digest").eqNullSafe(F.col(f"{sequential}.digest"))
    shown = F.when(F.col(f"{fresh}.available"), F.col(f"{fresh}.digest"))
    return rows.groupBy(*keys).agg(F.bool_and(agree).alias("attempts_equal"), (F.count_distinct(shown) == 1).alias("stable"), F.count(F.lit(1)).alias("checkpoints"))


def checkpoint_findings(rows: DataFrame, keys: list[str], fresh: str, sequential: str, entropy_end: str) -> DataFrame:
    """One row of findings over all scans (``keys``): counts of scans and checkpoints, how many scans can be drawn at their entropy's end, agree in all attempts, are stable, and how often each frame status occurs."""
    per = attempts_equal(rows, keys, fresh, sequential).join(rows.groupBy(*keys).agg(F.bool_or(F.col(entropy_end) & F.col(f"{fresh}.available")).alias("drawn")), keys)
    counts = per.agg(
        F.count(F.lit(1)).alias("scan_count"), F.sum("checkpoints").alias("checkpoint_count"), F.count_if("drawn").alias("entropy_end_drawn"),
        F.count_if("attempts_equal").alias("attempts_equal_count"), F.count_if("stable").alias("stable_count"),
    )
    both = rows.select(F.explode(F.array(*(F.struct(F.lit(n).alias("attempt"), F.col(f"{s}.status").cast("string").alias("status")) for n, s in (("fresh", fresh), ("sequential", sequential))))).alias("s")).select("s.*")
    # A row for each status value, of which the format has a handful.
    told = both.groupBy("attempt", "status").agg(F.count(F.lit(1)).alias("n")).groupBy("attempt").agg(F.array_sort(F.collect_list(F.concat_ws(":", "status", F.col("n").cast("string")))).alias("h"))
    wide = told.agg(*(F.max(F.when(F.col("attempt") == n, F.col("h"))).alias(f"{n}_statuses") for n in ("fresh", "sequential")))
    return counts.crossJoin(wide)


def scan_deltas(rows: DataFrame, keys: list[str], scan: str, offset: str, psnr: str, total: str, first: int = 8) -> DataFrame:
    """What the scan behind ``first`` adds in each series: bytes, their share of the file in parts per million, and quality."""
    second = first + 1

    def at(n: int, column: str) -> Column:
        return F.max(F.when(F.col(scan) == n, F.col(column)))

    wide = rows.where(F.col(scan).isin(first, second)).groupBy(*keys).agg(*(at(n, c).alias(f"_{c}{n}") for c in (offset, psnr) for n in (first, second)), F.max(total).alias("_total"), F.count_distinct(scan).alias("_n")).where("_n = 2")
    added = F.col(f"_{offset}{second}") - F.col(f"_{offset}{first}")
    return wide.select(*keys, added.alias("additional_bytes"), F.call_function("div", (added * 1_000_000).cast("long"), F.col("_total").cast("long")).alias("additional_ppm"), (F.col(f"_{psnr}{second}") - F.col(f"_{psnr}{first}")).alias("psnr_gain"))
