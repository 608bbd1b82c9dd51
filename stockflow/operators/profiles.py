"""Distributions behind the charts.

Values are counted per group first, which makes daily counts and delays few. Quartiles are
selected by rank, so that a group of many different values is never in one buffer either.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FINE_RANGES = 4096


def value_counts(df: DataFrame, column: str, ordered: bool = True) -> DataFrame:
    """Rows per value, most frequent first."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), column) if ordered else counts


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """Equal-width bins over [min, max], the last one closed; empty bins are kept.

    When all values are equal the range is one unit wide around the value.
    """
    counted = (
        df.select(F.col(column).cast("double").alias("_v"))
        .filter(F.col("_v").isNotNull())
        .groupBy("_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    flat = F.col("_low") == F.col("_high")
    edges = (
        counted.agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        .select(
            F.when(flat, F.col("_low") - 0.5).otherwise(F.col("_low")).alias("low"),
            F.when(flat, F.col("_high") + 0.5).otherwise(F.col("_high")).alias("high"),
        )
        .select("low", ((F.col("high") - F.col("low")) / bins).alias("width"))
    )
    edge = edges.select(F.struct("low", "width").alias("value")).scalar()
    frame = edges.filter(F.col("low").isNotNull()).select(
        "low", "width", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )
    slot = F.least(F.floor((F.col("_v") - edge["low"]) / edge["width"]), F.lit(bins - 1)).cast("int")
    filled = counted.groupBy(slot.alias("bin")).agg(F.sum("_n").alias("_rows"))
    return frame.join(filled, "bin", "left").select(
        "bin",
        (F.col("low") + F.col("bin") * F.col("width")).alias("bin_start"),
        (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("bin_end"),
        F.coalesce("_rows", F.lit(0)).alias("count"),
    )


def _counted(df: DataFrame, value: str, by: Sequence[str], weight: str | None) -> DataFrame:
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).alias("_value"))
        .agg(rows.alias("_n"))
    )


def _coarse_range(value: Column) -> Column:
    """A number that never falls as the value grows: sign, and 64 steps for each factor of e."""
    endless = F.lit(1 << 39)
    step = F.when(F.abs(value) == float("inf"), endless).otherwise(F.floor(F.ln(F.abs(value)) * 64) + 64 * 800)
    ranged = F.when(value > 0, step).when(value < 0, -step).otherwise(0)
    return F.when(F.isnan(value), endless + 1).otherwise(ranged).cast("long")


def _counted_ranges(rows: DataFrame, keys: Sequence[str], part: Column) -> DataFrame:
    """Rows in each range ``_part`` of a group's values, and how many stand before it."""
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy(*keys, part.alias("_part")).agg(
        F.sum("_n").alias("_rows"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
    )
    return ranges.withColumn("_ahead", F.coalesce(F.sum("_rows").over(before), F.lit(0)))


def _places_in(places: Column, start: Column, rows: Column) -> Column:
    return F.filter(places, lambda p: (p >= start) & (p < start + rows))


def quantiles(counted: DataFrame, by: Sequence[str], shares: Mapping[str, float]) -> DataFrame:
    """Exact quantiles, interpolated between neighbours, and ``count`` of each group.

    ``counted`` has (group, ``_value``, ``_n``); the figures are those of ``percentile`` with
    frequencies. Selection by rank: the rows of a group are counted by coarse ranges of the value,
    those of the ranges that hold a wanted place by ``FINE_RANGES`` equal parts of what the range
    spans, and only the values of the parts that hold one are sorted. A task sees a group's
    range counts and such a part, never the values of a group. Exact for any values; parts are
    small unless values crowd on many scales at once.
    """
    by = list(by)
    rows = counted.select(*by, "_value", "_n", F.col("_value").cast("double").alias("_v"))
    rows = rows.withColumn("_coarse", _coarse_range(F.col("_v")))
    at = {n: (F.col("count") - 1).cast("double") * F.lit(float(q)) for n, q in shares.items()}
    places = F.array_distinct(F.array(*[end(p) for p in at.values() for end in (F.floor, F.ceil)]))

    coarse = _counted_ranges(rows, by, F.col("_coarse")).withColumnRenamed("_part", "_coarse")
    coarse = coarse.withColumn("count", F.sum("_rows").over(Window.partitionBy(*by)))
    held = coarse.withColumn("_places", _places_in(places, F.col("_ahead"), F.col("_rows"))).filter("size(_places) > 0")
    held = held.select(*by, "_coarse", "_low", "_high", "_places", F.col("_ahead").alias("_start"), "count")

    keys = [*by, "_coarse"]
    share = (F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low"))
    fine = F.when(F.col("_low") < F.col("_high"), F.floor(share * FINE_RANGES)).otherwise(0).cast("long")
    inner = rows.join(held, keys).withColumn("_fine", fine)
    before = Window.partitionBy(*keys).orderBy("_fine").rowsBetween(Window.unboundedPreceding, -1)
    parts = inner.groupBy(*keys, "_fine").agg(
        F.sum("_n").alias("_rows"), *[F.first(c).alias(c) for c in ("_places", "_start", "count")]
    )
    parts = parts.withColumn("_start", F.col("_start") + F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    parts = parts.withColumn("_places", _places_in(F.col("_places"), F.col("_start"), F.col("_rows")))
    parts = parts.filter("size(_places) > 0").drop("_rows")

    sorted_part = Window.partitionBy(*keys, "_fine").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    found = inner.select(*keys, "_fine", "_v", "_n").join(parts, [*keys, "_fine"])
    found = found.withColumn("_start", F.col("_start") + F.coalesce(F.sum("_n").over(sorted_part), F.lit(0)))
    own = _places_in(F.col("_places"), F.col("_start"), F.col("_n"))
    found = found.select(*by, "count", "_v", F.explode(own).alias("_place"))

    def value(position: Column) -> Column:
        ends = [F.first(end(position)) for end in (F.floor, F.ceil)]
        low, high = [F.max(F.when(F.col("_place") == end(position), F.col("_v"))) for end in (F.floor, F.ceil)]
        where = F.first(position)
        between = (ends[1] - where) * low + (where - ends[0]) * high
        return F.when((ends[0] == ends[1]) | (low == high), low).otherwise(between)

    return found.groupBy(*by).agg(F.first("count").alias("count"), *[value(p).alias(n) for n, p in at.items()])


def _quartiles(counted: DataFrame, by: Sequence[str], whisker: float) -> DataFrame:
    spread = F.col("q3") - F.col("q1")
    return (
        quantiles(counted, by, {"q1": 0.25, "median": 0.5, "q3": 0.75})
        .withColumn("_low_fence", F.col("q1") - spread * whisker)
        .withColumn("_high_fence", F.col("q3") + spread * whisker)
    )


def _inside():
    return F.col("_value").between(F.col("_low_fence"), F.col("_high_fence"))


def box_stats(
    df: DataFrame, value: str, by: Sequence[str], whisker: float = 1.5, weight: str | None = None
) -> DataFrame:
    """Quartiles, whiskers and outlier count per group.

    Whiskers end at the extreme values inside ``whisker`` interquartile ranges of the box.
    ``weight`` names a column of row counts when the rows are counted already.
    """
    by = list(by)
    counted = _counted(df, value, by, weight)
    boxes = _quartiles(counted, by, whisker)
    return (
        counted.join(boxes, by)
        .groupBy(*by, "count", "q1", "median", "q3")
        .agg(
            F.min("_value").alias("min"),
            F.min(F.when(_inside(), F.col("_value"))).alias("whisker_low"),
            F.max(F.when(_inside(), F.col("_value"))).alias("whisker_high"),
            F.max("_value").alias("max"),
            F.sum(F.when(~_inside(), F.col("_n")).otherwise(0)).alias("outliers"),
        )
    )


def box_outliers(
    df: DataFrame, value: str, by: Sequence[str], whisker: float = 1.5, weight: str | None = None
) -> DataFrame:
    """The values outside the whiskers and how often each occurs."""
    by = list(by)
    counted = _counted(df, value, by, weight)
    return (
        counted.join(_quartiles(counted, by, whisker), by)
        .filter(~_inside())
        .select(*by, F.col("_value").alias(value), F.col("_n").alias("count"))
    )


def mean_with_spread(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mean and the ends of a one-deviation error bar per group."""
    mean, spread = F.avg(value), F.stddev_samp(value)
    return df.groupBy(*by).agg(
        mean.alias("mean"),
        spread.alias("std"),
        (mean - spread).alias("low"),
        (mean + spread).alias("high"),
    )

