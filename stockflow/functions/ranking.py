"""Ranks and dense row numbers that never sort one whole group in one task.

``rank()`` over a few large groups, or over no group at all, sends each group to a
single task. The helpers here count the distinct sort values first (map-side combined)
and rank those, so a group costs as many rows as it has distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockflow.sources.tables_io import staged


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    match = reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_r_{k}"]) for k in keys])
    return left.join(right, match).drop(*[f"_r_{k}" for k in keys])


def rank_by_value(
    df: DataFrame,
    value: str,
    name: str,
    partition_by: Sequence[str] = (),
    bucket: Column | None = None,
    at_most: int | None = None,
) -> DataFrame:
    """Add SQL ``RANK()`` by ``value``, highest first; ties share a rank.

    ``bucket`` is a non-decreasing function of ``value`` with few results. Give it when a
    group may hold many distinct values: values are then ranked inside a bucket and only
    the bucket totals in one task. ``at_most`` keeps ranks up to k, with all ties (F3).
    """
    keys = list(partition_by)
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    before = (Window.unboundedPreceding, -1)
    if bucket is None:
        higher = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(value)).rowsBetween(*before)
        ranks = counts.select(
            *keys, value, (F.coalesce(F.sum("_n").over(higher), F.lit(0)) + 1).alias(name)
        )
    else:
        counts = counts.withColumn("_bucket", bucket)
        in_bucket = (
            Window.partitionBy(*keys, "_bucket").orderBy(F.desc_nulls_last(value)).rowsBetween(*before)
        )
        over_buckets = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("_bucket")).rowsBetween(*before)
        ahead = (
            counts.groupBy(*keys, "_bucket")
            .agg(F.sum("_n").alias("_in_bucket"))
            .withColumn("_ahead", F.coalesce(F.sum("_in_bucket").over(over_buckets), F.lit(0)))
            .drop("_in_bucket")
        )
        ranks = _null_safe_join(counts, ahead, [*keys, "_bucket"]).select(
            *keys,
            value,
            (F.coalesce(F.sum("_n").over(in_bucket), F.lit(0)) + F.col("_ahead") + 1).alias(name),
        )
    if at_most is not None:
        ranks = ranks.filter(F.col(name) <= at_most)
    return _null_safe_join(df, ranks, [*keys, value])


def number_rows(
    df: DataFrame, name: str, major: str, minor: Column, order_by: Sequence[str]
) -> DataFrame:
    """Add dense surrogate keys 1..n in the order ``major, minor, *order_by``.

    ``major`` must have a bounded number of values, such as dates, and ``minor`` spreads
    each of them over a fixed number of buckets. Bucket sizes are counted and turned into
    offsets; the rows are only ever sorted inside a bucket.
    """
    bucketed = df.withColumn("_minor", minor)
    sizes = bucketed.groupBy(major, "_minor").agg(F.count(F.lit(1)).alias("_n"))
    before = (Window.unboundedPreceding, -1)
    starts = (
        sizes.groupBy(major)
        .agg(F.sum("_n").alias("_total"))
        .select(
            major,
            F.coalesce(F.sum("_total").over(Window.orderBy(major).rowsBetween(*before)), F.lit(0)).alias(
                "_major_start"
            ),
        )
    )
    within = Window.partitionBy(major).orderBy("_minor").rowsBetween(*before)
    minor_starts = sizes.select(
        major, "_minor", F.coalesce(F.sum("_n").over(within), F.lit(0)).alias("_minor_start")
    )
    offsets = _null_safe_join(minor_starts, starts, [major])
    position = F.row_number().over(Window.partitionBy(major, "_minor").orderBy(*order_by))
    return (
        _null_safe_join(bucketed, offsets, [major, "_minor"])
        .withColumn(name, F.col("_major_start") + F.col("_minor_start") + position)
        .drop("_minor", "_major_start", "_minor_start")
    )


def extend_keys(
    stored: DataFrame,
    rows: DataFrame,
    natural: Sequence[str],
    name: str,
    major: str,
    minor: Column,
    order_by: Sequence[str],
) -> DataFrame:
    """Surrogate keys of the rows whose natural key is not among the ``stored`` ones.

    ``stored`` holds the natural columns and ``name``. Its keys stay what they are; the unseen
    rows get the numbers after the highest one, without a gap, in the order of ``number_rows``.
    The natural columns must not change from load to load and must tell rows apart (give equal
    rows a copy number); NULL counts as a value. ``major`` and ``minor`` are as there.
    """
    known = stored.select([F.col(c).alias(f"_k_{c}") for c in natural])
    same = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(known[f"_k_{c}"]) for c in natural])
    unseen = rows.join(known, same, "left_anti")
    highest = F.coalesce(stored.agg(F.max(name).alias("value")).scalar(), F.lit(0))
    return number_rows(unseen, name, major, minor, order_by).withColumn(name, F.col(name) + highest)


def row_positions(ordered: DataFrame, name: str, last: str, ties: Sequence[str]) -> DataFrame:
    """Where the rows of a sorted result stand: first and last place, from 1, of their tie group.

    Rows with equal ``ties`` may come in any order; a sort that is right gives them adjacent
    places. The sorted partitions are numbered on their own and moved on by the rows before.
    """
    marked = staged(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered-rows")
    part = F.shiftright("_at", 33)
    sizes = marked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    placed = marked.withColumn("_part", part).join(starts, "_part")
    place = F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    group = Window.partitionBy(*ties)
    return placed.withColumns({name: F.min(place).over(group), last: F.max(place).over(group)}).drop("_at", "_part", "_start")
