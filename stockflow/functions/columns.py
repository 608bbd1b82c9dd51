"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

from stockflow.schemas import STATUS_ORDER, WEEKDAYS


def ratio(top: Column, bottom: Column) -> Column:
    """Division as double; NULL where the divisor is 0 or NULL."""
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def percent(top: Column, bottom: Column) -> Column:
    return ratio(F.lit(100.0) * top.cast("double"), bottom)


def month_start(day: Column) -> Column:
    """First of the month as text, ``yyyy-MM-01``.

    Group by ``F.trunc(day, "MM")`` and apply this to the groups: a date key is narrower
    than its text, and is formatted once per group instead of once per row.
    """
    return F.date_format(day, "yyyy-MM-01")


def month_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def day_name(day: Column) -> Column:
    # An indexed literal list keeps the names independent of the JVM locale.
    return F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday(day) + 1)


def position_in(value: Column, labels: Sequence[str]) -> Column:
    """1-based place of ``value`` in a fixed list, 0 when absent."""
    return F.array_position(F.array(*map(F.lit, labels)), value)


def status_position(status: Column) -> Column:
    return position_in(status, STATUS_ORDER)


def scalar(df: DataFrame, value: Column) -> Column:
    """One aggregate of ``df`` as an uncorrelated scalar subquery."""
    return df.agg(value.alias("value")).scalar()


def trailing_cutoff(df: DataFrame, day: str, days: int) -> Column:
    """The date ``days`` before the last one in ``df``.

    ``>=`` against it spans ``days + 1`` calendar days, as the reports define it. Where the
    table is partitioned by ``month``, the last date is looked for in the last month only.
    """
    if "month" in df.columns:
        df = df.filter(F.col("month") == scalar(df, F.max("month")))
    return F.date_sub(scalar(df, F.max(day)), days)


def in_trailing_window(df: DataFrame, day: str, days: int) -> Column:
    """Whether a row is at or after the cutoff; with a ``month`` partition, also by its month."""
    cutoff = trailing_cutoff(df, day, days)
    inside = F.col(day) >= cutoff
    return inside & (F.col("month") >= month_label(cutoff)) if "month" in df.columns else inside


def in_months_until(df: DataFrame, day: Column) -> DataFrame:
    """Where the table is partitioned by ``month``, its months up to that of ``day``."""
    return df.filter(F.col("month") <= month_label(day)) if "month" in df.columns else df


def trailing_rows_sum(value: Column, ordered: WindowSpec, rows: int) -> Column:
    """Sum over the last ``rows`` rows, as the difference of two running sums.

    Each row is added once, however long the frame is. Exact for whole numbers and decimals.
    """
    all_so_far = F.sum(value).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    left_behind = F.sum(value).over(ordered.rowsBetween(Window.unboundedPreceding, -rows))
    return all_so_far - F.coalesce(left_behind, F.lit(0))


def trailing_range_sum(value: Column, ordered: WindowSpec, reach: int) -> Column:
    """``trailing_rows_sum`` over a range of the ordering number, from ``reach - 1`` below on."""
    all_so_far = F.sum(value).over(ordered.rangeBetween(Window.unboundedPreceding, 0))
    left_behind = F.sum(value).over(ordered.rangeBetween(Window.unboundedPreceding, -reach))
    return all_so_far - F.coalesce(left_behind, F.lit(0))


def exact(df: DataFrame, column: str) -> Column:
    """A measure in a type whose sums and differences are exact; fractions keep 4 digits."""
    kind = df.schema[column].dataType
    if isinstance(kind, IntegralType):
        return F.col(column).cast("long")
    return F.col(column) if isinstance(kind, DecimalType) else F.col(column).cast("decimal(18,4)")
