"""Date tables, daily and monthly series, and the dense product-day grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockflow.functions.columns import day_name, month_label, month_start, scalar
from stockflow.operators.profiles import box_stats


def daily_demand(sales: DataFrame, measure: str = "units_sold") -> DataFrame:
    """Units of all products per day, with weekday and month."""
    return sales.groupBy("sale_date").agg(F.sum(measure).alias(measure)).select(
        "sale_date",
        measure,
        day_name(F.col("sale_date")).alias("dow"),
        month_label(F.col("sale_date")).alias("month"),
    )


def weekday_distribution(
    sales: DataFrame, measure: str = "units_sold", ordered: bool = True
) -> DataFrame:
    """Box-plot summary of the daily totals by weekday, Monday first."""
    totals = daily_demand(sales, measure).withColumn("weekday", F.weekday("sale_date") + 1)
    stats = box_stats(totals, measure, ["weekday", "dow"])
    return stats.orderBy("weekday") if ordered else stats


def monthly_demand(sales: DataFrame, measure: str = "units_sold", ordered: bool = True) -> DataFrame:
    """Units of all products per month."""
    monthly = (
        sales.groupBy(F.trunc("sale_date", "MM").alias("_month"))
        .agg(F.sum(measure).alias(measure))
        .select(month_label(F.col("_month")).alias("month"), measure)
    )
    return monthly.orderBy("month") if ordered else monthly


def monthly_revenue(sales: DataFrame, products: DataFrame, ordered: bool = True) -> DataFrame:
    """Revenue earned and lost per month (I4).

    Summed per product and month before the price is joined. Sales of unknown products count
    as earned; without a price nothing is known of what they lost.
    """
    per_product = sales.groupBy("product_id", F.trunc("sale_date", "MM").alias("_month")).agg(
        F.sum("revenue").alias("_revenue"),
        F.sum(F.col("units_demanded") - F.col("units_sold")).alias("_gap"),
    )
    lost = (F.col("_gap").cast("decimal(18,0)") * F.col("unit_price")).cast("decimal(28,2)")
    monthly = (
        per_product.join(products.select("product_id", "unit_price"), "product_id", "left")
        .groupBy("_month")
        .agg(F.sum("_revenue").alias("revenue"), F.sum(lost).alias("revenue_lost"))
        .select(month_label(F.col("_month")).alias("month"), "revenue", "revenue_lost")
    )
    return monthly.orderBy("month") if ordered else monthly


def date_table(bounds: DataFrame) -> DataFrame:
    """One row per calendar day between ``first_day`` and ``last_day`` of a one-row frame."""
    days = bounds.select(F.explode(F.sequence("first_day", "last_day")).alias("date"))
    day = F.col("date")
    return days.select(
        "date",
        F.year(day).alias("year"),
        F.month(day).alias("month_number"),
        month_start(day).alias("month_start"),
        F.dayofyear(day).alias("day_of_year"),
        (F.weekday(day) + 1).alias("weekday"),
        day_name(day).alias("dow"),
    )


def date_bounds(df: DataFrame, day: str) -> DataFrame:
    return df.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def on_calendar(calendar: DataFrame, facts: DataFrame, day: str, sums: Sequence[str]) -> DataFrame:
    """Totals of a fact for every calendar day, 0 where it has no row."""
    totals = facts.groupBy(F.col(day).alias("date")).agg(*[F.sum(c).alias(c) for c in sums])
    return calendar.join(totals, "date", "left").select(
        *calendar.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in sums]
    )


def dense_product_days(
    inventory: DataFrame,
    sales: DataFrame,
    start: Column | None = None,
    end: Column | None = None,
    receipts: DataFrame | None = None,
) -> DataFrame:
    """One row per product and calendar day.

    ``receipts`` (product_id, day, units) adds what came in; without it that flow is 0.

    Missing flows are 0, missing stock is the last known value, NULL before the first one.
    Without a range each product runs from its own first to its own last day, so the result
    stays in proportion to the history. Only the facts are shuffled: each row then emits
    itself and the empty days up to the next row.
    """
    facts = (
        inventory.select(
            "product_id",
            F.col("snapshot_date").alias("_day"),
            F.col("stock_on_hand").cast("long").alias("_stock"),
            F.col("is_stockout").cast("int").alias("_out"),
            F.lit(None).cast("long").alias("_sold"),
            F.lit(None).cast("long").alias("_wanted"),
            F.lit(None).cast("long").alias("_got"),
        )
        .unionByName(
            sales.select(
                "product_id",
                F.col("sale_date").alias("_day"),
                F.lit(None).cast("long").alias("_stock"),
                F.lit(None).cast("int").alias("_out"),
                F.col("units_sold").cast("long").alias("_sold"),
                F.col("units_demanded").cast("long").alias("_wanted"),
                F.lit(None).cast("long").alias("_got"),
            )
        )
    )
    if receipts is not None:
        came_in = receipts.select(
            "product_id", F.col("day").alias("_day"), F.col("units").cast("long").alias("_got")
        )
        facts = facts.unionByName(came_in, allowMissingColumns=True)
    facts = facts.groupBy("product_id", "_day").agg(
        *[F.max(c).alias(c) for c in ("_stock", "_out")],
        *[F.sum(c).alias(c) for c in ("_sold", "_wanted", "_got")],
    )
    by_day = Window.partitionBy("product_id").orderBy("_day")
    day = F.col("_day")
    before_next = F.date_sub(F.lead("_day").over(by_day), 1)
    first, last = day, F.coalesce(before_next, day)
    if start is not None:
        reach_back = F.when(F.lag("_day").over(by_day).isNull(), F.least(day, start)).otherwise(day)
        first = F.greatest(reach_back, start)
    if end is not None:
        last = F.least(F.coalesce(before_next, F.greatest(day, end)), end)
    known = F.last("_stock", ignorenulls=True).over(by_day)
    emitted = (
        facts.withColumns({"_known": known, "_from": first, "_to": last})
        .filter("_from <= _to")
        .withColumn("snapshot_date", F.explode(F.sequence("_from", "_to")))
    )
    own = F.col("snapshot_date") == day

    def flow(column: str) -> Column:
        return F.when(own, F.coalesce(column, F.lit(0))).otherwise(F.lit(0))

    return emitted.select(
        "product_id",
        "snapshot_date",
        F.when(F.col("snapshot_date") >= day, F.col("_known")).alias("stock_on_hand"),
        flow("_out").alias("is_stockout"),
        flow("_sold").alias("units_sold"),
        flow("_wanted").alias("units_demanded"),
        flow("_got").alias("receipts"),
    )


def range_of(df: DataFrame, day: str) -> tuple[Column, Column]:
    """First and last day of a fact, as columns for ``dense_product_days``."""
    return scalar(df, F.min(day)), scalar(df, F.max(day))
