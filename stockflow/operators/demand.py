"""Demand over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockflow.functions.columns import exact, month_start, ratio, trailing_rows_sum
from stockflow.schemas import WEEKDAYS

LABELS = ("product_name", "category", "pattern_group")


def daily_sales(sales: DataFrame) -> DataFrame:
    """Sales summed to one row per product and day, the grain the operators expect."""
    return sales.groupBy("product_id", "sale_date").agg(
        *[F.sum(c).alias(c) for c in ("units_sold", "units_demanded", "revenue")]
    )


def rolling_demand(
    sales: DataFrame,
    products: DataFrame,
    days: int = 30,
    measure: str = "units_sold",
    ordered: bool = True,
) -> DataFrame:
    """Moving average and total of the last ``days`` rows of each product (K1).

    Counts rows, not calendar days; early rows have a shorter frame. Frames are differences
    of running sums, so their length costs nothing. Window and join share the partitioning by
    product. ``ordered`` sorts the fact-sized result, which is a second
    shuffle: leave it off when the result is written or aggregated.
    """
    by_day = Window.partitionBy("product_id").orderBy("sale_date")
    units = exact(sales, measure)
    known = trailing_rows_sum(units.isNotNull().cast("long"), by_day, days)
    total = F.when(known > 0, trailing_rows_sum(F.coalesce(units, F.lit(0)), by_day, days))
    result = (
        sales.select("product_id", "sale_date", measure, total.alias("_total"), known.alias("_known"))
        .withColumn(f"rolling_{days}d_avg_demand", F.round(ratio(F.col("_total"), F.col("_known")), 2))
        .withColumnRenamed("_total", f"rolling_{days}d_total_demand")
        .join(products.select("product_id", *LABELS), "product_id")
        .select(
            "product_id",
            *LABELS,
            "sale_date",
            measure,
            f"rolling_{days}d_avg_demand",
            f"rolling_{days}d_total_demand",
        )
    )
    return result.orderBy("product_id", "sale_date") if ordered else result


def latest_rolling_demand(
    sales: DataFrame, products: DataFrame, days: int = 30, measure: str = "units_sold"
) -> DataFrame:
    """``rolling_demand`` at the last sale date of all products.

    Products without a row on that date drop out. Only the newest ``days`` rows of a product
    matter, and the row-number limit is applied before the shuffle as well as after it.
    """
    newest_first = Window.partitionBy("product_id").orderBy(F.desc("sale_date"))
    last_day = sales.agg(F.max("sale_date").alias("value")).scalar()
    latest = (
        sales.select("product_id", "sale_date", measure)
        .withColumn("_age", F.row_number().over(newest_first))
        .filter(F.col("_age") <= days)
        .groupBy("product_id")
        .agg(
            F.max("sale_date").alias("sale_date"),
            F.round(F.avg(measure), 2).alias(f"rolling_{days}d_avg_demand"),
            F.sum(measure).alias(f"rolling_{days}d_total_demand"),
        )
        .filter(F.col("sale_date") == last_day)
    )
    return latest.join(products.select("product_id", *LABELS), "product_id").select(
        "product_id", *LABELS, "sale_date", f"rolling_{days}d_avg_demand", f"rolling_{days}d_total_demand"
    )


def demand_growth_streaks(
    sales: DataFrame,
    products: DataFrame,
    min_months: int = 4,
    measure: str = "units_sold",
    ordered: bool = True,
) -> DataFrame:
    """Runs of at least ``min_months`` monthly rises in a row.

    Each month is compared with the previous month present. The number of non-rises so far
    names the run a rise belongs to, so one window serves both steps.
    """
    monthly = sales.groupBy("product_id", F.trunc("sale_date", "MM").alias("month")).agg(
        F.sum(measure).alias("units")
    )
    by_month = Window.partitionBy("product_id").orderBy("month")
    rose = F.coalesce(F.col("units") > F.lag("units").over(by_month), F.lit(False))
    runs = (
        monthly.withColumn("_rose", rose)
        .withColumn("_run", F.count_if(~F.col("_rose")).over(by_month))
        .filter("_rose")
        .groupBy("product_id", "_run")
        .agg(
            F.count(F.lit(1)).alias("consecutive_growth_months"),
            month_start(F.min("month")).alias("streak_start"),
            month_start(F.max("month")).alias("streak_end"),
        )
        .filter(F.col("consecutive_growth_months") >= min_months)
    )
    result = runs.join(products.select("product_id", *LABELS), "product_id").select(
        "product_id", *LABELS, "consecutive_growth_months", "streak_start", "streak_end"
    )
    if ordered:
        return result.orderBy(F.desc("consecutive_growth_months"), "product_id")
    return result


def demand_profile(sales: DataFrame, measure: str = "units_demanded") -> DataFrame:
    """Level, volatility, trend and weekday shape of each product's demand.

    The slope is in units per calendar day. A weekday index of 1.2 is 20% above the
    product's mean; it is NULL when the product has no row on that weekday.
    """
    units = F.col(measure).cast("double")
    mean = F.avg(units)
    day = F.unix_date("sale_date").cast("double")
    weekday = F.weekday("sale_date")
    return sales.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("days"),
        mean.alias("mean_demand"),
        F.stddev_samp(units).alias("std_demand"),
        ratio(F.stddev_samp(units), mean).alias("coefficient_of_variation"),
        F.regr_slope(units, day).alias("trend_slope"),
        *[
            ratio(F.avg(F.when(weekday == i, units)), mean).alias(f"{name.lower()}_index")
            for i, name in enumerate(WEEKDAYS)
        ],
    )


def festive_uplift(
    sales: DataFrame,
    products: DataFrame,
    by: Sequence[str] = ("pattern_group",),
    first_day: int = 280,
    last_day: int = 320,
    measure: str = "units_demanded",
) -> DataFrame:
    """Mean demand per row on the festive days of the year against the rest."""
    festive = F.dayofyear("sale_date").between(first_day, last_day)
    units = F.col(measure)
    per_product = sales.groupBy("product_id").agg(
        F.sum(F.when(festive, units)).alias("_in"),
        F.count_if(festive).alias("_in_days"),
        F.sum(F.when(~festive, units)).alias("_out"),
        F.count_if(~festive).alias("_out_days"),
    )
    inside = ratio(F.sum("_in"), F.sum("_in_days"))
    outside = ratio(F.sum("_out"), F.sum("_out_days"))
    return (
        per_product.join(products.select("product_id", *[c for c in by if c != "product_id"]), "product_id")
        .groupBy(*by)
        .agg(
            inside.alias("festive_avg_demand"),
            outside.alias("other_avg_demand"),
            ratio(inside, outside).alias("festive_uplift"),
        )
    )
