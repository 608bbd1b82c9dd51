"""Reorder points, stock status, open orders and what to reorder."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockflow.functions.columns import (
    exact,
    in_months_until,
    in_trailing_window,
    ratio,
    scalar,
    status_position,
    trailing_cutoff,
    trailing_range_sum,
)
from stockflow.schemas import CRITICAL, HEALTHY, OVERSTOCKED, REORDER_SOON, SERVICE_LEVEL_Z, Z_95


def _mean_and_std(total: Column, squares: Column, n: Column) -> tuple[Column, Column]:
    """Mean and population deviation over n days; a flat series gets deviation 1."""
    mean = total / n
    deviation = F.sqrt(F.greatest(squares / n - mean * mean, F.lit(0.0)))
    return mean, F.when(deviation == 0, 1.0).otherwise(deviation)


def demand_baseline(
    sales: DataFrame, baseline_days: int | None = 60, measure: str = "units_demanded"
) -> DataFrame:
    """Daily mean and deviation per product over its first calendar days.

    Days without a sales row count as zero demand, up to the last sale of any product.
    ``None`` takes the whole history, from the first to the last sale of any product.

    First days come from one combined aggregate; the second pass reads the facts up to the last
    product's baseline only, of a mart partitioned by month only those months.
    """
    days = sales.select("product_id", "sale_date", F.col(measure).cast("double").alias("units"))
    if baseline_days is None:
        span = F.datediff(F.max("sale_date"), F.min("sale_date")) + 1
        n = F.max(scalar(sales, span.cast("double")))
    else:
        first = sales.groupBy("product_id").agg(F.min("sale_date").alias("_first"))
        # Past the last product's baseline there is nothing to read.
        end = F.date_add(scalar(first, F.max("_first")), baseline_days - 1)
        early = in_months_until(sales, end).filter(F.col("sale_date") <= end)
        days = early.select("product_id", "sale_date", F.col(measure).cast("double").alias("units"))
        days = days.join(first, "product_id").filter(F.datediff("sale_date", "_first") < baseline_days)
        last = F.max(scalar(sales, F.max("sale_date")))
        n = F.least(F.datediff(last, F.max("_first")) + 1, F.lit(baseline_days)).cast("double")
    totals = days.groupBy("product_id").agg(
        F.sum("units").alias("_total"),
        F.sum(F.col("units") * F.col("units")).alias("_squares"),
        n.alias("_n"),
    )
    mean, deviation = _mean_and_std(F.col("_total"), F.col("_squares"), F.col("_n"))
    return totals.select(
        "product_id", mean.alias("avg_daily_demand"), deviation.alias("demand_std_dev")
    )


def _lead_times(products: DataFrame, suppliers: DataFrame, lead_penalty: str | None) -> DataFrame:
    """Quoted lead time per product, stretched by an optional factor column on products."""
    penalty = F.lit(1.0) if lead_penalty is None else F.col(lead_penalty).cast("double")
    quoted = suppliers.select(
        "supplier_id",
        F.col("avg_lead_time_days").cast("double").alias("_lead"),
        F.col("lead_time_std_dev").cast("double").alias("_lead_std"),
    )
    return products.join(quoted, "supplier_id", "left").select(
        "product_id",
        (F.col("_lead") * penalty).alias("lead_time_days"),
        (F.col("_lead_std") * penalty).alias("lead_time_std_dev"),
    )


def _safety_stock(z: Column, method: str) -> Column:
    if method == "simple":
        return z * F.col("demand_std_dev") * F.sqrt("lead_time_days")
    if method == "full":
        demand_part = F.col("lead_time_days") * F.col("demand_std_dev") * F.col("demand_std_dev")
        lead_part = (
            F.col("avg_daily_demand")
            * F.col("avg_daily_demand")
            * F.col("lead_time_std_dev")
            * F.col("lead_time_std_dev")
        )
        return z * F.sqrt(demand_part + lead_part)
    raise ValueError(f"method must be 'simple' or 'full', not {method!r}")


def _with_points(stats: DataFrame, z: Column, method: str) -> DataFrame:
    mean = F.col("avg_daily_demand")
    point = F.greatest(mean * F.col("lead_time_days") + F.col("safety_stock"), mean * 2)
    return stats.withColumn("safety_stock", _safety_stock(z, method)).withColumn(
        # greatest() skips NULLs; without a quoted lead time there is no reorder point.
        "reorder_point", F.when(F.col("lead_time_days").isNotNull(), point)
    )


def reorder_point(
    sales: DataFrame,
    products: DataFrame,
    suppliers: DataFrame,
    z: float = Z_95,
    baseline_days: int | None = 60,
    method: str = "simple",
    lead_penalty: str | None = None,
    measure: str = "units_demanded",
) -> DataFrame:
    """Safety stock and reorder point per product (K3; ``method="full"`` is K4).

    The full method also covers the variance of the lead time. The reorder point is never
    below two days of mean demand.
    """
    stats = demand_baseline(sales, baseline_days, measure).join(
        _lead_times(products, suppliers, lead_penalty), "product_id"
    )
    return _with_points(stats, F.lit(z), method)


def reorder_point_by_service_level(
    sales: DataFrame,
    products: DataFrame,
    suppliers: DataFrame,
    levels: Mapping[float, float] = SERVICE_LEVEL_Z,
    baseline_days: int | None = 60,
    method: str = "simple",
    lead_penalty: str | None = None,
) -> DataFrame:
    """Reorder point of each product at each service level (K6)."""
    stats = demand_baseline(sales, baseline_days).join(
        _lead_times(products, suppliers, lead_penalty), "product_id"
    )
    choices = F.array(
        *[
            F.struct(F.lit(level).alias("service_level_pct"), F.lit(z).alias("z"))
            for level, z in levels.items()
        ]
    )
    return _with_points(stats.select("*", F.inline(choices)), F.col("z"), method)


def reorder_point_asof(
    sales: DataFrame,
    inventory: DataFrame,
    products: DataFrame,
    suppliers: DataFrame,
    z: float = Z_95,
    lookback: int = 60,
    lead_penalty: str | None = None,
    measure: str = "units_demanded",
) -> DataFrame:
    """Reorder point at each snapshot date from the ``lookback`` days up to it (K5).

    The frame is a range of calendar days, so days without a row count as zero demand
    without being generated, and no later row is seen. It is taken as the difference of two
    running sums, whatever the ``lookback``.
    """
    units = exact(sales, measure)
    flows = sales.select(
        "product_id", F.col("sale_date").alias("day"), units.alias("units"), F.lit(0).alias("snapshot")
    ).unionByName(
        inventory.select(
            "product_id", F.col("snapshot_date").alias("day"), F.lit(None).cast("long").alias("units"), F.lit(1).alias("snapshot")
        )
    )
    days = (
        flows.groupBy("product_id", "day")
        .agg(F.coalesce(F.sum("units"), F.lit(0)).alias("units"), F.max("snapshot").alias("snapshot"))
        .withColumn("_d", F.unix_date("day"))
    )
    by_day = Window.partitionBy("product_id").orderBy("_d")
    first = F.min("_d").over(by_day.rowsBetween(Window.unboundedPreceding, 0))
    stats = (
        days.withColumn("_total", trailing_range_sum(F.col("units"), by_day, lookback).cast("double"))
        .withColumn("_squares", trailing_range_sum(F.col("units") * F.col("units"), by_day, lookback).cast("double"))
        .withColumn("_n", F.least(F.col("_d") - first + 1, F.lit(lookback)).cast("double"))
        .filter("snapshot = 1")
    )
    mean, deviation = _mean_and_std(F.col("_total"), F.col("_squares"), F.col("_n"))
    stats = stats.select(
        "product_id",
        F.col("day").alias("snapshot_date"),
        mean.alias("avg_daily_demand"),
        deviation.alias("demand_std_dev"),
    ).join(_lead_times(products, suppliers, lead_penalty), "product_id")
    return _with_points(stats, F.lit(z), "simple")


def latest_stock(inventory: DataFrame, *extra: Column) -> DataFrame:
    """The newest snapshot of each product (C3, E7), beside further aggregates.

    One map-side combined hash aggregation instead of a join back to the newest date.
    """
    carried = [c for c in ("stock_on_hand", "reorder_point_snapshot") if c in inventory.columns]
    return inventory.groupBy("product_id").agg(
        *[F.max_by(c, "snapshot_date").alias(c) for c in carried], *extra
    )


def recent_demand(sales: DataFrame, window_days: int = 30, measure: str = "units_sold") -> DataFrame:
    """Mean daily demand per product since ``window_days`` before the last sale.

    Of a mart partitioned by month only the window's months are read.
    """
    recent = sales.filter(in_trailing_window(sales, "sale_date", window_days))
    return recent.groupBy("product_id").agg(F.avg(measure).alias("avg_daily_demand"))


def stock_status(
    products: DataFrame,
    inventory: DataFrame,
    sales: DataFrame,
    window_days: int = 30,
    soon_factor: float = 1.2,
    over_factor: float = 3.0,
    measure: str = "units_sold",
    ordered: bool = True,
) -> DataFrame:
    """Replenishment status and days of inventory of every product (K7).

    The first rule that matches wins: at or below the reorder point with a recent stockout
    is Critical; up to ``soon_factor`` times the point is Reorder Soon; above
    ``over_factor`` times the point with below-average demand is Overstocked. A product
    without recent sales has no demand to compare and stays Healthy.
    """
    cutoff = trailing_cutoff(inventory, "snapshot_date", window_days)
    short_days = F.sum(F.when(F.col("snapshot_date") >= cutoff, F.col("is_stockout")))
    stock = latest_stock(inventory, F.coalesce(short_days, F.lit(0)).alias("_short_days"))
    demand = recent_demand(sales, window_days, measure).withColumnRenamed("avg_daily_demand", "_demand")
    point = F.col("reorder_point_snapshot").cast("double")
    on_hand = F.col("stock_on_hand")
    status = (
        F.when((on_hand <= point) & (F.col("_short_days") > 0), CRITICAL)
        .when(on_hand <= point * soon_factor, REORDER_SOON)
        .when(
            (on_hand > point * over_factor) & (F.col("_demand") < scalar(sales, F.avg(measure))),
            OVERSTOCKED,
        )
        .otherwise(HEALTHY)
    )
    result = (
        products.select("product_id", "product_name", "category", "pattern_group")
        .join(stock, "product_id")
        .join(demand, "product_id", "left")
        .select(
            "product_id",
            "product_name",
            "category",
            "pattern_group",
            "stock_on_hand",
            F.round(point, 1).alias("reorder_point"),
            F.round("_demand", 2).alias("avg_daily_demand_30d"),
            F.col("_short_days").alias("stockout_days_last_30d"),
            F.round(ratio(on_hand, F.col("_demand")), 1).alias("days_of_inventory_remaining"),
            status.alias("status"),
        )
    )
    if ordered:
        return result.orderBy(status_position(F.col("status")), F.asc("days_of_inventory_remaining"))
    return result


def slice_status(
    status: DataFrame,
    statuses: Sequence[str] | None = None,
    categories: Sequence[str] | None = None,
    patterns: Sequence[str] | None = None,
) -> DataFrame:
    """Keep chosen statuses, categories and patterns."""
    for column, wanted in (("status", statuses), ("category", categories), ("pattern_group", patterns)):
        if wanted is not None:
            status = status.filter(F.col(column).isin(list(wanted)))
    return status


def open_purchase_orders(pos: DataFrame, as_of: Column) -> DataFrame:
    """Orders placed by a date and not yet received then, cancelled ones left out."""
    arrived = F.col("actual_delivery_date")
    return pos.filter(
        (F.col("order_date") <= as_of)
        & (arrived.isNull() | (arrived > as_of))
        & (F.col("status") != "Cancelled")
    )


def in_transit_by_product(pos: DataFrame, as_of: Column) -> DataFrame:
    return (
        open_purchase_orders(pos, as_of)
        .groupBy("product_id")
        .agg(
            F.count(F.lit(1)).alias("open_orders"),
            F.sum("quantity_ordered").alias("units_in_transit"),
        )
    )


def replenishment_list(
    inventory: DataFrame,
    sales: DataFrame,
    products: DataFrame,
    suppliers: DataFrame,
    pos: DataFrame,
    as_of: Column | None = None,
    cover: float = 2.5,
    minimum: int = 20,
    baseline_days: int | None = 60,
    lead_penalty: str | None = None,
) -> DataFrame:
    """Products to reorder now, and how much.

    A product is listed when its latest stock is at or below the reorder point and nothing
    is on order. The quantity covers ``cover`` lead times of demand, rounded half to even.
    """
    if as_of is None:
        as_of = scalar(inventory, F.max("snapshot_date"))
    stock = latest_stock(inventory).select("product_id", "stock_on_hand")
    points = reorder_point(
        sales, products, suppliers, baseline_days=baseline_days, lead_penalty=lead_penalty
    )
    quantity = F.bround(F.col("avg_daily_demand") * F.col("lead_time_days") * cover, 0).cast("long")
    open_keys = open_purchase_orders(pos, as_of).select("product_id").distinct()
    return (
        stock.join(points, "product_id")
        .filter(F.col("stock_on_hand") <= F.col("reorder_point"))
        .join(open_keys, "product_id", "left_anti")
        .select(
            "product_id",
            "stock_on_hand",
            F.round("reorder_point", 2).alias("reorder_point"),
            F.greatest(quantity, F.lit(minimum)).alias("order_quantity"),
        )
    )
