"""Dashboard measures; ``by`` is the grouping a visual applies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.functions.columns import ratio
from stockflow.operators.demand import rolling_demand
from stockflow.operators.ledger import stock_against_reorder_point
from stockflow.operators.replenishment import latest_stock, recent_demand


def _dims(products: DataFrame, by: Sequence[str], *extra: str) -> DataFrame:
    return products.select("product_id", *[c for c in by if c != "product_id"], *extra)


def _newest_stock(inventory: DataFrame) -> DataFrame:
    return latest_stock(inventory).select("product_id", "stock_on_hand")


def stock_value(units: Column, unit_cost: Column) -> Column:
    return (units.cast("decimal(18,0)") * unit_cost).cast("decimal(28,2)")


def total_revenue(sales: DataFrame, products: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Revenue earned (K15). Sales of unknown products count too, under empty attributes."""
    if not by:
        return sales.agg(F.sum("revenue").alias("total_revenue"))
    per_product = sales.groupBy("product_id").agg(F.sum("revenue").alias("_revenue"))
    return (
        per_product.join(_dims(products, by), "product_id", "left")
        .groupBy(*by)
        .agg(F.sum("_revenue").alias("total_revenue"))
    )


def inventory_turnover(
    sales: DataFrame, inventory: DataFrame, products: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Revenue over average stock times average unit cost.

    As the dashboard states it: both averages are unweighted, and revenue stands in for the
    cost of goods sold. The facts are summed per product before they meet the dimension;
    those of unknown products count under empty attributes.
    """
    revenue = sales.groupBy("product_id").agg(F.sum("revenue").alias("_revenue"))
    stock = inventory.groupBy("product_id").agg(
        F.sum("stock_on_hand").alias("_stock"), F.count("stock_on_hand").alias("_days")
    )
    parts = (
        products.select("product_id", *[c for c in by if c != "product_id"], "unit_cost")
        .join(revenue, "product_id", "full")
        .join(stock, "product_id", "full")
    )
    avg_stock = ratio(F.sum("_stock"), F.sum("_days"))
    avg_cost = ratio(F.sum("unit_cost"), F.count("unit_cost"))
    return parts.groupBy(*by).agg(
        F.sum("_revenue").alias("total_revenue"),
        avg_stock.alias("avg_stock_on_hand"),
        avg_cost.alias("avg_unit_cost"),
        ratio(F.sum("_revenue"), avg_stock * avg_cost).alias("inventory_turnover"),
    )


def days_of_inventory(
    inventory: DataFrame,
    sales: DataFrame,
    products: DataFrame,
    by: Sequence[str] = (),
    window_days: int = 30,
) -> DataFrame:
    """Latest stock over average daily demand of the trailing window.

    Demand is the per-product average of the status report, summed over the group. Stock is
    the last known value of each product, which on daily data is that of the last date.
    Stock of unknown products counts under empty attributes.
    """
    parts = (
        _newest_stock(inventory)
        .join(_dims(products, by), "product_id", "left")
        .join(recent_demand(sales, window_days), "product_id", "left")
    )
    stock, demand = F.sum("stock_on_hand"), F.sum("avg_daily_demand")
    return parts.groupBy(*by).agg(
        stock.alias("stock_on_hand"),
        demand.alias("avg_daily_demand_30d"),
        ratio(stock, demand).alias("days_of_inventory_remaining"),
    )


def inventory_value(inventory: DataFrame, products: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Latest stock of each product at unit cost (K21); unknown products have no value."""
    return (
        _newest_stock(inventory)
        .join(_dims(products, by, "unit_cost"), "product_id", "left")
        .groupBy(*by)
        .agg(F.sum(stock_value(F.col("stock_on_hand"), F.col("unit_cost"))).alias("inventory_value"))
    )


def status_counts(status: DataFrame) -> DataFrame:
    """Number of products in each status."""
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("products"))


def carrying_cost(
    inventory: DataFrame, products: DataFrame, annual_rate: float, by: Sequence[str] = ("product_id",)
) -> DataFrame:
    """Average stock at unit cost, times a yearly rate, for the days covered.

    The rate has no default: it is the user's cost of capital and storage. Stock of unknown
    products has no cost.
    """
    span = F.datediff(F.max("snapshot_date"), F.min("snapshot_date")) + 1
    per_product = inventory.groupBy("product_id").agg(
        F.avg("stock_on_hand").alias("_stock"), span.alias("_days")
    )
    cost = (
        F.col("_stock") * F.col("unit_cost").cast("double") * F.lit(float(annual_rate)) * F.col("_days") / 365
    )
    return (
        per_product.join(_dims(products, by, "unit_cost"), "product_id", "left")
        .groupBy(*by)
        .agg(F.sum(cost).alias("carrying_cost"))
    )


def product_detail(
    product_id: int | Column, sales: DataFrame, inventory: DataFrame, products: DataFrame
) -> DataFrame:
    """Drill-through: one product's daily stock, reorder point, rolling demand and stockouts.

    ``units_lost`` and ``estimated_revenue_lost`` are those of stockout days, as in the
    stockout summary from which a user drills.
    """
    chosen = F.col("product_id") == product_id
    gaps = sales.filter(chosen).select(
        "product_id",
        F.col("sale_date").alias("snapshot_date"),
        (F.col("units_demanded") - F.col("units_sold")).alias("_gap"),
    )
    days = ["product_id", "snapshot_date"]
    out = F.col("is_stockout") == 1
    lost = F.when(out, F.coalesce("_gap", F.lit(0))).otherwise(0).cast("long")
    losses = (
        inventory.filter(chosen)
        .select(*days, "is_stockout")
        .join(gaps, days, "left")
        .join(products.filter(chosen).select("product_id", "unit_price"), "product_id", "left")
        .select(
            *days,
            "is_stockout",
            lost.alias("units_lost"),
            stock_value(lost, F.col("unit_price")).alias("estimated_revenue_lost"),
        )
    )
    demand = rolling_demand(sales.filter(chosen), products.filter(chosen), ordered=False).select(
        "product_id",
        F.col("sale_date").alias("snapshot_date"),
        "units_sold",
        "rolling_30d_avg_demand",
        "rolling_30d_total_demand",
    )
    series = stock_against_reorder_point(inventory.filter(chosen))
    return series.join(demand, days, "left").join(losses, days, "left")
