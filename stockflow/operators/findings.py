"""Headline findings built on status, cover and causes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.functions.columns import scalar
from stockflow.operators.measures import days_of_inventory, stock_value
from stockflow.operators.suppliers import supplier_reliability
from stockflow.schemas import CRITICAL, OVERSTOCKED, REORDER_SOON


def excess_cover(
    inventory: DataFrame, sales: DataFrame, products: DataFrame, above_days: float = 60.0
) -> DataFrame:
    """Products with more than ``above_days`` of inventory and the capital in it."""
    cover = days_of_inventory(inventory, sales, products, by=["product_id"])
    return (
        cover.filter(F.col("days_of_inventory_remaining") > above_days)
        .join(products.select("product_id", "product_name", "unit_cost"), "product_id")
        .select(
            "product_id",
            "product_name",
            "stock_on_hand",
            "days_of_inventory_remaining",
            stock_value(F.col("stock_on_hand"), F.col("unit_cost")).alias("capital_tied_up"),
        )
    )


def excess_cover_total(cover: DataFrame) -> DataFrame:
    return cover.agg(
        F.count(F.lit(1)).alias("products"),
        F.coalesce(F.sum("capital_tied_up"), F.lit(0)).alias("capital_tied_up"),
    )


def overstock_capital(
    status: DataFrame, products: DataFrame, statuses: Sequence[str] = (OVERSTOCKED,)
) -> DataFrame:
    """Stock at cost of products by status, Overstocked unless told otherwise."""
    return (
        status.filter(F.col("status").isin(list(statuses)))
        .join(products.select("product_id", "unit_cost"), "product_id")
        .groupBy("status")
        .agg(
            F.count(F.lit(1)).alias("products"),
            F.sum(stock_value(F.col("stock_on_hand"), F.col("unit_cost"))).alias("capital_tied_up"),
        )
    )


def at_risk_products(status: DataFrame, summary: DataFrame, products: DataFrame) -> DataFrame:
    """Critical and Reorder Soon products with the revenue they have lost to date.

    ``summary`` is the unfiltered stockout summary; revenue lost to date is what "revenue
    at risk" means here.
    """
    return (
        status.filter(F.col("status").isin(CRITICAL, REORDER_SOON))
        .select("product_id", "product_name", "category", "stock_on_hand", "reorder_point", "status")
        .join(products.select("product_id", "supplier_id"), "product_id")
        .join(summary.select("product_id", "estimated_revenue_lost"), "product_id", "left")
        .withColumn("revenue_at_risk", F.coalesce("estimated_revenue_lost", F.lit(0)))
        .drop("estimated_revenue_lost")
    )


def at_risk_totals(at_risk: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count and revenue at risk, overall or by category or supplier."""
    return at_risk.groupBy(*by).agg(
        F.count(F.lit(1)).alias("products_at_risk"),
        F.count_if(F.col("status") == CRITICAL).alias("critical_products"),
        F.coalesce(F.sum("revenue_at_risk"), F.lit(0)).alias("revenue_at_risk"),
    )


def cause_split(
    status: DataFrame, streaks: DataFrame, pos: DataFrame, products: DataFrame
) -> DataFrame:
    """Why each at-risk product is at risk: demand, supply, both or neither.

    Demand-driven products have a growth streak; supply-driven ones have a supplier whose
    measured reliability is below that of all received orders together.
    """
    reliability = supplier_reliability(pos)
    average = scalar(
        reliability,
        F.sum(F.col("reliability_score") * F.col("received_orders")) / F.sum("received_orders"),
    )
    late = reliability.select(
        "supplier_id", F.when(F.col("reliability_score") < average, 1).otherwise(0).alias("_late")
    )
    growing = streaks.select("product_id", F.lit(1).alias("_growing")).distinct()
    grew, was_late = F.col("demand_driven") == 1, F.col("supply_driven") == 1
    cause = (
        F.when(grew & was_late, "demand and supply")
        .when(grew, "demand")
        .when(was_late, "supply")
        .otherwise("unexplained")
    )
    return (
        status.filter(F.col("status").isin(CRITICAL, REORDER_SOON))
        .select("product_id", "product_name", "status")
        .join(products.select("product_id", "supplier_id"), "product_id")
        .join(growing, "product_id", "left")
        .join(late, "supplier_id", "left")
        .withColumn("demand_driven", F.coalesce("_growing", F.lit(0)))
        .withColumn("supply_driven", F.coalesce("_late", F.lit(0)))
        .select("product_id", "product_name", "status", "supplier_id", "demand_driven", "supply_driven",
                cause.alias("cause"))
    )
