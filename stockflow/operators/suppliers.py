"""Supplier delivery performance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.functions.columns import percent, ratio, scalar
from stockflow.functions.ranking import rank_by_value
from stockflow.operators.profiles import box_stats
from stockflow.sources.tables_io import staged


def received_orders(pos: DataFrame) -> DataFrame:
    """Orders with an actual delivery date, whatever their status."""
    return pos.filter(F.col("actual_delivery_date").isNotNull())


def _on_time():
    return (F.col("status") == "Delivered") & (
        F.col("actual_delivery_date") <= F.col("expected_delivery_date")
    )


def _order_performance(pos: DataFrame) -> DataFrame:
    return (
        received_orders(pos)
        .groupBy("supplier_id")
        .agg(
            F.count(F.lit(1)).alias("total_orders"),
            F.count_if(_on_time()).alias("on_time_orders"),
            F.count_if(F.col("status") == "Delayed").alias("delayed_orders"),
            F.avg(F.datediff("actual_delivery_date", "order_date")).alias("_lead"),
        )
    )


def _supplied_stockouts(products: DataFrame, inventory: DataFrame) -> DataFrame:
    """Stockout rate over all snapshots of the products a supplier supplies."""
    per_product = inventory.groupBy("product_id").agg(
        F.sum("is_stockout").alias("_out"), F.count("is_stockout").alias("_days")
    )
    return (
        per_product.join(products.select("product_id", "supplier_id"), "product_id")
        .groupBy("supplier_id")
        .agg(
            ratio(F.sum("_out"), F.sum("_days")).alias("_stockout_rate"),
            F.count(F.lit(1)).alias("_products_tracked"),
        )
    )


def supplier_performance(
    suppliers: DataFrame, pos: DataFrame, products: DataFrame, inventory: DataFrame
) -> DataFrame:
    """Unrounded figures behind the ranking; only suppliers with orders and products."""
    return (
        suppliers.select("supplier_id", "supplier_name", "region", "avg_lead_time_days")
        .join(_order_performance(pos), "supplier_id")
        .join(_supplied_stockouts(products, inventory), "supplier_id")
        .withColumn("_on_time_pct", percent(F.col("on_time_orders"), F.col("total_orders")))
    )


def supplier_ranking(
    suppliers: DataFrame,
    pos: DataFrame,
    products: DataFrame,
    inventory: DataFrame,
    ordered: bool = True,
) -> DataFrame:
    """Suppliers ranked by on-time share of received orders (K8).

    Ranked on the unrounded share. Shares are bucketed by hundredths of a percent, so that
    no task sees all suppliers. The figures, a row per supplier, are written to the shared
    folder for the two passes of the ranking, so the facts are read once.
    """
    performance = staged(supplier_performance(suppliers, pos, products, inventory), "supplier-figures")
    ranked = rank_by_value(
        performance, "_on_time_pct", "on_time_rank", bucket=F.floor(F.col("_on_time_pct") * 100)
    )
    result = ranked.select(
        "supplier_id",
        "supplier_name",
        "region",
        F.col("avg_lead_time_days").alias("quoted_avg_lead_time"),
        F.round("_lead", 1).alias("actual_avg_lead_time"),
        "total_orders",
        "on_time_orders",
        "delayed_orders",
        F.round("_on_time_pct", 1).alias("on_time_pct"),
        F.round(percent(F.col("delayed_orders"), F.col("total_orders")), 1).alias("delay_pct"),
        F.round(F.col("_stockout_rate") * 100, 1).alias("stockout_rate_pct_of_products_supplied"),
        "on_time_rank",
    )
    return result.orderBy("on_time_rank") if ordered else result


def delivery_delays(pos: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Lead and delay in days of every received order; early ones are negative."""
    return (
        received_orders(pos)
        .withColumn("actual_lead_days", F.datediff("actual_delivery_date", "order_date"))
        .withColumn("delay_days", F.datediff("actual_delivery_date", "expected_delivery_date"))
        .join(suppliers.select("supplier_id", "supplier_name"), "supplier_id")
    )


def delay_profile(pos: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Box-plot summary of delay days by supplier.

    Delays are counted per supplier key before the name is joined, so a supplier with very
    many orders brings only its distinct delays to the join.
    """
    delay = F.datediff("actual_delivery_date", "expected_delivery_date").alias("delay_days")
    counted = received_orders(pos).groupBy("supplier_id", delay).agg(F.count(F.lit(1)).alias("orders"))
    named = counted.join(suppliers.select("supplier_id", "supplier_name"), "supplier_id")
    return box_stats(named, "delay_days", ["supplier_name"], weight="orders")


def supplier_reliability(pos: DataFrame) -> DataFrame:
    """Measured reliability and lead time of each supplier from its orders."""
    lead = F.datediff("actual_delivery_date", "order_date")
    return (
        received_orders(pos)
        .groupBy("supplier_id")
        .agg(
            F.count(F.lit(1)).alias("received_orders"),
            ratio(F.count_if(_on_time()), F.count(F.lit(1))).alias("reliability_score"),
            F.avg(lead).alias("mean_lead_days"),
            F.stddev_samp(lead).alias("std_lead_days"),
        )
    )


def delivered_share(pos: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Dashboard form of on-time delivery: Delivered orders over all orders."""
    delivered = F.count_if(F.col("status") == "Delivered")
    every = F.count(F.lit(1))
    return pos.groupBy(*by).agg(
        delivered.alias("delivered_orders"),
        every.alias("all_orders"),
        ratio(delivered, every).alias("on_time_delivery"),
    )


def supplier_scatter(
    suppliers: DataFrame, pos: DataFrame, products: DataFrame, inventory: DataFrame
) -> DataFrame:
    """On-time share, stockout rate and number of products per supplier."""
    supplied = (
        products.filter(F.col("supplier_id").isNotNull())
        .groupBy("supplier_id")
        .agg(F.count(F.lit(1)).alias("products_supplied"))
    )
    return (
        supplier_performance(suppliers, pos, products, inventory)
        .join(supplied, "supplier_id")
        .select(
            "supplier_id",
            "supplier_name",
            F.col("_on_time_pct").alias("on_time_pct"),
            (F.col("_stockout_rate") * 100).alias("stockout_rate_pct"),
            "products_supplied",
        )
    )


def supplier_correlation(scatter: DataFrame) -> DataFrame:
    """Correlation of on-time share and stockout rate over suppliers."""
    return scatter.agg(
        F.count(F.lit(1)).alias("suppliers"),
        F.corr("on_time_pct", "stockout_rate_pct").alias("correlation"),
    )


def underperforming_suppliers(
    suppliers: DataFrame,
    pos: DataFrame,
    products: DataFrame,
    inventory: DataFrame,
    on_time_below: float | None = None,
) -> DataFrame:
    """Suppliers above the company stockout rate that are also late.

    Late means an on-time share below ``on_time_below`` percent, or below the share of all
    received orders when it is not given.
    """
    company_rate = scalar(inventory, F.avg("is_stockout"))
    if on_time_below is None:
        late_line = scalar(received_orders(pos), percent(F.count_if(_on_time()), F.count(F.lit(1))))
    else:
        late_line = F.lit(float(on_time_below))
    return (
        supplier_performance(suppliers, pos, products, inventory)
        .filter((F.col("_stockout_rate") > company_rate) & (F.col("_on_time_pct") < late_line))
        .select(
            "supplier_id",
            "supplier_name",
            F.round("_on_time_pct", 1).alias("on_time_pct"),
            F.round(F.col("_stockout_rate") * 100, 1).alias("stockout_rate_pct"),
        )
    )
