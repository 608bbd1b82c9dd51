"""Stockout counts, rates, runs and what they cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockflow.functions.columns import month_label, percent, ratio, scalar


def product_days(inventory: DataFrame, sales: DataFrame, regions: bool = False) -> DataFrame:
    """Snapshots and sales of the same product and day, one row each (C4).

    Both facts are stacked and summed by (product, day) in one shuffle with map-side
    combine, which gives the inner join without its fan-out: several sales rows of a day,
    one per region say, become one. With ``regions`` the day's regions are one more aggregate,
    at most as many as there are.
    """
    place = F.struct("region").alias("_place") if regions else F.lit(None).cast("int").alias("_place")
    nowhere = F.lit(None).cast("struct<region:string>" if regions else "int").alias("_place")
    seen = [F.collect_set("_place").alias("regions")] if regions else []
    snapshots = inventory.select(
        "product_id",
        F.col("snapshot_date").alias("day"),
        "is_stockout",
        F.lit(None).cast("long").alias("units_sold"),
        F.lit(None).cast("long").alias("units_demanded"),
        F.lit(0).alias("_sale"),
        nowhere,
    )
    flows = sales.select(
        "product_id",
        F.col("sale_date").alias("day"),
        F.lit(None).cast("int").alias("is_stockout"),
        F.col("units_sold").cast("long").alias("units_sold"),
        F.col("units_demanded").cast("long").alias("units_demanded"),
        F.lit(1).alias("_sale"),
        place,
    )
    return (
        snapshots.unionByName(flows)
        .groupBy("product_id", "day")
        .agg(
            F.max("is_stockout").alias("is_stockout"),
            F.sum("units_sold").alias("units_sold"),
            F.sum("units_demanded").alias("units_demanded"),
            F.max("_sale").alias("_has_sale"),
            F.min("_sale").alias("_no_snapshot"),
            *seen,
        )
        .filter("_has_sale = 1 AND _no_snapshot = 0")
        .drop("_has_sale", "_no_snapshot")
    )


def _money(units: Column, price: Column) -> Column:
    return (units.cast("decimal(18,0)") * price).cast("decimal(28,2)")


def stockout_summary(products: DataFrame, inventory: DataFrame, sales: DataFrame) -> DataFrame:
    """Stockout days, rate, units and revenue lost of every product (K9, unfiltered)."""
    lost = F.when(F.col("is_stockout") == 1, F.col("units_demanded") - F.col("units_sold")).otherwise(0)
    per_product = (
        product_days(inventory, sales)
        .groupBy("product_id")
        .agg(
            F.sum("is_stockout").alias("total_stockout_days"),
            F.count(F.lit(1)).alias("days_tracked"),
            F.sum(lost).alias("total_units_lost"),
        )
    )
    return per_product.join(
        products.select("product_id", "product_name", "category", "pattern_group", "unit_price"),
        "product_id",
    ).select(
        "product_id",
        "product_name",
        "category",
        "pattern_group",
        "total_stockout_days",
        "days_tracked",
        F.round(percent(F.col("total_stockout_days"), F.col("days_tracked")), 2).alias("stockout_rate_pct"),
        "total_units_lost",
        _money(F.col("total_units_lost"), F.col("unit_price")).alias("estimated_revenue_lost"),
    )


def top_stockouts(summary: DataFrame, k: int = 5, ordered: bool = True) -> DataFrame:
    """Products of rank k or better by stockout days in their category, ties kept (K9).

    Total lost revenue comes from the summary, not from this cut.
    """
    worst = Window.partitionBy("category").orderBy(F.desc_nulls_last("total_stockout_days"))
    # Each task keeps its own top k before the shuffle, so a large category is no burden.
    top = summary.withColumn("rank_in_category", F.rank().over(worst)).filter(F.col("rank_in_category") <= k)
    return top.orderBy("category", "rank_in_category") if ordered else top


def _per_product(inventory: DataFrame, *extra: Column) -> DataFrame:
    return inventory.groupBy("product_id", *extra).agg(
        F.sum("is_stockout").alias("_out"), F.count("is_stockout").alias("_days")
    )


def stockout_rate(
    inventory: DataFrame,
    products: DataFrame | None = None,
    sales: DataFrame | None = None,
    by: Sequence[str] = (),
    ordered: bool = True,
) -> DataFrame:
    """Share of snapshots that are stockouts, overall or by group, highest first.

    ``by`` takes product columns (category, pattern_group, supplier_id), ``month`` and
    ``region``. The region of a product-day is that of its sales, so snapshots without a
    sale drop out there. Snapshots are counted per product before dimensions are joined.
    """
    facts, keys = inventory, []
    if "region" in by:
        days = product_days(inventory, sales, regions=True)
        facts = days.select("product_id", F.col("day").alias("snapshot_date"), "is_stockout", F.inline("regions"))
        keys.append(F.col("region"))
    if "month" in by:
        keys.append(F.trunc("snapshot_date", "MM").alias("month"))
    counted = _per_product(facts, *keys)
    looked_up = [c for c in by if c not in ("region", "month", "product_id")]
    if looked_up:
        counted = counted.join(products.select("product_id", *looked_up), "product_id", "left")
    rates = counted.groupBy(*by).agg(
        F.sum("_out").alias("stockout_days"),
        F.sum("_days").alias("days_tracked"),
        ratio(F.sum("_out"), F.sum("_days")).alias("stockout_rate"),
    )
    if "month" in by:
        rates = rates.withColumn("month", month_label(F.col("month")))
    return rates.orderBy(F.desc("stockout_rate")) if ordered and by else rates


def service_level(inventory: DataFrame, products: DataFrame) -> DataFrame:
    """Achieved service level per product: one minus its stockout rate.

    Unknown products have no pattern.
    """
    return (
        _per_product(inventory)
        .join(products.select("product_id", "pattern_group"), "product_id", "left")
        .select(
            "product_id",
            "pattern_group",
            (1 - ratio(F.col("_out"), F.col("_days"))).alias("achieved_service_level"),
        )
    )


def service_level_by_pattern(levels: DataFrame, target: float = 0.95) -> DataFrame:
    """Mean, sample deviation and range of the levels per pattern, against a target."""
    level = F.col("achieved_service_level")
    return levels.groupBy("pattern_group").agg(
        F.avg(level).alias("mean"),
        F.stddev_samp(level).alias("std"),
        F.min(level).alias("min"),
        F.max(level).alias("max"),
        F.count_if(level >= target).alias("products_on_target"),
        F.when(F.avg(level) >= target, 1).otherwise(0).alias("meets_target"),
    )


def _grouped_lost(
    per_product: DataFrame, products: DataFrame, by: Sequence[str], total: Column, looked_up: Sequence[str] = ()
) -> DataFrame:
    """One total, or one for each group; unknown products stand under empty attributes."""
    wanted = [*looked_up, *[c for c in by if c != "product_id"]]
    if wanted:
        per_product = per_product.join(products.select("product_id", *wanted), "product_id", "left")
    return per_product.groupBy(*by).agg(total)


def units_lost(
    inventory: DataFrame, sales: DataFrame, products: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Units demanded but not sold on stockout days, of unknown products too."""
    gap = F.col("units_demanded") - F.col("units_sold")
    per_product = (
        product_days(inventory, sales)
        .filter("is_stockout = 1")
        .groupBy("product_id")
        .agg(F.sum(gap).alias("_gap"))
    )
    return _grouped_lost(per_product, products, by, F.coalesce(F.sum("_gap"), F.lit(0)).alias("units_lost"))


def revenue_lost_all_sales(sales: DataFrame, products: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Dashboard form: unmet demand of all sales rows at the unit price."""
    per_product = sales.groupBy("product_id").agg(
        F.sum(F.col("units_demanded") - F.col("units_sold")).alias("_gap")
    )
    lost = F.coalesce(F.sum(_money(F.col("_gap"), F.col("unit_price"))), F.lit(0)).alias("revenue_lost")
    return _grouped_lost(per_product, products, by, lost, ["unit_price"])


def revenue_lost_on_stockouts(
    inventory: DataFrame, sales: DataFrame, products: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Report form: unmet demand of stockout days only, at the unit price."""
    gap = F.col("units_demanded") - F.col("units_sold")
    per_product = (
        product_days(inventory, sales)
        .filter("is_stockout = 1")
        .groupBy("product_id")
        .agg(F.sum(gap).alias("_gap"))
    )
    lost = F.coalesce(F.sum(_money(F.col("_gap"), F.col("unit_price"))), F.lit(0)).alias("revenue_lost")
    return _grouped_lost(per_product, products, by, lost, ["unit_price"])


def revenue_lost_share(summary: DataFrame, group: str) -> DataFrame:
    """Revenue lost per group and its share of the total, from the unfiltered summary."""
    lost = F.sum("estimated_revenue_lost")
    grouped = summary.groupBy(group).agg(lost.alias("revenue_lost"))
    total = scalar(grouped, F.sum("revenue_lost"))
    return grouped.withColumn("share_pct", F.round(percent(F.col("revenue_lost"), total), 2))


def high_stockout_products(summary: DataFrame, above_pct: float = 5.0) -> DataFrame:
    """Products whose stockout rate exceeds a cut-line."""
    rate = percent(F.col("total_stockout_days"), F.col("days_tracked"))
    return summary.filter(rate > above_pct)


def high_stockout_share(summary: DataFrame, above_pct: float = 5.0) -> DataFrame:
    """How many products exceed the cut-line, and what share of all they are."""
    rate = percent(F.col("total_stockout_days"), F.col("days_tracked"))
    over = F.count_if(rate > above_pct)
    every = F.count(F.lit(1))
    return summary.agg(
        over.alias("products_above"),
        every.alias("products"),
        F.round(percent(over, every), 2).alias("share_pct"),
    )


def stockout_runs(inventory: DataFrame, calendar_days: bool = False) -> DataFrame:
    """Runs of consecutive stockouts per product.

    By default a run goes on until a snapshot in stock. With ``calendar_days`` it also ends
    at a day without a snapshot; on daily data the two agree. The first form names a run by
    the snapshots in stock before it, the second by its date less its place in the series.
    """
    by_day = Window.partitionBy("product_id").orderBy("snapshot_date")
    days = inventory.select("product_id", "snapshot_date", "is_stockout")
    if calendar_days:
        days = days.filter("is_stockout = 1").withColumn(
            "_run", F.unix_date("snapshot_date") - F.row_number().over(by_day)
        )
    else:
        days = days.withColumn("_run", F.count_if(F.col("is_stockout") == 0).over(by_day)).filter(
            "is_stockout = 1"
        )
    return (
        days.groupBy("product_id", "_run")
        .agg(
            F.min("snapshot_date").alias("run_start"),
            F.max("snapshot_date").alias("run_end"),
            F.count(F.lit(1)).alias("stockout_days"),
        )
        .drop("_run")
    )


def stockout_duration(runs: DataFrame, dims: DataFrame, by: Sequence[str] = ("category",)) -> DataFrame:
    """How often stockouts start and how long they last, by product, category or region.

    ``dims`` maps product_id to the grouping columns.
    """
    keys = [c for c in by if c != "product_id"]
    per_product = runs.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("_runs"),
        F.sum("stockout_days").alias("_days"),
        F.max("stockout_days").alias("_longest"),
    )
    if keys:
        per_product = per_product.join(dims.select("product_id", *keys).distinct(), "product_id")
    return per_product.groupBy(*by).agg(
        F.sum("_runs").alias("stockout_runs"),
        F.sum("_days").alias("stockout_days"),
        ratio(F.sum("_days"), F.sum("_runs")).alias("avg_run_days"),
        F.max("_longest").alias("longest_run_days"),
    )
