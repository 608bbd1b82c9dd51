"""Every operator as a query over the test tables.

Each function takes (tables, spark) and names the inventory ids it covers. Results come
back with decimals as doubles, so that both engines compare the same plain types.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from stockflow.functions.columns import scalar
from stockflow.functions.ranking import number_rows, row_positions
from stockflow.operators import (
    calendars,
    demand,
    findings,
    ledger,
    measures,
    profiles,
    quality,
    replenishment,
    stockouts,
    suppliers,
)
from stockflow.schemas import CRITICAL, REORDER_SOON
from stockflow.sources import marts, stored_ledger, tables_io
from stockflow.sources.testdata_map import MappedTables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
COVERS: dict[str, list[str]] = {}

CARRYING_RATE = 0.2
AS_OF = "1999-06-30"
GRID_START, GRID_END = "1998-01-01", "1998-12-31"
FIRST_LOAD, LATE_MONTH = "1997-06-10", "1996-07"


def plain(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def query(name: str, covers: str):
    def register(build: Callable[[MappedTables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(build(MappedTables(spark, sf_dir)))

        run.__name__ = name
        run.__doc__ = f"Covers {covers}."
        QUERIES[name] = run
        COVERS[name] = covers.split()
        return build

    return register


# Sources, sinks and quality


def _round_trip(t, table):
    folder = tables_io.shared_dir(t.spark, "csv")
    rows = _numbered_orders(t) if table == "purchase_orders" else t.all()[table]
    tables_io.write_tables({table: rows.withColumn("helper", F.lit(1))}, folder, drop=["helper"])
    return tables_io.load_table(t.spark, f"{folder}/{table}.csv", table)


@query("a01_csv_round_trip", "A1 A2 A3 A4 A5 A16")
def _(t):
    return _round_trip(t, "purchase_orders")


@query("a01_csv_products", "A1 A4 A5 A16")
def _(t):
    return _round_trip(t, "products")


@query("a01_csv_suppliers", "A1 A4 A5 A16")
def _(t):
    return _round_trip(t, "suppliers")


@query("a01_csv_sales", "A1 A3 A4 A5 A16")
def _(t):
    return _round_trip(t, "sales")


@query("a01_csv_inventory", "A1 A3 A4 A5 A16")
def _(t):
    return _round_trip(t, "inventory")


def _checked(t):
    """The mapped tables, with the raw lines, whose declared key has real repeats."""
    return {**t.all(), "lineitem": t.raw("lineitem")}


@query("a01_rejected_rows", "A1 A3")
def _(t):
    """Orders exported with faults in three of fifty products: by product, rows and rejects."""
    fault = F.col("product_id") % 50
    day = F.date_format("order_date", "yyyy-MM-dd")
    text = {
        "order_date": F.when(fault == 7, F.date_format("order_date", "dd/MM/yyyy")).otherwise(day),
        "quantity_ordered": F.when(fault == 8, "many").otherwise(F.col("quantity_ordered").cast("string")),
        "unit_cost": F.when(fault == 9, "n/a").otherwise(F.col("unit_cost").cast("string")),
    }
    folder = tables_io.shared_dir(t.spark, "csv")
    orders = t.purchase_orders.withColumn("po_id", F.lit(1).cast("long")).withColumns(text)
    tables_io.write_tables({"purchase_orders": orders}, folder)
    good, bad = tables_io.load_with_rejects(t.spark, f"{folder}/purchase_orders.csv", "purchase_orders")
    rejected = bad.select(F.split("line", ",")[1].cast("long").alias("product_id"), F.lit(None).cast("int").alias("units"))
    both = good.select("product_id", F.col("quantity_ordered").alias("units")).unionByName(rejected)
    return both.groupBy("product_id").agg(
        F.count("units").alias("rows"), F.count_if(F.col("units").isNull()).alias("rejected"), F.sum("units").alias("units")
    )


@query("a06_null_cells", "A6 H14")
def _(t):
    return quality.null_cells(t.all())


@query("a07_duplicate_rows", "A7")
def _(t):
    return quality.duplicate_rows(_checked(t))


@query("a08_orphan_keys", "A8")
def _(t):
    tables = {**t.all(), "lineitem": t.raw("lineitem"), "orders": t.raw("orders"), "part": t.raw("part")}
    raw_keys = [
        ("lineitem", "l_orderkey", "orders", "o_orderkey"),
        ("lineitem", "l_partkey", "part", "p_partkey"),
    ]
    return quality.orphan_report(tables, quality.FOREIGN_KEYS + raw_keys)


@query("a09_repeated_keys", "A9")
def _(t):
    keys = {**quality.KEYS, "lineitem": [["l_orderkey", "l_linenumber"]]}
    return quality.key_report({**_checked(t), "purchase_orders": _numbered_orders(t)}, keys)


@query("a09_repeated_line_keys", "A9")
def _(t):
    return quality.repeated_keys(t.raw("lineitem"), ["l_orderkey", "l_linenumber"])


@query("a10_domain_violations", "A10")
def _(t):
    return quality.domain_report(t.all())


@query("a11_table_report", "A11")
def _(t):
    return quality.table_report(t.all())


@query("a12_domain_rules", "A12 H15")
def _(t):
    return quality.domain_rules(t.sales, t.inventory, t.products)


@query("a13_row_counts", "A13 G1 D2")
def _(t):
    return quality.row_counts(t.all())


def _numbered_orders(t):
    """Numbered by product and day, in which order a purchase history emits its orders."""
    rest = ["supplier_id", "expected_delivery_date", "actual_delivery_date", "quantity_ordered", "status"]
    ranged = t.purchase_orders.withColumn("range", F.floor(F.col("product_id") / 256))
    bucket = F.struct("product_id", F.trunc("order_date", "MM"))
    return number_rows(ranged, "po_id", "range", bucket, ["order_date", *rest]).drop("range")


@query("a14_surrogate_keys", "A14")
def _(t):
    return _numbered_orders(t)


ORDER_KEY = ["product_id", "supplier_id", "order_date", "expected_delivery_date", "quantity_ordered", "copy"]


@query("a14_keys_kept", "A14")
def _(t):
    """Three loads: orders up to a day, then all, then all again; keys of the first stay."""
    rest = ["actual_delivery_date", "status"]
    copies = Window.partitionBy(*ORDER_KEY[:-1]).orderBy(*rest)
    orders = t.purchase_orders.withColumns(
        {"copy": F.row_number().over(copies), "range": F.floor(F.col("product_id") / 256)}
    )
    path = tables_io.shared_dir(t.spark, "keys")
    table = marts.KeyTable(t.spark, path, ORDER_KEY, "po_id")
    bucket = F.struct("product_id", F.trunc("order_date", "MM"))
    for rows in (orders.filter(F.col("order_date") < FIRST_LOAD), orders, orders):
        keyed = table.load(rows, "range", bucket, ORDER_KEY[2:3] + ORDER_KEY[1:2] + ORDER_KEY[3:])
    return keyed.drop("copy", "range")


@query("a17_refreshed_mart", "A17 K1")
def _(t):
    """A mart published before a month's late sales of every tenth product, then refreshed."""
    late = (F.col("product_id") % 10 == 3) & (F.date_format("sale_date", "yyyy-MM") == LATE_MONTH)
    path = tables_io.shared_dir(t.spark, "mart")

    def build(sales):
        return demand.rolling_demand(sales, t.products, ordered=False)

    tables_io.publish_mart(build(t.sales.filter(~late)), path, day="sale_date")
    marts.refresh_mart(path, t.sales, t.sales.filter(late), build, rows=30)
    return t.spark.read.parquet(path).drop("month")


@query("a17_published_mart", "A15 A17")
def _(t):
    path = tables_io.shared_dir(t.spark, "mart")
    mart = tables_io.publish_mart(tables_io.stamp_loaded(t.sales), path, day="sale_date")
    return mart.groupBy("month").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("units_sold").alias("units_sold"),
        F.count("created_at").alias("stamped"),
    )


@query("a17_bucketed_mart", "A17 K1")
def _(t):
    path = tables_io.shared_dir(t.spark, "bucketed")
    buckets = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"sales_{path[-12:]}"
    sales = tables_io.publish_bucketed(t.sales, name, path, buckets)
    t.spark.sql(f"DROP TABLE {name}")  # the files stay, and the frame knows them
    return demand.rolling_demand(sales, t.products, ordered=False)


# Scalars, distributions, calendar


@query("h10_scalar_functions", "H2 H10 H11 H12 H13")
def _(t):
    units = F.col("units_demanded")
    day = F.col("sale_date")
    price_rank = F.split("product_name", " ")[0]
    return t.sales.join(t.products.select("product_id", "sku", "product_name"), "product_id").select(
        "product_id",
        "sku",
        price_rank.alias("first_word"),
        F.date_format(day, "yyyy-MM-dd").alias("iso_date"),
        F.date_format(F.date_add(day, 7), "yyyy-MM-dd").alias("iso_next_week"),
        F.dayofyear(day).alias("day_of_year"),
        F.round(F.sin(F.dayofyear(day) * 2 * 3.141592653589793 / 7), 9).alias("weekly_wave"),
        F.sqrt(units.cast("double")).alias("root"),
        F.least(F.greatest(units, F.lit(5)), F.lit(40)).alias("clipped"),
        F.bround(units / 4, 0).cast("long").alias("quarter_half_even"),
        F.when(F.dayofyear(day).between(280, 320), units * 1.8).otherwise(units * 1.0).alias("lifted"),
    )


@query("d08_demand_baseline", "D8 H11")
def _(t):
    return replenishment.demand_baseline(t.sales)


@query("d09_order_status_counts", "D9 F4")
def _(t):
    return profiles.value_counts(t.purchase_orders, "status")


@query("d09_pattern_counts", "D9")
def _(t):
    return profiles.value_counts(t.products, "pattern_group")


@query("d10_units_sold_histogram", "D10")
def _(t):
    return profiles.histogram(t.sales, "units_sold")


def _labelled_sales(t):
    """Sales counted by product and units before the product's pattern is looked up."""
    counted = t.sales.groupBy("product_id", "units_sold").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(t.products.select("product_id", "pattern_group"), "product_id")


@query("d11_units_by_pattern", "D11 C7")
def _(t):
    return profiles.box_stats(_labelled_sales(t), "units_sold", ["pattern_group"], weight="n")


@query("d11_unit_outliers", "D11")
def _(t):
    return profiles.box_outliers(_labelled_sales(t), "units_sold", ["pattern_group"], weight="n")


@query("d12_service_level_bars", "D12 D6")
def _(t):
    levels = stockouts.service_level(t.snapshots, t.products)
    bars = profiles.mean_with_spread(levels, "achieved_service_level", ["pattern_group"])
    return _rounded(bars, 9, "mean", "std", "low", "high")


def _rounded(df, digits, *columns):
    """Figures whose last bits depend on the order of addition."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("i01_daily_demand", "I1 H8 H9")
def _(t):
    return calendars.daily_demand(t.sales)


@query("i02_weekday_distribution", "I2 F5 D11")
def _(t):
    return calendars.weekday_distribution(t.sales)


@query("i03_monthly_demand", "I3 D7")
def _(t):
    return calendars.monthly_demand(t.sales)


@query("i04_monthly_revenue", "I4")
def _(t):
    return calendars.monthly_revenue(t.sales, t.products)


@query("i05_date_table", "I5")
def _(t):
    return calendars.date_table(calendars.date_bounds(t.sales, "sale_date"))


@query("c10_calendar_demand", "C10 I5")
def _(t):
    dates = calendars.date_table(calendars.date_bounds(t.inventory, "snapshot_date"))
    on_days = calendars.on_calendar(dates, t.sales, "sale_date", ["units_sold", "units_demanded"])
    return on_days.select("date", "dow", "units_sold", "units_demanded")


def _grid_totals(grid):
    return grid.groupBy("snapshot_date").agg(
        F.count(F.lit(1)).alias("products"),
        F.sum("stock_on_hand").alias("stock_on_hand"),
        F.sum("is_stockout").alias("stockouts"),
        F.sum("units_sold").alias("units_sold"),
        F.sum("units_demanded").alias("units_demanded"),
        F.sum("receipts").alias("receipts"),
    )


@query("i06_dense_days", "I6")
def _(t):
    return _grid_totals(calendars.dense_product_days(t.inventory, t.sales, receipts=t.receipts))


@query("i06_dense_days_in_range", "I6")
def _(t):
    start, end = F.lit(GRID_START).cast("date"), F.lit(GRID_END).cast("date")
    return _grid_totals(calendars.dense_product_days(t.inventory, t.sales, start, end, t.receipts))


# Demand


@query("k01_rolling_demand", "K1 B1 C1 E1 E2 F1 H1")
def _(t):
    return demand.rolling_demand(t.sales, t.products, ordered=False)


@query("k01_rolling_true_demand", "K1")
def _(t):
    return demand.rolling_demand(t.sales, t.products, days=7, measure="units_demanded", ordered=False)


@query("k02_latest_rolling_demand", "K2 B8 C6")
def _(t):
    return demand.latest_rolling_demand(t.sales, t.products)


@query("k10_growth_streaks", "K10 B6 B7 D7 E5 E6 H7")
def _(t):
    return demand.demand_growth_streaks(t.sales, t.products)


@query("k34_demand_profile", "K34")
def _(t):
    profile = demand.demand_profile(t.sales)
    return _rounded(profile, 6, "std_demand", "coefficient_of_variation", "trend_slope")


@query("k35_festive_uplift", "K35 H10")
def _(t):
    return demand.festive_uplift(t.sales, t.products)


# Replenishment


@query("k03_reorder_point", "K3 D8 H11")
def _(t):
    return replenishment.reorder_point(t.sales, t.products, t.suppliers)


@query("k03_reorder_point_penalised", "K3")
def _(t):
    slow = F.when(F.col("category") == "ECONOMY", 1.6).otherwise(1.0)
    return replenishment.reorder_point(
        t.sales, t.products.withColumn("slow", slow), t.suppliers, baseline_days=None, lead_penalty="slow"
    )


@query("k04_full_safety_stock", "K4")
def _(t):
    return replenishment.reorder_point(t.sales, t.products, t.suppliers, method="full")


@query("k05_reorder_point_asof", "K5")
def _(t):
    return replenishment.reorder_point_asof(t.sales, t.inventory, t.products, t.suppliers)


@query("k06_service_levels", "K6")
def _(t):
    return replenishment.reorder_point_by_service_level(t.sales, t.products, t.suppliers)


def _status(t, ordered=False):
    return replenishment.stock_status(t.products, t.inventory, t.sales, ordered=ordered)


@query("k07_stock_status", "K7 B1 B3 B10 C2 C3 C6 D1 E7 F2 H3 H4 H5")
def _(t):
    return _status(t, ordered=True)


@query("b09_status_slice", "B9")
def _(t):
    return replenishment.slice_status(
        _status(t), statuses=[CRITICAL, REORDER_SOON], categories=["SMALL", "LARGE", "ECONOMY"]
    )


@query("k37_open_orders", "K37")
def _(t):
    return replenishment.open_purchase_orders(t.purchase_orders, F.lit(AS_OF).cast("date"))


@query("k37_units_in_transit", "K37")
def _(t):
    return replenishment.in_transit_by_product(t.purchase_orders, F.lit(AS_OF).cast("date"))


@query("k38_replenishment_list", "K38 H2")
def _(t):
    return replenishment.replenishment_list(
        t.inventory, t.sales, t.products, t.suppliers, t.purchase_orders, baseline_days=None
    )


# Ledger


@query("k36_stock_ledger", "K36")
def _(t):
    return t.derive_ledger().drop("unit_price")


@query("k36_extended_ledger", "K36")
def _(t):
    """A first ledger, the days after it, and then late movements of every tenth product."""
    def loads(moves):
        late = (F.col("product_id") % 10 == 3) & (F.date_format("day", "yyyy-MM") == LATE_MONTH)
        new = F.col("day") >= FIRST_LOAD
        return moves.filter(~new & ~late), moves.filter(new & ~late), moves.filter(late)

    path = tables_io.shared_dir(t.spark, "ledger")
    opening = t.opening.select("product_id", "opening_stock")
    first, *later = zip(loads(t.demand), loads(t.receipts), strict=True)
    stored_ledger.store_ledger(*first, opening, path)
    for moved in later:
        stored_ledger.extend_ledger(t.spark, path, *moved)
    return stored_ledger.stored_days(t.spark, path).drop("block")


@query("g02_appended_products", "G2 K36")
def _(t):
    """Row sets of groups of products, each replayed on its own, one after the other."""
    def part(df, n):
        return df.filter(F.col("product_id") % 3 == n)

    opening = t.opening.select("product_id", "opening_stock")
    sets = [ledger.stock_ledger(part(t.demand, n), part(t.receipts, n), part(opening, n)) for n in range(3)]
    return reduce(DataFrame.unionByName, sets)


# Row order: the place of each row in the sorted report


@query("f01_rolling_order", "F1 K1")
def _(t):
    report = demand.rolling_demand(t.sales, t.products).select("product_id", "sale_date")
    return row_positions(report, "place", "last_place", ["product_id", "sale_date"])


@query("f01_ranking_order", "F1 F3 K9")
def _(t):
    report = stockouts.top_stockouts(_summary(t)).select("product_id", "category", "rank_in_category")
    return row_positions(report, "place", "last_place", ["category", "rank_in_category"])


@query("f02_status_order", "F2 K7")
def _(t):
    report = _status(t, ordered=True).select("product_id", "status", "days_of_inventory_remaining")
    return row_positions(report, "place", "last_place", ["status", "days_of_inventory_remaining"])


@query("f04_rate_order", "F4 K12")
def _(t):
    report = stockouts.stockout_rate(t.snapshots, t.products, by=["pattern_group"])
    return row_positions(report, "place", "last_place", ["stockout_rate"])


@query("f04_count_order", "F4 D9")
def _(t):
    report = profiles.value_counts(t.purchase_orders, "status")
    return row_positions(report, "place", "last_place", ["status"])


@query("f05_weekday_order", "F5 I2")
def _(t):
    report = calendars.weekday_distribution(t.sales).select("dow", "count")
    return row_positions(report, "place", "last_place", ["dow"])


@query("k39_lost_sales", "K39 C8")
def _(t):
    before = t.ledger.withColumn("units_available", F.col("stock_on_hand") + F.col("units_sold"))
    days = before.select("product_id", "day", "units_demanded", "units_available", "unit_price")
    return ledger.lost_sales(days).drop("unit_price")


@query("k24_reorder_crossings", "K24")
def _(t):
    return ledger.stock_against_reorder_point(t.inventory)


# Stockouts


def _summary(t):
    return stockouts.stockout_summary(t.products, t.inventory, t.sales)


@query("k09_top_stockouts", "K9 B2 B5 C4 D3 D5 E4 F3")
def _(t):
    return stockouts.top_stockouts(_summary(t))


@query("k09_stockout_summary", "K9 C4 D3 D5")
def _(t):
    return _summary(t)


@query("k12_rate_by_pattern", "K12 D4 F4")
def _(t):
    return stockouts.stockout_rate(t.snapshots, t.products, by=["pattern_group"])


@query("k12_rate_by_category", "K12 D4")
def _(t):
    return stockouts.stockout_rate(t.snapshots, t.products, by=["category"])


@query("k12_rate_by_region", "K12 C4")
def _(t):
    return stockouts.stockout_rate(t.inventory, sales=t.sales, by=["region"])


@query("k12_rate_by_supplier", "K12")
def _(t):
    return stockouts.stockout_rate(t.snapshots, t.products, by=["supplier_id"])


@query("k12_rate_by_month", "K12 B9")
def _(t):
    return stockouts.stockout_rate(t.snapshots, t.products, by=["month", "category"])


@query("k13_service_level", "K13")
def _(t):
    return stockouts.service_level(t.snapshots, t.products)


@query("k13_service_level_by_pattern", "K13 D6")
def _(t):
    levels = stockouts.service_level(t.snapshots, t.products)
    return _rounded(stockouts.service_level_by_pattern(levels), 9, "mean", "std")


@query("k16_units_lost", "K16 C9")
def _(t):
    return stockouts.units_lost(t.inventory, t.sales, t.products, by=["category"])


@query("k17_revenue_lost_all_sales", "K17 D13")
def _(t):
    return stockouts.revenue_lost_all_sales(t.sales, t.products, by=["category"])


@query("k17_revenue_lost_on_stockouts", "K17")
def _(t):
    return stockouts.revenue_lost_on_stockouts(t.inventory, t.sales, t.products, by=["category"])


@query("k23_lost_by_category", "K23")
def _(t):
    return stockouts.revenue_lost_share(_summary(t), "category")


@query("k23_lost_by_pattern", "K23")
def _(t):
    return stockouts.revenue_lost_share(_summary(t), "pattern_group")


@query("k23_lost_by_supplier", "K23")
def _(t):
    supplied = _summary(t).join(t.products.select("product_id", "supplier_id"), "product_id")
    return stockouts.revenue_lost_share(supplied, "supplier_id")


@query("k26_high_stockout_products", "K26")
def _(t):
    return stockouts.high_stockout_products(_summary(t))


@query("k26_high_stockout_share", "K26")
def _(t):
    return stockouts.high_stockout_share(_summary(t))


@query("k32_stockout_runs", "K32 E6")
def _(t):
    return stockouts.stockout_runs(t.inventory)


@query("k32_duration_by_category", "K32")
def _(t):
    return stockouts.stockout_duration(stockouts.stockout_runs(t.inventory), t.products, by=["category"])


@query("k32_duration_by_region", "K32")
def _(t):
    runs = stockouts.stockout_runs(t.inventory)
    return stockouts.stockout_duration(runs, t.sales.select("product_id", "region"), by=["region"])


@query("k32_calendar_runs", "K32")
def _(t):
    return stockouts.stockout_runs(t.inventory, calendar_days=True)


# Suppliers


@query("k08_supplier_ranking", "K8 B4 C5 D3 D4 D5 E3 H6")
def _(t):
    return suppliers.supplier_ranking(t.suppliers, t.purchase_orders, t.products, t.inventory)


@query("k11_delivery_delays", "K11 B4 H6")
def _(t):
    return suppliers.delivery_delays(t.purchase_orders, t.suppliers)


@query("k11_delay_profile", "K11 D11")
def _(t):
    return suppliers.delay_profile(t.purchase_orders, t.suppliers)


@query("k14_supplier_reliability", "K14")
def _(t):
    return _rounded(suppliers.supplier_reliability(t.purchase_orders), 6, "std_lead_days")


@query("k20_delivered_share", "K20 D14")
def _(t):
    return suppliers.delivered_share(t.purchase_orders, ("supplier_id",))


@query("k25_supplier_scatter", "K25")
def _(t):
    return suppliers.supplier_scatter(t.suppliers, t.purchase_orders, t.products, t.inventory)


@query("k25_supplier_correlation", "K25")
def _(t):
    scatter = suppliers.supplier_scatter(t.suppliers, t.purchase_orders, t.products, t.inventory)
    return _rounded(suppliers.supplier_correlation(scatter), 6, "correlation")


@query("k30_underperforming_suppliers", "K30")
def _(t):
    return suppliers.underperforming_suppliers(t.suppliers, t.purchase_orders, t.products, t.inventory)


# Measures and findings


@query("k15_total_revenue", "K15 D2")
def _(t):
    return measures.total_revenue(t.sales, t.products)


@query("k15_revenue_by_category", "K15")
def _(t):
    return measures.total_revenue(t.sales, t.products, by=["category"])


@query("k18_inventory_turnover", "K18")
def _(t):
    return measures.inventory_turnover(t.sales, t.inventory, t.products)


@query("k18_turnover_by_category", "K18")
def _(t):
    return measures.inventory_turnover(t.sales, t.inventory, t.products, by=["category"])


@query("k19_days_of_inventory", "K19")
def _(t):
    cover = measures.days_of_inventory(t.inventory, t.sales, t.products, by=["category"])
    return _rounded(cover, 6, "avg_daily_demand_30d", "days_of_inventory_remaining")


@query("k19_days_of_inventory_by_product", "K19")
def _(t):
    return measures.days_of_inventory(t.inventory, t.sales, t.products, by=["product_id"])


@query("k21_inventory_value", "K21")
def _(t):
    return measures.inventory_value(t.inventory, t.products, by=["category"])


@query("k22_status_counts", "K22")
def _(t):
    return measures.status_counts(_status(t))


@query("k27_excess_cover", "K27")
def _(t):
    return findings.excess_cover(t.inventory, t.sales, t.products)


@query("k27_excess_cover_total", "K27")
def _(t):
    return findings.excess_cover_total(findings.excess_cover(t.inventory, t.sales, t.products))


@query("k28_overstock_capital", "K28")
def _(t):
    return findings.overstock_capital(_status(t), t.products)


@query("k29_at_risk_products", "K29")
def _(t):
    return findings.at_risk_products(_status(t), _summary(t), t.products)


@query("k29_at_risk_by_category", "K29")
def _(t):
    at_risk = findings.at_risk_products(_status(t), _summary(t), t.products)
    return findings.at_risk_totals(at_risk, by=["category"])


@query("k29_at_risk_by_supplier", "K29")
def _(t):
    at_risk = findings.at_risk_products(_status(t), _summary(t), t.products)
    return findings.at_risk_totals(at_risk, by=["supplier_id"])


@query("k31_cause_split", "K31")
def _(t):
    streaks = demand.demand_growth_streaks(t.sales, t.products, ordered=False)
    return findings.cause_split(_status(t), streaks, t.purchase_orders, t.products)


@query("k33_carrying_cost", "K33")
def _(t):
    return measures.carrying_cost(t.inventory, t.products, CARRYING_RATE)


@query("k33_carrying_cost_by_category", "K33")
def _(t):
    return _rounded(measures.carrying_cost(t.inventory, t.products, CARRYING_RATE, by=["category"]), 4, "carrying_cost")


@query("k40_product_detail", "K40 B7")
def _(t):
    """Detail of the product with the most stockout days, the smallest key among equals."""
    short = t.inventory.groupBy("product_id").agg(F.sum("is_stockout").alias("days"))
    worst = F.max(F.struct("days", (-F.col("product_id")).alias("key")))
    chosen = -scalar(short, worst)["key"]
    return measures.product_detail(chosen, t.sales, t.inventory, t.products)
