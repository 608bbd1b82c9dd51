import pytest
from conftest import product, rows
from pyspark.sql import functions as F
from test_demand import sale

from stockflow.operators.calendars import dense_product_days
from stockflow.operators.findings import at_risk_products, at_risk_totals, excess_cover, overstock_capital
from stockflow.operators.measures import (
    carrying_cost,
    days_of_inventory,
    inventory_turnover,
    inventory_value,
    product_detail,
    total_revenue,
)
from stockflow.operators.replenishment import stock_status
from stockflow.operators.stockouts import (
    high_stockout_share,
    revenue_lost_all_sales,
    revenue_lost_on_stockouts,
    revenue_lost_share,
    service_level,
    service_level_by_pattern,
    stockout_duration,
    stockout_rate,
    stockout_runs,
    stockout_summary,
    top_stockouts,
    units_lost,
)


def snap(pid, when, stock, out=0):
    return (pid, when, stock, out, 10)


def tables(make):
    inventory = make("inventory", [snap(1, "2024-01-01", 0, 1), snap(1, "2024-01-02", 5), snap(2, "2024-01-01", 4)])
    sales = make(
        "sales",
        [sale(1, "2024-01-01", 2, 6), sale(1, "2024-01-02", 3), sale(2, "2024-01-01", 4)],
    )
    products = make("products", [product(1), product(2, "Beauty", cost=20, price=30)])
    return products, inventory, sales


def test_summary(make):
    got = rows(
        stockout_summary(*tables(make)),
        "product_id", "total_stockout_days", "days_tracked", "stockout_rate_pct", "total_units_lost", "estimated_revenue_lost",
    )
    assert got == [(1, 1, 2, 50.0, 4, 60.0), (2, 0, 1, 0.0, 0, 0.0)]


def test_two_regions_do_not_double_the_days(make):
    products, inventory, _ = tables(make)
    sales = make("sales", [sale(1, "2024-01-01", 1, 4), sale(1, "2024-01-01", 1, 2, "South"), sale(1, "2024-01-02", 3)])
    got = rows(stockout_summary(products, inventory, sales), "product_id", "total_stockout_days", "days_tracked", "total_units_lost")
    assert got == [(1, 1, 2, 4)]


def summary_of(spark, days, category="Toys"):
    return spark.createDataFrame([(i, category, d) for i, d in enumerate(days)], "product_id int, category string, total_stockout_days long")


@pytest.mark.parametrize(
    ("days", "kept"),
    [([9, 8, 7, 6, 5, 5, 4], [1, 2, 3, 4, 5, 5]), ([9, 9, 8], [1, 1, 3]), ([0] * 7, [1] * 7)],
)
def test_rank_keeps_ties(spark, days, kept):
    top = top_stockouts(summary_of(spark, days)).collect()
    assert [r["rank_in_category"] for r in top] == kept


def test_rank_of_a_missing_category(spark):
    summary = summary_of(spark, [3, 2]).unionByName(summary_of(spark, [4], None))
    assert rows(top_stockouts(summary), "category", "rank_in_category") == [("Toys", 1), ("Toys", 2), (None, 1)]


def test_total_comes_from_the_unfiltered_summary(make):
    products = make("products", [product(i) for i in range(1, 9)])
    inventory = make("inventory", [snap(i, f"2024-01-{d:02d}", 0, 1) for i in range(1, 9) for d in range(1, i + 1)])
    sales = make("sales", [sale(i, f"2024-01-{d:02d}", 0, 1) for i in range(1, 9) for d in range(1, i + 1)])
    summary = stockout_summary(products, inventory, sales)
    [share] = revenue_lost_share(summary, "category").collect()
    assert (float(share["revenue_lost"]), share["share_pct"]) == (36 * 15.0, 100.0)
    assert top_stockouts(summary).count() == 5


def test_both_forms_of_revenue_lost(make):
    products, inventory, sales = tables(make)
    assert rows(revenue_lost_all_sales(sales, products)) == rows(revenue_lost_on_stockouts(inventory, sales, products)) == [(60.0,)]
    assert rows(units_lost(inventory, sales, products)) == [(4,)]
    # A gap on a day that was not flagged counts in the first form only.
    unflagged = make("inventory", [snap(1, "2024-01-01", 0, 0)])
    assert rows(revenue_lost_on_stockouts(unflagged, sales, products)) == [(0,)]


def test_rates(make):
    products, inventory, sales = tables(make)
    assert rows(stockout_rate(inventory), "stockout_rate") == [(pytest.approx(1 / 3),)]
    assert rows(stockout_rate(inventory, products, by=["category"]), "category", "stockout_rate") == [("Beauty", 0.0), ("Toys", 0.5)]
    assert rows(stockout_rate(inventory, sales=sales, by=["region"]), "region", "days_tracked") == [("North", 3)]
    assert rows(stockout_rate(inventory, products, by=["month", "supplier_id"]), "month", "supplier_id", "stockout_days") == [("2024-01", 1, 1)]


def test_service_level_of_a_single_product_group(make):
    products, inventory, _ = tables(make)
    levels = service_level(inventory, products)
    assert rows(levels, "product_id", "achieved_service_level") == [(1, 0.5), (2, 1.0)]
    [all_] = service_level_by_pattern(levels).collect()
    assert (all_["mean"], all_["products_on_target"], all_["meets_target"]) == (0.75, 1, 0)
    [one] = service_level_by_pattern(levels.filter("product_id = 1")).collect()
    assert one["std"] is None


def test_high_stockout_share(spark):
    summary = spark.createDataFrame([(1, 5, 100), (2, 6, 100)], "product_id int, total_stockout_days long, days_tracked long")
    assert rows(high_stockout_share(summary)) == [(1, 2, 50.0)]


def test_runs_by_snapshot_and_by_calendar(make):
    flags = {"01": 1, "02": 1, "04": 1, "05": 0, "06": 1}
    inventory = make("inventory", [snap(1, f"2024-01-{d}", 0, f) for d, f in flags.items()])
    assert rows(stockout_runs(inventory), "run_start", "run_end", "stockout_days") == [
        ("2024-01-01", "2024-01-04", 3), ("2024-01-06", "2024-01-06", 1)]
    calendar = stockout_runs(inventory, calendar_days=True)
    assert rows(calendar, "run_start", "stockout_days") == [("2024-01-01", 2), ("2024-01-04", 1), ("2024-01-06", 1)]
    dense = dense_product_days(inventory, make("sales", []))
    assert rows(stockout_runs(dense)) == rows(calendar)
    assert rows(stockout_duration(stockout_runs(inventory), make("products", [product(1)]))) == [("Toys", 2, 4, 2.0, 3)]


def test_measures(make):
    products, inventory, sales = tables(make)
    assert rows(total_revenue(sales, products)) == [((2 + 3 + 4) * 15.0,)]
    [turn] = inventory_turnover(sales, inventory, products).collect()
    assert turn["inventory_turnover"] == pytest.approx(135 / (3.0 * 15.0))
    assert rows(inventory_value(inventory, products)) == [(5 * 10 + 4 * 20.0,)]
    [cover] = days_of_inventory(inventory, sales, products).collect()
    assert cover["days_of_inventory_remaining"] == pytest.approx(9 / (2.5 + 4))
    assert rows(carrying_cost(inventory, products, 0.365, by=["product_id"])) == [
        (1, pytest.approx(2.5 * 10 * 0.365 * 2 / 365)), (2, pytest.approx(4 * 20 * 0.365 / 365))]


def test_cover_and_overstock_are_different_cuts(make):
    products = make("products", [product(1), product(2)])
    inventory = make("inventory", [(1, "2024-01-01", 70, 0, 60), (2, "2024-01-01", 31, 0, 10)])
    sales = make("sales", [sale(1, "2024-01-01", 1), sale(2, "2024-01-01", 0)])
    status = stock_status(products, inventory, sales)
    assert rows(excess_cover(inventory, sales, products), "product_id", "capital_tied_up") == [(1, 700.0)]
    assert rows(overstock_capital(status, products), "products", "capital_tied_up") == [(1, 310.0)]


def test_at_risk(make):
    products, inventory, sales = tables(make)
    low = inventory.withColumn("reorder_point_snapshot", F.lit(100))
    risk = at_risk_products(stock_status(products, low, sales), stockout_summary(products, low, sales), products)
    assert rows(at_risk_totals(risk, ["category"])) == [("Beauty", 1, 0, 0.0), ("Toys", 1, 1, 60.0)]


def test_drill_through_is_one_product(make):
    products, inventory, sales = tables(make)
    got = rows(product_detail(1, sales, inventory, products), "product_id", "snapshot_date", "units_sold", "rolling_30d_total_demand")
    assert got == [(1, "2024-01-01", 2, 2), (1, "2024-01-02", 3, 5)]
