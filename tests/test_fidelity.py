"""Text kept exactly, totals kept whole, checks that never skip, and row order."""

import pandas as pd
import pytest
import __spark_entry__ as entry
from conftest import product, rows
from pyspark.sql import functions as F
from test_demand import sale, series
from test_stockouts import snap

from stockflow.operators import quality
from stockflow.operators.calendars import dense_product_days, monthly_revenue
from stockflow.operators.measures import days_of_inventory, inventory_turnover, product_detail, total_revenue
from stockflow.operators.replenishment import demand_baseline, recent_demand, stock_status
from stockflow.operators.stockouts import stockout_rate
from stockflow.plans.registry import QUERIES
from stockflow.sources.tables_io import drop_stored, files_state, load_table, publish_mart, write_tables, written_once

SF = "/root/testdata/sf0.001"
NAMES = ['5" pipe', '5" pipe, big', "  padded ", "comma, inside", "back\\slash", '"quoted"', "\\\"", "plain"]


def named(name, i):
    return (i, f"SKU-{i:04d}", name, "Toys", 10, 15, 1, "baseline")


def test_text_survives_a_round_trip(spark, make, tmp_path):
    before = make("products", [named(n, i) for i, n in enumerate(NAMES)])
    write_tables({"products": before}, str(tmp_path))
    assert rows(load_table(spark, f"{tmp_path}/products.csv", "products")) == rows(before)


def test_a_file_of_another_tool_reads_the_same(spark, make, tmp_path):
    before = make("products", [named(n, i) for i, n in enumerate(NAMES)])
    frame = pd.DataFrame([[str(c) for c in r] for r in before.collect()], columns=before.columns)
    frame.to_csv(tmp_path / "products.csv", index=False)
    assert rows(load_table(spark, f"{tmp_path}/products.csv", "products")) == rows(before)
    write_tables({"products": before}, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out" / "products.csv").glob("part-*.csv"))
    back = pd.concat([pd.read_csv(p, dtype=str, keep_default_na=False) for p in parts])
    assert sorted(back["product_name"]) == sorted(NAMES)


def test_line_breaks_need_the_option(spark, make, tmp_path):
    before = make("products", [named("two\nlines", 1), named("one", 2)])
    with pytest.raises(Exception, match="line break"):
        write_tables({"products": before}, str(tmp_path / "a"))
    write_tables({"products": before}, str(tmp_path / "b"), multiline=True)
    assert rows(load_table(spark, f"{tmp_path}/b/products.csv", "products", multiline=True)) == rows(before)


def test_totals_keep_facts_of_unknown_products(make):
    sales = make("sales", [(1, "2024-01-01", "North", 1, 1, 10), (9, "2024-01-02", "North", 1, 3, 90)])
    products = make("products", [product(1)])
    stock = make("inventory", [snap(1, "2024-01-02", 4), snap(9, "2024-01-02", 6)])
    assert rows(total_revenue(sales, products)) == [(100.0,)]
    assert rows(total_revenue(sales, products, by=["category"])) == sorted([("Toys", 10.0), (None, 90.0)], key=repr)
    [turnover] = inventory_turnover(sales, stock, products).collect()
    assert (float(turnover["total_revenue"]), turnover["avg_stock_on_hand"], turnover["avg_unit_cost"]) == (100, 5, 10)
    assert rows(monthly_revenue(sales, products), "month", "revenue") == [("2024-01", 100.0)]
    assert rows(days_of_inventory(stock, sales, products), "stock_on_hand") == [(10,)]
    rates = stockout_rate(stock, products, by=["category"])
    assert rows(rates, "category", "days_tracked") == sorted([("Toys", 1), (None, 1)], key=repr)


def test_total_revenue_has_no_join(spark, make):
    total = total_revenue(make("sales", [sale(1, "2024-01-01", 1)]), make("products", [product(1)]))
    assert "Join" not in total._jdf.queryExecution().executedPlan().toString()


def test_absent_columns_are_violations(make):
    orders = make("purchase_orders", []).drop("po_id")
    sales = make("sales", [sale(1, "2024-01-01", 1)]).drop("region")
    keys = rows(quality.key_report({"purchase_orders": orders, "sales": sales}))
    assert keys == [("purchase_orders", "po_id", None, None, 1), ("sales", "product_id, sale_date", 0, 0, 0)]
    rules = rows(quality.domain_report({"purchase_orders": orders, "sales": sales}))
    assert ("purchase_orders", "po_id is missing", 1) in rules and ("sales", "region is missing", 1) in rules
    assert ("sales", "units_sold is required", 0) in rules


def test_baseline_runs_on_after_the_last_sale_of_a_product(make):
    sales = make("sales", [sale(1, "2024-01-01", 50), *series(2, [1] * 366)])
    got = {r["product_id"]: r["avg_daily_demand"] for r in demand_baseline(sales).collect()}
    assert got == {1: pytest.approx(50 / 60), 2: pytest.approx(1.0)}


def test_receipts_are_a_flow(spark, make):
    stock = make("inventory", [snap(1, "2024-01-01", 4), snap(1, "2024-01-03", 6)])
    came_in = spark.createDataFrame([(1, 2), (1, 3)], "product_id long, units int").withColumn(
        "day", F.lit("2024-01-03").cast("date")
    )
    grid = dense_product_days(stock, make("sales", []), receipts=came_in)
    assert rows(grid, "snapshot_date", "receipts") == [("2024-01-01", 0), ("2024-01-02", 0), ("2024-01-03", 5)]
    assert {r[0] for r in rows(dense_product_days(stock, make("sales", [])), "receipts")} == {0}


def test_drill_through_has_the_stockout_figures(make):
    stock = make("inventory", [(1, "2024-01-01", 0, 1, 5), (1, "2024-01-02", 4, 0, 5)])
    sales = make("sales", [sale(1, "2024-01-01", 2, 5), sale(1, "2024-01-02", 1, 1)])
    detail = product_detail(1, sales, stock, make("products", [product(1)]))
    assert rows(detail, "is_stockout", "units_lost", "estimated_revenue_lost") == [(0, 0, 0.0), (1, 3, 45.0)]


def test_trailing_window_reads_its_months_only(spark, make, tmp_path):
    sales = make("sales", series(1, [1] * 400) + series(2, [2] * 10))
    mart = publish_mart(sales, str(tmp_path / "sales"), day="sale_date")
    recent = recent_demand(mart)
    assert rows(recent) == rows(recent_demand(sales))
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert any("month" in line.split("PartitionFilters:")[1].split("PushedFilters")[0] for line in plan.splitlines() if "PartitionFilters" in line)
    stock = make("inventory", [snap(1, "2024-01-01", 1), snap(1, "2025-02-03", 2), snap(2, "2025-01-20", 3)])
    shelf = publish_mart(stock, str(tmp_path / "stock"), day="snapshot_date")
    items = make("products", [product(1), product(2)])
    assert rows(stock_status(items, shelf, mart)) == rows(stock_status(items, stock, sales))


def test_stored_tables_are_shared_and_dropped(spark, tmp_path):
    source = str(tmp_path / "in.parquet")
    spark.range(4).write.parquet(source)
    state = files_state(spark, [source])
    first = written_once(spark, "shared", state, lambda: spark.read.parquet(source)).inputFiles()
    again = written_once(spark.newSession(), "shared", state, lambda: pytest.fail("derived twice")).inputFiles()
    assert first == again
    drop_stored(spark)
    built = []
    written_once(spark, "shared", state, lambda: built.append(1) or spark.read.parquet(source))
    assert built == [1]


def plan_of(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_top_stockouts_read_each_fact_once(spark):
    text = plan_of(spark, "k09_top_stockouts")
    assert text.count("WindowGroupLimit") == 2
    assert text.count("FileScan parquet") == 4  # products, inventory, sales and their regions


STATUS = ["🔴 Critical", "🟠 Reorder Soon", "🔵 Overstocked", "🟢 Healthy"]
ORDERS = {
    "k12_rate_by_pattern": lambda r: -r["stockout_rate"],
    "k12_rate_by_category": lambda r: -r["stockout_rate"],
    "d09_order_status_counts": lambda r: -r["count"],
    "k08_supplier_ranking": lambda r: r["on_time_rank"],
    "k09_top_stockouts": lambda r: (r["category"], r["rank_in_category"]),
    "i02_weekday_distribution": lambda r: r["weekday"],
    "i03_monthly_demand": lambda r: r["month"],
    "k07_stock_status": lambda r: (
        STATUS.index(r["status"]),
        r["days_of_inventory_remaining"] is not None,
        r["days_of_inventory_remaining"] or 0,
    ),
}


@pytest.mark.parametrize("name", list(ORDERS))
def test_rows_come_in_the_stated_order(spark, name):
    found = [ORDERS[name](r) for r in entry.queries()[name](spark, SF).collect()]
    assert found and found == sorted(found)


def test_rolling_demand_in_order(spark, make):
    from stockflow.operators.demand import rolling_demand

    sales = make("sales", series(2, [1, 2, 3]) + series(1, [4, 5]))
    got = rolling_demand(sales, make("products", [product(1), product(2)])).collect()
    keys = [(r["product_id"], r["sale_date"]) for r in got]
    assert keys == sorted(keys)
