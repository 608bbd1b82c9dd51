import datetime as dt
import math

import pytest
from conftest import day, product, rows, supplier
from pyspark.sql import functions as F
from test_demand import sale, series

from stockflow.operators.measures import status_counts
from stockflow.operators.replenishment import (
    demand_baseline,
    in_transit_by_product,
    open_purchase_orders,
    reorder_point,
    reorder_point_asof,
    reorder_point_by_service_level,
    replenishment_list,
    slice_status,
    stock_status,
)
from stockflow.schemas import CRITICAL, HEALTHY, OVERSTOCKED, REORDER_SOON


def only(df):
    [row] = df.collect()
    return row


def test_formula_and_baseline_prefix(make):
    units = [4, 8] * 30 + [100] * 20  # the last 20 days are outside the baseline
    sales = make("sales", series(1, units))
    got = only(reorder_point(sales, make("products", [product(1)]), make("suppliers", [supplier(1, 9)])))
    assert got["avg_daily_demand"] == 6.0
    assert got["demand_std_dev"] == 2.0
    assert got["safety_stock"] == pytest.approx(1.65 * 2 * 3)
    assert got["reorder_point"] == pytest.approx(6 * 9 + 9.9)


def test_flat_and_zero_demand_get_deviation_one(make):
    sales = make("sales", series(1, [7] * 60) + series(2, [0] * 60))
    got = {r["product_id"]: r for r in demand_baseline(sales).collect()}
    assert got[1]["demand_std_dev"] == 1.0
    assert (got[2]["avg_daily_demand"], got[2]["demand_std_dev"]) == (0.0, 1.0)


def test_missing_days_count_as_zero(make):
    sales = make("sales", [sale(1, "2024-01-01", 10), sale(1, "2024-01-10", 10)])
    got = only(demand_baseline(sales))
    assert got["avg_daily_demand"] == 2.0
    assert got["demand_std_dev"] == pytest.approx(4.0)
    assert only(demand_baseline(sales, baseline_days=5))["avg_daily_demand"] == 2.0
    # The whole history is that of all products: 20 days here.
    both = sales.unionByName(make("sales", [sale(2, "2024-01-20", 10)]))
    got = {r["product_id"]: r["avg_daily_demand"] for r in demand_baseline(both, baseline_days=None).collect()}
    assert got == {1: 1.0, 2: 0.5}


def test_floor_of_two_days_and_missing_lead_time(make):
    sales = make("sales", series(1, [10] * 60) + series(2, [10] * 60))
    products = make("products", [product(1, supplier=1), product(2, supplier=9)])
    got = {r["product_id"]: r for r in reorder_point(sales, products, make("suppliers", [supplier(1, 0.5)])).collect()}
    assert got[1]["reorder_point"] == 20.0
    assert got[2]["reorder_point"] is None


def test_true_demand_is_used_unless_told_otherwise(make):
    sales = make("sales", [sale(1, "2024-01-01", 2, 10)])
    assert only(demand_baseline(sales))["avg_daily_demand"] == 10.0
    assert only(demand_baseline(sales, measure="units_sold"))["avg_daily_demand"] == 2.0


def test_full_method_penalty_and_levels(make):
    sales = make("sales", series(1, [4, 8] * 30))
    products, suppliers = make("products", [product(1)]), make("suppliers", [supplier(1, 9, 2)])
    full = only(reorder_point(sales, products, suppliers, method="full"))
    assert full["safety_stock"] == pytest.approx(1.65 * math.sqrt(9 * 4 + 36 * 4))
    slow = products.withColumn("slow", F.lit(1.6))
    assert only(reorder_point(sales, slow, suppliers, lead_penalty="slow"))["lead_time_days"] == pytest.approx(14.4)
    levels = {r["service_level_pct"]: r["safety_stock"] for r in reorder_point_by_service_level(sales, products, suppliers).collect()}
    assert levels == {p: pytest.approx(z * 6) for p, z in {90.0: 1.28, 95.0: 1.65, 97.5: 1.96, 99.0: 2.33}.items()}
    with pytest.raises(ValueError, match="method"):
        reorder_point(sales, products, suppliers, method="other")


def test_asof_sees_no_later_day(make):
    units = [2] * 70 + [50] * 10
    sales = make("sales", series(1, units))
    start = day("2024-01-01")
    inventory = make("inventory", [(1, (start + dt.timedelta(days=i)).isoformat(), 5, 0, None) for i in range(80)])
    got = {
        r["snapshot_date"]: r
        for r in reorder_point_asof(sales, inventory, make("products", [product(1)]), make("suppliers", [supplier(1)])).collect()
    }
    assert len(got) == 80
    assert got[start]["avg_daily_demand"] == 2.0
    assert got[start + dt.timedelta(days=69)]["avg_daily_demand"] == 2.0
    assert got[start + dt.timedelta(days=79)]["avg_daily_demand"] == pytest.approx((50 * 2 + 10 * 50) / 60)


LAST = "2024-03-31"


def status_tables(make):
    """One product per rule; reorder points are 100, the company average is 5."""
    stock = {1: 100, 2: 100, 3: 120, 4: 301, 5: 300, 6: 301, 7: 121, 8: 301}
    inventory = [(p, LAST, s, 0, 100) for p, s in stock.items()]
    inventory += [(1, "2024-03-01", 0, 1, 100)]  # exactly 30 days back: counts
    inventory += [(2, "2024-02-29", 0, 1, 100)]  # 31 days back: does not
    daily = {1: 5, 2: 5, 3: 5, 4: 1, 5: 1, 6: 13, 7: 5}
    sales = [sale(p, LAST, u) for p, u in daily.items()]
    sales += [sale(8, "2024-01-01", 5)]  # nothing recent
    products = [product(p) for p in stock]
    return make("products", products), make("inventory", inventory), make("sales", sales)


def test_status_rules_and_boundaries(make):
    got = {r["product_id"]: r for r in stock_status(*status_tables(make)).collect()}
    assert {p: r["status"] for p, r in got.items()} == {
        1: CRITICAL,
        2: REORDER_SOON,  # at the point without a recent stockout
        3: REORDER_SOON,  # exactly 1.2 times the point
        4: OVERSTOCKED,
        5: HEALTHY,  # exactly 3 times is not above
        6: HEALTHY,  # demand above the company average
        7: HEALTHY,
        8: HEALTHY,  # no recent demand to compare
    }
    assert got[8]["avg_daily_demand_30d"] is None and got[8]["days_of_inventory_remaining"] is None
    assert got[1]["stockout_days_last_30d"] == 1 and got[2]["stockout_days_last_30d"] == 0
    assert got[3]["days_of_inventory_remaining"] == 24.0


def test_status_order_counts_and_slices(make):
    status = stock_status(*status_tables(make))
    shown = status.collect()
    labels = [r["status"] for r in shown]
    assert labels == [CRITICAL, REORDER_SOON, REORDER_SOON, OVERSTOCKED, HEALTHY, HEALTHY, HEALTHY, HEALTHY]
    assert [r["product_id"] for r in shown if r["status"] == HEALTHY][0] == 8  # NULL cover first
    assert sum(r["products"] for r in status_counts(status).collect()) == 8
    assert slice_status(status, statuses=[CRITICAL], categories=["Toys"]).count() == 1
    assert slice_status(status, patterns=["overstock"]).count() == 0


def test_window_covers_31_days_and_latest_is_per_product(make):
    products = make("products", [product(1), product(2)])
    inventory = make("inventory", [(1, LAST, 50, 0, 10), (2, "2024-03-20", 7, 0, 10)])
    sales = make("sales", [sale(1, LAST, 1), sale(1, "2024-03-01", 3), sale(1, "2024-02-29", 50)])
    got = {r["product_id"]: r for r in stock_status(products, inventory, sales).collect()}
    assert got[1]["avg_daily_demand_30d"] == 2.0
    assert got[2]["stock_on_hand"] == 7


def order(pid, placed, arrived, status="Delivered", units=20, expected=None, who=1):
    return (1, pid, who, placed, expected or placed, arrived, units, 10, status)


def test_open_orders(make):
    pos = make(
        "purchase_orders",
        [
            order(1, "2024-01-01", None, "In Transit"),
            order(1, "2024-01-01", "2024-02-01", units=30),
            order(2, "2024-01-01", "2024-01-15"),
            order(3, "2024-01-20", "2024-02-01"),
            order(4, "2024-01-01", None, "Cancelled"),
        ],
    )
    as_of = F.lit("2024-01-15").cast("date")
    assert rows(open_purchase_orders(pos, as_of), "product_id") == [(1,), (1,)]
    assert rows(in_transit_by_product(pos, as_of)) == [(1, 2, 50)]


def test_replenishment_quantities(make):
    # Mean demand 5, 0.2 and 5; lead 5 days: 62.5 rounds half to even, small orders are 20.
    sales = make("sales", series(1, [5] * 60) + series(2, [0, 0, 0, 0, 1] * 12) + series(3, [5] * 60))
    inventory = make("inventory", [(p, "2024-02-29", s, 0, None) for p, s in ((1, 3), (2, 0), (3, 3))])
    pos = make("purchase_orders", [order(3, "2024-02-20", None, "In Transit")])
    products = make("products", [product(p) for p in (1, 2, 3)])
    got = replenishment_list(inventory, sales, products, make("suppliers", [supplier(1, 5)]), pos)
    assert rows(got, "product_id", "order_quantity") == [(1, 62), (2, 20)]
