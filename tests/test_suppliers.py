import pytest
from conftest import product, rows, supplier
from test_replenishment import order
from test_stockouts import snap

from stockflow.operators.findings import cause_split
from stockflow.operators.suppliers import (
    delay_profile,
    delivered_share,
    delivery_delays,
    supplier_correlation,
    supplier_ranking,
    supplier_reliability,
    supplier_scatter,
    underperforming_suppliers,
)


def tables(make):
    suppliers = make("suppliers", [supplier(1), supplier(2), supplier(3), supplier(4)])
    products = make("products", [product(i, supplier=i) for i in (1, 2, 3)])
    inventory = make("inventory", [snap(1, "2024-01-01", 1), snap(2, "2024-01-01", 0, 1), snap(3, "2024-01-01", 2)])
    pos = make(
        "purchase_orders",
        [
            order(1, "2024-01-01", "2024-01-05", expected="2024-01-08"),  # early
            order(1, "2024-01-01", None, "In Transit", expected="2024-01-08"),
            order(1, "2024-01-01", None, "Cancelled", expected="2024-01-08"),
            order(2, "2024-01-01", "2024-01-10", "Delayed", expected="2024-01-08", who=2),
            order(2, "2024-01-01", "2024-01-09", "Delivered", expected="2024-01-08", who=2),  # late all the same
            order(3, "2024-01-01", "2024-01-08", expected="2024-01-08", who=3),
            order(3, "2024-01-01", "2024-01-08", expected="2024-01-08", who=4),  # supplies nothing
        ],
    )
    return suppliers, pos, products, inventory


def test_ranking(make):
    got = [
        (r["supplier_id"], r["total_orders"], r["on_time_orders"], r["delayed_orders"], r["on_time_pct"], r["on_time_rank"])
        for r in supplier_ranking(*tables(make)).collect()
    ]
    assert sorted(got[:2]) == [(1, 1, 1, 0, 100.0, 1), (3, 1, 1, 0, 100.0, 1)]
    assert got[2:] == [(2, 2, 0, 1, 0.0, 3)]


def test_rank_uses_the_unrounded_share(make):
    suppliers = make("suppliers", [supplier(1), supplier(2)])
    late = lambda who: order(1, "2024-01-01", "2024-02-01", "Delayed", expected="2024-01-08", who=who)
    good = lambda who: order(1, "2024-01-01", "2024-01-05", expected="2024-01-08", who=who)
    # 1999/2000 and 2000/2001 both show as 100.0 or 99.9x, but are not equal
    pos = make("purchase_orders", [good(1)] * 1999 + [late(1)] + [good(2)] * 2000 + [late(2)])
    products = make("products", [product(1, supplier=1), product(2, supplier=2)])
    inventory = make("inventory", [snap(1, "2024-01-01", 1), snap(2, "2024-01-01", 1)])
    got = rows(supplier_ranking(suppliers, pos, products, inventory), "supplier_id", "on_time_pct", "on_time_rank")
    assert got == [(1, 100.0, 2), (2, 100.0, 1)]


def test_the_two_on_time_forms_differ(make):
    _, pos, _, _ = tables(make)
    dashboard = {r["supplier_id"]: r["on_time_delivery"] for r in delivered_share(pos, ("supplier_id",)).collect()}
    measured = {r["supplier_id"]: r["reliability_score"] for r in supplier_reliability(pos).collect()}
    assert dashboard[1] == pytest.approx(1 / 3) and measured[1] == 1.0
    assert dashboard[2] == 0.5 and measured[2] == 0.0


def test_delays(make):
    suppliers, pos, _, _ = tables(make)
    got = rows(delivery_delays(pos, suppliers), "supplier_id", "actual_lead_days", "delay_days")
    assert got == [(1, 4, -3), (2, 8, 1), (2, 9, 2), (3, 7, 0), (4, 7, 0)]
    assert rows(delay_profile(pos, suppliers), "supplier_name", "count", "median") == [
        ("Supplier 01", 1, -3.0), ("Supplier 02", 2, 1.5), ("Supplier 03", 1, 0.0), ("Supplier 04", 1, 0.0)]


def test_scatter_and_underperformers(make):
    scatter = supplier_scatter(*tables(make))
    assert rows(scatter, "supplier_id", "on_time_pct", "stockout_rate_pct", "products_supplied") == [
        (1, 100.0, 0.0, 1), (2, 0.0, 100.0, 1), (3, 100.0, 0.0, 1)]
    [corr] = supplier_correlation(scatter).collect()
    assert corr["correlation"] == pytest.approx(-1.0)
    assert rows(underperforming_suppliers(*tables(make)), "supplier_id") == [(2,)]
    assert underperforming_suppliers(*tables(make), on_time_below=0.0).count() == 0


def test_cause_split(make, spark):
    _, pos, products, _ = tables(make)
    status = spark.createDataFrame([(i, "x", "🔴 Critical") for i in (1, 2, 3)], "product_id long, product_name string, status string")
    streaks = spark.createDataFrame([(1,), (2,), (2,)], "product_id long")
    assert rows(cause_split(status, streaks, pos, products), "product_id", "cause") == [
        (1, "demand"), (2, "demand and supply"), (3, "unexplained")]
