import datetime as dt

import pytest
from conftest import day, product, rows

from stockflow.operators.demand import (
    daily_sales,
    demand_growth_streaks,
    demand_profile,
    festive_uplift,
    latest_rolling_demand,
    rolling_demand,
)


def sale(pid, when, sold, demanded=None, region="North"):
    return (pid, when, region, sold, sold if demanded is None else demanded, sold * 15)


def series(pid, units, start="2024-01-01", step=1):
    first = day(start)
    return [sale(pid, (first + dt.timedelta(days=i * step)).isoformat(), u) for i, u in enumerate(units)]


def test_frame_counts_rows_not_days(make):
    sales = make("sales", series(1, range(1, 36), step=3))
    products = make("products", [product(1)])
    got = {r["sale_date"]: r for r in rolling_demand(sales, products).collect()}
    first, last = min(got), max(got)
    assert got[first]["rolling_30d_avg_demand"] == 1.0
    # 30 rows 6..35, though they span 88 days
    assert got[last]["rolling_30d_total_demand"] == sum(range(6, 36))
    assert got[last]["rolling_30d_avg_demand"] == 20.5


def test_rolling_is_sorted_and_takes_a_measure(make):
    sales = make("sales", [sale(2, "2024-01-02", 1, 4), sale(2, "2024-01-01", 2, 2), sale(1, "2024-01-05", 3, 3)])
    products = make("products", [product(1), product(2)])
    ordered = rolling_demand(sales, products, days=2, measure="units_demanded").collect()
    assert [(r["product_id"], r["sale_date"].day) for r in ordered] == [(1, 5), (2, 1), (2, 2)]
    assert [r["rolling_2d_total_demand"] for r in ordered] == [3, 2, 6]


def test_latest_matches_rolling_on_the_last_day(make):
    sales = make("sales", series(1, range(40)) + series(2, range(10)) + series(3, range(2), "2024-02-08"))
    products = make("products", [product(i) for i in (1, 2, 3)])
    columns = ["product_id", "sale_date", "rolling_30d_avg_demand", "rolling_30d_total_demand"]
    everything = rolling_demand(sales, products).filter("sale_date = '2024-02-09'")
    latest = latest_rolling_demand(sales, products)
    assert rows(latest, *columns) == rows(everything, *columns)
    assert {r[0] for r in rows(latest, "product_id")} == {1, 3}


def monthly(pid, units, months):
    return [sale(pid, f"2024-{m:02d}-15", u) for u, m in zip(units, months, strict=True)]


def test_growth_streaks(make):
    sales = make(
        "sales",
        monthly(1, [1, 2, 3, 4, 5], [1, 2, 3, 4, 5])  # four rises
        + monthly(2, [1, 2, 3, 4], [1, 2, 3, 4])  # three rises
        + monthly(3, [1, 2, 3, 3, 4, 5, 6, 7], range(1, 9))  # equal months break the run
        + monthly(4, [1, 2, 3, 4, 5], [1, 2, 6, 9, 12]),  # missing months do not
    )
    products = make("products", [product(i) for i in range(1, 5)])
    got = demand_growth_streaks(sales, products).select(
        "product_id", "consecutive_growth_months", "streak_start", "streak_end"
    )
    assert [tuple(r) for r in got.collect()] == [
        (1, 4, "2024-02-01", "2024-05-01"),
        (3, 4, "2024-05-01", "2024-08-01"),
        (4, 4, "2024-02-01", "2024-12-01"),
    ]
    assert demand_growth_streaks(sales, products, min_months=3).count() == 4


def test_two_regions_in_a_day_become_one_row(make):
    sales = make("sales", [sale(1, "2024-01-01", 2), sale(1, "2024-01-01", 3, 5, "South")])
    assert rows(daily_sales(sales), "product_id", "units_sold", "units_demanded") == [(1, 5, 7)]


def test_profile(make):
    sales = make("sales", series(1, [2, 4, 6, 8], "2024-01-01") + series(2, [5], "2024-01-06"))
    got = {r["product_id"]: r for r in demand_profile(sales).collect()}
    assert got[1]["mean_demand"] == 5.0
    assert got[1]["trend_slope"] == pytest.approx(2.0)
    assert got[1]["coefficient_of_variation"] == pytest.approx(got[1]["std_demand"] / 5)
    assert got[1]["monday_index"] == pytest.approx(0.4)
    assert got[1]["sunday_index"] is None
    assert got[2]["std_demand"] is None and got[2]["saturday_index"] == 1.0


def test_festive_uplift(make):
    sales = make("sales", series(1, [9, 9], "2023-10-07") + series(1, [3], "2024-03-01"))
    products = make("products", [product(1)])
    assert rows(festive_uplift(sales, products)) == [("baseline", 9.0, 3.0, 3.0)]
