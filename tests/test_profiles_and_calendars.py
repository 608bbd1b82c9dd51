import numpy as np
import pytest
from conftest import product, rows
from pyspark.sql import functions as F
from test_demand import sale
from test_stockouts import snap

from stockflow.operators import calendars, profiles


def values(spark, numbers, group="a"):
    return spark.createDataFrame([(group, n) for n in numbers], "g string, v int")


def test_histogram_like_numpy(spark):
    numbers = [0, 1, 1, 5, 39, 40, 80]
    expected, _ = np.histogram(numbers, bins=40)
    got = rows(profiles.histogram(values(spark, numbers), "v"), "bin", "count")
    assert [n for _, n in sorted(got)] == expected.tolist()


def test_histogram_of_equal_values(spark):
    got = rows(profiles.histogram(values(spark, [4, 4, 4]), "v", bins=4), "bin", "bin_start", "count")
    assert got == [(0, 3.5, 0), (1, 3.75, 0), (2, 4.0, 3), (3, 4.25, 0)]
    assert profiles.histogram(values(spark, []), "v").count() == 0


def test_box(spark):
    numbers = [1, 2, 4, 9, 100]
    [box] = profiles.box_stats(values(spark, numbers), "v", ["g"]).collect()
    assert [box["q1"], box["median"], box["q3"]] == np.percentile(numbers, [25, 50, 75]).tolist()
    assert (box["whisker_low"], box["whisker_high"], box["max"], box["outliers"]) == (1, 9, 100, 1)
    assert rows(profiles.box_outliers(values(spark, numbers), "v", ["g"])) == [("a", 100, 1)]


def test_box_of_equal_values_and_weights(spark):
    [flat] = profiles.box_stats(values(spark, [3, 3, 3]), "v", ["g"]).collect()
    assert (flat["q1"], flat["whisker_high"], flat["outliers"]) == (3.0, 3, 0)
    counted = spark.createDataFrame([("a", 1, 3), ("a", 2, 1)], "g string, v int, n int")
    assert rows(profiles.box_stats(counted, "v", ["g"], weight="n")) == rows(
        profiles.box_stats(values(spark, [1, 1, 1, 2]), "v", ["g"])
    )


def test_counts_and_bars(spark):
    df = values(spark, [1, 1, 2])
    assert [tuple(r) for r in profiles.value_counts(df, "v").collect()] == [(1, 2), (2, 1)]
    [bar] = profiles.mean_with_spread(df, "v", ["g"]).collect()
    assert bar["low"] == pytest.approx(4 / 3 - np.std([1, 1, 2], ddof=1))
    [single] = profiles.mean_with_spread(values(spark, [7]), "v", ["g"]).collect()
    assert (single["mean"], single["std"], single["low"]) == (7.0, None, None)


def test_daily_weekday_monthly(make):
    sales = make("sales", [sale(1, "2024-01-01", 2), sale(2, "2024-01-01", 3), sale(1, "2024-02-04", 4)])
    assert rows(calendars.daily_demand(sales)) == [("2024-01-01", 5, "Monday", "2024-01"), ("2024-02-04", 4, "Sunday", "2024-02")]
    assert [r["dow"] for r in calendars.weekday_distribution(sales).collect()] == ["Monday", "Sunday"]
    assert [tuple(r) for r in calendars.monthly_demand(sales).collect()] == [("2024-01", 5), ("2024-02", 4)]


def test_monthly_revenue(make):
    sales = make("sales", [sale(1, "2024-01-01", 2, 5), sale(1, "2024-02-01", 1)])
    got = calendars.monthly_revenue(sales, make("products", [product(1)]))
    assert rows(got) == [("2024-01", 30.0, 45.0), ("2024-02", 15.0, 0.0)]


def test_date_table(make):
    sales = make("sales", [sale(1, "2024-02-28", 2), sale(1, "2024-03-01", 3)])
    dates = calendars.date_table(calendars.date_bounds(sales, "sale_date"))
    assert rows(dates, "date", "day_of_year", "dow") == [
        ("2024-02-28", 59, "Wednesday"), ("2024-02-29", 60, "Thursday"), ("2024-03-01", 61, "Friday")]
    assert rows(calendars.on_calendar(dates, sales, "sale_date", ["units_sold"]), "date", "units_sold") == [
        ("2024-02-28", 2), ("2024-02-29", 0), ("2024-03-01", 3)]


def grid(make, start=None, end=None):
    inventory = make("inventory", [snap(1, "2024-01-02", 5), snap(1, "2024-01-04", 0, 1), snap(2, "2024-01-09", 7)])
    sales = make("sales", [sale(1, "2024-01-02", 3), sale(1, "2024-01-03", 1, 2)])
    bounds = [None if b is None else F.lit(b).cast("date") for b in (start, end)]
    return rows(calendars.dense_product_days(inventory, sales, *bounds), "product_id", "snapshot_date", "stock_on_hand", "is_stockout", "units_sold", "units_demanded")


def test_grid_fills_flows_with_zero_and_carries_stock(make):
    assert grid(make) == [
        (1, "2024-01-02", 5, 0, 3, 3), (1, "2024-01-03", 5, 0, 1, 2), (1, "2024-01-04", 0, 1, 0, 0), (2, "2024-01-09", 7, 0, 0, 0)]


def test_grid_over_a_range(make):
    assert grid(make, "2024-01-01", "2024-01-05") == [
        (1, "2024-01-01", None, 0, 0, 0), (1, "2024-01-02", 5, 0, 3, 3), (1, "2024-01-03", 5, 0, 1, 2),
        (1, "2024-01-04", 0, 1, 0, 0), (1, "2024-01-05", 0, 0, 0, 0),
        *[(2, f"2024-01-0{d}", None, 0, 0, 0) for d in range(1, 6)]]
    assert [r for r in grid(make, "2024-01-05", "2024-01-06") if r[0] == 1] == [
        (1, "2024-01-05", 0, 0, 0, 0), (1, "2024-01-06", 0, 0, 0, 0)]
    assert [r for r in grid(make, "2024-01-10", "2024-01-10")] == [
        (1, "2024-01-10", 0, 0, 0, 0), (2, "2024-01-10", 7, 0, 0, 0)]
