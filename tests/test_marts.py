import datetime as dt
import random

import pytest
from conftest import product, rows
from pyspark.sql import functions as F

from stockflow.functions.ranking import extend_keys
from stockflow.operators.demand import rolling_demand
from stockflow.operators.ledger import stock_ledger  # noqa: F401
from stockflow.operators.measures import carrying_cost, inventory_value
from stockflow.operators.stockouts import revenue_lost_all_sales, revenue_lost_on_stockouts, service_level, units_lost
from stockflow.sources import marts
from stockflow.sources.tables_io import publish_mart

START = dt.date(2024, 1, 10)
MART = ("product_id", "sale_date", "units_sold", "rolling_4d_avg_demand", "rolling_4d_total_demand", "month")


def sales_rows(seed, products=4, days=160):
    rng = random.Random(seed)
    return {
        (p, START + dt.timedelta(days=d)): rng.randrange(20)
        for p in range(1, products + 1) for d in range(days) if rng.random() < (0.05 if p == 2 else 0.5)
    }


def test_refreshed_mart_equals_a_full_publish(spark, make, tmp_path):
    products = make("products", [product(p) for p in range(1, 6)])

    def table(facts):
        return make("sales", [(p, d.isoformat(), "North", n, n, n) for (p, d), n in facts.items()])

    def build(sales):
        return rolling_demand(sales, products, days=4, ordered=False)

    for seed in (1, 2):
        old = sales_rows(seed)
        new = dict(old)
        keys = sorted(old)
        changed = [keys[7], keys[40]]
        new[keys[7]] += 5
        del new[keys[40]]
        for extra in ((2, START + dt.timedelta(days=33)), (5, START + dt.timedelta(days=90))):
            if extra not in new:
                new[extra] = 3
                changed.append(extra)
        path = str(tmp_path / f"mart{seed}")
        publish_mart(build(table(old)), path, day="sale_date")
        marks = spark.createDataFrame(changed, "product_id long, sale_date date")
        months = marts.refresh_mart(path, table(new), marks, build, rows=4)
        full = build(table(new)).withColumn("month", F.date_format("sale_date", "yyyy-MM"))
        got = spark.read.parquet(path).withColumn("month", F.col("month").cast("string"))
        assert rows(got, *MART) == rows(full, *MART)
        before = build(table(old)).withColumn("month", F.date_format("sale_date", "yyyy-MM"))
        differ = {r[-1] for r in set(rows(full, *MART)) ^ set(rows(before, *MART))}
        assert differ <= set(months)


def test_only_reached_months_are_rewritten(spark, make, tmp_path):
    path = tmp_path / "mart"
    facts = make("sales", [(1, (START + dt.timedelta(days=i)).isoformat(), "N", 1, 1, 1) for i in range(150)])
    products = make("products", [product(1)])
    build = lambda sales: rolling_demand(sales, products, days=10, ordered=False)
    publish_mart(build(facts), str(path), day="sale_date")
    files = lambda: {f.relative_to(path).as_posix() for f in path.rglob("*.parquet")}
    before = files()
    marks = spark.createDataFrame([(1, dt.date(2024, 2, 25))], "product_id long, sale_date date")
    assert marts.refresh_mart(str(path), facts, marks, build, rows=10) == ["2024-02", "2024-03"]
    assert {f.split("/")[0] for f in before - files()} == {"month=2024-02", "month=2024-03"}


def test_emptied_month_goes_and_strangers_are_refused(spark, tmp_path):
    path = str(tmp_path / "mart")
    facts = spark.createDataFrame([(1, dt.date(2024, 1, 5)), (1, dt.date(2024, 2, 5))], "product_id long, sale_date date")
    publish_mart(facts, path, day="sale_date")
    marts.replace_months(spark.read.parquet(path).limit(0).withColumn("month", F.lit("2024-02")), path, ["2024-02"])
    assert [r.month for r in spark.read.parquet(path).collect()] == ["2024-01"]
    with pytest.raises(Exception, match="not a month to replace"):
        marts.replace_months(spark.read.parquet(path).withColumn("month", F.lit("2024-05")), path, ["2024-02"])


def test_months_within_days(spark):
    marks = spark.createDataFrame([(dt.date(2024, 1, 31),), (dt.date(2024, 12, 5),), (None,)], "day date")
    assert marts.months_within_days(marks, "day", 1) == ["2024-01", "2024-12"]
    assert marts.months_within_days(marks, "day", 31) == ["2024-01", "2024-02", "2024-03", "2024-12", "2025-01"]


def test_keys_survive_loads(spark, tmp_path):
    def frame(items):
        return spark.createDataFrame(items, "major int, name string, note string")

    table = marts.KeyTable(spark, str(tmp_path / "keys"), ["major", "name"], "id")
    first = frame([(2, "b", "x"), (1, "z", None), (1, None, "x")])
    load = lambda df: rows(table.load(df, "major", F.lit(0), ["name"]), "id", "major", "name")
    assert load(first) == [(1, 1, None), (2, 1, "z"), (3, 2, "b")]
    assert load(first) == [(1, 1, None), (2, 1, "z"), (3, 2, "b")]
    second = frame([(2, "b", "changed"), (0, "a", "x"), (1, "y", None), (1, None, "x")])
    assert load(second) == [(1, 1, None), (3, 2, "b"), (4, 0, "a"), (5, 1, "y")]
    assert load(frame([(None, None, None)])) == [(6, None, None)]
    assert rows(table.keys(), "id") == [(i,) for i in range(1, 7)]
    assert load(frame([])) == []


def test_unseen_rows_alone_are_numbered(spark):
    stored = spark.createDataFrame([(1, 10)], "k int, id long")
    fresh = extend_keys(stored, spark.createDataFrame([(1, 0), (5, 0), (3, 0)], "k int, m int"), ["k"], "id", "m", F.lit(0), ["k"])
    assert rows(fresh, "k", "id") == [(3, 11), (5, 12)]


def test_totals_keep_facts_of_unknown_products(spark, make):
    products = make("products", [product(1, category="Toys", cost=2, price=10)])
    inventory = make("inventory", [(1, "2024-01-01", 5, 1, 1), (9, "2024-01-01", 7, 1, 1)])
    sales = make("sales", [(1, "2024-01-01", "N", 2, 5, 1), (9, "2024-01-01", "N", 0, 8, 1)])
    assert rows(units_lost(inventory, sales, products)) == [(11,)]
    assert rows(units_lost(inventory, sales, products, ["category"])) == sorted([("Toys", 3), (None, 8)], key=repr)
    assert rows(units_lost(inventory, sales, products, ["product_id"])) == [(1, 3), (9, 8)]
    assert rows(revenue_lost_on_stockouts(inventory, sales, products)) == [(30.0,)]
    assert rows(revenue_lost_all_sales(sales, products, ["product_id"])) == [(1, 30.0), (9, 0.0)]
    assert rows(service_level(inventory, products), "product_id", "achieved_service_level") == [(1, 0.0), (9, 0.0)]
    assert rows(inventory_value(inventory, products)) == [(10.0,)]
    assert rows(carrying_cost(inventory, products, 0.5), "product_id") == [(1,), (9,)]
