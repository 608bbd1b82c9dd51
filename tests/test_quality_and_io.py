import shutil
from urllib.parse import urlparse

import pytest
from conftest import product, rows, supplier
from pyspark.sql import functions as F
from test_demand import sale
from test_replenishment import order
from test_stockouts import snap

from stockflow.functions.ranking import number_rows, rank_by_value
from stockflow.operators import quality
from stockflow.schemas import TABLES
from stockflow.sources.tables_io import (
    files_state,
    load_table,
    load_tables,
    publish_mart,
    shared_dir,
    stamp_loaded,
    write_tables,
    written_once,
)


def tables(make):
    return {
        "suppliers": make("suppliers", [supplier(1)]),
        "products": make("products", [product(1), product(2, supplier=7), product(2, None)]),
        "purchase_orders": make(
            "purchase_orders",
            [order(1, "2024-01-01", None, "In Transit"), order(9, "2024-01-01", "2024-01-02", "Lost")],
        ),
        "sales": make(
            "sales",
            [
                sale(1, "2024-01-01", 2), sale(1, "2024-01-01", 2), sale(1, "2024-01-01", 2),
                sale(2, "2019-12-31", -1, -2), sale(8, "2031-01-01", 3, 1), sale(8, "2030-01-01", 3),
            ],
        ),
        "inventory": make("inventory", [snap(1, "2024-01-01", -1), (None, "2024-01-02", 1, 0, None)]),
    }


def test_table_report(make):
    report = rows(quality.table_report(tables(make)))
    assert ("sales", 6, 0, 2) in report
    assert ("products", 3, 1, 0) in report
    assert ("purchase_orders", 2, 1, 0) in report
    assert ("inventory", 2, 2, 0) in report
    assert rows(quality.null_cells(tables(make))) == sorted(((t, n) for t, _, n, _ in report), key=repr)
    assert rows(quality.duplicate_rows(tables(make))) == sorted(((t, d) for t, _, _, d in report), key=repr)
    assert rows(quality.row_counts(tables(make))) == sorted(((t, n) for t, n, _, _ in report), key=repr)


def test_report_of_an_empty_table(make):
    assert rows(quality.table_report({"sales": make("sales", [])})) == [("sales", 0, 0, 0)]


def test_orphans(make):
    got = {r["foreign_key"]: (r["orphan_keys"], r["orphan_rows"]) for r in quality.orphan_report(tables(make)).collect()}
    assert got == {
        "products.supplier_id": (1, 1),
        "purchase_orders.product_id": (1, 1),
        "purchase_orders.supplier_id": (0, 0),
        "sales.product_id": (1, 2),
        "inventory.product_id": (0, 0),  # NULL is no orphan
    }


def test_keys(make):
    got = {(r["table_name"], r["key_columns"]): (r["repeated_keys"], r["surplus_rows"]) for r in quality.key_report(tables(make)).collect()}
    assert got[("products", "product_id")] == (1, 1)
    assert got[("sales", "product_id, sale_date")] == (1, 2)
    assert got[("suppliers", "supplier_id")] == (0, 0)


def test_domains(make):
    got = {(r["table_name"], r["rule"]): r["violations"] for r in quality.domain_report(tables(make)).collect()}
    assert got[("purchase_orders", "status is listed")] == 1
    assert got[("products", "category is required")] == 1
    assert got[("inventory", "product_id is required")] == 1
    assert ("purchase_orders", "actual_delivery_date is required") not in got


def test_rules_and_verdict(make):
    t = tables(make)
    got = quality.domain_rules(t["sales"], t["inventory"], t["products"])
    assert rows(got, "rule", "violations") == [
        ("missing category", 1), ("negative stock_on_hand", 1), ("negative units_demanded", 1),
        ("negative units_sold", 1), ("sale_date out of range", 2), ("units_demanded below units_sold", 2)]
    assert {r["verdict"] for r in got.collect()} == {"ISSUES"}
    clean = quality.domain_rules(make("sales", [sale(1, "2024-01-01", 1)]), make("inventory", []), make("products", []))
    assert {r["verdict"] for r in clean.collect()} == {"PASS"}


CSV = '''po_id,product_id,supplier_id,order_date,expected_delivery_date,actual_delivery_date,quantity_ordered,unit_cost,status
1,1,1,2024-01-01,2024-01-09,,20,10.50,"In Transit"
2,1,1,2024-01-01,2024-01-09,2024-01-08,30,10.50,Delivered
'''


def test_csv_empty_date_is_null(spark, tmp_path):
    path = tmp_path / "purchase_orders.csv"
    path.write_text(CSV)
    df = load_table(spark, str(path), "purchase_orders")
    assert [f.dataType for f in df.schema] == [f.dataType for f in TABLES["purchase_orders"]]
    assert rows(df, "po_id", "actual_delivery_date", "status") == [(1, None, "In Transit"), (2, "2024-01-08", "Delivered")]


def test_csv_bad_cell_fails_or_becomes_null(spark, tmp_path):
    path = tmp_path / "purchase_orders.csv"
    path.write_text(CSV.replace("2024-01-08", "soon"))
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE"):
        load_table(spark, str(path), "purchase_orders").collect()
    assert load_table(spark, str(path), "purchase_orders", mode="PERMISSIVE").count() == 2


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_round_trip(spark, make, tmp_path, fmt):
    before = tables(make)
    before["suppliers"] = before["suppliers"].withColumn("helper", F.lit(True))
    write_tables(before, str(tmp_path), fmt, drop=["helper"])
    after = load_tables(spark, str(tmp_path), fmt)
    for name in TABLES:
        assert rows(after[name]) == rows(before[name].drop("helper"))


def test_mart_stamp_and_shared_dir(spark, make, tmp_path):
    sales = make("sales", [sale(1, "2024-01-01", 2), sale(1, "2024-02-01", 3)])
    mart = publish_mart(stamp_loaded(sales), str(tmp_path / "mart"), day="sale_date")
    assert rows(mart.filter("month = '2024-02'"), "units_sold") == [(3,)]
    assert mart.filter("created_at IS NULL").count() == 0
    assert publish_mart(sales, str(tmp_path / "plain")).count() == 2
    assert shared_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_written_once_follows_its_sources(spark, tmp_path):
    source = str(tmp_path / "in.parquet")
    builds = []

    def derived():
        def build():
            builds.append(1)
            return spark.read.parquet(source)

        return written_once(spark, "t", files_state(spark, [source]), build)

    spark.range(3).write.parquet(source)
    assert (derived().count(), derived().count(), len(builds)) == (3, 3, 1)
    spark.range(5).write.mode("overwrite").parquet(source)
    spark.catalog.refreshByPath(source)
    assert (derived().count(), len(builds)) == (5, 2)
    shutil.rmtree(urlparse(derived().inputFiles()[0]).path.rsplit("/", 1)[0])
    assert (derived().count(), len(builds)) == (5, 3)


def test_dense_numbers(spark):
    df = spark.range(200).select(
        F.col("id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 7).cast("int")).alias("day")
    )
    got = number_rows(df, "n", "day", F.col("id") % 3, ["id"]).collect()
    expected = sorted(got, key=lambda r: (r["day"], r["id"] % 3, r["id"]))
    assert [r["n"] for r in expected] == list(range(1, 201))


def test_bucketed_rank_equals_rank(spark):
    df = spark.range(300).select((F.col("id") % 37 * 2.5).alias("v"), "id")
    expected = df.selectExpr("id", "rank() OVER (ORDER BY v DESC) AS r")
    assert rows(rank_by_value(df, "v", "r", bucket=F.floor(F.col("v") / 10)), "id", "r") == rows(expected, "id", "r")
    assert rows(rank_by_value(df, "v", "r"), "id", "r") == rows(expected, "id", "r")
