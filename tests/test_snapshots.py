"""Snapshots as a plan, beside the stored inventory (F1)."""

import datetime as dt
from decimal import Decimal

import pytest
from conftest import rows

from stockflow.plans.registry import QUERIES
from stockflow.sources.tables_io import stored_dir
from stockflow.sources.testdata_map import MappedTables

DAY = dt.datetime(1996, 3, 1)


@pytest.fixture
def folder(spark, tmp_path):
    def put(name, schema, found):
        spark.createDataFrame(found, schema).write.parquet(str(tmp_path / f"{name}.parquet"))

    put("region", "r_regionkey long, r_name string", [(i, f"R{i}") for i in range(5)])
    put("nation", "n_nationkey long, n_regionkey long", [(0, 0)])
    put("supplier", "s_suppkey long, s_name string, s_nationkey long", [(1, "A", 0), (2, "B", 0)])
    part = "p_partkey long, p_name string, p_type string, p_brand string, p_size int, p_retailprice double"
    put("part", part, [(i, f"P{i}", f"T{i % 2}", f"B{i % 3}", i, 10.0 + i) for i in range(1, 8)])
    orders = "o_orderkey long, o_orderstatus string, o_orderdate timestamp"
    put("orders", orders, [(i, "PFO"[i % 3], DAY) for i in range(40)])
    line = (
        "l_orderkey long, l_partkey long, l_suppkey long, l_quantity decimal(12,2), l_shipdate timestamp, "
        "l_returnflag string, l_linestatus string"
    )
    lines = [
        (i % 40, 1 + i % 9, 1 + i % 2, Decimal(1 + i % 7), DAY + dt.timedelta(days=i * 7 % 50), "NR"[i % 2], "FOO"[i % 3])
        for i in range(300)
    ]
    put("lineitem", line, lines)
    return str(tmp_path)


def test_the_plan_gives_the_stored_rows(spark, folder):
    t = MappedTables(spark, folder)
    assert rows(t.snapshots, *t.inventory.columns) == rows(t.inventory, *t.inventory.columns)


def test_rates_store_no_second_ledger(spark, folder):
    files = lambda: {f.getPath().getName() for f in listed(spark)}
    before = files()
    assert QUERIES["f04_rate_order"](spark, folder).count() == 4  # with unknown parts
    made = {name.split("-")[0] for name in files() - before}
    assert made == {"ledger", "products"}  # once also the inventory


def listed(spark):
    path = spark._jvm.org.apache.hadoop.fs.Path(stored_dir(spark))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.listStatus(path) if files.exists(path) else []
