"""The same answers when one product and one supplier hold a third of all lines."""

import __spark_entry__ as entry
import duckdb
import pytest
from compare import TABLES, connect, differences

from stockflow.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
HOT = "CASE WHEN hash(l_orderkey, l_linenumber, l_partkey) % 3 = 0 THEN {key} ELSE {column} END AS {column}"


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("skewed"))
    con = duckdb.connect()
    for table in TABLES:
        columns = "*"
        if table == "lineitem":
            hot = ", ".join(HOT.format(key=k, column=c) for c, k in (("l_partkey", 7), ("l_suppkey", 3)))
            columns = f"* EXCLUDE (l_partkey, l_suppkey), {hot}"
        con.execute(f"COPY (SELECT {columns} FROM '{SF}/{table}.parquet') TO '{folder}/{table}.parquet'")
    return folder


@pytest.mark.parametrize(
    "name",
    [
        "a14_surrogate_keys",
        "d11_units_by_pattern",
        "k01_rolling_demand",
        "k05_reorder_point_asof",
        "k07_stock_status",
        "k08_supplier_ranking",
        "k09_top_stockouts",
        "k10_growth_streaks",
        "k11_delay_profile",
        "k12_rate_by_region",
        "k36_stock_ledger",
    ],
)
def test_same_answer_on_skewed_lines(spark, skewed, name):
    found, count = differences(spark, connect(skewed), QUERIES[name], entry.oracle_sql()[name], skewed)
    assert not found, found[:3]
    assert count > 0
