import datetime as dt

from conftest import day, rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stockflow.operators.ledger import lost_sales, stock_against_reorder_point, stock_ledger

MOVES = "product_id long, day date, units int"
START = dt.date(2024, 1, 1)


def replay(opening, moves):
    """Day-by-day reference replay of one product."""
    stock, out = opening, []
    for when in sorted(moves):
        wanted, got = moves[when]
        stock += got
        sold = min(wanted, stock)
        stock -= sold
        out.append((when, wanted, got, sold, stock, int(sold < wanted)))
    return out


movement = st.tuples(st.integers(1, 3), st.integers(0, 6), st.integers(0, 9), st.booleans())


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(movement, min_size=1, max_size=25), st.integers(0, 8))
def test_ledger_equals_sequential_replay(spark, movements, opening):
    demand, receipts, by_product = [], [], {}
    for pid, offset, units, is_receipt in movements:
        when = START + dt.timedelta(days=offset)
        (receipts if is_receipt else demand).append((pid, when, units))
        wanted, got = by_product.setdefault(pid, {}).get(when, (0, 0))
        by_product[pid][when] = (wanted, got + units) if is_receipt else (wanted + units, got)
    openings = spark.createDataFrame([(p, opening) for p in (1, 2, 3)], "product_id long, opening_stock int")
    ledger = stock_ledger(
        spark.createDataFrame(demand, MOVES), spark.createDataFrame(receipts, MOVES), openings
    )
    expected = sorted(
        (pid, *step) for pid, moves in by_product.items() for step in replay(opening, moves)
    )
    got = sorted(
        tuple(r)
        for r in ledger.select(
            "product_id", "day", "units_demanded", "units_received", "units_sold", "stock_on_hand", "is_stockout"
        ).collect()
    )
    assert got == expected
    # Balance: opening + received - sold = closing, and nothing goes below zero.
    for pid in by_product:
        mine = [r for r in got if r[0] == pid]
        assert opening + sum(r[3] for r in mine) - sum(r[4] for r in mine) == mine[-1][5]
        assert all(0 <= r[4] <= r[2] and r[5] >= 0 for r in mine)


def test_demand_before_first_receipt_and_same_day(spark):
    demand = spark.createDataFrame([(1, day("2024-01-01"), 5), (1, day("2024-01-03"), 4)], MOVES)
    receipts = spark.createDataFrame([(1, day("2024-01-03"), 10)], MOVES)
    opening = spark.createDataFrame([(1, 0)], "product_id long, opening_stock int")
    got = rows(stock_ledger(demand, receipts, opening), "day", "units_sold", "stock_on_hand", "is_stockout")
    assert got == [("2024-01-01", 0, 0, 1), ("2024-01-03", 4, 6, 0)]


def test_lost_sales(spark):
    days = spark.createDataFrame([(1, 5, 3, 2.5), (2, 2, 3, 2.5), (3, 0, 0, 2.5)], "id int, units_demanded int, units_available int, unit_price double")
    days = days.withColumn("unit_price", F.col("unit_price").cast("decimal(10,2)"))
    got = rows(lost_sales(days), "id", "units_sold", "units_lost", "is_stockout", "revenue")
    assert got == [(1, 3, 2, 1, 7.5), (2, 2, 0, 0, 5.0), (3, 0, 0, 0, 0.0)]


def test_crossings(make):
    inventory = make(
        "inventory",
        [(1, f"2024-01-0{i}", stock, 0, 10) for i, stock in enumerate([12, 10, 9, 15, 8], start=1)]
        + [(2, "2024-01-01", 3, 0, 10), (3, "2024-01-01", 3, 0, None)],
    )
    got = rows(stock_against_reorder_point(inventory), "product_id", "snapshot_date", "crossed_below")
    crossed = [(p, d) for p, d, flag in got if flag]
    assert crossed == [(1, "2024-01-02"), (1, "2024-01-05"), (2, "2024-01-01")]
    assert {p for p, _, _ in rows(stock_against_reorder_point(inventory, [2]), "product_id", "snapshot_date", "crossed_below")} == {2}
