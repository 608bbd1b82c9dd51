"""The mechanisms behind the plans: selection by rank, fingerprints, running sums, rejects."""

import datetime as dt
import math
import random

import pytest
from conftest import product, rows, supplier
from pyspark.sql import functions as F
from test_demand import sale
from test_replenishment import order
from test_stockouts import snap

from stockflow.functions.columns import exact
from stockflow.functions.ranking import row_positions
from stockflow.operators import profiles, quality, replenishment, stockouts, suppliers
from stockflow.operators.demand import rolling_demand
from stockflow.plans.registry import QUERIES
from stockflow.sources.tables_io import load_with_rejects

SF = "/root/testdata/sf0.001"


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def draws(kind, rng, n):
    if kind == "smooth":
        return [rng.gauss(0, 1) for _ in range(n)]
    if kind == "scales":
        return [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(n)]
    if kind == "crowded":
        return [1 + rng.random() * 1e-13 for _ in range(n - 1)] + [1e200]
    if kind == "few":
        return [float(rng.randrange(-3, 4)) for _ in range(n)]
    return [0.0, -0.0, 5e-324, -5e-324, 1.7e308, math.inf, -math.inf][:n]


@pytest.mark.parametrize("kind", ["smooth", "scales", "crowded", "few", "extremes"])
def test_quartiles_are_those_of_percentile(spark, kind):
    rng = random.Random(kind)
    data = [(g, v) for g, n in (("a", 1), ("b", 2), ("c", 5), ("d", 400)) for v in draws(kind, rng, n)]
    df = spark.createDataFrame(data, "g string, v double")
    counted = df.groupBy("g", F.col("v").alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    got = profiles.quantiles(counted, ["g"], {"q1": 0.25, "median": 0.5, "q3": 0.75, "all": 1.0, "odd": 0.137})
    want = df.groupBy("g").agg(
        F.count(F.lit(1)).alias("count"),
        *[F.percentile("v", q).alias(n) for n, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("all", 1.0), ("odd", 0.137))],
    )
    plain = lambda df: [tuple("nan" if c != c else c for c in r) for r in rows(df)]
    assert plain(got) == plain(want)


def test_selection_sorts_a_small_part(spark):
    """All values different: what reaches the sorting window is a sliver of the group."""
    df = spark.range(0, 200_000, 1, 4).select(F.lit("a").alias("g"), (F.rand(5) * 1000).alias("v"))
    counted = df.groupBy("g", F.col("v").alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    boxes = profiles.quantiles(counted, ["g"], {"q1": 0.25, "median": 0.5, "q3": 0.75})
    text = final_plan(boxes)
    assert "percentile" not in text and "collect" not in text
    assert rows(boxes) == rows(df.groupBy("g").agg(
        F.count(F.lit(1)).alias("count"), *[F.percentile("v", q).alias(n) for n, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    ))
    chosen = counted.select("g", F.col("_value").alias("_v"), profiles._coarse_range(F.col("_value")).alias("c"), "_n")
    largest = chosen.groupBy("c").count().agg(F.max("count")).first()[0]
    assert largest < 200_000 / 50  # a coarse range, which FINE_RANGES then divides


def test_fingerprints_tell_null_from_value(spark):
    df = spark.createDataFrame([(None, 1), (1, None), (None, 1), (None, None), (0, 1), (1, 0)], "a int, b int")
    assert rows(quality.duplicate_rows({"t": df})) == [("t", 1)]
    twice = spark.createDataFrame([("x", None)] * 5 + [("x", ""), (None, "x")], "a string, `b.c` string")
    assert rows(quality.duplicate_rows({"t": twice})) == [("t", 4)]
    assert rows(quality.table_report({"t": twice})) == [("t", 7, 6, 4)]


def test_rows_meet_by_fingerprint(spark):
    wide = spark.range(1000).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(40)])
    passes = quality.duplicate_rows({"t": wide})._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in passes and "SortMergeJoin" not in passes  # known to be small when planned
    few = wide.unionByName(wide.filter("c0 = 7"))
    assert rows(quality.duplicate_rows({"t": few})) == [("t", 1)]


def test_baseline_needs_no_window_over_the_facts(spark):
    text = QUERIES["d08_demand_baseline"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text


def test_baseline_prefix(make):
    sales = make("sales", [sale(1, "2024-01-01", 4), sale(1, "2024-01-03", 2), sale(1, "2024-01-09", 50), sale(2, "2024-01-08", 6)])
    got = {r.product_id: r.avg_daily_demand for r in replenishment.demand_baseline(sales, 5).collect()}
    assert got == {1: 6 / 5, 2: 6 / 2}  # the second product has two days up to the last sale


def test_ranking_reads_figures_once(spark):
    df = QUERIES["k08_supplier_ranking"](spark, SF)
    assert {f.split("/")[-2].rsplit("-", 1)[0] for f in df.inputFiles()} == {"supplier-figures"}
    assert "InMemoryTableScan" not in df._jdf.queryExecution().executedPlan().toString()


def test_ranking_ties(make):
    pos = make("purchase_orders", [order(1, "2024-01-01", "2024-01-02", expected="2024-01-05", who=s) for s in (1, 2)]
               + [order(1, "2024-01-01", "2024-03-02", "Delayed", expected="2024-01-01", who=3)])
    products = make("products", [product(s, supplier=s) for s in (1, 2, 3)])
    inventory = make("inventory", [snap(s, "2024-01-01", 1) for s in (1, 2, 3)])
    ranked = suppliers.supplier_ranking(make("suppliers", [supplier(s) for s in (1, 2, 3)]), pos, products, inventory)
    assert rows(ranked, "supplier_id", "on_time_rank") == [(1, 1), (2, 1), (3, 3)]


def test_regions_share_the_facts_shuffle(spark):
    text = QUERIES["k12_rate_by_region"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(product_id") == 2  # facts by (product, day), then counts
    assert "SortMergeJoin" not in text and text.count("regions") > 0


def test_day_with_two_regions_counts_in_both(make):
    inventory = make("inventory", [snap(1, "2024-01-01", 0, 1), snap(1, "2024-01-02", 5)])
    day = lambda d, place: (1, d, place, 1, 1, 1)
    sales = make("sales", [day("2024-01-01", "N"), day("2024-01-01", "S"), day("2024-01-01", "N"), day("2024-01-02", None)])
    got = rows(stockouts.stockout_rate(inventory, sales=sales, by=["region"]))
    assert got == sorted([("N", 1, 1, 1.0), ("S", 1, 1, 1.0), (None, 0, 1, 0.0)], key=repr)


def test_frames_are_differences_of_running_sums(spark, make):
    rng = random.Random(4)
    days = sorted(rng.sample(range(300), 90))
    units = [rng.choice([None, rng.randrange(50)]) for _ in days]
    start = dt.date(2024, 1, 1)
    sales = make("sales", [(1, (start + dt.timedelta(days=d)).isoformat(), "N", u, u, u) for d, u in zip(days, units, strict=True)])
    got = rolling_demand(sales, make("products", [product(1)]), days=7)
    want = []
    for i, d in enumerate(days):
        frame = [u for u in units[max(0, i - 6) : i + 1] if u is not None]
        mean = round(sum(frame) / len(frame) + 1e-9, 2) if frame else None
        want.append(((start + dt.timedelta(days=d)).isoformat(), mean, sum(frame) if frame else None))
    assert rows(got, "sale_date", "rolling_7d_avg_demand", "rolling_7d_total_demand") == sorted(want, key=repr)
    frames = got._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding$()" in frames and "specifiedwindowframe(RowFrame, -6" not in frames


def test_asof_range_is_a_difference_too(make):
    sales = make("sales", [sale(1, "2024-01-01", 4), sale(1, "2024-01-03", 2), sale(1, "2024-01-08", 6)])
    inventory = make("inventory", [snap(1, d, 1) for d in ("2024-01-01", "2024-01-04", "2024-01-08", "2024-01-20")])
    got = replenishment.reorder_point_asof(sales, inventory, make("products", [product(1)]), make("suppliers", [supplier(1)]), lookback=5)
    assert [r[1] for r in rows(got, "snapshot_date", "avg_daily_demand")] == [4.0, 6 / 4, 6 / 5, 0.0]


def test_exact_types(spark):
    df = spark.range(1).selectExpr("1 as i", "cast(1.5 as double) as d", "cast(1.25 as decimal(10,2)) as m")
    kinds = df.select(*[exact(df, c).alias(c) for c in df.columns]).dtypes
    assert kinds == [("i", "bigint"), ("d", "decimal(18,4)"), ("m", "decimal(10,2)")]


def test_good_rows_and_rejects_are_the_lines(spark, tmp_path):
    header = "product_id,sale_date,region,units_sold,units_demanded,revenue\n"
    lines = ['1,2024-01-01,"N, or S",2,2,5.00', "x,2024-01-02,N,1,1,1.00", "2,2024-13-01,N,1,1,1.00", "3,2024-01-01,N,,1,",
             "4,2024-01-01,N,1,1", "5,2024-01-01,N,1,1,1.00,9", '6,2024-01-01,"say ""hi""",1,1,1.00']
    (tmp_path / "sales.csv").mkdir()
    (tmp_path / "sales.csv" / "a.csv").write_text(header + "\n".join(lines[:4]) + "\n")
    (tmp_path / "sales.csv" / "b.csv").write_text(header + "\n".join(lines[4:]) + "\n")
    good, bad = load_with_rejects(spark, str(tmp_path / "sales.csv"), "sales")
    assert [r[0] for r in rows(good, "product_id")] == [1, 3, 6]
    assert sorted(r.line for r in bad.collect()) == sorted([lines[1], lines[2], lines[4], lines[5]])
    assert {(r.file.rsplit("/", 1)[1], r.line[0]) for r in bad.collect()} == {("a.csv", "x"), ("a.csv", "2"), ("b.csv", "4"), ("b.csv", "5")}
    assert good.select("product_id").count() == 3  # also where few columns are read


def test_positions_follow_the_sort(spark):
    df = spark.createDataFrame([(i % 5, i) for i in range(50)], "k int, i int").repartition(4)
    got = rows(row_positions(df.orderBy(F.desc("k")), "place", "last_place", ["k"]).select("k", "place", "last_place").distinct())
    assert got == [(k, 1 + 10 * (4 - k), 10 * (5 - k)) for k in range(5)]
    unsorted = row_positions(df, "place", "last_place", ["k"]).select("k", "place", "last_place").distinct()
    assert rows(unsorted) != got
