"""Stock ledger replay and the flags derived from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockflow.sources.tables_io import staged


#: Days that are replayed together; a product's blocks are replayed side by side.
BLOCK_DAYS = 64


def day_block(day: Column, block_days: int = BLOCK_DAYS) -> Column:
    return F.floor(F.unix_date(day) / F.lit(block_days)).cast("long")


def daily_moves(demand: DataFrame, receipts: DataFrame, block_days: int = BLOCK_DAYS) -> DataFrame:
    """Units demanded and received by product and day, with the day's ``block``.

    ``demand`` and ``receipts`` hold (product_id, day, units), any number of rows a day. They
    are summed on both sides of the shuffle, so a product costs at most its number of days.
    """
    return (
        demand.select("product_id", "day", F.col("units").alias("demanded"), F.lit(0).alias("received"))
        .unionByName(
            receipts.select("product_id", "day", F.lit(0).alias("demanded"), F.col("units").alias("received"))
        )
        .groupBy("product_id", "day")
        .agg(F.sum("demanded").alias("units_demanded"), F.sum("received").alias("units_received"))
        .withColumn("block", day_block(F.col("day"), block_days))
    )


def block_pairs(moves: DataFrame) -> DataFrame:
    """Each block's movements as a pair: ``net``, and ``least``, the lowest running sum in it.

    The pair is all that later days need to know: stock S before the block becomes
    ``max(S + net, net - least)`` after it.
    """
    so_far = (
        Window.partitionBy("product_id", "block")
        .orderBy("day")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = F.sum(F.col("units_received") - F.col("units_demanded")).over(so_far)
    return (
        moves.withColumn("_running", running)
        .groupBy("product_id", "block")
        .agg(F.max_by("_running", "day").alias("net"), F.min("_running").alias("least"))
    )


def combine_pairs(pairs: DataFrame, span: int) -> DataFrame:
    """Pairs of ``span`` blocks each, from those of their blocks; associative.

    Blocks without movements have no pair: they are the pair that changes nothing.
    """
    wide = F.floor(F.col("block") / span).cast("long")
    inside = Window.partitionBy("product_id", "_wide").orderBy("block")
    before = F.sum("net").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    return (
        pairs.withColumn("_wide", wide)
        .withColumn("_lowest", F.coalesce(before, F.lit(0)) + F.col("least"))
        .groupBy("product_id", F.col("_wide").alias("block"))
        .agg(F.sum("net").alias("net"), F.min("_lowest").alias("least"))
    )


def block_openings(pairs: DataFrame, opening: DataFrame) -> DataFrame:
    """Stock at the start of each block, beside the opening's further columns.

    Unrolled, stock with lost sales is the running net position less its own running minimum
    below zero; over blocks both come from the pairs of the blocks before. A product without
    an opening row starts empty.
    """
    carried = [c for c in opening.columns if c not in ("product_id", "opening_stock")]
    earlier = Window.partitionBy("product_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    started = F.coalesce("opening_stock", F.lit(0)) + F.coalesce(F.sum("net").over(earlier), F.lit(0))
    return (
        pairs.join(opening, "product_id", "left")
        .withColumn("_started", started)
        .withColumn("_lowest", F.min(F.col("_started") + F.col("least")).over(earlier))
        .select(
            "product_id",
            "block",
            (F.col("_started") - F.least(F.lit(0), F.coalesce("_lowest", F.lit(0)))).alias("opening_stock"),
            *carried,
        )
    )


def _replay(moves: DataFrame, openings: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """The days of each of ``keys`` from the stock at its start, without a look at others."""
    carried = [c for c in openings.columns if c not in (*keys, "opening_stock")]
    by_day = Window.partitionBy(*keys).orderBy("day")
    so_far = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moves = moves.join(openings, list(keys), how).withColumn("opening_stock", F.coalesce("opening_stock", F.lit(0)))
    net = F.col("opening_stock") + F.sum(F.col("units_received") - F.col("units_demanded")).over(so_far)
    return (
        moves.withColumn("_net", net)
        .withColumn("stock_on_hand", F.col("_net") - F.least(F.lit(0), F.min("_net").over(so_far)))
        .withColumn(
            "units_sold",
            F.coalesce(F.lag("stock_on_hand").over(by_day), F.col("opening_stock"))
            + F.col("units_received")
            - F.col("stock_on_hand"),
        )
        .select(
            "product_id",
            "day",
            "units_demanded",
            "units_received",
            "units_sold",
            "stock_on_hand",
            stockout_flag(F.col("units_demanded"), F.col("units_sold")).alias("is_stockout"),
            *carried,
            "block",
        )
    )


def ledger_of(moves: DataFrame, opening: DataFrame) -> DataFrame:
    """The ledger by blocks, as a segmented scan.

    The moves are staged, for the pairs and the replay both read them.
    """
    return replay_blocks(staged(moves, "ledger-moves"), opening)


def replay_blocks(moves: DataFrame, opening: DataFrame) -> DataFrame:
    """The same for moves that are stored already.

    Blocks of days are reduced to pairs, the pairs give each block its opening stock, and all
    blocks are replayed independently, so a long history splits over tasks. The moves are dealt
    out by product and block once, for the pairs and the replay.
    """
    dated = moves.filter(F.col("product_id").isNotNull() & F.col("block").isNotNull()).repartition("product_id", "block")
    openings = block_openings(block_pairs(dated), _after_undated(moves, opening))
    return _replay(dated, openings, ("product_id", "block"), "inner")


def _after_undated(moves: DataFrame, opening: DataFrame) -> DataFrame:
    """Openings behind the moves without a day, a block before all others that has no net."""
    undated = block_pairs(moves.filter(F.col("block").isNull())).select("product_id", "least")
    stock = F.when(F.col("least").isNull(), F.col("opening_stock")).otherwise(
        F.greatest(F.coalesce("opening_stock", F.lit(0)), -F.col("least"))
    )
    return opening.join(undated, "product_id", "full").withColumn("opening_stock", stock).drop("least")


def stock_ledger(
    demand: DataFrame, receipts: DataFrame, opening: DataFrame, block_days: int | None = None
) -> DataFrame:
    """Replay end-of-day stock from opening stock, demand and receipts.

    ``opening`` holds (product_id, opening_stock) and further columns, which are carried
    along; a product without a row there opens empty, with those columns NULL. Receipts arrive
    before the day's demand, unmet demand is lost: ``S = max(S_before + received - demanded, 0)``.

    Unrolled, stock is the running net position less its own running minimum below zero, so two
    window passes by product replace the day-by-day loop. With ``block_days`` they go by blocks
    of so many days instead (``ledger_of``), for histories too long for one task each;
    ``stored_ledger`` keeps a ledger by blocks and goes on from its stored stock.
    """
    moves = daily_moves(demand, receipts, block_days or BLOCK_DAYS)
    if block_days is None:
        return _replay(moves, opening, ("product_id",), "left").drop("block")
    return ledger_of(moves, opening).drop("block")


def stockout_flag(demanded: Column, sold: Column) -> Column:
    return F.when(sold < demanded, 1).otherwise(0)


def lost_sales(days: DataFrame) -> DataFrame:
    """From demand, stock available and price to what is sold, short and earned.

    ``days`` needs units_demanded, units_available and unit_price.
    """
    sold = F.least("units_demanded", "units_available")
    return days.withColumns(
        {
            "units_sold": sold,
            "units_lost": F.col("units_demanded") - sold,
            "is_stockout": stockout_flag(F.col("units_demanded"), sold),
            "revenue": (sold.cast("decimal(18,0)") * F.col("unit_price")).cast("decimal(28,2)"),
        }
    )


def stock_against_reorder_point(
    inventory: DataFrame, product_ids: Sequence[int] | None = None
) -> DataFrame:
    """Daily stock beside the reorder point, marking the days it fell to or below.

    A product already at or below its point on its first day counts as a crossing there.
    """
    if product_ids is not None:
        inventory = inventory.filter(F.col("product_id").isin(list(product_ids)))
    by_day = Window.partitionBy("product_id").orderBy("snapshot_date")
    above = F.col("stock_on_hand") > F.col("reorder_point_snapshot")
    return (
        inventory.withColumn("_above", above)
        .withColumn("_was_above", F.coalesce(F.lag("_above").over(by_day), F.lit(True)))
        .select(
            "product_id",
            "snapshot_date",
            "stock_on_hand",
            F.col("reorder_point_snapshot").cast("double").alias("reorder_point"),
            F.when(F.col("_was_above") & ~F.col("_above"), 1).otherwise(0).alias("crossed_below"),
        )
    )
