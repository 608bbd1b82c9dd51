"""A stock ledger that is kept and extended, instead of replayed from the first day.

Under one folder stand ``days``, the ledger's rows, and ``state``, every product's stock at the
end of each block of days, both partitioned by block, and ``opening``, what products started
with. New days are replayed from the last
state alone and added. Movements for days that are already there, late ones, make the blocks
from theirs on be replayed from the state before, out of the stored movements, and replaced
whole; earlier blocks stay as they are. Each load's moves are made once and staged, for their
bounds and the replay. All is staged in the shared folder before a partition is
touched. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockflow.operators.ledger import BLOCK_DAYS, daily_moves, ledger_of, replay_blocks
from stockflow.sources.tables_io import _file_system, staged

DAYS = (
    "product_id long, day date, units_demanded long, units_received long, units_sold long, "
    "stock_on_hand long, is_stockout int, block long"
)
STATE = "product_id long, stock long, block long"
OPENING = "product_id long, opening_stock long"
MOVES = ("product_id", "day", "units_demanded", "units_received", "block")


def stored_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DAYS).parquet(f"{path}/days")


def stored_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATE).parquet(f"{path}/state")


def block_states(ends: DataFrame, start: DataFrame, first: int, last: int) -> DataFrame:
    """Every product's stock at the end of each block from ``first`` to ``last``.

    ``ends`` are the ledger's last rows of their product and block; ``start`` (product_id,
    opening_stock) is the state before ``first``. A product without movements in a block keeps
    its stock.
    """
    ends = ends.select("product_id", "block", F.col("stock_on_hand").alias("stock"))
    before = start.select("product_id", F.lit(first - 1).cast("long").alias("block"), F.col("opening_stock").alias("stock"))
    marks = before.unionByName(ends)
    following = F.lead("block").over(Window.partitionBy("product_id").orderBy("block"))
    begin, until = F.greatest("block", F.lit(first).cast("long")), F.coalesce(following - 1, F.lit(last).cast("long"))
    return (
        marks.withColumn("_until", until)
        .filter(F.col("_until") >= begin)
        .select("product_id", "stock", F.explode(F.sequence(begin, F.col("_until"))).alias("block"))
    )


def _write(rows: DataFrame, path: str, mode: str) -> None:
    """Overwriting replaces the blocks that ``rows`` has rows for, and no others."""
    writer = rows.hint("rebalance", F.col("block")).write.mode(mode).partitionBy("block")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def _add_openings(path: str, opening: DataFrame) -> None:
    """Keep the opening stock of products that have none yet."""
    opening = opening.select("product_id", F.col("opening_stock").cast("long").alias("opening_stock"))
    if _exists(opening.sparkSession, f"{path}/opening"):
        opening = opening.join(_stored_openings(opening.sparkSession, path), "product_id", "left_anti")
    staged(opening, "ledger-opening").write.mode("append").parquet(f"{path}/opening")


def _exists(spark: SparkSession, path: str) -> bool:
    files, place = _file_system(spark, path)
    return files.exists(place)


def _stored_openings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OPENING).parquet(f"{path}/opening")


def _start(spark: SparkSession, path: str, block: int) -> DataFrame:
    """Stock after ``block``; products that have no state there start with their opening."""
    states = stored_states(spark, path).filter(F.col("block") == block)
    known = states.select("product_id", F.col("stock").alias("opening_stock"))
    return known.unionByName(_stored_openings(spark, path).join(known, "product_id", "left_anti"))


def store_ledger(
    demand: DataFrame, receipts: DataFrame, opening: DataFrame, path: str, block_days: int = BLOCK_DAYS
) -> None:
    """Write a first ledger, from (product_id, day, units) twice and (product_id, opening_stock)."""
    moves = staged(daily_moves(demand, receipts, block_days), "ledger-moves")
    first, last = moves.agg(F.min("block"), F.max("block")).first()
    if first is None:
        raise ValueError("a first ledger needs movements")
    _add_openings(path, opening)
    start = _stored_openings(moves.sparkSession, path)
    _put(path, replay_blocks(moves, start), start, first, last, "overwrite")


def _put(path: str, rows: DataFrame, start: DataFrame, first: int, last: int, mode: str) -> None:
    # Marked where the rows of a product and block still stand together.
    following = F.lead("day").over(Window.partitionBy("product_id", "block").orderBy("day"))
    rows = staged(rows.withColumn("_ends", following.isNull()), "ledger-days")
    states = staged(block_states(rows.filter("_ends"), start, first, last), "ledger-state")
    _write(rows.drop("_ends"), f"{path}/days", mode)
    _write(states, f"{path}/state", "overwrite")


def new_days(spark: SparkSession, path: str, moves: DataFrame, latest: int) -> DataFrame:
    """Ledger rows of days after all stored ones, from the last state; no stored day is read.

    ``moves`` are read twice; give staged ones.
    """
    return replay_blocks(moves, _start(spark, path, latest))


def late_days(spark: SparkSession, path: str, moves: DataFrame, first: int) -> DataFrame:
    """Ledger rows from block ``first`` on, with ``moves`` among the stored ones."""
    stored = stored_days(spark, path).filter(F.col("block") >= first).select(*MOVES)
    both = stored.unionByName(moves.select(*MOVES)).groupBy("product_id", "day", "block")
    summed = both.agg(*[F.sum(c).alias(c) for c in ("units_demanded", "units_received")])
    return ledger_of(summed, _start(spark, path, first - 1))


def extend_ledger(
    spark: SparkSession,
    path: str,
    demand: DataFrame,
    receipts: DataFrame,
    opening: DataFrame | None = None,
    block_days: int = BLOCK_DAYS,
) -> None:
    """Add movements of new or of stored days to a ledger, and the openings of new products.

    ``block_days`` must be that of the first ledger. The driver holds five figures. A product
    that the ledger knows keeps its opening; without one it starts empty.
    """
    moves = staged(daily_moves(demand, receipts, block_days), "ledger-moves")
    first, last, first_day = moves.agg(F.min("block"), F.max("block"), F.min("day")).first()
    if first is None:
        return
    latest = stored_states(spark, path).agg(F.max("block")).first()[0]
    last_day = stored_days(spark, path).filter(F.col("block") == latest).agg(F.max("day")).first()[0]
    if opening is not None:
        _add_openings(path, opening)
    if first_day > last_day:
        start = _start(spark, path, latest)
        _put(path, new_days(spark, path, moves, latest), start, min(first, latest + 1), last, "append")
    else:
        start = _start(spark, path, first - 1)
        _put(path, late_days(spark, path, moves, first), start, first, max(last, latest), "overwrite")
