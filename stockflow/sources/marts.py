"""Published results and keys that are kept up to date from one load to the next."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockflow.functions.ranking import extend_keys
from stockflow.sources.tables_io import _file_system, staged


def months_within_days(changed: DataFrame, day: str, days: int) -> list[str]:
    """Months whose trailing windows of ``days`` calendar days see a changed day."""
    first, last = F.trunc(day, "MM"), F.trunc(F.date_add(day, days - 1), "MM")
    months = changed.select(F.explode(F.sequence(first, last, F.expr("interval 1 month"))).alias("month"))
    return _months(months.select(F.date_format("month", "yyyy-MM").alias("month")))


def months_within_rows(facts: DataFrame, changed: DataFrame, key: str, day: str, rows: int) -> list[str]:
    """Months with a row whose frame of ``rows`` rows of its key holds a changed (key, day).

    A changed day may have lost its row. Only the keys that changed are sorted, from their
    first changed day on.
    """
    marks = changed.select(key, day, F.lit(1).alias("_changed")).distinct()
    since = marks.groupBy(F.col(key).alias("_key")).agg(F.min(day).alias("_since"))
    later = facts.join(since, (F.col(key) == F.col("_key")) & (F.col(day) >= F.col("_since")))
    both = later.select(key, day, F.lit(0).alias("_changed")).unionByName(marks)
    days = both.groupBy(key, day).agg(F.max("_changed").alias("_changed"))
    frame = Window.partitionBy(key).orderBy(day).rowsBetween(1 - rows, 0)
    hit = days.withColumn("_hit", F.max("_changed").over(frame)).filter("_hit = 1")
    return _months(hit.select(F.date_format(day, "yyyy-MM").alias("month")))


def _months(months: DataFrame) -> list[str]:
    """At most one row a month of the calendar comes to the driver."""
    return sorted(r.month for r in months.distinct().filter("month IS NOT NULL").collect())


def replace_months(df: DataFrame, path: str, months: Sequence[str]) -> None:
    """Put ``df`` (with ``month``) in the place of these months of a mart; others are not touched.

    Rows of other months are refused. A month for which ``df`` has no rows is removed. The rows
    are staged first, so ``df`` may be made from the mart itself.
    """
    stray = F.raise_error(F.concat(F.lit("not a month to replace: "), F.coalesce("month", F.lit("none"))))
    rows = staged(df.withColumn("month", F.when(F.col("month").isin(list(months)), F.col("month")).otherwise(stray)), "mart-months")
    written = set(_months(rows.select("month")))
    (
        rows.hint("rebalance", F.col("month"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("month")
        .parquet(path)
    )
    for month in months:
        if month not in written:
            files, place = _file_system(df.sparkSession, f"{path}/month={month}")
            files.delete(place, True)


def refresh_mart(
    path: str,
    facts: DataFrame,
    changed: DataFrame,
    build: Callable[[DataFrame], DataFrame],
    rows: int,
    key: str = "product_id",
    day: str = "sale_date",
) -> list[str]:
    """Bring a mart of trailing row frames, partitioned by month, up to date; the months replaced.

    ``facts`` are the present facts, ``changed`` the (key, day) pairs that were added, altered or
    removed since the mart was made, ``build`` the computation whose result was published. The
    months that a changed day reaches are replaced: keys that changed are computed anew from
    their own facts, all others keep their rows.
    """
    months = months_within_rows(facts, changed, key, day, rows)
    if not months:
        return months
    spark = facts.sparkSession
    mart = spark.read.parquet(path).withColumn("month", F.col("month").cast("string"))
    keys = changed.select(key).distinct()
    fresh = build(facts.join(keys, key, "left_semi")).withColumn("month", F.date_format(day, "yyyy-MM"))
    kept = mart.filter(F.col("month").isin(months)).join(keys, key, "left_anti")
    fresh = fresh.filter(F.col("month").isin(months)).select(*mart.columns)
    replace_months(kept.unionByName(fresh), path, months)
    return months


class KeyTable:
    """Surrogate keys under a folder: the natural columns and the key, one part for each load."""

    def __init__(self, spark: SparkSession, path: str, natural: Sequence[str], name: str):
        self.spark, self.path, self.natural, self.name = spark, path, list(natural), name

    def keys(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def load(self, rows: DataFrame, major: str, minor: Column, order_by: Sequence[str]) -> DataFrame:
        """Number the unseen of ``rows``, keep their keys, and return all rows with their key.

        Loads come one at a time; a load that is repeated finds all its rows and adds none.
        """
        files, place = _file_system(self.spark, self.path)
        if files.exists(place):
            stored = self.keys()
        else:
            stored = rows.select(*self.natural, F.lit(0).cast("long").alias(self.name)).limit(0)
        fresh = extend_keys(stored, rows, self.natural, self.name, major, minor, order_by)
        fresh = fresh.select(*self.natural, F.col(self.name).cast("long").alias(self.name))
        staged(fresh, "new-keys").write.mode("append").parquet(self.path)
        known = self.keys().select(*[F.col(c).alias(f"_k_{c}") for c in self.natural], self.name)
        same = F.lit(True)
        for c in self.natural:
            same = same & rows[c].eqNullSafe(known[f"_k_{c}"])
        return rows.join(known, same).drop(*[f"_k_{c}" for c in self.natural])
