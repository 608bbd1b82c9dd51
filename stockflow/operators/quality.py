"""Data-quality checks on the input tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockflow.schemas import EARLIEST_SALE, FOREIGN_KEYS, KEYS, LATEST_SALE, PO_STATUSES, TABLES
from stockflow.sources.tables_io import staged


def _stack(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _total(flag: Column) -> Column:
    return F.coalesce(F.sum(flag.cast("long")), F.lit(0))


def _null_cells(columns: Sequence[str]) -> Column:
    quoted = ["`" + c.replace("`", "``") + "`" for c in columns]
    return reduce(lambda a, b: a + b, [F.col(c).isNull().cast("long") for c in quoted])


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    return _stack(
        [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("table_name"), "rows") for t, df in tables.items()]
    )


def null_cells(tables: Mapping[str, DataFrame]) -> DataFrame:
    """NULL cells per table, over all columns in one pass."""
    return _stack(
        [
            df.agg(_total(_null_cells(df.columns)).alias("null_cells")).select(
                F.lit(t).alias("table_name"), "null_cells"
            )
            for t, df in tables.items()
        ]
    )


def _fingerprint(columns: Sequence[str]) -> list[Column]:
    """128 bits of a row in which a NULL differs from every value."""
    cells = [part for c in columns for part in (F.col(c), F.col(c).isNull())]
    return [F.xxhash64(*cells).alias("_f1"), F.xxhash64(F.lit("row"), *reversed(cells)).alias("_f2")]


def _surplus_rows(df: DataFrame) -> DataFrame:
    """``duplicate_rows``: second and later copies of whole rows; NULLs compare equal.

    Fingerprints are counted first, 16 bytes a row however wide it is. Whole rows are compared,
    and moved, only where a fingerprint repeats. Those are staged, so that their size is known
    before the second pass is planned, which then filters by them without moving the others.
    """
    columns = [f"_c{i}" for i in range(len(df.columns))]
    marked = df.toDF(*columns).select("*", *_fingerprint(columns))
    repeated = marked.groupBy("_f1", "_f2").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    copies = marked.join(staged(repeated, "repeated-rows"), ["_f1", "_f2"], "left_semi").groupBy("_f1", "_f2", *columns)
    return copies.agg(F.count(F.lit(1)).alias("_copies")).agg(_total(F.col("_copies") - 1).alias("duplicate_rows"))


def duplicate_rows(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Second and later copies of whole rows per table; NULLs compare equal."""
    return _stack(
        [_surplus_rows(df).select(F.lit(t).alias("table_name"), "duplicate_rows") for t, df in tables.items()]
    )


def table_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, NULL cells and duplicate rows per table.

    The first two are counted in one pass without a shuffle, the third by fingerprints.
    """
    unknown = F.lit(None).cast("long")
    frames = []
    for table, df in tables.items():
        cells = df.agg(F.count(F.lit(1)).alias("rows"), _total(_null_cells(df.columns)).alias("null_cells"))
        copies = _surplus_rows(df).select(unknown.alias("rows"), unknown.alias("null_cells"), "duplicate_rows")
        both = cells.withColumn("duplicate_rows", unknown).unionByName(copies)
        frames.append(both.select(F.lit(table).alias("table_name"), "*"))
    figures = ("rows", "null_cells", "duplicate_rows")
    return _stack(frames).groupBy("table_name").agg(*[F.max(c).alias(c) for c in figures])


def orphan_keys(child: DataFrame, child_column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Foreign keys without a parent, with their row counts.

    Keys are counted before the anti join, so a hot key is one row in it. NULL is no orphan.
    """
    keys = (
        child.filter(F.col(child_column).isNotNull())
        .groupBy(F.col(child_column).alias("key"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return keys.join(parent.select(F.col(parent_column).alias("key")), "key", "left_anti")


def orphan_report(
    tables: Mapping[str, DataFrame],
    foreign_keys: Sequence[tuple[str, str, str, str]] = FOREIGN_KEYS,
) -> DataFrame:
    """Orphaned keys and rows per foreign key."""
    return _stack(
        [
            orphan_keys(tables[child], column, tables[parent], parent_column)
            .agg(F.count(F.lit(1)).alias("orphan_keys"), _total(F.col("rows")).alias("orphan_rows"))
            .select(
                F.lit(f"{child}.{column}").alias("foreign_key"),
                F.lit(f"{parent}.{parent_column}").alias("parent_key"),
                "orphan_keys",
                "orphan_rows",
            )
            for child, column, parent, parent_column in foreign_keys
        ]
    )


def repeated_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("count")).filter("count > 1")


def key_report(
    tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[Sequence[str]]] = KEYS
) -> DataFrame:
    """Repeated values, surplus rows and absent columns per unique key.

    A declared key with an absent column is reported as such; its rows cannot be compared,
    so the other figures are NULL.
    """
    frames = []
    for table, df in tables.items():
        for key in keys[table]:
            absent = [c for c in key if c not in df.columns]
            if absent:
                empty = F.lit(None).cast("long")
                found = df.sparkSession.range(1).select(empty.alias("repeated_keys"), empty.alias("surplus_rows"))
            else:
                found = repeated_keys(df, key).agg(
                    F.count(F.lit(1)).alias("repeated_keys"),
                    _total(F.col("count") - 1).alias("surplus_rows"),
                )
            frames.append(
                found.select(
                    F.lit(table).alias("table_name"),
                    F.lit(", ".join(key)).alias("key_columns"),
                    "repeated_keys",
                    "surplus_rows",
                    F.lit(len(absent)).cast("long").alias("missing_columns"),
                )
            )
    return _stack(frames)


def _flag_counts(df: DataFrame, flags: Mapping[str, Column], name: str) -> DataFrame:
    """Rows on which each flag holds: one pass, then one output row per flag."""
    totals = df.agg(*[_total(F.coalesce(flag, F.lit(False))).alias(f"_{i}") for i, flag in enumerate(flags.values())])
    pairs = F.array(
        *[
            F.struct(F.lit(label).alias(name), F.col(f"_{i}").alias("violations"))
            for i, label in enumerate(flags)
        ]
    )
    return totals.select(F.inline(pairs))


def domain_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """NULLs in required columns, absent required columns and statuses outside the list (A10).

    An absent column is one violation.
    """
    frames = []
    for table, df in tables.items():
        required = [f.name for f in TABLES[table].fields if not f.nullable]
        flags = {f"{c} is required": F.col(c).isNull() for c in required if c in df.columns}
        for absent in (c for c in required if c not in df.columns):
            one = df.sparkSession.range(1).select(F.lit(1).cast("long").alias("violations"))
            rule = F.lit(f"{absent} is missing").alias("rule")
            frames.append(one.select(F.lit(table).alias("table_name"), rule, "violations"))
        if "status" in df.columns:
            flags["status is listed"] = ~F.col("status").isin(PO_STATUSES)
        frames.append(_flag_counts(df, flags, "rule").select(F.lit(table).alias("table_name"), "rule", "violations"))
    return _stack(frames)


def domain_rules(
    sales: DataFrame,
    inventory: DataFrame,
    products: DataFrame,
    earliest: str = EARLIEST_SALE,
    latest: str = LATEST_SALE,
) -> DataFrame:
    """Implausible values per rule, and the overall verdict beside each."""
    day = F.col("sale_date")
    outside = (day < F.lit(earliest).cast("date")) | (day > F.lit(latest).cast("date"))
    checks = _stack(
        [
            _flag_counts(
                sales,
                {
                    "negative units_sold": F.col("units_sold") < 0,
                    "negative units_demanded": F.col("units_demanded") < 0,
                    "units_demanded below units_sold": F.col("units_demanded") < F.col("units_sold"),
                    "sale_date out of range": outside,
                },
                "rule",
            ),
            _flag_counts(inventory, {"negative stock_on_hand": F.col("stock_on_hand") < 0}, "rule"),
            _flag_counts(products, {"missing category": F.col("category").isNull()}, "rule"),
        ]
    )
    # Six rows, so the window over all of them is safe in one task.
    worst = F.max("violations").over(Window.partitionBy())
    return checks.withColumn("verdict", F.when(worst == 0, "PASS").otherwise("ISSUES"))
