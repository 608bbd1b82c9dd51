from __future__ import annotations

import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql.types import StructField, StructType

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from stockflow.schemas import TABLES  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("stockflow-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


@pytest.fixture(scope="session")
def make(spark):
    """make("sales", [(...)]) builds a table with its declared types, all nullable."""

    def build(table, rows):
        schema = StructType([StructField(f.name, f.dataType, True) for f in TABLES[table].fields])
        converted = []
        for row in rows:
            cells = []
            for field, value in zip(schema.fields, row, strict=True):
                kind = field.dataType.typeName()
                if value is None:
                    cells.append(None)
                elif kind == "date":
                    cells.append(day(value))
                elif kind == "decimal":
                    cells.append(Decimal(str(value)))
                else:
                    cells.append(value)
            converted.append(tuple(cells))
        return spark.createDataFrame(converted, schema)

    return build


def rows(df, *columns):
    """Rows of the chosen columns as sorted tuples, decimals as floats, dates as text."""

    def plain(value):
        if isinstance(value, Decimal):
            return float(value)
        if isinstance(value, dt.date):
            return value.isoformat()
        return value

    picked = df.select(*columns) if columns else df
    return sorted((tuple(plain(v) for v in r) for r in picked.collect()), key=repr)


def product(i, category="Toys", cost=10, price=15, supplier=1, pattern="baseline"):
    return (i, f"SKU-{i:04d}", f"{category} {i}", category, cost, price, supplier, pattern)


def supplier(i, lead=4, std=1, region="North"):
    return (i, f"Supplier {i:02d}", region, lead, std, 0.9)
