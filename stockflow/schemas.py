"""Table definitions, keys and constants (A4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DateType,
    DecimalType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _table(*fields: tuple) -> StructType:
    return StructType([StructField(name, kind, nullable) for name, kind, nullable in fields])


SUPPLIERS = _table(
    ("supplier_id", LongType(), False),
    ("supplier_name", StringType(), False),
    ("region", StringType(), False),
    ("avg_lead_time_days", DecimalType(5, 2), False),
    ("lead_time_std_dev", DecimalType(5, 2), False),
    ("reliability_score", DecimalType(4, 2), False),
)

PRODUCTS = _table(
    ("product_id", LongType(), False),
    ("sku", StringType(), False),
    ("product_name", StringType(), False),
    ("category", StringType(), False),
    ("unit_cost", DecimalType(10, 2), False),
    ("unit_price", DecimalType(10, 2), False),
    ("supplier_id", LongType(), False),
    ("pattern_group", StringType(), False),
)

PURCHASE_ORDERS = _table(
    ("po_id", LongType(), False),
    ("product_id", LongType(), False),
    ("supplier_id", LongType(), False),
    ("order_date", DateType(), False),
    ("expected_delivery_date", DateType(), False),
    ("actual_delivery_date", DateType(), True),
    ("quantity_ordered", IntegerType(), False),
    ("unit_cost", DecimalType(10, 2), False),
    ("status", StringType(), False),
)

SALES = _table(
    ("product_id", LongType(), False),
    ("sale_date", DateType(), False),
    ("region", StringType(), False),
    ("units_sold", IntegerType(), False),
    ("units_demanded", IntegerType(), False),
    ("revenue", DecimalType(12, 2), False),
)

INVENTORY = _table(
    ("product_id", LongType(), False),
    ("snapshot_date", DateType(), False),
    ("stock_on_hand", IntegerType(), False),
    ("is_stockout", IntegerType(), False),
    ("reorder_point_snapshot", DecimalType(10, 2), True),
)

TABLES = {
    "suppliers": SUPPLIERS,
    "products": PRODUCTS,
    "purchase_orders": PURCHASE_ORDERS,
    "sales": SALES,
    "inventory": INVENTORY,
}

# Unique keys. sales and inventory carry one row per product and day.
KEYS = {
    "suppliers": [["supplier_id"]],
    "products": [["product_id"], ["sku"]],
    "purchase_orders": [["po_id"]],
    "sales": [["product_id", "sale_date"]],
    "inventory": [["product_id", "snapshot_date"]],
}

# (child table, child column, parent table, parent column)
FOREIGN_KEYS = [
    ("products", "supplier_id", "suppliers", "supplier_id"),
    ("purchase_orders", "product_id", "products", "product_id"),
    ("purchase_orders", "supplier_id", "suppliers", "supplier_id"),
    ("sales", "product_id", "products", "product_id"),
    ("inventory", "product_id", "products", "product_id"),
]

# Fixed values.
PO_STATUSES = ["Delivered", "Delayed", "In Transit", "Cancelled"]
CRITICAL = "🔴 Critical"
REORDER_SOON = "🟠 Reorder Soon"
OVERSTOCKED = "🔵 Overstocked"
HEALTHY = "🟢 Healthy"
STATUS_ORDER = [CRITICAL, REORDER_SOON, OVERSTOCKED, HEALTHY]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
SERVICE_LEVEL_Z = {90.0: 1.28, 95.0: 1.65, 97.5: 1.96, 99.0: 2.33}
Z_95 = 1.65
EARLIEST_SALE = "2020-01-01"
LATEST_SALE = "2030-01-01"


def conform(df: DataFrame, table: str) -> DataFrame:
    """Cast and order the columns of ``df`` to the declared table."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[table].fields])
