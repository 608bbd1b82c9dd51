"""Reading and writing the five tables."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from stockflow.schemas import TABLES, conform

CHECKPOINT_DIR = "spark.checkpoint.dir"

REJECTED = "_rejected"

CSV_READ = {
    "header": "true",
    "sep": ",",
    "quote": '"',
    "escape": '"',  # a quote inside a quoted cell is doubled
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "nullValue": "",
    "dateFormat": "yyyy-MM-dd",
    # Columns go by position; a header that says otherwise fails the read.
    "enforceSchema": "false",
}


def load_table(
    spark: SparkSession,
    path: str,
    table: str,
    fmt: str = "csv",
    mode: str = "FAILFAST",
    multiline: bool = False,
) -> DataFrame:
    """Read one table with its declared schema; an empty CSV cell is NULL (A1-A3).

    A CSV cell that does not parse fails the read. ``mode="PERMISSIVE"`` turns such cells
    into NULLs, which the NOT NULL checks then count. Blanks, commas and doubled quotes in
    quoted cells come back as they were; cells with line breaks need ``multiline``, with
    which Spark cannot split a file.
    """
    if fmt == "csv":
        reader = spark.read.schema(TABLES[table]).options(**CSV_READ).option("mode", mode)
        return reader.option("multiLine", multiline).csv(path)
    return conform(spark.read.format(fmt).load(path), table)


def load_with_rejects(spark: SparkSession, path: str, table: str) -> tuple[DataFrame, DataFrame]:
    """The rows of a CSV table that parse, and (file, line) of those that do not (A1, A3).

    A line is rejected for a cell that does not fit its declared type, or for cells too many or
    too few; it is kept as it stands, so rows and rejects together are the lines of the files.
    Each side is a scan of its own. Headers must match; cells with line breaks are not taken.
    """
    declared = TABLES[table]
    schema = StructType([*[StructField(f.name, f.dataType, True) for f in declared], StructField(REJECTED, StringType())])
    reader = spark.read.schema(schema).options(**CSV_READ).option("mode", "PERMISSIVE")
    lines = reader.option("columnNameOfCorruptRecord", REJECTED).csv(path)
    parsed = staged(lines.select("*", F.col("_metadata.file_path").alias("_file")), f"{table}-lines")
    good = parsed.filter(F.col(REJECTED).isNull()).select(*declared.names)
    bad = parsed.filter(F.col(REJECTED).isNotNull())
    return good, bad.select(F.col("_file").alias("file"), F.col(REJECTED).alias("line"))


def load_tables(
    spark: SparkSession, directory: str, fmt: str = "csv", mode: str = "FAILFAST"
) -> dict[str, DataFrame]:
    suffix = ".csv" if fmt == "csv" else ""
    return {
        table: load_table(spark, f"{directory}/{table}{suffix}", table, fmt, mode) for table in TABLES
    }


def write_tables(
    tables: Mapping[str, DataFrame],
    directory: str,
    fmt: str = "csv",
    drop: Sequence[str] = (),
    mode: str = "overwrite",
    multiline: bool = False,
) -> None:
    """Write tables side by side, in declared column order, without helper columns.

    Text in CSV files is kept exactly, with quotes doubled. A line break in a cell fails the
    write unless ``multiline`` says that the file will be read with that option.
    """
    suffix = ".csv" if fmt == "csv" else ""
    for table, df in tables.items():
        df = df.drop(*drop)
        declared = [name for name in TABLES[table].names if name in df.columns]
        others = [name for name in df.columns if name not in declared]
        df = df.select(*declared, *others)
        if fmt == "csv" and not multiline:
            df = df.select(*[_one_line(f) for f in df.schema.fields])
        writer = df.write.mode(mode).format(fmt)
        if fmt == "csv":
            writer = writer.options(
                header="true",
                escape='"',
                nullValue="",
                emptyValue="",
                ignoreLeadingWhiteSpace="false",
                ignoreTrailingWhiteSpace="false",
            )
        writer.save(f"{directory}/{table}{suffix}")


def _one_line(field: StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if field.dataType != StringType():
        return column
    message = F.lit(f"{field.name} has a line break; write with multiline=True")
    return F.when(column.rlike("[\\r\\n]"), F.raise_error(message)).otherwise(column).alias(field.name)


def publish_mart(df: DataFrame, path: str, day: str | None = None) -> DataFrame:
    """Publish a query result as Parquet and read it back.

    With ``day`` the mart is partitioned by month; a filter on ``month`` reads only its
    files, as the trailing windows of the reports do. The rebalance routes rows to their month, to write few files, and splits a
    busy month by size over as many tasks as it needs.
    """
    if day is None:
        df.write.mode("overwrite").parquet(path)
    else:
        (
            df.withColumn("month", F.date_format(day, "yyyy-MM"))
            .hint("rebalance", F.col("month"))
            .write.mode("overwrite")
            .partitionBy("month")
            .parquet(path)
        )
    return df.sparkSession.read.parquet(path)


def publish_bucketed(
    df: DataFrame, table: str, path: str, buckets: int, key: str = "product_id", day: str = "sale_date"
) -> DataFrame:
    """Publish a daily fact bucketed by product and sorted by day.

    Windows and groupings by product on the table need no shuffle. Rows are routed to their
    bucket before writing, so each bucket is one file; choose ``buckets`` so that one fits
    the memory of a task.
    """
    (
        df.repartition(buckets, key)
        .write.mode("overwrite")
        .bucketBy(buckets, key)
        .sortBy(key, day)
        .option("path", path)
        .saveAsTable(table)
    )
    return df.sparkSession.table(table)


def stamp_loaded(df: DataFrame, column: str = "created_at") -> DataFrame:
    """Add the load timestamp a table defaults to."""
    return df.withColumn(column, F.current_timestamp())


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the folder every executor can reach.

    Only in local mode, as in tests, is one made up where the session names none.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="stockflow-")
        spark.conf.set(CHECKPOINT_DIR, base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, whoever reads it how often."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SCHEMAS: dict[str, StructType] = {}


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def stored_dir(spark: SparkSession) -> str:
    """Where ``written_once`` keeps its tables, for all sessions with the same shared folder."""
    return shared_dir(spark, "").rsplit("/", 1)[0] + "/stockflow-stored"


def drop_stored(spark: SparkSession) -> None:
    """Delete all tables that ``written_once`` has kept in the shared folder."""
    files, place = _file_system(spark, stored_dir(spark))
    files.delete(place, True)
    _SCHEMAS.clear()


@cache
def _code_state() -> str:
    """A hash of this package, so that tables derived by other code are not taken for its own."""
    package = Path(__file__).resolve().parents[1]
    parts = [path.read_bytes() for path in sorted(package.rglob("*.py"))]
    return hashlib.sha256(b"\0".join(parts)).hexdigest()


def files_state(spark: SparkSession, paths: Sequence[str]) -> tuple:
    """Number, total size and hash of the files under ``paths``, without reading them."""
    listed = spark.read.format("binaryFile").load(list(paths))
    marks = F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)")
    return tuple(listed.agg(F.count(F.lit(1)), F.sum("length"), F.sum(marks)).first())


def written_once(
    spark: SparkSession, name: str, state: tuple, build: Callable[[], DataFrame]
) -> DataFrame:
    """A derived table, written to the shared folder once per state of its sources and this code.

    ``state`` comes from ``files_state``: a changed, added or removed source file gives a
    new copy. Sessions with the same shared folder share the copies; only one of them should
    derive a table at a time. ``drop_stored`` removes them.
    """
    digest = hashlib.sha256(repr((name, _code_state(), *state)).encode()).hexdigest()[:24]
    path = f"{stored_dir(spark)}/{name}-{digest}"
    files, done = _file_system(spark, f"{path}/_SUCCESS")
    if not files.exists(done):
        df = build()
        df.write.mode("overwrite").parquet(path)
        _SCHEMAS[path] = df.schema
    elif path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)
