"""What the operators of this subpackage share."""

from __future__ import annotations

from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, ship

#: Rows of an Arrow batch; with whole texts the default of 10,000 would hold too much in a worker.
BATCH_ROWS = 500

#: Rows of a file of a table of pairs of numbers.
ROWS_A_FILE = 250_000


def tuned(spark: SparkSession) -> SparkSession:
    """Brings the package to the workers, and keeps Arrow batches small unless the session has chosen a size itself."""
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Batches of so many rows for what is run inside: where a row is large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """The rows written as a table to the shared folder and read again: lineage ends there, and a lost executor loses nothing.

    ``rows``: how many there are about, where that is known and small; then they come in as few files as hold ROWS_A_FILE.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    few = df if rows is None else df.coalesce(1 + rows // ROWS_A_FILE)
    few.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text, a null text as empty, without whatever other columns there are."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_table(spark: SparkSession, table: pa.Table) -> DataFrame:
    """A few rows from the driver; whether they are broadcast is left to the size threshold."""
    return spark.createDataFrame(table)


def crc_mod(column: str, n: int):
    """crc32 of the number as decimal text, modulo n; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


__all__ = ["BATCH_ROWS", "arrow_rows", "crc_mod", "documents", "fresh", "shared_folder", "small_table", "texts", "tuned", "written"]
