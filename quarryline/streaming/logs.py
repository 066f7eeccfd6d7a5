"""Append-only logs as streams: reading, deduplication within a watermark, windowed counts, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_log(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 1000) -> DataFrame:
    """A folder of JSON lines as a stream; marks of a session's start are dropped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("mode", "DROPMALFORMED").json(folder).filter("kind <> 'session_start'")


def table_log(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder, a single file or a folder of files, as a stream."""
    path = f"{folder}/{name}"
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    first = spark.read.format("binaryFile").load(path).select("path").first()
    single = first is not None and first["path"].endswith(f"/{name}")
    return source.option("pathGlobFilter", name).parquet(folder) if single else source.parquet(path)


def _timed(steps: DataFrame, time: str, late: str) -> DataFrame:
    return steps.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def once(steps: DataFrame, key: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Each key once; the state of a key goes when the watermark has passed it."""
    return _timed(steps, time, late).dropDuplicatesWithinWatermark(key)


def counts(steps: DataFrame, time: str, width: str, key: str, late: str = "1 hour") -> DataFrame:
    return _timed(steps, time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))


def sessions(steps: DataFrame, time: str, gap: str, key: str, late: str = "1 hour") -> DataFrame:
    return _timed(steps, time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that is there now, through the stream to a table in ``folder``.

    In append mode Spark's own file sink commits.  In update mode each batch's changes are written with its
    number, the same batch always to the same place, and the last change of a key counts when they are read.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/_checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/rows").start()
    else:
        query = writer.foreachBatch(lambda rows, number: rows.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/rows")
