"""What has to be built again: sources against the manifest of what was built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENGINE_VERSION = "1"

MANIFEST = "doc_id long, sha256 string, size long, options string, version string, complete boolean"


def fingerprint(docs: DataFrame, options: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.sha2(text, 256).alias("sha256"), F.octet_length(text).cast("long").alias("size"), F.lit(options).alias("options"), F.lit(ENGINE_VERSION).alias("version"))


def decision(sources: DataFrame, manifest: DataFrame) -> DataFrame:
    """``reason``: why a document must be built, the cheapest test first; null where it can be used again."""
    m = manifest.select("doc_id", *[F.col(c).alias(f"m_{c}") for c in ("sha256", "size", "options", "version", "complete")])
    reason: Column = (
        F.when(F.col("m_version").isNull(), "new")
        .when(F.col("m_version") != F.col("version"), "version")
        .when(~F.coalesce("m_complete", F.lit(False)), "incomplete")
        .when(F.col("m_options") != F.col("options"), "options")
        .when(F.col("m_size") != F.col("size"), "size")
        .when(F.col("m_sha256") != F.col("sha256"), "content")
    )
    return sources.join(m, "doc_id", "left").withColumn("reason", reason).select("doc_id", "sha256", "size", "options", "version", "reason")


def to_build(docs: DataFrame, manifest: DataFrame, options: str) -> DataFrame:
    """Only the documents that changed, with their text; all others are taken out before any work is done."""
    keep = decision(fingerprint(docs, options), manifest).filter("reason IS NULL").select("doc_id")
    return docs.join(keep, "doc_id", "left_anti")


def publish(spark: SparkSession, rows: DataFrame, folder: str, version: int) -> str:
    """A new version of the manifest beside the old ones: a reader never sees half of it, and a failed write changes nothing."""
    path = f"{folder}/version={version}"
    rows.write.mode("overwrite").parquet(path)
    return path
