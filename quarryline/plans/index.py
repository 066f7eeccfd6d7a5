"""The indexing plan: documents to pages, furniture, front matter, captions and one manifest row for each document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import titles as tt
from ..operators import layout

LINES_A_PAGE = 25


def pages(docs: DataFrame) -> DataFrame:
    """Pages of 25 lines, made inside each document's row; a null text is one empty page."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    numbers = F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / LINES_A_PAGE).cast("int"))
    made = F.transform(numbers, lambda k: F.array_join(F.slice(lines, k * LINES_A_PAGE + 1, F.lit(LINES_A_PAGE)), "\n"))
    return docs.select("doc_id", F.posexplode(made).alias("k", "page_text")).select("doc_id", (F.col("k") + 1).cast("long").alias("page"), "page_text")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, pages, chars, bullets, captions, title, its family, and all of it as JSON without empty fields."""
    page_rows = pages(docs)
    signals = page_rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("page_text")).cast("long").alias("chars"), F.sum(tx.bullet_count(F.col("page_text"))).cast("long").alias("bullets"), F.min_by("page_text", "page").alias("first"))
    found = layout.captions(page_rows, "doc_id", "page").groupBy("doc_id").agg(F.count(F.lit(1)).alias("captions"))
    title = F.trim(F.split("first", "\n")[0])
    rows = signals.join(found, "doc_id", "left").withColumn("title", F.substring(title, 1, 120)).withColumn("family", tt.family(F.col("title")).family)
    fields = F.to_json(F.struct("doc_id", "pages", "chars", F.nullif("bullets", F.lit(0)).alias("bullets"), "captions", F.nullif("title", F.lit("")).alias("title"), "family"))
    return rows.select("doc_id", "pages", "chars", "bullets", F.coalesce("captions", F.lit(0)).alias("captions"), "title", "family", fields.alias("manifest"))
