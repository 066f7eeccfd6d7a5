"""Calls of a language model, handed in as a function and off unless one is: captions for pictures and summaries of sections.

The function gets a list of inputs and gives a list of texts.  It runs in Arrow batches on the executors;
a picture that stands in many places is asked about once and its answer is joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.payloads import attested
from ..functions.replies import outline_entries
from ..operators.layout import caption_candidates


def answered(rows: DataFrame, column: str, ask: Callable[[list[str]], list[str]] | None, name: str) -> DataFrame:
    """The rows with the model's answers as a column; null where there is no model."""
    if ask is None:
        return rows.withColumn(name, F.lit(None).cast("string"))

    @F.pandas_udf("string")
    def reply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(ask(batch.fillna("").tolist()), dtype=object)

    return rows.withColumn(name, reply(F.col(column)))


def captioned(figures: DataFrame, ask: Callable[[list[str]], list[str]] | None, most: int = 20) -> DataFrame:
    """Figures with a caption from the model where the page had none, for the largest pictures of a document."""
    wanted = caption_candidates(figures.filter("caption IS NULL"), most).select("doc_id", "picture", F.concat_ws("/", "doc_id", "picture").alias("asked"))
    own = F.coalesce(F.nullif(F.col("xref"), F.lit(0)), -F.col("seq"))
    told = answered(wanted, "asked", ask, "told").select("doc_id", "picture", "told")
    return figures.withColumn("picture", own).join(told, ["doc_id", "picture"], "left").withColumn("caption", F.coalesce("caption", "told")).drop("told", "picture")


def summarised(sections: DataFrame, ask: Callable[[list[str]], list[str]] | None, recommended: DataFrame | None = None) -> DataFrame:
    """Sections (with section_text) with a summary from the model, in documents that are recommended for it (all, if none are named); an empty text has none."""
    rows = sections if recommended is None else sections.join(recommended.filter("recommend_summaries").select("doc_id"), "doc_id", "left_semi")
    wanted = rows.filter(F.trim("section_text") != "").select("doc_id", "seq", "section_text")
    told = answered(wanted, "section_text", ask, "summary").select("doc_id", "seq", F.nullif(F.trim("summary"), F.lit("")).alias("summary"))
    return sections.join(told, ["doc_id", "seq"], "left")


def outlined(chunks: DataFrame, ask: Callable[[list[str]], list[str]] | None) -> DataFrame:
    """An outline from the model for documents without one: chunks are doc_id, chunk, text with page marks and total_pages.

    An entry counts only if its page has a mark in its chunk and lies in the document; entries that say the
    same (level, title, page) count once, at their first place.  Without a model there are none.
    """
    replies = answered(chunks, "text", ask, "reply").filter("reply IS NOT NULL")
    entries = F.transform(outline_entries(F.col("reply")), lambda e: F.struct(e.level.alias("level"), e.title.alias("title"), e.page.cast("long").alias("start_page")))
    kept = replies.select("doc_id", "chunk", "total_pages", F.posexplode(attested(entries, F.col("text"), F.col("total_pages"))).alias("k", "e"))
    once = kept.groupBy("doc_id", "total_pages", "e").agg(F.min(F.struct("chunk", "k")).alias("at"))
    order = Window.partitionBy("doc_id").orderBy("at")
    return once.select("doc_id", F.row_number().over(order).cast("long").alias("seq"), "e.level", "e.title", "e.start_page", "total_pages")
