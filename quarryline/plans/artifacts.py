"""What a build hands out: the manifest of a document as JSON, and the pair of outputs for each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import file_name
from ..operators import layout
from ..sources.files import marked_text, unique_stems

# What a document without a table of contents says, and the fields of a section that an agent sees.
NO_TOC_HINT = (
    "This PDF has no usable table of contents, so there is no section map to plan from. Orient by reading pages 1-2 with get_section_text, "
    "then locate content with search_text and read around each hit with get_section_text. inspect_page renders a page as an image when the extracted text is unclear."
)
AGENT_FIELDS = ["title", "start_page", "end_page", "boilerplate_category", "summary", "table_count"]

#: Pages of a figure digest.
MOST_PAGES = 40


def nested_toc(sections: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``toc``: a document's sections as nested JSON, each with its agent fields and its sections below it as ``nodes``.

    ``sections`` have seq and depth (1 for the top) in reading order.  An entry's text opens it and closes
    what the next one is not below of, so the whole is one concatenation in order.  A count of 0 is left out.
    """
    order = Window.partitionBy(doc).orderBy("seq")
    after = F.coalesce(F.lead("depth").over(order), F.lit(1))
    before = F.lag("depth").over(order)
    shown = [F.nullif(F.col(c), F.lit(0)).alias(c) if c == "table_count" else F.nullif(F.col(c), F.lit("")).alias(c) if c in ("boilerplate_category", "summary") else F.col(c) for c in AGENT_FIELDS if c in sections.columns]
    fields = F.regexp_replace(F.to_json(F.struct(*shown)), r"\}\z", "")
    rows = sections.withColumns({"_after": after, "_before": before})
    comma = F.when(F.col("_before") >= F.col("depth"), ",").otherwise("")
    end = F.when(F.col("_after") > F.col("depth"), ',"nodes":[').otherwise(F.concat(F.lit("}"), F.repeat(F.lit("]}"), (F.col("depth") - F.col("_after")).cast("int"))))
    parts = F.array_sort(F.collect_list(F.struct("seq", F.concat(comma, fields, end).alias("t"))))
    return rows.groupBy(doc).agg(F.concat(F.lit("["), F.array_join(F.transform(parts, lambda p: p.t), ""), F.lit("]")).alias("toc"))


def figures_json(figures: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``figures``: how many there are, of which kind and with captions, and the first pages that have some."""
    totals = figures.groupBy(doc).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("kind") == "raster").alias("raster"), F.count_if(F.trim("caption") != "").alias("captioned"), F.count_distinct("page").alias("_pages"))
    pages = layout.figure_digest(figures.withColumn("caption", F.nullif(F.trim("caption"), F.lit(""))), doc, most_pages=MOST_PAGES)
    listed = pages.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("page", "figures", "caption"))).alias("pages"))
    digest = F.struct("total", "raster", "captioned", F.coalesce("pages", F.expr("cast(array() as array<struct<page:bigint,figures:bigint,caption:string>>)")).alias("pages"), F.when(F.col("_pages") > MOST_PAGES, F.lit(True)).alias("truncated"))
    return totals.join(listed, doc, "left").select(doc, F.to_json(digest).alias("figures"))


NO_FIGURES = '{"total":0,"raster":0,"captioned":0,"pages":[]}'


def artifact_manifest(documents: DataFrame, sections: DataFrame, figures: DataFrame | None = None, doc: str = "doc_id") -> DataFrame:
    """doc_id and ``manifest``: source, pages, paths, quality, contents and figures of each document as JSON.

    ``documents`` have the key, source and total_pages, and may have json_path, text_path, toc_quality (a score),
    toc_source, family (published only where there is one) and captions_blocked (only where true).  A document
    without sections has an empty table of contents and a hint.
    """
    have = lambda name, kind: F.col(name) if name in documents.columns else F.lit(None).cast(kind)
    head = F.to_json(F.struct("source", "total_pages", *[have(c, k).alias(c) for c, k in (("json_path", "string"), ("text_path", "string"), ("toc_quality", "double"), ("toc_source", "string"))]), {"ignoreNullFields": "false"})
    rows = documents.withColumn("_head", F.regexp_replace(head, r"\}\z", "")).join(nested_toc(sections, doc), doc, "left")
    if figures is not None:
        rows = rows.join(figures_json(figures, doc).withColumnRenamed("figures", "_figures"), doc, "left")
    shown: list[Column] = [
        F.col("_head"), F.lit(',"toc":'), F.coalesce("toc", F.lit("[]")), F.lit(',"figures":'), F.coalesce("_figures", F.lit(NO_FIGURES)) if figures is not None else F.lit(NO_FIGURES),
        F.when(F.coalesce(have("captions_blocked", "boolean"), F.lit(False)), ',"figure_captions_blocked":true').otherwise(""),
        F.when(have("family", "string").isNotNull(), F.concat(F.lit(',"multi_variant":'), F.to_json(F.struct(have("family", "string").alias("family"))))).otherwise(""),
        F.when(F.col("toc").isNull(), F.regexp_replace(F.to_json(F.struct(F.lit(NO_TOC_HINT).alias("hint"))), r"\A\{(.*)\}\z", ",$1")).otherwise(""), F.lit("}"),
    ]
    return rows.select(doc, F.concat(*shown).alias("manifest"))


def deliverables(pages: DataFrame, manifests: DataFrame, names: DataFrame, doc: str = "doc_id") -> DataFrame:
    """A row for each document with what its two outputs hold: file names of its own stem, the manifest, and the text with page marks.

    ``names``: the key and ``name``, of which file names are made; of equal ones the later get numbers.
    """
    stems = unique_stems(names.select(doc, file_name(F.col("name")).alias("_stem")), "_stem", doc).select(doc, "stem")
    both = stems.join(manifests.select(doc, F.col("manifest").alias("json")), doc).join(marked_text(pages, doc), doc)
    return both.select(doc, F.concat("stem", F.lit(".json")).alias("json_name"), "json", F.concat("stem", F.lit(".txt")).alias("text_name"), "text")


def current(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of rows written by several builds (``version``) those of each document's last."""
    last = rows.groupBy(key).agg(F.max("version").alias("version"))
    return rows.join(last, [key, "version"])
