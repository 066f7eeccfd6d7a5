"""Pages as blocks: recurring headers and footers, columns and reading order, pictures, front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import furniture_key, has_letter, lines, may_be_furniture

# The band at a page's edge, and the shares and floors of recurrence.
BAND = 0.2
FRACTION, FLOOR, PARITY_FLOOR, OTHER_SHARE = 0.5, 3, 6, 0.2

# Geometry of two columns, as shares of the page's width, and heights in points.
NARROW, WIDE, GUTTER_LEAST, GUTTER_MOST, TALL, MEDIUM, SPREAD, SPANNING = 0.25, 0.55, 10.0, 0.20, 80.0, 40.0, 0.10, 0.60


def text_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.filter("block_type = 0")


def is_banded(y0: Column, y1: Column, height: Column) -> Column:
    """Wholly inside the top or the bottom fifth of its page."""
    return (height > 0) & ((y1 <= BAND * height) | (y0 >= (1 - BAND) * height))


def furniture(keys: DataFrame, doc: str, page: str, key: str, pages: DataFrame, fraction: float = FRACTION, floor: int = FLOOR, parity_floor: int = PARITY_FLOOR) -> DataFrame:
    """Keys that recur over enough pages, or over enough of the odd or the even ones and few of the others.

    ``keys`` may name a page's key more than once; ``pages`` has each document's total_pages.
    """
    per_page = keys.filter(has_letter(F.col(key))).select(doc, page, key).distinct()
    counts = per_page.groupBy(doc, key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(page) % 2 == 1).alias("odd"), F.count_if(F.col(page) % 2 == 0).alias("even")).join(pages, doc)
    p = F.col("total_pages")
    everywhere = F.col("n") >= F.greatest(F.lit(floor), F.ceil(fraction * p))
    side = lambda here, other, bucket: (F.col(here) >= F.greatest(F.lit(parity_floor), F.ceil(fraction * bucket))) & (F.col(other) <= OTHER_SHARE * F.col(here))
    parity = side("odd", "even", F.ceil(p / 2)) | side("even", "odd", F.floor(p / 2))
    return counts.filter(everywhere | parity).select(doc, key, "n", "odd", "even")


def without_furniture(blocks: DataFrame, doc: str, found: DataFrame) -> DataFrame:
    """Blocks but for those at a page's edge whose key is furniture."""
    droppable = is_banded(F.col("y0"), F.col("y1"), F.col("page_height")) & may_be_furniture(F.col("text"))
    keyed = blocks.withColumn("_key", F.when(droppable, furniture_key(F.col("text"))))
    return keyed.join(found.select(doc, F.col("key").alias("_key")), [doc, "_key"], "left_anti").drop("_key")


def columns_of(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """gutter, column_top and column_bottom of pages with two columns.

    Pairs of blocks of one page that overlap in height, each a quarter to about half of the page wide, with
    a gutter between them: one pair of tall blocks is enough, or two of medium height; gutters must agree.
    """
    width = F.col("x1") - F.col("x0")
    fit = text_blocks(blocks).filter(width.between(NARROW * F.col("page_width"), WIDE * F.col("page_width")))
    side = lambda s: fit.select(doc, "page", F.col("page_width").alias(f"w{s}"), *[F.col(c).alias(f"{c}{s}") for c in ("x0", "x1", "y0", "y1")])
    gap = F.col("x0r") - F.col("x1l")
    overlap = F.least("y1l", "y1r") - F.greatest("y0l", "y0r")
    pairs = side("l").join(side("r"), [doc, "page"]).filter((overlap > 0) & (gap > GUTTER_LEAST) & (gap <= GUTTER_MOST * F.col("wl")))
    height = F.least(F.col("y1l") - F.col("y0l"), F.col("y1r") - F.col("y0r"))
    pairs = pairs.select(doc, "page", ((F.col("x1l") + F.col("x0r")) / 2).alias("gutter"), height.alias("h"), F.least("y0l", "y0r").alias("top"), F.greatest("y1l", "y1r").alias("bottom"), F.col("wl").alias("w"))
    by = Window.partitionBy(doc, "page")
    chosen = pairs.withColumn("tall", F.max((F.col("h") >= TALL).cast("int")).over(by)).filter(((F.col("tall") == 1) & (F.col("h") >= TALL)) | ((F.col("tall") == 0) & (F.col("h") >= MEDIUM)))
    agreed = chosen.withColumn("mean", F.avg("gutter").over(by)).groupBy(doc, "page").agg(
        F.count(F.lit(1)).alias("n"), F.max("tall").alias("tall"), F.avg("gutter").alias("gutter"), F.max(F.abs(F.col("gutter") - F.col("mean"))).alias("spread"),
        F.max("w").alias("w"), F.min("top").alias("column_top"), F.max("bottom").alias("column_bottom"),
    )
    return agreed.filter(((F.col("tall") == 1) | (F.col("n") >= 2)) & (F.col("spread") <= SPREAD * F.col("w"))).select(doc, "page", "gutter", "column_top", "column_bottom")


def reading_order(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``place``: down the page; with two columns first what is above them, then the left, the right, and what is below."""
    found = text_blocks(blocks).join(columns_of(blocks, doc), [doc, "page"], "left")
    wide = (F.col("x1") - F.col("x0")) > SPANNING * F.col("page_width")
    zone = (
        F.when(F.col("gutter").isNull(), 0)
        .when(F.col("y1") <= F.col("column_top"), 0)
        .when((F.col("y0") >= F.col("column_bottom")) | wide, 3)
        .when((F.col("x0") + F.col("x1")) / 2 < F.col("gutter"), 1)
        .otherwise(2)
    )
    across = F.when(F.col("gutter").isNull() | zone.isin(0, 3), F.col("x0")).otherwise(F.lit(0.0))
    order = Window.partitionBy(doc, "page").orderBy("zone", "y0", "across", "block_no")
    return found.withColumn("zone", zone).withColumn("across", across).withColumn("place", F.row_number().over(order)).drop("across", "gutter", "column_top", "column_bottom")


def rasters(images: DataFrame, least_percent: float = 1.0) -> DataFrame:
    """Placements clipped to the page, their share of it, and whether it is large enough to count."""
    x0, y0 = F.greatest(F.lit(0.0), F.least("x0", "x1")), F.greatest(F.lit(0.0), F.least("y0", "y1"))
    x1, y1 = F.least(F.col("page_width"), F.greatest("x0", "x1")), F.least(F.col("page_height"), F.greatest("y0", "y1"))
    area = 100 * F.greatest(F.lit(0.0), x1 - x0) * F.greatest(F.lit(0.0), y1 - y0) / (F.col("page_width") * F.col("page_height"))
    return images.withColumn("page_area_pct", F.round(area, 2)).withColumn("counts", area >= least_percent)


def excluded(images: DataFrame, doc: str = "doc_id") -> DataFrame:
    return images.groupBy(doc).agg(F.count_if("counts").alias("kept"), F.count_if((~F.col("counts")) & (F.col("page_area_pct") > 0)).alias("excluded"))


def figure_digest(figures: DataFrame, doc: str = "doc_id", most_pages: int = 40, caption_chars: int = 350) -> DataFrame:
    """For each page its figures, captions and the caption of its largest figure; of a document the first pages."""
    n = F.count_if(F.col("caption").isNotNull())
    shown = F.max_by("caption", F.struct(F.coalesce("page_area_pct", F.lit(-1.0)), -F.col("seq"))).alias("c")
    captioned = figures.filter(F.col("caption").isNotNull()).groupBy(doc, "page").agg(shown)
    pages = figures.groupBy(doc, "page").agg(F.count(F.lit(1)).alias("figures"), n.alias("captioned")).join(captioned, [doc, "page"], "left")
    ranked = pages.withColumn("rank", F.row_number().over(Window.partitionBy(doc).orderBy("page"))).withColumn("pages", F.count(F.lit(1)).over(Window.partitionBy(doc)))
    return ranked.filter(F.col("rank") <= most_pages).select(doc, "page", "figures", "captioned", F.substring("c", 1, caption_chars).alias("caption"), (F.col("pages") > most_pages).alias("truncated"))


def pictures(figures: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Placements of one picture once, its largest standing for it; a picture without a number is its own."""
    own = F.coalesce(F.nullif(F.col("xref"), F.lit(0)), -F.col("seq"))
    best = F.struct(F.col("page_area_pct"), -F.col("page"), -F.col("seq"))
    return figures.groupBy(doc, own.alias("picture")).agg(F.count(F.lit(1)).alias("placements"), F.max_by("page", best).alias("page"), F.max("page_area_pct").alias("page_area_pct"))


def caption_candidates(figures: DataFrame, most: int = 20, doc: str = "doc_id") -> DataFrame:
    """The largest pictures of a document, of equal ones the one that comes first."""
    ranked = pictures(figures, doc).withColumn("rank", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("page_area_pct"), "page", "picture")))
    return ranked.filter(F.col("rank") <= most)


# A figure's label and number, with its title on the same line or on the next.
_NUMBER = r"((?>\d+(?:[-–.]\d+)*))"
SPLIT_CAPTION = rf"^(?i:figure|fig\.)\s*{_NUMBER}\s*[.:]?\s*$"
LINE_CAPTION = rf"^(?i:figure|fig\.)\s*{_NUMBER}(?:\s*[.:]\s*|\s+[-–—]\s+)(\S.*)$"


def captions(pages: DataFrame, *keys: str) -> DataFrame:
    """Figure captions of each page's text, in order."""
    split = pages.select(*keys, F.posexplode(F.filter(F.transform(lines(F.col("page_text")), lambda x: F.trim(x)), lambda x: x != "")).alias("line", "line_text"))
    after = F.lead("line_text").over(Window.partitionBy(*keys).orderBy("line"))
    rows = split.withColumn("after", after)
    number = F.when(F.rlike("line_text", F.lit(LINE_CAPTION)), F.regexp_extract("line_text", LINE_CAPTION, 1)).when(F.rlike("line_text", F.lit(SPLIT_CAPTION)), F.regexp_extract("line_text", SPLIT_CAPTION, 1))
    title = F.when(F.rlike("line_text", F.lit(LINE_CAPTION)), F.regexp_extract("line_text", LINE_CAPTION, 2)).otherwise(F.col("after"))
    return rows.select(*keys, "line", number.alias("figure_number"), title.alias("title")).filter("figure_number IS NOT NULL AND title IS NOT NULL").withColumn("caption", F.concat(F.lit("Figure "), "figure_number", F.lit(" "), "title"))


def front_matter(pages: DataFrame, doc: str = "doc_id", max_pages: int = 2, max_chars: int = 6000) -> DataFrame:
    """The first pages' text up to a budget of characters, cut at line ends; a page that does not fit at all is left out, and so is what follows."""
    first = pages.filter(F.col("page") <= max_pages)
    rows = first.select(doc, "page", F.col("page_text").alias("t"), F.length("page_text").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(doc).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.greatest(F.lit(0), F.lit(max_chars) - F.col("before"))
    head = F.expr("substring(t, 1, room)")
    cut = F.when(F.contains(head, F.lit("\n")), F.regexp_replace(head, r"\n[^\n]*\z", "")).otherwise(F.lit(""))
    kept = rows.withColumn("before", before).withColumn("room", room).withColumn("kept", F.when(F.col("n") <= F.col("room"), F.col("t")).otherwise(cut))
    # nothing is shown after the first page that was cut
    whole_before = F.coalesce(F.min((F.col("kept") == F.col("t")).cast("int")).over(Window.partitionBy(doc).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(1))
    shown = kept.withColumn("open", whole_before).filter((F.col("open") == 1) & ((F.col("kept") != "") | (F.col("n") == 0)))
    return shown.groupBy(doc).agg(F.sum(F.length("kept")).cast("long").alias("chars_shown"), F.count(F.lit(1)).alias("pages_shown"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "kept"))), lambda x: F.concat(F.lit("--- PAGE "), x.page, F.lit(" ---\n"), x.kept)), "\n").alias("text"))


def title_text(spans: DataFrame, doc: str = "doc_id", most: int = 8, within: float = 1.5) -> DataFrame:
    """The spans of the first page that are about as large as the largest, in order."""
    first = spans.filter("page = 1").withColumn("top", F.max("size").over(Window.partitionBy(doc)))
    large = first.filter(F.col("size") >= F.col("top") - within).withColumn("rank", F.row_number().over(Window.partitionBy(doc).orderBy("seq"))).filter(F.col("rank") <= most)
    return large.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s.text), " ").alias("title_text"))


def chunks(pages: DataFrame, doc: str = "doc_id", size: int = 15_000) -> DataFrame:
    """Runs of whole pages of about ``size`` characters: a page that would go beyond starts the next run."""
    step = lambda s, p: F.struct(F.when((s.held > 0) & (s.held + p.n > size), p.n).otherwise(s.held + p.n).alias("held"), F.when((s.held > 0) & (s.held + p.n > size), s.chunk + 1).otherwise(s.chunk).alias("chunk"), F.concat(s.done, F.array(F.struct(p.page.alias("page"), F.when((s.held > 0) & (s.held + p.n > size), s.chunk + 1).otherwise(s.chunk).alias("chunk")))).alias("done"))
    start = F.struct(F.lit(0).cast("long").alias("held"), F.lit(1).alias("chunk"), F.expr("cast(array() as array<struct<page:bigint,chunk:int>>)").alias("done"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("page").cast("long").alias("page"), F.length("page_text").cast("long").alias("n"))))
    return pages.groupBy(doc).agg(F.aggregate(ordered, start, step, lambda s: s.done).alias("d")).select(doc, F.inline("d"))
