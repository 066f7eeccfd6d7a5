"""Section trees from flat outlines: parents, page ranges, breadcrumbs, inherited classes, quality.

An outline has a row for each entry: the document's key, ``seq`` (reading order), ``level`` (1 and
up), ``title``, ``start_page``, and the document's ``total_pages``.  Trees stay flat: a node knows its
parent's seq and its path of ancestors.  All of a document's entries meet in one array, which is as
large as one table of contents, and are folded there by array functions; no driver loop, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import titles
from ..functions.text import furniture_key


def valid_entries(outline: DataFrame) -> DataFrame:
    """Entries with a level below 1 raise; entries outside of the pages are dropped, so their children move up."""
    checked = F.when(F.col("level") < 1, F.raise_error(F.lit("an outline level must be 1 or more"))).otherwise(F.col("level").cast("int"))
    return outline.withColumn("level", checked).filter(F.col("start_page").between(1, F.col("total_pages")))


def _folded(rows: DataFrame, doc: str, fields: list[str], state: str, out: str, step, backwards: bool = False) -> DataFrame:
    """A document's rows in order of seq through one fold: ``step(open, row)`` gives the next ``open`` and what the row comes to."""
    entries = F.array_sort(F.collect_list(F.struct("seq", *fields)))
    start = F.struct(F.expr(f"cast(array() as {state})").alias("open"), F.expr(f"cast(array() as array<{out}>)").alias("done"))

    def both(s: Column, e: Column) -> Column:
        now, done = step(s.open, e)
        return F.struct(now.alias("open"), F.concat(s.done, F.array(done)).alias("done"))

    return rows.groupBy(doc).agg(F.aggregate(F.reverse(entries) if backwards else entries, start, both, lambda s: s.done).alias("_done")).select(doc, F.inline("_done"))


def with_parents(outline: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``parent_seq``: the nearest entry before with a smaller level; ``path`` and ``lineage``: the seqs, and the entries with title and start, from the root down to the entry itself.

    One fold over the document's entries in order; the state is the stack of open entries.
    """
    typed = outline.select(doc, F.col("seq").cast("long").alias("seq"), F.col("level").cast("int").alias("level"), "title", F.col("start_page").cast("long").alias("start_page"), F.col("total_pages").cast("long").alias("total_pages"))
    entry = "struct<seq:bigint,level:int,title:string,start_page:bigint>"

    def step(opened: Column, e: Column) -> tuple[Column, Column]:
        now = F.concat(F.filter(opened, lambda o: o.level < e.level), F.array(F.struct(e.seq.alias("seq"), e.level.alias("level"), e.title.alias("title"), e.start_page.alias("start_page"))))
        return now, F.struct(e.seq.alias("seq"), e.total_pages.alias("total_pages"), now.alias("lineage"))

    rows = _folded(typed, doc, ["level", "title", "start_page", "total_pages"], f"array<{entry}>", f"struct<seq:bigint,total_pages:bigint,lineage:array<{entry}>>", step)
    own = F.element_at("lineage", -1)
    tree = rows.select(doc, "seq", own.level.alias("level"), own.title.alias("title"), own.start_page.alias("start_page"), "total_pages", F.transform("lineage", lambda x: x.seq).alias("path"), F.size("lineage").alias("depth"), "lineage")
    return tree.withColumn("parent_seq", F.when(F.col("depth") > 1, F.element_at("path", -2)))


def with_end_pages(tree: DataFrame, doc: str = "doc_id") -> DataFrame:
    """A node ends before its next sibling starts, or with its parent, and never before its own start.

    Closed form: with the nearest ancestor-or-self that has a next sibling, the end is the page before
    that sibling or, if it is larger, the largest start on the path from there down.  Those siblings come
    from one fold backwards, whose state is the start of the next entry on each depth.
    """

    def step(nexts: Column, e: Column) -> tuple[Column, Column]:
        known = F.filter(F.transform(F.slice(nexts, F.lit(1), e.depth), lambda x, k: F.struct((k + 1).alias("depth"), x.alias("start"))), lambda x: x.start.isNotNull())
        upper = F.when(e.depth > 1, F.transform(F.sequence(F.lit(0), F.greatest(e.depth - 2, F.lit(0))), lambda k: F.get(nexts, k))).otherwise(F.slice(nexts, F.lit(1), F.lit(0)))
        last = F.get(known, F.size(known) - 1)
        return F.concat(upper, F.array(e.start_page)), F.struct(e.seq.alias("seq"), last.depth.alias("_from"), last.start.alias("_next"))

    found = _folded(tree, doc, ["depth", "start_page"], "array<bigint>", "struct<seq:bigint,_from:int,_next:bigint>", step, backwards=True)
    starts = F.transform(F.slice("lineage", F.coalesce("_from", F.lit(1)), F.col("depth")), lambda x: x.start_page)
    return tree.join(found, [doc, "seq"]).withColumn("end_page", F.greatest(F.coalesce(F.col("_next") - 1, F.col("total_pages").cast("long")), F.array_max(starts))).drop("_from", "_next")


def with_ids(tree: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Four digits and more in depth-first order, which is reading order."""
    return tree.withColumn("node_id", F.format_string("%04d", F.row_number().over(Window.partitionBy(doc).orderBy("seq"))))


def with_breadcrumbs(tree: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Trimmed titles from the root down, joined by ' > '; an empty root title adds nothing."""
    names = F.transform("lineage", lambda x: F.trim(x.title))
    shown = F.when(F.get(names, F.lit(0)) == "", F.slice(names, F.lit(2), F.greatest(F.size(names) - 1, F.lit(0)))).otherwise(names)
    return tree.withColumn("breadcrumb", F.array_join(shown, " > "))


def with_classes(tree: DataFrame, doc: str = "doc_id", families: DataFrame | None = None) -> DataFrame:
    """The boilerplate class of the node's own title, or else the nearest ancestor's.

    In a document of a product family (``families``: its keys) 'ordering' is lifted, for the node and
    what lies below it.
    """
    own = F.nullif(titles.boilerplate_class(F.col("title")), F.lit(""))
    if families is not None:
        tree = tree.join(families.select(doc).distinct().withColumn("_family", F.lit(True)), doc, "left")
        own = F.when(F.col("_family") & (own == "ordering"), F.lit("")).otherwise(own)

    def step(opened: Column, e: Column) -> tuple[Column, Column]:
        above = F.filter(opened, lambda o: o.depth < e.depth)
        kind = F.coalesce(e._own, F.get(above, F.size(above) - 1).kind)
        return F.concat(above, F.array(F.struct(e.depth.alias("depth"), kind.alias("kind")))), F.struct(e.seq.alias("seq"), F.coalesce(kind, F.lit("")).alias("boilerplate_category"))

    classed = tree.withColumn("_own", own)
    found = _folded(classed, doc, ["depth", "_own"], "array<struct<depth:int,kind:string>>", "struct<seq:bigint,boilerplate_category:string>", step)
    return tree.drop("_family").join(found, [doc, "seq"])


def build_tree(outline: DataFrame, doc: str = "doc_id") -> DataFrame:
    return with_classes(with_breadcrumbs(with_ids(with_end_pages(with_parents(valid_entries(outline), doc), doc), doc), doc), doc)


def covered_pages(tree: DataFrame, *columns: str) -> DataFrame:
    """A row for each page of each node's range: turns joins by range into joins by key."""
    pages = F.when(F.col("start_page") <= F.col("end_page"), F.sequence("start_page", "end_page"))
    return tree.select(*columns, F.explode(pages).alias("page"))


def sum_over_ranges(tree: DataFrame, pages: DataFrame, value: str, doc: str = "doc_id") -> DataFrame:
    """The sum of a page's values over each node's range; 0 where no page has one."""
    found = covered_pages(tree, doc, "seq").join(pages.select(doc, "page", value), [doc, "page"]).groupBy(doc, "seq").agg(F.sum(value).alias(value))
    return tree.join(found, [doc, "seq"], "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)))


def deepest_for_page(tree: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The breadcrumb of the deepest node that covers a page; of equal levels the first in order."""
    return covered_pages(tree, doc, "seq", "level", "breadcrumb").groupBy(doc, "page").agg(F.max_by("breadcrumb", F.struct(F.col("level"), -F.col("seq"))).alias("breadcrumb"))


def leaves(tree: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Nodes without children and with a range that is not turned round."""
    parents = tree.filter(F.col("parent_seq").isNotNull()).select(doc, F.col("parent_seq").alias("seq")).distinct()
    return tree.join(parents, [doc, "seq"], "left_anti").filter(F.col("start_page") <= F.col("end_page"))


def quality(tree: DataFrame, doc: str = "doc_id") -> DataFrame:
    """A score from the number of entries, the pages covered, the depth, the titles and how different they are."""
    n = F.col("entry_count")
    entries = F.when(n < 3, 0.2).when(n <= 5, 0.6).when(n <= 30, 1.0).when(n <= 60, 0.7).otherwise(0.4)
    depth = F.when(F.col("max_depth") >= 3, 1.0).when(F.col("max_depth") == 2, 0.7).otherwise(0.3)
    title = F.trim("title")
    good = (F.length(title) >= 3) & ~F.rlike(title, F.lit(r"^[\d.]+$"))
    key = furniture_key(F.when(F.col("breadcrumb") != "", F.col("breadcrumb")).otherwise(F.col("title")))
    # pages covered without exploding them: a node's pages past all that came before it in start order
    before = Window.partitionBy(doc).orderBy("start_page", "seq").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end_page") - F.greatest(F.col("start_page") - 1, F.coalesce(F.max("end_page").over(before), F.lit(0))))
    each = tree.withColumn("_fresh", fresh).groupBy(doc).agg(
        F.count(F.lit(1)).alias("entry_count"), F.max("level").alias("max_depth"), F.sum("_fresh").alias("covered"), F.max("total_pages").alias("total_pages"),
        F.avg(good.cast("double")).alias("title_score"), F.count_distinct(key).alias("distinct_keys"),
    )
    coverage = F.least(F.lit(1.0), F.col("covered") / F.col("total_pages"))
    score = (0.3 * entries + 0.3 * coverage + 0.2 * depth + 0.2 * F.col("title_score")) * F.col("distinct_keys") / n
    return each.select(doc, "entry_count", "max_depth", F.round(coverage, 3).alias("page_coverage"), F.round(score, 3).alias("score"), ((F.round(score, 3) < 0.5) | (n > 40)).alias("recommend_summaries"))


def accepts(current: Column, candidate: Column) -> Column:
    """Whether a candidate tree takes over: there is none yet, or it scores higher."""
    return candidate.isNotNull() & (current.isNull() | (candidate > current))
