"""Queries over blocks, pages and figures; lines of documents are blocks, 25 to a page."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout
from . import register, table
from .texts import LINES, doc_lines

_FKEY = r"regexp_replace(trim(regexp_replace(line_text, '\s+', ' ', 'g')), '[0-9]+', '#', 'g')"


@register("a01_a02_furniture", f"""WITH {LINES}, k AS (SELECT DISTINCT source, doc_id AS page, {_FKEY} AS key FROM lines WHERE length(trim(line_text)) BETWEEN 1 AND 200 AND NOT regexp_matches(trim(line_text), '(?i)^(figure\\b|fig\\.|table\\b|chart\\b)') AND regexp_matches(line_text, '\\pL')),
t AS (SELECT source, count(*) AS pages FROM documents GROUP BY 1),
c AS (SELECT source, key, count(*) AS n, sum(CASE WHEN page % 2 = 1 THEN 1 ELSE 0 END) AS odd, sum(CASE WHEN page % 2 = 0 THEN 1 ELSE 0 END) AS even FROM k GROUP BY 1, 2)
SELECT source, key, n, CAST(odd AS BIGINT) AS odd, CAST(even AS BIGINT) AS even FROM c JOIN t USING (source)
WHERE n >= greatest(3, ceil(0.15 * pages)) OR (odd >= greatest(3, ceil(0.15 * ceil(pages / 2))) AND even <= 0.2 * odd) OR (even >= greatest(3, ceil(0.15 * floor(pages / 2))) AND odd <= 0.2 * even)""")  # fmt: skip
def a01(spark, sf_dir):
    from ..functions.text import furniture_key, may_be_furniture

    rows = doc_lines(spark, sf_dir).filter(may_be_furniture(F.col("line_text"))).select("source", F.col("doc_id").alias("page"), furniture_key(F.col("line_text")).alias("key"))
    pages = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("total_pages"))
    return layout.furniture(rows, "source", "page", "key", pages, 0.15, 3, 3)


# Pages of a part: running header on all, another footer on odd and even pages, body lines; 12 pages each.
_PAGES = "SELECT p_partkey AS doc_id, pg AS page, k, CASE k WHEN 0 THEN 'Datasheet ' || p_name || ' page ' || pg WHEN 1 THEN CASE WHEN pg % 2 = 1 THEN 'Left note ' || p_brand ELSE 'Right note ' || p_type END ELSE 'Body ' || chr(CAST(97 + pg AS INT)) || ' ' || p_name END AS line FROM part, range(1, 13) a(pg), range(0, 3) b(k)"


def _part_pages(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    pages = part.select("p_partkey", "p_name", "p_brand", "p_type", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("page")).select("*", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("k"))
    c, lit = F.col, F.lit
    note = F.when(c("page") % 2 == 1, F.concat(lit("Left note "), c("p_brand"))).otherwise(F.concat(lit("Right note "), c("p_type")))
    line = F.when(c("k") == 0, F.concat(lit("Datasheet "), c("p_name"), lit(" page "), c("page"))).when(c("k") == 1, note).otherwise(F.concat(lit("Body "), F.char(c("page") + 97), lit(" "), c("p_name")))
    y0 = F.when(c("k") == 0, 10.0).when(c("k") == 1, 780.0).otherwise(400.0)
    return pages.select(c("p_partkey").alias("doc_id"), "page", "k", line.alias("text"), lit(0.0).alias("x0"), lit(500.0).alias("x1"), y0.alias("y0"), (y0 + 10).alias("y1"), lit(800.0).alias("page_height"), lit(600.0).alias("page_width"), lit(0).alias("block_type"), c("k").alias("block_no"))


@register("a01_furniture_both_routes", "SELECT p_partkey AS doc_id, key, CAST(n AS BIGINT) AS n FROM (SELECT p_partkey, 'Datasheet ' || p_name || ' page #' AS key, 12 AS n FROM part UNION ALL SELECT p_partkey, regexp_replace('Left note ' || p_brand, '[0-9]+', '#', 'g'), 6 FROM part UNION ALL SELECT p_partkey, 'Right note ' || p_type, 6 FROM part)")
def a01_both(spark, sf_dir):
    from ..functions.text import furniture_key

    pages = _part_pages(spark, sf_dir).withColumn("key", furniture_key(F.col("text")))
    totals = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(12).alias("total_pages"))
    return layout.furniture(pages, "doc_id", "page", "key", totals).select("doc_id", "key", "n")


@register("p08_blocks_without_furniture", f"SELECT doc_id, page, line FROM ({_PAGES}) WHERE k = 2")
def p08(spark, sf_dir):
    from ..functions.text import furniture_key

    blocks = _part_pages(spark, sf_dir)
    totals = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(12).alias("total_pages"))
    found = layout.furniture(blocks.withColumn("key", furniture_key(F.col("text"))), "doc_id", "page", "key", totals)
    return layout.without_furniture(blocks, "doc_id", found).select("doc_id", F.col("page").cast("long").alias("page"), F.col("text").alias("line"))


# Blocks of line items: columns by line number, heights by quantity.
_BLOCKS = "SELECT l_orderkey AS doc_id, 1 AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS block_no, CASE WHEN l_linenumber % 3 = 0 THEN 20.0 WHEN l_linenumber % 3 = 1 THEN 310.0 ELSE 20.0 END AS x0, CASE WHEN l_linenumber % 3 = 0 THEN 280.0 WHEN l_linenumber % 3 = 1 THEN 570.0 ELSE 570.0 END AS x1, CASE WHEN l_linenumber % 3 = 2 THEN 20.0 ELSE 100.0 + l_quantity END AS y0, CASE WHEN l_linenumber % 3 = 2 THEN 60.0 ELSE 200.0 + 2 * l_quantity END AS y1, CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS block_type, 600.0 AS page_width, 800.0 AS page_height FROM {lineitem}"


def _item_blocks(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("ql_lineitem")
    rows = spark.sql(_BLOCKS.format(lineitem="ql_lineitem"))
    return rows.select("doc_id", "page", F.col("block_no").cast("long").alias("block_no"), *[F.col(c).cast("double").alias(c) for c in ("x0", "x1", "y0", "y1", "page_width", "page_height")], "block_type")


_B = f"b AS ({_BLOCKS.format(lineitem='lineitem')}), tb AS (SELECT * FROM b WHERE block_type = 0)"
_COLUMNS = f"""{_B}, f AS (SELECT * FROM tb WHERE x1 - x0 BETWEEN 150 AND 330),
pr AS (SELECT l.doc_id, (l.x1 + r.x0) / 2 AS gutter, least(l.y1 - l.y0, r.y1 - r.y0) AS h, least(l.y0, r.y0) AS top, greatest(l.y1, r.y1) AS bottom FROM f l JOIN f r ON l.doc_id = r.doc_id WHERE least(l.y1, r.y1) > greatest(l.y0, r.y0) AND r.x0 - l.x1 > 10 AND r.x0 - l.x1 <= 120),
cols AS (SELECT doc_id, avg(gutter) AS gutter, min(top) AS column_top, max(bottom) AS column_bottom FROM pr WHERE h >= 80 GROUP BY 1)"""


@register("p03_text_blocks", f"WITH {_B} SELECT doc_id, block_no FROM tb")
def p03(spark, sf_dir):
    return layout.text_blocks(_item_blocks(spark, sf_dir)).select("doc_id", "block_no")


@register("p04_edge_band", f"WITH {_B} SELECT doc_id, block_no, y1 <= 160 OR y0 >= 640 AS banded FROM b")
def p04(spark, sf_dir):
    return _item_blocks(spark, sf_dir).select("doc_id", "block_no", layout.is_banded(F.col("y0"), F.col("y1"), F.col("page_height")).alias("banded"))


@register("j06_w08_two_columns", f"WITH {_COLUMNS} SELECT doc_id, gutter, column_top, column_bottom FROM cols")
def j06(spark, sf_dir):
    return layout.columns_of(_item_blocks(spark, sf_dir)).select("doc_id", "gutter", "column_top", "column_bottom")


@register("w07_reading_order", f"""WITH {_COLUMNS}, z AS (SELECT tb.*, CASE WHEN gutter IS NULL THEN 0 WHEN y1 <= column_top THEN 0 WHEN y0 >= column_bottom OR x1 - x0 > 360 THEN 3 WHEN (x0 + x1) / 2 < gutter THEN 1 ELSE 2 END AS zone, gutter FROM tb LEFT JOIN cols USING (doc_id))
SELECT doc_id, block_no, zone, row_number() OVER (PARTITION BY doc_id ORDER BY zone, y0, CASE WHEN gutter IS NULL OR zone IN (0, 3) THEN x0 ELSE 0 END, block_no) AS place FROM z""")  # fmt: skip
def w07(spark, sf_dir):
    return layout.reading_order(_item_blocks(spark, sf_dir)).select("doc_id", "block_no", "zone", "place")


# Pictures of line items.
_IMAGES = "SELECT l_orderkey AS doc_id, l_linenumber AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq, CASE WHEN l_suppkey % 4 = 0 THEN 0 ELSE l_partkey % 5 END AS xref, -10.0 AS x0, -10.0 AS y0, l_quantity * 14 AS x1, l_quantity * 18 AS y1, 600.0 AS page_width, 800.0 AS page_height, CASE WHEN l_tax > 0.02 THEN 'Figure ' || l_partkey || ' of ' || l_shipdate::DATE END AS caption FROM lineitem"


def _images(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("ql_lineitem")
    sql = _IMAGES.replace("FROM lineitem", "FROM ql_lineitem").replace("l_shipdate::DATE", "CAST(l_shipdate AS DATE)")
    rows = spark.sql(sql)
    return rows.select("doc_id", "page", F.col("seq").cast("long").alias("seq"), F.col("xref").cast("long").alias("xref"), *[F.col(c).cast("double").alias(c) for c in ("x0", "x1", "y0", "y1", "page_width", "page_height")], "caption")


_I = f"i AS ({_IMAGES}), r AS (SELECT *, 100 * least(600, x1) * least(800, y1) / 480000 AS area FROM i), g AS (SELECT *, round(area, 2) AS pct, area >= 1.0 AS counts FROM r)"


@register("p10_raster_filter", f"WITH {_I} SELECT doc_id, CAST(sum(CASE WHEN counts THEN 1 ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN NOT counts AND pct > 0 THEN 1 ELSE 0 END) AS BIGINT) AS excluded FROM g GROUP BY 1")
def p10(spark, sf_dir):
    return layout.excluded(layout.rasters(_images(spark, sf_dir)))


@register("a05_figure_digest", f"WITH {_I} SELECT doc_id, page, count(*) AS figures, count(caption) AS captioned, arg_max(caption, struct_pack(a := pct, b := -seq)) FILTER (WHERE caption IS NOT NULL) AS caption FROM g WHERE counts GROUP BY 1, 2")
def a05(spark, sf_dir):
    return layout.figure_digest(layout.rasters(_images(spark, sf_dir)).filter("counts")).select("doc_id", "page", "figures", "captioned", "caption")


@register("l03_picture_groups", f"WITH {_I} SELECT doc_id, CASE WHEN xref = 0 THEN -seq ELSE xref END AS picture, count(*) AS placements, max(pct) AS page_area_pct FROM g GROUP BY 1, 2")
def l03(spark, sf_dir):
    return layout.pictures(layout.rasters(_images(spark, sf_dir))).select("doc_id", "picture", "placements", "page_area_pct")


@register("l02_l05_caption_candidates", f"WITH {_I}, q AS (SELECT doc_id, CASE WHEN xref = 0 THEN -seq ELSE xref END AS picture, max(pct) AS pct, arg_max(page, struct_pack(a := pct, b := -page, c := -seq)) AS page FROM g GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pct DESC, page, picture) AS rank FROM q) SELECT doc_id, picture, page, rank FROM k WHERE rank <= 3")
def l02(spark, sf_dir):
    return layout.caption_candidates(layout.rasters(_images(spark, sf_dir)), 3).select("doc_id", "picture", "page", "rank")


@register("f17_figure_captions", "SELECT p_partkey, figure_number, caption FROM (SELECT p_partkey, p_size || '-1' AS figure_number, 'Figure ' || p_size || '-1 ' || p_name AS caption FROM part UNION ALL SELECT p_partkey, p_size || '', 'Figure ' || p_size || ' Next line' FROM part)")
def f17(spark, sf_dir):
    c, lit = F.col, F.lit
    text = F.concat(lit("Figure "), c("p_size"), lit("-1: "), c("p_name"), lit("\nFigure 3 shows the parts\n\nFIG. "), c("p_size"), lit("\n\nNext line\nFigure 1.2-1 shows no caption"))
    return layout.captions(table(spark, sf_dir, "part").select("p_partkey", text.alias("page_text")), "p_partkey").select("p_partkey", "figure_number", "caption")


# Pages of documents: 25 lines each.
_DOC_PAGES = f"{LINES}, pages_ AS (SELECT doc_id, CAST(line // 25 + 1 AS BIGINT) AS page, string_agg(line_text, chr(10) ORDER BY line) AS page_text FROM lines GROUP BY 1, 2)"


def doc_pages(spark, sf_dir):
    """Lines are numbered and joined inside each document's own row, so nothing is shuffled."""
    lines = F.split("text", "\n")
    numbers = F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 25).cast("int"))
    pages = F.transform(numbers, lambda k: F.array_join(F.slice(lines, k * 25 + 1, F.lit(25)), "\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(pages).alias("k", "page_text")).select("doc_id", (F.col("k") + 1).cast("long").alias("page"), "page_text")


@register("k02_page_table", f"WITH {_DOC_PAGES} SELECT doc_id, page, page_text FROM pages_")
def k02(spark, sf_dir):
    return doc_pages(spark, sf_dir)


@register("s12_page_marks", f"WITH {_DOC_PAGES} SELECT doc_id, page, regexp_replace(regexp_replace(page_text, '^[\\r\\n]+', ''), '\\s+$', '') AS page_text FROM pages_")
def s12(spark, sf_dir):
    from ..sources.files import marked_text, page_texts

    return page_texts(marked_text(doc_pages(spark, sf_dir), "doc_id")).withColumn("page", F.col("page").cast("long"))


@register("a68_corpus_shape", f"WITH {_DOC_PAGES}, p AS (SELECT doc_id, count(*) AS total_pages, sum(length(page_text)) AS n_chars FROM pages_ GROUP BY 1), f AS (SELECT CAST(l_partkey AS BIGINT) AS doc_id, count(*) AS figures, count(*) FILTER (WHERE l_returnflag = 'R') AS raster, count(*) FILTER (WHERE trim(CASE l_linestatus WHEN 'O' THEN l_shipmode ELSE ' ' END) <> '') AS captioned FROM (SELECT l_partkey, l_returnflag, l_linestatus, 'mode' AS l_shipmode FROM lineitem) GROUP BY 1) SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN total_pages END AS total_pages, coalesce(figures, 0) AS figures, coalesce(raster, 0) AS raster, coalesce(captioned, 0) AS captioned, CASE WHEN doc_id % 9 = 0 OR doc_id % 10 = 0 THEN -1 ELSE CAST(floor(n_chars / total_pages) AS BIGINT) END AS chars_per_page FROM p LEFT JOIN f USING (doc_id)")
def a68(spark, sf_dir):
    from ..operators import reports

    sizes = doc_pages(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("page_text")).alias("chars"))
    docs = sizes.select("doc_id", F.when(F.col("doc_id") % 9 != 0, F.col("n")).alias("total_pages"), F.when(F.col("doc_id") % 10 != 0, F.col("chars")).alias("n_chars"))
    figures = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("doc_id"), F.when(F.col("l_returnflag") == "R", "raster").otherwise("caption").alias("kind"), F.when(F.col("l_linestatus") == "O", "mode").otherwise(" ").alias("caption"))
    return reports.corpus_shape(docs, figures)


@register("w16_front_matter", f"""WITH {_DOC_PAGES}, f AS (SELECT doc_id, page, page_text AS t, length(page_text) AS n, coalesce(sum(length(page_text)) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pages_ WHERE page <= 2),
k AS (SELECT *, CASE WHEN n <= greatest(0, 1000 - before) THEN t WHEN contains(t[1:CAST(greatest(0, 1000 - before) AS INT)], chr(10)) THEN regexp_replace(t[1:CAST(greatest(0, 1000 - before) AS INT)], '\\n[^\\n]*$', '') ELSE '' END AS kept FROM f),
o AS (SELECT *, coalesce(min(CASE WHEN kept = t THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS open FROM k)
SELECT doc_id, CAST(sum(length(kept)) AS BIGINT) AS chars_shown, count(*) AS pages_shown FROM o WHERE open = 1 AND (kept <> '' OR n = 0) GROUP BY 1""")  # fmt: skip
def w16(spark, sf_dir):
    return layout.front_matter(doc_pages(spark, sf_dir), max_chars=1000).select("doc_id", "chars_shown", "pages_shown")


@register("w14_page_chunks", f"""WITH RECURSIVE {_DOC_PAGES}, r AS (SELECT doc_id, page, length(page_text) AS held, 1 AS chunk FROM pages_ WHERE page = 1
UNION ALL SELECT p.doc_id, p.page, CASE WHEN r.held > 0 AND r.held + length(p.page_text) > 3000 THEN length(p.page_text) ELSE r.held + length(p.page_text) END, r.chunk + CASE WHEN r.held > 0 AND r.held + length(p.page_text) > 3000 THEN 1 ELSE 0 END FROM r JOIN pages_ p ON p.doc_id = r.doc_id AND p.page = r.page + 1)
SELECT doc_id, page, chunk FROM r""")  # fmt: skip
def w14(spark, sf_dir):
    return layout.chunks(doc_pages(spark, sf_dir), size=3000)


@register("f24_title_text", "WITH s AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq, l_quantity / 5 AS size, l_shipdate::DATE::VARCHAR AS text FROM lineitem), t AS (SELECT *, max(size) OVER (PARTITION BY doc_id) AS top FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS rank FROM t WHERE size >= top - 1.5) SELECT doc_id, string_agg(text, ' ' ORDER BY seq) AS title_text FROM r WHERE rank <= 8 GROUP BY 1")
def f24(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    spans = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.row_number().over(order).alias("seq"), (F.col("l_quantity") / 5).alias("size"), F.col("l_shipdate").cast("date").cast("string").alias("text"))
    return layout.title_text(spans)
