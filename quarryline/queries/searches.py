"""Queries over pages of documents; benchmark passages are the patterns: their first four words, or the whole of them where it says so."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reads
from ..operators import search as s
from . import register, table
from .layouts import _DOC_PAGES, LINES, doc_pages

_PATTERNS = "patterns AS (SELECT item_id AS pattern_id, array_to_string(string_split(text, ' ')[1:4], ' ') AS pattern FROM benchmark)"


def patterns(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pattern_id"), F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("pattern"))


def quotations(spark, sf_dir):
    """Whole passages beside their first four words: odd numbers beside even ones."""
    b = table(spark, sf_dir, "benchmark")
    short = F.array_join(F.slice(F.split("text", " "), 1, 4), " ")
    return b.select(F.posexplode(F.array(short, "text")).alias("k", "pattern"), "item_id").select((F.col("item_id") * 2 + F.col("k")).alias("pattern_id"), "pattern")


_HITS = f"WITH {_DOC_PAGES}, {_PATTERNS}, h AS (SELECT pattern_id, doc_id, page, page_text, pattern, CAST((length(page_text) - length(replace(lower(page_text), lower(pattern), ''))) / length(pattern) AS BIGINT) AS hits, CAST(instr(lower(page_text), lower(pattern)) - 1 AS BIGINT) AS first_start FROM pages_ JOIN patterns ON contains(lower(page_text), lower(pattern)))"


@register("f06_literal_search", f"{_HITS} SELECT pattern_id, doc_id, page, hits, first_start FROM h")
def f06(spark, sf_dir):
    found = s.search(doc_pages(spark, sf_dir), patterns(spark, sf_dir), None, levels=1)
    return found.groupBy("pattern_id", "doc_id", "page").agg(F.count(F.lit(1)).alias("hits"), F.min("start").cast("long").alias("first_start"))


@register("l01_capped_search", f"{_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY doc_id, page) AS rank FROM h) SELECT pattern_id, doc_id, page, first_start FROM r WHERE rank = 1")
def l01(spark, sf_dir):
    return s.search(doc_pages(spark, sf_dir), patterns(spark, sf_dir), 1, levels=1).select("pattern_id", "doc_id", "page", F.col("start").cast("long").alias("first_start"))


@register("f09_snippets", f"{_HITS} SELECT pattern_id, doc_id, page, CASE WHEN first_start > 80 THEN '...' ELSE '' END || trim(regexp_replace(page_text[CAST(greatest(0, first_start - 80) + 1 AS INT):CAST(least(length(page_text), first_start + length(pattern) + 80) AS INT)], '\\s+', ' ', 'g')) || CASE WHEN first_start + length(pattern) + 80 < length(page_text) THEN '...' ELSE '' END AS snippet FROM h")
def f09(spark, sf_dir):
    pages = doc_pages(spark, sf_dir)
    first = s.search(pages, patterns(spark, sf_dir), None, levels=1).groupBy("pattern_id", "doc_id", "page").agg(F.min(F.struct("start", "end")).alias("m"))
    return first.join(pages, ["doc_id", "page"]).select("pattern_id", "doc_id", "page", s.snippet(F.col("page_text"), F.col("m.start"), F.col("m.end")).alias("snippet"))


# Pages with line breaks and other words between those of the pattern.
@register("f07_collapsed_search", "SELECT p_partkey AS doc_id, 2 AS level, CAST(length(p_brand) + 1 AS INT) AS start, CAST(length(p_brand) + 1 + 17 AS INT) AS \"end\" FROM part")
def f07(spark, sf_dir):
    pages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page"), F.concat("p_brand", F.lit(" "), F.lit("recessive \nbit-xy"), F.lit(" "), "p_name").alias("page_text"))
    return s.search(pages, spark.createDataFrame([(1, "Recessive bit-xy")], "pattern_id int, pattern string"), None).select("doc_id", "level", "start", "end")


@register("f05_f08_ordered_tokens", "SELECT p_partkey AS doc_id, 3 AS level, CAST(0 AS INT) AS start, CAST(length('alpha ') + length(p_name) + length(' beta, ') + length(p_brand) + length(' gamma') AS INT) AS \"end\" FROM part")
def f05(spark, sf_dir):
    pages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page"), F.concat(F.lit("alpha "), "p_name", F.lit(" beta, "), "p_brand", F.lit(" gamma tail")).alias("page_text"))
    return s.search(pages, spark.createDataFrame([(1, "Alpha beta gamma")], "pattern_id int, pattern string"), None).select("doc_id", "level", "start", "end")


@register("f10_search_ladder", None)
def f10(spark, sf_dir):
    return s.search(doc_pages(spark, sf_dir), quotations(spark, sf_dir), None).select("pattern_id", "doc_id", "page", "start", "end", "level")


@register("l01_multi_pattern", None)
def l01_multi(spark, sf_dir):
    found = s.search(doc_pages(spark, sf_dir), patterns(spark, sf_dir), None)
    return s.distinct_spans(found, 20)


# A page for each part with its name as a heading: alone on a line, after a table row that starts with it.
@register("f18_heading_offsets", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0 WHEN p_partkey % 3 = 1 THEN length(p_name) + 10 ELSE length(p_brand) + 1 END AS offset FROM part")
def f18(spark, sf_dir):
    k, name = F.col("p_partkey") % 3, F.col("p_name")
    text = F.when(k == 0, F.concat(F.lit("4 "), name, F.lit("\nrow"))).when(k == 1, F.concat(name, F.lit(" 300 1100\n"), name, F.lit("  \nrow"))).otherwise(F.concat(F.col("p_brand"), F.lit("\n"), name, F.lit(" merged with the line")))
    return table(spark, sf_dir, "part").select("p_partkey", s.heading_offset(text, name).cast("long").alias("offset"))


# Sections and matches from line items: an order is a document, quantities are offsets.
_SECTIONS = "sections AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq, l_linenumber AS start_page, l_linenumber + l_suppkey % 3 AS end_page, CASE WHEN l_partkey % 5 <> 0 THEN CAST(l_quantity AS BIGINT) END AS \"offset\" FROM lineitem), matches AS (SELECT o_orderkey AS doc_id, o_custkey % 7 + 1 AS page, CAST(floor(o_totalprice) AS BIGINT) % 50 AS start FROM orders)"


@register("j03_j04_section_of_match", f"WITH {_SECTIONS}, c AS (SELECT m.*, s.seq, row_number() OVER (PARTITION BY m.doc_id ORDER BY s.start_page DESC, CASE WHEN s.start_page < m.page THEN 0 ELSE s.\"offset\" END DESC, s.seq DESC) AS rn FROM matches m JOIN sections s ON s.doc_id = m.doc_id AND ((s.start_page < m.page AND s.end_page >= m.page - 1) OR (s.start_page = m.page AND s.\"offset\" <= m.start))) SELECT m.doc_id, m.page, m.start, c.seq FROM matches m LEFT JOIN (SELECT * FROM c WHERE rn = 1) c USING (doc_id)")
def j03(spark, sf_dir):
    from pyspark.sql import Window

    item = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    sections = item.select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(order).cast("long").alias("seq"), F.col("l_linenumber").cast("long").alias("start_page"), (F.col("l_linenumber") + F.col("l_suppkey") % 3).cast("long").alias("end_page"), F.when(F.col("l_partkey") % 5 != 0, F.round("l_quantity").cast("long")).alias("offset"))
    matches = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 7 + 1).alias("page"), (F.floor("o_totalprice") % 50).alias("start"))
    return s.section_at(matches, sections).select("doc_id", "page", "start", "seq")


# Pages of five lines, some of which open with the rest of a table; an outline of their own lines' first words, some of them on no page.
_READ_PAGES = f"""{LINES}, marked AS (SELECT doc_id, CAST(line // 5 + 1 AS BIGINT) AS page, (doc_id + line // 5 + 1) % 11 = 0 AS goes_on, string_agg(line_text, chr(10) ORDER BY line) AS t FROM lines GROUP BY ALL),
read_pages AS (SELECT doc_id, page, goes_on, CASE WHEN goes_on THEN 'Table ' || page || ' values (Continued)' || chr(10) ELSE '' END || t AS page_text FROM marked),
words AS (SELECT doc_id, CAST(line // 5 + 1 AS BIGINT) AS page, line % 5 AS place, array_to_string(string_split(line_text, ' ')[1:3], ' ') AS title FROM lines WHERE line % 5 IN (0, 3)),
outline AS (
  SELECT doc_id, page * 10 AS seq, 1 AS level, title, page AS start_page FROM words WHERE place = 0 AND (doc_id + page) % 3 <> 0 AND trim(title) <> ''
  UNION ALL SELECT m.doc_id, m.page * 10 + 5, 2, m.title, m.page FROM words m JOIN words o ON o.doc_id = m.doc_id AND o.page = m.page AND o.place = 0 WHERE m.place = 3 AND (m.doc_id + m.page) % 2 = 0 AND trim(m.title) <> '' AND lower(o.title) <> lower(m.title)
  UNION ALL SELECT doc_id, page * 10 + (CASE WHEN page % 2 = 0 THEN 2 ELSE 7 END), 1, CASE WHEN page = 3 THEN 'Selection guide' ELSE 'No such heading ' || page END, page FROM read_pages WHERE (doc_id + page) % 7 = 0
),
sections AS (SELECT *, least(start_page + seq % 3, (SELECT max(page) FROM read_pages r WHERE r.doc_id = o.doc_id)) AS end_page, 'in ' || title AS breadcrumb FROM outline o),
page_lines AS (SELECT doc_id, page, unnest(string_split(page_text, chr(10))) AS l, unnest(range(len(string_split(page_text, chr(10))))) AS k FROM read_pages),
starts AS (SELECT doc_id, page, lower(l) AS l, CAST(coalesce(sum(length(l) + 1) OVER (PARTITION BY doc_id, page ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place_at FROM page_lines),
heads AS (SELECT s.doc_id, s.start_page AS page, s.seq, s.title, coalesce(min(CASE WHEN regexp_replace(x.l, '[ \\t]+$', '') = lower(s.title) THEN x.place_at END), max(CASE WHEN starts_with(x.l, lower(s.title)) AND regexp_matches(substr(x.l, length(s.title) + 1, 1), '^\\s?$') THEN x.place_at END)) AS place_at
  FROM sections s LEFT JOIN starts x ON x.doc_id = s.doc_id AND x.page = s.start_page GROUP BY ALL),
placed AS (SELECT h.*, h.place_at IS NOT NULL AND NOT regexp_matches(substr(page_text, 1, h.place_at), '^\\s*$') AS mid FROM heads h JOIN read_pages USING (doc_id, page)),
first_mid AS (SELECT doc_id, page, min(place_at) AS place_at, arg_min(seq, place_at) AS seq, arg_min(title, place_at) AS title FROM placed WHERE mid GROUP BY 1, 2),
page_heads AS (SELECT p.doc_id, p.page, count(*) FILTER (WHERE NOT p.mid AND p.place_at IS NOT NULL) AS opens, count(*) FILTER (WHERE p.place_at IS NULL) AS lost, count(*) FILTER (WHERE p.place_at IS NULL AND p.seq < f.seq) > 0 AS uncertain, any_value(f.place_at) AS place_at, any_value(f.title) AS title FROM placed p LEFT JOIN first_mid f USING (doc_id, page) GROUP BY 1, 2)"""


def read_pages(spark, sf_dir):
    lines = F.split("text", "\n")
    numbers = F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 5).cast("int"))
    parts = F.transform(numbers, lambda k: F.array_join(F.slice(lines, k * 5 + 1, F.lit(5)), "\n"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(parts).alias("k", "t")).select("doc_id", (F.col("k") + 1).cast("long").alias("page"), "t")
    goes_on = F.when((F.col("doc_id") + F.col("page")) % 11 == 0, F.format_string("Table %d values (Continued)\n", "page")).otherwise("")
    return rows.select("doc_id", "page", F.concat(goes_on, "t").alias("page_text"), "t")


def read_sections(pages):
    lines, page, k = F.split("t", "\n"), F.col("page"), F.col("doc_id") + F.col("page")
    words = lambda n: F.array_join(F.slice(F.split(F.get(lines, F.lit(n)), " "), 1, 3), " ")
    entry = lambda ok, add, level, title: F.when(ok & (F.trim(title) != ""), F.struct((page * 10 + add).alias("seq"), F.lit(level).alias("level"), title.alias("title")))
    lost = F.when(page == 3, F.lit("Selection guide")).otherwise(F.format_string("No such heading %d", page))
    entries = F.array(entry(k % 3 != 0, F.lit(0), 1, words(0)), entry((k % 2 == 0) & (F.lower(words(0)) != F.lower(words(3))), F.lit(5), 2, words(3)), entry(k % 7 == 0, F.when(page % 2 == 0, 2).otherwise(7), 1, lost))
    last = pages.groupBy("doc_id").agg(F.max("page").alias("pages"))
    rows = pages.select("doc_id", F.col("page").alias("start_page"), F.inline(F.array_compact(entries))).join(last, "doc_id")
    return rows.select("doc_id", "seq", "level", "title", "start_page", F.least(F.col("start_page") + F.col("seq") % 3, "pages").alias("end_page"), F.array(F.struct("seq", "title")).alias("lineage"), F.concat(F.lit("in "), "title").alias("breadcrumb"))


@register("f18_page_headings", f"WITH {_READ_PAGES} SELECT doc_id, seq, CASE WHEN mid THEN place_at ELSE 0 END AS \"offset\" FROM placed WHERE place_at IS NOT NULL")
def f18_pages(spark, sf_dir):
    pages = read_pages(spark, sf_dir)
    sections = read_sections(pages)
    # a heading that opens its page counts from the page's start
    found = reads.headings(sections, pages)
    return found.select("doc_id", F.inline(F.transform("mid", lambda m: F.struct(m.seq.alias("seq"), m.offset.cast("long").alias("offset"))))).unionByName(found.select("doc_id", F.explode("top").alias("seq")).withColumn("offset", F.lit(0).cast("long")))


@register("j04_match_sections", f"""WITH {_READ_PAGES}, matches AS (SELECT doc_id, page, CAST((doc_id * 7 + page * 13) % greatest(length(page_text), 1) AS BIGINT) AS start FROM read_pages),
by_place AS (SELECT doc_id, page FROM page_heads WHERE place_at IS NOT NULL AND NOT uncertain),
c AS (SELECT m.*, s.breadcrumb, row_number() OVER (PARTITION BY m.doc_id, m.page ORDER BY s.start_page DESC, CASE WHEN s.start_page < m.page OR NOT h.mid THEN 0 ELSE h.place_at END DESC, s.seq DESC) AS rn FROM matches m JOIN by_place USING (doc_id, page) JOIN sections s ON s.doc_id = m.doc_id JOIN placed h ON h.doc_id = s.doc_id AND h.seq = s.seq
  WHERE (s.start_page < m.page AND s.end_page >= m.page - 1) OR (s.start_page = m.page AND CASE WHEN h.mid THEN h.place_at WHEN h.place_at IS NOT NULL THEN 0 END <= m.start)),
d AS (SELECT m.*, s.breadcrumb, row_number() OVER (PARTITION BY m.doc_id, m.page ORDER BY s.level DESC, s.seq) AS rn FROM matches m ANTI JOIN by_place USING (doc_id, page) JOIN sections s ON s.doc_id = m.doc_id AND m.page BETWEEN s.start_page AND s.end_page)
SELECT m.doc_id, m.page, m.start, coalesce(c.breadcrumb, d.breadcrumb) AS breadcrumb FROM matches m LEFT JOIN (SELECT * FROM c WHERE rn = 1) c USING (doc_id, page) LEFT JOIN (SELECT * FROM d WHERE rn = 1) d USING (doc_id, page)""")  # fmt: skip
def j04(spark, sf_dir):
    pages = read_pages(spark, sf_dir)
    sections = read_sections(pages)
    matches = pages.select("doc_id", "page", ((F.col("doc_id") * 7 + F.col("page") * 13) % F.greatest(F.length("page_text"), F.lit(1))).alias("start"))
    return reads.breadcrumbs_of_matches(matches, sections, reads.headings(sections, pages))


@register("f01_f20_section_read", f"""WITH {_READ_PAGES}, n AS (SELECT doc_id, max(page) AS total FROM read_pages GROUP BY 1),
ranges AS (SELECT doc_id, total, page AS a, least(page + 1, total) AS b FROM read_pages JOIN n USING (doc_id) WHERE page % 2 = 1),
clear AS (SELECT * FROM page_heads WHERE opens = 0 AND place_at IS NOT NULL AND NOT uncertain),
body AS (SELECT r.doc_id, r.a, string_agg('--- PAGE ' || p.page || ' ---' || chr(10) || CASE WHEN p.page = r.a AND c.place_at IS NOT NULL THEN substr(p.page_text, 1, c.place_at) || '=== SECTION STARTS: ' || trim(c.title) || ' (text above is the previous section''s) ===' || chr(10) || substr(p.page_text, c.place_at + 1) ELSE p.page_text END, chr(10) ORDER BY p.page) AS t FROM ranges r JOIN read_pages p ON p.doc_id = r.doc_id AND p.page BETWEEN r.a AND r.b LEFT JOIN clear c ON c.doc_id = p.doc_id AND c.page = p.page GROUP BY 1, 2),
guides AS (SELECT doc_id, start_page, end_page FROM sections WHERE title = 'Selection guide')
SELECT r.doc_id, r.doc_id * 100000 + r.a AS range_id, concat_ws(chr(10),
  CASE WHEN r.a = r.b THEN '=== Page ' || r.a || ' of ' || r.total || ' ===' ELSE '=== Pages ' || r.a || '-' || r.b || ' of ' || r.total || ' ===' END,
  CASE WHEN r.doc_id % 13 < 2 AND NOT (g.start_page IS NOT NULL AND g.start_page <= r.a AND r.b <= g.end_page) THEN '=== NOTE: this datasheet covers a product family' || CASE WHEN r.doc_id % 13 = 1 THEN ' (XY' || r.doc_id || ')' ELSE '' END || '. Do NOT report a per-part answer from the text below: it describes the family, and a given part may not have what it names. '
    || CASE WHEN g.start_page IS NULL THEN 'Search for the exact requested part number and verify the value where that part is explicitly named.' ELSE 'Check likely part-specific evidence in "Selection guide" (page ' || g.start_page || '), and search for the exact requested part number before answering.' END || ' ===' END,
  CASE WHEN r.a > 1 AND (r.doc_id + r.a) % 11 = 0 THEN '=== NOTE: this range opens inside "Table ' || r.a || ' values", which is continued from page ' || (r.a - 1) || '. ===' END,
  CASE WHEN r.b < r.total AND (r.doc_id + r.b + 1) % 11 = 0 THEN '=== NOTE: "Table ' || (r.b + 1) || ' values" is continued on page ' || (r.b + 1) || ', which is outside this range. ===' END,
  CASE WHEN h.opens = 0 AND h.lost > 0 AND c.place_at IS NULL THEN '=== NOTE: a section starts on page ' || h.page || ', but its heading could not be located there, so this range may end before its section does. Read page ' || h.page || ' too if values seem to be missing. ===' END,
  body.t,
  CASE WHEN c.place_at IS NOT NULL THEN '=== Continued from the top of page ' || c.page || ', up to the next section heading "' || trim(c.title) || '" ===' || chr(10) || '--- PAGE ' || c.page || ' ---' || chr(10) || regexp_replace(substr(x.page_text, 1, c.place_at), '\\s+$', '') END) AS text
FROM ranges r JOIN body ON body.doc_id = r.doc_id AND body.a = r.a LEFT JOIN guides g ON g.doc_id = r.doc_id LEFT JOIN read_pages x ON x.doc_id = r.doc_id AND x.page = r.b + 1 AND r.b < r.total LEFT JOIN page_heads h ON h.doc_id = r.doc_id AND h.page = x.page LEFT JOIN clear c ON c.doc_id = r.doc_id AND c.page = x.page""")  # fmt: skip
def f20(spark, sf_dir):
    pages = read_pages(spark, sf_dir)
    last = pages.groupBy("doc_id").agg(F.max("page").alias("n"))
    ranges = pages.filter("page % 2 = 1").join(last, "doc_id").select((F.col("doc_id") * 100000 + F.col("page")).alias("range_id"), "doc_id", F.col("page").alias("first_page"), F.least(F.col("page") + 1, "n").alias("last_page"))
    families = last.filter("doc_id % 13 < 2").select("doc_id", F.when(F.col("doc_id") % 13 == 1, F.concat(F.lit("XY"), "doc_id")).otherwise("").alias("family"))
    return reads.section_reads(pages, read_sections(pages), ranges, families)


# The range of a note is each second page and the one after it; documents of families are those of two remainders.
@register("f21_family_notes", f"""WITH {_READ_PAGES}, guides AS (SELECT doc_id, start_page, end_page FROM sections WHERE title = 'Selection guide')
SELECT p.doc_id, p.page, CASE WHEN g.start_page IS NOT NULL AND g.start_page <= p.page AND p.page + 1 <= g.end_page THEN NULL ELSE '=== NOTE: this datasheet covers a product family' || CASE WHEN p.doc_id % 13 = 1 THEN ' (XY' || p.doc_id || ')' ELSE '' END || '. Do NOT report a per-part answer from the text below: it describes the family, and a given part may not have what it names. '
  || CASE WHEN g.start_page IS NULL THEN 'Search for the exact requested part number and verify the value where that part is explicitly named.' ELSE 'Check likely part-specific evidence in "Selection guide" (page ' || g.start_page || '), and search for the exact requested part number before answering.' END || ' ===' END AS note FROM read_pages p LEFT JOIN guides g USING (doc_id) WHERE p.doc_id % 13 < 2 AND p.page % 2 = 1""")  # fmt: skip
def f21(spark, sf_dir):
    pages = read_pages(spark, sf_dir)
    found = reads.evidence(read_sections(pages))
    rows = pages.filter("doc_id % 13 < 2 AND page % 2 = 1").join(found, "doc_id", "left")
    family = F.when(F.col("doc_id") % 13 == 1, F.concat(F.lit("XY"), "doc_id")).otherwise("")
    return rows.select("doc_id", "page", reads.family_note(family, F.col("shown"), F.col("resolving"), F.col("page"), F.col("page") + 1).alias("note"))


# One page of each document out of its whole text with marks; the marks and blank ends are gone.
@register("f02_page_body", f"WITH {_DOC_PAGES} SELECT doc_id, page, regexp_replace(regexp_replace(page_text, '^[\\r\\n]+', ''), '\\s+$', '') AS body FROM pages_ JOIN (SELECT doc_id, max(page) AS pages FROM pages_ GROUP BY 1) USING (doc_id) WHERE page = doc_id % pages + 1")
def f02(spark, sf_dir):
    from ..sources.files import marked_text, page_body

    whole = marked_text(doc_pages(spark, sf_dir), "doc_id")
    last = doc_pages(spark, sf_dir).groupBy("doc_id").agg(F.max("page").alias("pages"))
    wanted = whole.join(last, "doc_id").withColumn("page", F.col("doc_id") % F.col("pages") + 1)
    return wanted.select("doc_id", "page", page_body(F.col("text"), F.col("page")).alias("body"))


@register("f19_continued_tail", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand || ' row' END AS tail FROM part")
def f19(spark, sf_dir):
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_brand", F.lit(" row\n"), "p_name", F.lit("\nbody"))).otherwise(F.concat("p_name", F.lit("\nbody")))
    return table(spark, sf_dir, "part").select("p_partkey", s.continued(text, s.heading_offset(text, F.col("p_name"))).alias("tail"))


@register("j25_probe_hits", "SELECT item_id AS pattern_id, count(*) AS documents FROM documents JOIN benchmark b ON contains(lower(documents.text), lower(b.text)) GROUP BY 1")
def j25(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), F.col("text").alias("page_text"))
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pattern_id"), F.col("text").alias("pattern"))
    return s.search(docs, passages, None, levels=1).groupBy("pattern_id").agg(F.count_distinct("doc_id").alias("documents"))


def flagship(spark, sf_dir):
    """Pages that hold a benchmark passage's opening words, with counts and snippets, the first hundred by hits."""
    pages = doc_pages(spark, sf_dir)
    found = s.search(pages, patterns(spark, sf_dir), None)
    counted = found.groupBy("pattern_id", "doc_id", "page").agg(F.count(F.lit(1)).alias("hits"), F.min(F.struct("start", "end")).alias("m"), F.min("level").alias("level"))
    ranked = counted.orderBy(F.desc("hits"), "pattern_id", "doc_id", "page").limit(100)
    return ranked.join(pages, ["doc_id", "page"]).select("pattern_id", "doc_id", "page", "hits", "level", s.snippet(F.col("page_text"), F.col("m.start"), F.col("m.end")).alias("snippet"))
