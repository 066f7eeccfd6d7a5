"""Queries over lines, titles and annotations; lines of documents and texts made from parts and line items stand in for pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import titles as tt
from . import register, table

# lines of documents: (doc_id, line, text)
LINES = "lines AS (SELECT doc_id, source, UNNEST(range(len(string_split(text, chr(10))))) AS line, UNNEST(string_split(text, chr(10))) AS line_text FROM documents)"


def doc_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line", "line_text")).withColumn("line", F.col("line").cast("long"))


_KEY = r"regexp_replace(trim(regexp_replace(line_text, '\s+', ' ', 'g')), '[0-9]+', '#', 'g')"


@register("p06_furniture_key", f"WITH {LINES} SELECT doc_id, line, {_KEY} AS key FROM lines")
def p06(spark, sf_dir):
    return doc_lines(spark, sf_dir).select("doc_id", "line", tx.furniture_key(F.col("line_text")).alias("key"))


@register("p05_furniture_candidate", f"WITH {LINES} SELECT doc_id, line, length(trim(line_text)) BETWEEN 1 AND 200 AND NOT regexp_matches(trim(line_text), '(?i)^(figure\\b|fig\\.|table\\b|chart\\b)') AS candidate FROM lines")
def p05(spark, sf_dir):
    return doc_lines(spark, sf_dir).select("doc_id", "line", tx.may_be_furniture(F.col("line_text")).alias("candidate"))


@register("p07_has_letter", f"WITH {LINES} SELECT doc_id, line, regexp_matches(line_text, '\\pL') AS lettered FROM lines")
def p07(spark, sf_dir):
    return doc_lines(spark, sf_dir).select("doc_id", "line", tx.has_letter(F.col("line_text")).alias("lettered"))


@register("f03_dash_folding", "SELECT p_partkey, translate(replace(p_name, ' ', CASE p_partkey % 3 WHEN 0 THEN '–' WHEN 1 THEN '—' ELSE '−' END), '‐‑‒–—―−', '-------') AS folded FROM part")
def f03(spark, sf_dir):
    dash = F.when(F.col("p_partkey") % 3 == 0, "–").when(F.col("p_partkey") % 3 == 1, "—").otherwise("−")
    return table(spark, sf_dir, "part").select("p_partkey", tx.fold_dashes(F.replace("p_name", F.lit(" "), dash)).alias("folded"))


@register("f04_search_token", "SELECT doc_id, list_transform(string_split(text, ' '), lambda x: lower(trim(x, '.,;:!?'))) AS tokens FROM (SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents)")
def f04(spark, sf_dir):
    words = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")
    return table(spark, sf_dir, "documents").select("doc_id", F.transform(words, lambda x: tx.search_token(x)).alias("tokens"))


@register("a06_page_signals", f"WITH {LINES} SELECT doc_id, CAST(line // 25 + 1 AS BIGINT) AS page, CAST(sum(CASE WHEN regexp_matches(line_text, '^\\s*([•▪○◦‣·∙*]|[-–—](\\s|$))') THEN 1 ELSE 0 END) AS BIGINT) AS bullets, CAST(sum(length(line_text)) AS BIGINT) AS chars FROM lines GROUP BY 1, 2")
def a06(spark, sf_dir):
    return doc_lines(spark, sf_dir).groupBy("doc_id", (F.floor(F.col("line") / 25) + 1).alias("page")).agg(F.sum(tx.bullet_count(F.col("line_text"))).alias("bullets"), F.sum(F.length("line_text")).cast("long").alias("chars"))


# Titles made from parts: numbering, a title and perhaps a suffix, in all combinations.
_TITLES = ["Revision History", "Important Notice", "Ordering Information", "Package Outlines", "Contents", "Glossary", "Contact Information", "Electrical Characteristics", "Marking Information", "Device Comparison", "Selection Guide", "Part Numbering"]
def _case(values, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN {'NULL' if v is None else repr(v)}" for k, v in enumerate(values)) + " END"


def _pick(values, key):
    out = F.lit(None).cast("string")
    for k, v in enumerate(values):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


# Titles of parts: a numbering from the part's own numbers, a phrase or the part's name, and what may follow it.
_PHRASES = [*_TITLES, "Nomenclature", "Trademarks", "How to Order", "A Glossary of Terms", "Available Options", "Package Marking Information"]
_TITLE_ROWS = f"""titles AS (SELECT p_partkey, CASE p_partkey % 13 WHEN 0 THEN '' WHEN 1 THEN p_size || ' ' WHEN 2 THEN p_size || '.' || (p_partkey % 9 + 1) || ' ' WHEN 3 THEN p_size || '.' WHEN 4 THEN chr(CAST(65 + p_partkey % 26 AS INT)) || ')' WHEN 5 THEN chr(CAST(97 + p_partkey % 26 AS INT)) || '. ' WHEN 6 THEN 'Chapter ' || p_size || ': ' WHEN 7 THEN 'APPENDIX ' || chr(CAST(65 + p_partkey % 26 AS INT)) || ' - ' WHEN 8 THEN ' section ' || p_size || '. ' WHEN 9 THEN 'Appendix A: ' || p_size || '. ' WHEN 10 THEN 'Annex B) 4.' || p_size || ' - ' WHEN 11 THEN 'Table ' || p_size || '. ' ELSE '  ' END
  || CASE WHEN p_size % 6 = 0 THEN p_name ELSE ([{", ".join(repr(x) for x in _PHRASES)}])[p_partkey % {len(_PHRASES)} + 1] END
  || CASE p_size % 7 WHEN 0 THEN '' WHEN 1 THEN ' (Continued)' WHEN 2 THEN ' (cont.).' WHEN 3 THEN ':' WHEN 4 THEN ' [CONT’D]' WHEN 5 THEN ': (continued) (Cont)' ELSE ' -. ' END AS title FROM part),
normal AS (SELECT *, lower(regexp_replace(regexp_replace(regexp_replace(trim(title), '(?i)^(?:\\s*(?:{tt.LEADING}))+', ''), '(?i)(?:{tt.CONTINUED.replace("'", "''")}|{tt.TITLE_ENDS})+$', ''), '^{tt.TITLE_ENDS}+', '')) AS normal FROM titles)"""
_TITLE_CLASS = " ".join(f"WHEN regexp_full_match(normal, '{p}') THEN '{name}'" for name, p in tt.BOILERPLATE)
_TITLE_EVIDENCE = " ".join(f"WHEN regexp_matches(regexp_replace(normal, '{tt.TABLE_PREFIX}', ''), '{p}') THEN '{name}'" for name, p in tt.EVIDENCE)


def _titles(spark, sf_dir):
    k, size, letter = F.col("p_partkey"), F.col("p_size").cast("string"), lambda first: F.chr(F.lit(first) + F.col("p_partkey") % 26)
    j = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    before = [F.lit(""), j(size, " "), j(size, ".", (k % 9 + 1).cast("string"), " "), j(size, "."), j(letter(65), ")"), j(letter(97), ". "), j("Chapter ", size, ": "), j("APPENDIX ", letter(65), " - "), j(" section ", size, ". "), j("Appendix A: ", size, ". "), j("Annex B) 4.", size, " - "), j("Table ", size, ". "), F.lit("  ")]
    after = ["", " (Continued)", " (cont.).", ":", " [CONT’D]", ": (continued) (Cont)", " -. "]
    phrase = F.when(F.col("p_size") % 6 == 0, F.col("p_name")).otherwise(F.get(F.array(*map(F.lit, _PHRASES)), (k % len(_PHRASES)).cast("int")))
    title = F.concat(F.get(F.array(*before), (k % 13).cast("int")), phrase, F.get(F.array(*map(F.lit, after)), (F.col("p_size") % 7).cast("int")))
    return table(spark, sf_dir, "part").select(k, title.alias("title"))


@register("f11_normal_title", f"WITH {_TITLE_ROWS} SELECT p_partkey, title, normal FROM normal")
def f11(spark, sf_dir):
    return _titles(spark, sf_dir).select("p_partkey", "title", tt.normal_title(F.col("title")).alias("normal"))


@register("f12_boilerplate_class", f"WITH {_TITLE_ROWS} SELECT p_partkey, CASE {_TITLE_CLASS} ELSE '' END AS category FROM normal")
def f12(spark, sf_dir):
    return _titles(spark, sf_dir).select("p_partkey", tt.boilerplate_class(F.col("title")).alias("category"))


@register("p28_marking_legend", f"WITH {_TITLE_ROWS} SELECT p_partkey, regexp_matches(normal, '{tt.MARKING_LEGEND}') AS legend FROM normal")
def p28(spark, sf_dir):
    return _titles(spark, sf_dir).select("p_partkey", tt.is_marking_legend(F.col("title")).alias("legend"))


@register("f25_evidence_class", f"WITH {_TITLE_ROWS} SELECT p_partkey, CASE WHEN regexp_matches(normal, '{tt.MARKING_LEGEND}') THEN NULL {_TITLE_EVIDENCE} END AS kind FROM normal")
def f25(spark, sf_dir):
    return _titles(spark, sf_dir).select("p_partkey", tt.evidence_class(F.col("title")).alias("kind"))


# Document titles: one for each rule, and two that name no family.
_NAMES = ["PSC3P5xD, PSC3M5xD 32-bit Arm Cortex-M33", "PIC16F882/883/884/886/887 Data Sheet", "1N4001, 1N4002, 1N4003 Rectifier", "LM111, LM211, LM311 Voltage Comparator", "ESP32 Series Datasheet", "BME280 Combined humidity and pressure sensor", "Series Resistance Measurement"]
_FAMILY = ["PSC3P5xD, PSC3M5xD", "PIC16F882/883/884/886/887", "1N4001, 1N4002, 1N4003", "LM111, LM211, LM311", "ESP32", None, None]
_RULE = ["wildcard", "slash-list", "list", "near-identical", "series", None, None]


# Titles of documents with part numbers made of the part's key and size, one form for each rule and one of none.
_FAMILY_ROWS = "named AS (SELECT p_partkey, p_name, p_partkey % 6 AS k, CAST(100 + p_partkey % 900 AS VARCHAR) AS n FROM part)"


@register("f22_f23_product_family", f"WITH {_FAMILY_ROWS} SELECT p_partkey, CASE k WHEN 0 THEN 'PSC' || n || 'xD' WHEN 1 THEN 'PIC16F' || n || '/' || n WHEN 2 THEN 'TPS' || n || 'A, TPS' || n || 'B' WHEN 3 THEN 'LM1' || n || ', LM2' || n WHEN 4 THEN 'ESP' || n END AS family, CASE k WHEN 0 THEN 'wildcard' WHEN 1 THEN 'slash-list' WHEN 2 THEN 'list' WHEN 3 THEN 'near-identical' WHEN 4 THEN 'series' END AS rule FROM named")
def f22(spark, sf_dir):
    k, n = F.col("p_partkey") % 6, (F.col("p_partkey") % 900 + 100).cast("string")
    j = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    forms = [j("PSC", n, "xD 32-bit Arm Cortex-M33"), j("PIC16F", n, "/", n, " Data Sheet rev2"), j("TPS", n, "A, TPS", n, "B Regulator LQFP48"), j("LM1", n, ", LM2", n, " Voltage Comparator"), j("ESP", n, " Series Datasheet"), j(F.col("p_name"), " Table2")]
    return table(spark, sf_dir, "part").select("p_partkey", tt.family(F.get(F.array(*forms), k.cast("int"))).alias("f")).select("p_partkey", "f.family", "f.rule")


@register("j07_token_pairs", "SELECT a.p_partkey, min(b.p_partkey) AS first_other, count(*) AS others FROM part a JOIN part b ON a.p_name[1:3] = b.p_name[1:3] AND a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey <> b.p_partkey GROUP BY 1")
def j07(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.substring("p_name", 1, 3).alias("k"), "p_brand", "p_type")
    # a group's least and next member and its size tell each member the rest, without pairs
    by = part.groupBy("k", "p_brand", "p_type").agg(F.array_sort(F.collect_set("p_partkey")).alias("s")).filter(F.size("s") > 1).select("k", "p_brand", "p_type", F.col("s")[0].alias("a"), F.col("s")[1].alias("b"), (F.size("s") - 1).cast("long").alias("others"))
    return part.join(by, ["k", "p_brand", "p_type"]).select("p_partkey", F.when(F.col("p_partkey") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("first_other"), "others")


# Body text made from line items: footnote marks, references and captions.
_BODY = "concat('See Figure ', l_linenumber, '-', l_suppkey % 9 + 1, ' and refer to Table ', l_partkey % 40, '. see Section ', l_linenumber, '.', l_suppkey % 5, ' for limits. ', l_linenumber, ') Note ', l_suppkey % 7, ' (', l_partkey % 30, ') x')"
_ITEM = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _bodies(spark, sf_dir):
    c, lit = F.col, F.lit
    body = F.concat(lit("See Figure "), c("l_linenumber"), lit("-"), c("l_suppkey") % 9 + 1, lit(" and refer to Table "), c("l_partkey") % 40, lit(". see Section "), c("l_linenumber"), lit("."), c("l_suppkey") % 5, lit(" for limits. "), c("l_linenumber"), lit(") Note "), c("l_suppkey") % 7, lit(" ("), c("l_partkey") % 30, lit(") x"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", body.alias("body"))


_N = "CAST(l_linenumber AS VARCHAR)"
_M = "l_partkey % 30"


@register("f15_footnote_marks", f"SELECT {_ITEM}, list_concat(list_concat(CASE WHEN {_M} BETWEEN 1 AND 29 AND {_M} <> l_linenumber THEN [{_N} || ')', ({_M}) || ')'] ELSE [{_N} || ')'] END, ['Note ' || l_suppkey % 7]), CASE WHEN {_M} <= 20 THEN ['(' || {_M} || ')'] ELSE [] END) AS marks FROM lineitem")
def f15(spark, sf_dir):
    return _bodies(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", tx.footnote_marks(F.col("body")).alias("marks"))


@register("f16_cross_references", f"SELECT {_ITEM}, ['figure', 'table', 'section'] AS types, ['Figure ' || l_linenumber || '-' || (l_suppkey % 9 + 1), 'Table ' || l_partkey % 40, l_linenumber || '.' || l_suppkey % 5] AS targets FROM lineitem")
def f16(spark, sf_dir):
    return _bodies(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", tx.cross_references(F.col("body")).alias("r")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("r.type").alias("types"), F.col("r.target").alias("targets"))


@register("f13_continued_tables", "SELECT p_partkey, ['Table ' || p_size || ' ' || p_name, 'Table ' || p_size || '-' || p_partkey || '  ' || p_brand] AS tables FROM part")
def f13(spark, sf_dir):
    first, second = F.concat(F.lit("Table "), F.col("p_size"), F.lit(" "), F.col("p_name")), F.concat(F.lit("Table "), F.col("p_size"), F.lit("-"), F.col("p_partkey"), F.lit("  "), F.col("p_brand"))
    text = F.concat(F.lit("x "), first, F.lit("  (Continued)\n"), second, F.lit(" (cont.) y\n"), first, F.lit("(continued)\nTable of contents (Continued)"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.continued_tables(text).alias("tables"))


@register("f14_boundary_titles", "SELECT p_partkey, CASE WHEN p_partkey % 7 < 5 THEN [p_name] ELSE [] END AS titles FROM part")
def f14(spark, sf_dir):
    before = F.repeat(F.lit("a line\n\n"), (F.col("p_partkey") % 7).cast("int"))
    page = F.concat(before, F.lit("  "), F.col("p_name"), F.lit(" (continued)\nlast line"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.boundary_titles(page).alias("titles"))


@register("f26_framed_text", "SELECT doc_id, '<document>' || chr(10) || regexp_replace(text, '(?i)<(/?document)', '&lt;\\1', 'g') || chr(10) || '</document>' AS framed FROM documents")
def f26(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.framed(F.col("text"), "document").alias("framed"))


@register("f27_needles_all", "SELECT d.doc_id, list_bool_and(list_transform(['the', 'of', 'in'], lambda n: contains(lower(text), n))) AS all_in FROM documents d")
def f27(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.contains_all(F.col("text"), F.array(*[F.lit(x) for x in ("the", "of", "in")])).alias("all_in"))


@register("k04_file_name", "SELECT page_id, regexp_replace(url, '[<>:\"/\\\\|?*]', '_', 'g')[1:200] AS name FROM pages")
def k04(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.file_name(F.col("url")).alias("name"))


@register("k05_unique_stems", "SELECT p_partkey, CASE WHEN rn = 1 THEN p_name ELSE p_name || '-' || rn END AS stem FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part)")
def k05(spark, sf_dir):
    from ..sources.files import unique_stems

    return unique_stems(table(spark, sf_dir, "part"), "p_name", "p_partkey").select("p_partkey", "stem")


@register("p24_path_terms", "SELECT page_id, lower(url) AS path FROM pages WHERE contains(lower(url), 'example') AND contains(lower(url), '/fr')")
def p24(spark, sf_dir):
    from ..sources.files import matching

    return matching(table(spark, sf_dir, "pages").withColumnRenamed("url", "relpath"), "Example  \\FR").select("page_id", F.lower("relpath").alias("path"))


@register("f37_url_checks", "SELECT page_id, regexp_matches(url, '^https?://') AS is_url, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, contains(html, '%PDF-') AS is_pdf FROM pages")
def f37(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.rlike("url", F.lit("^https?://")).alias("is_url"), F.parse_url("url", F.lit("HOST")).alias("host"), (F.instr("html", "%PDF-") > 0).alias("is_pdf"))


@register("f32_f33_key_parts", "SELECT c_custkey, split_part(c_name, '#', 1) AS component, split_part(c_name || '|' || c_mktsegment, '|', 2) AS engine FROM customer")
def f32(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.split_part("c_name", F.lit("#"), F.lit(1)).alias("component"), F.split_part(F.concat_ws("|", "c_name", "c_mktsegment"), F.lit("|"), F.lit(2)).alias("engine"))


@register("u05_ordered_distinct", "SELECT o_custkey, list_distinct(list(o_orderpriority)) IS NOT NULL AS has_any, list_sort(list_distinct(list(o_orderpriority))) AS kinds FROM orders GROUP BY 1")
def u05(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.array_distinct(F.collect_list("o_orderpriority"))).alias("kinds")).select("o_custkey", F.lit(True).alias("has_any"), "kinds")


@register("u06_subset_test", "SELECT l_orderkey, count(DISTINCT CASE WHEN l_returnflag IN ('A', 'N') THEN l_returnflag END) = 2 AS holds_both FROM lineitem GROUP BY 1")
def u06(spark, sf_dir):
    flags = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("s"))
    return flags.select("l_orderkey", (F.size(F.array_except(F.array(F.lit("A"), F.lit("N")), "s")) == 0).alias("holds_both"))


@register("p13_p14_withheld_fields", "SELECT c_custkey, c_name FROM customer")
def p14(spark, sf_dir):
    from ..operators.claims import visible

    return visible(table(spark, sf_dir, "customer"), ["c_custkey", "c_name"])


@register("p15_number_leak", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, regexp_matches(' ' || l_partkey || '.5 x ' || l_suppkey || ' ', '[^0-9]' || CAST(l_quantity AS INT) || '[^0-9]') AS leaks FROM lineitem")
def p15(spark, sf_dir):
    from ..operators.claims import leaks_number

    text = F.concat(F.lit(" "), F.col("l_partkey"), F.lit(".5 x "), F.col("l_suppkey"), F.lit(" "))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", leaks_number(text, F.col("l_quantity").cast("int").cast("string")).alias("leaks"))
