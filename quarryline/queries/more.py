"""Queries over downloads, part numbers, options, model hooks and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import titles as tt
from ..plans import enrich, options
from ..sources import pdf, render
from . import register, table
from .layouts import _IMAGES, _images


@register("s02_download_checks", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'not a PDF by its type' WHEN 1 THEN 'empty' WHEN 2 THEN 'not a PDF by its content' END AS problem FROM pages")
def s02(spark, sf_dir):
    k = F.col("page_id") % 4
    content = F.when(k == 1, F.lit(b"")).when(k == 2, F.col("html").cast("binary")).otherwise(F.concat(F.lit(b"%PDF-1.7 "), F.col("html").cast("binary")))
    return table(spark, sf_dir, "pages").select("page_id", pdf.problem(content, F.when(k == 0, "text/html").otherwise("application/pdf"), F.col("url")).alias("problem"))


_QUERIES = ["ADS1115", "ADS111x", "1N4002", "1N4009", "LM311", "voltage"]
_FAMILIES = ["ADS111x", "ADS111x", "1N4001, 1N4002, 1N4003", "1N4001, 1N4002", "LM111, LM211, LM311", "LM111, LM211"]
_EXACT = [True, False, True, True, True, False]


@register("p26_exact_part_query", "SELECT p_partkey, p_partkey % 6 IN (0, 2, 3, 4) AS exact FROM part")
def p26(spark, sf_dir):
    from .texts import _pick

    k = F.col("p_partkey") % 6
    return table(spark, sf_dir, "part").select("p_partkey", tt.is_exact_part(_pick(_QUERIES, k), _pick(_FAMILIES, k)).alias("exact"))


@register("p09_option_key", "SELECT c_custkey, lower(trim(CASE c_custkey % 6 WHEN 0 THEN '0' WHEN 1 THEN ' FALSE ' WHEN 2 THEN 'no' WHEN 3 THEN 'Off' WHEN 4 THEN c_mktsegment END)) NOT IN ('0', 'false', 'no', 'off') OR c_custkey % 6 = 5 AS switched_on FROM customer")
def p09(spark, sf_dir):
    words = F.get(F.array(*map(F.lit, ["0", " FALSE ", "no", "Off"])), (F.col("c_custkey") % 6).cast("int"))
    value = F.when(F.col("c_custkey") % 6 == 4, F.col("c_mktsegment")).when(F.col("c_custkey") % 6 < 4, words)
    return table(spark, sf_dir, "customer").select("c_custkey", options.is_on(value).alias("switched_on"))


# A stand-in for a model: it answers with the first two words of what it is asked, and with entries of pages that it makes up in part.
@register("x07_model_summaries", "SELECT doc_id, doc_id AS seq, CASE WHEN doc_id % 3 = 0 THEN NULLIF(trim(array_to_string(string_split(text, ' ')[1:2], ' ')), '') END AS summary FROM documents")
def x07_summaries(spark, sf_dir):
    sections = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("seq"), F.col("text").alias("section_text"))
    wanted = sections.select("doc_id", (F.col("doc_id") % 3 == 0).alias("recommend_summaries"))
    found = enrich.summarised(sections, lambda asked: [" ".join(x.split(" ")[:2]) for x in asked], wanted)
    return found.select("doc_id", "seq", "summary")


@register("x07_model_outline", "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, title) AS seq, 1 AS level, title, page AS start_page FROM (SELECT o_orderkey AS doc_id, p.page, 'A ' || p.page AS title FROM orders, (SELECT unnest([1, 2]) AS page) p WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 2, 'B 2' FROM orders WHERE o_orderkey % 5 = 0)")
def x07_outline(spark, sf_dir):
    import json

    def ask(chunks: list[str]) -> list[str]:
        # 'A 1' and 'A 2' stand on pages of the chunk, 'B 2' is said twice, page 7 has no mark, page 9 lies past the end
        return ["Here:\n" + json.dumps([{"level": 1, "title": t, "page": p} for t, p in (("A 1", 1), ("A 2", 2), ("B 2", 2), ("B 2", 2), ("C", 7), ("D", 9))]) for _ in chunks]

    chunks = table(spark, sf_dir, "orders").filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("chunk"), F.lit("--- PAGE 1 ---\na\n--- PAGE 2 ---\nb\n--- PAGE 9 ---").alias("text"), F.lit(8).alias("total_pages"))
    return enrich.outlined(chunks, ask).select("doc_id", "seq", "level", "title", "start_page")


@register("x06_x07_model_captions", f"WITH i AS ({_IMAGES}), q AS (SELECT *, CASE WHEN xref = 0 THEN -seq ELSE xref END AS picture FROM i) SELECT doc_id, seq, coalesce(caption, 'picture ' || doc_id || '/' || picture) AS caption FROM q")
def x07(spark, sf_dir):
    from ..operators.layout import rasters

    figures = rasters(_images(spark, sf_dir))
    return enrich.captioned(figures, lambda asked: [f"picture {a}" for a in asked], 1000).select("doc_id", "seq", "caption")


@register("k10_report", """WITH r AS (SELECT n_nationkey, n_name, count(c_custkey) AS customers, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT 'markdown' AS form, k + 1 AS line, '| ' || n_nationkey || ' | ' || n_name || ' | ' || customers || ' |' AS body FROM r UNION ALL SELECT 'latex', k + 1, n_nationkey || ' & ' || replace(n_name, '_', '\\_') || ' & ' || customers || ' \\\\' FROM r
UNION ALL VALUES ('markdown', 0, '| n_nationkey | n_name | customers |'), ('markdown', 1, '| --- | --- | --- |'), ('latex', 0, '\\begin{tabular}{lll}'), ('latex', 1, 'n\\_nationkey & n\\_name & customers \\\\')
UNION ALL SELECT 'latex', max(k) + 2, '\\end{tabular}' FROM r""")  # fmt: skip
def k10(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    rows = table(spark, sf_dir, "nation").join(customers, "n_nationkey", "left").select("n_nationkey", "n_name", F.coalesce("customers", F.lit(0)).alias("customers")).orderBy("n_nationkey")
    found = [(form, k, body) for form, text in (("markdown", render.markdown(rows)), ("latex", render.latex(rows))) for k, body in enumerate(text.split("\n"))]
    return spark.createDataFrame(found, "form string, line long, body string")


@register("f35_outline_replies", "SELECT p_partkey, [p_name] AS titles, [p_size] AS pages FROM part")
def f35(spark, sf_dir):
    from ..functions.replies import outline_entries

    c, lit = F.col, F.lit
    reply = F.concat(lit('Sure:\n```json\n[{"level": "0", "title": " '), c("p_name"), lit(' ", "page": "'), c("p_size"), lit('"}, {"level": 2, "title": "", "page": 3}, {"title": "x", "page": "?"}]\n```'))
    return table(spark, sf_dir, "part").select("p_partkey", outline_entries(reply).alias("e")).select("p_partkey", F.col("e.title").alias("titles"), F.col("e.page").alias("pages"))


@register("m19_cut_notes", "SELECT doc_id, CASE WHEN length(text) > 500 THEN '=== NOTE: 500 of ' || length(text) || ' characters are shown (limit 500) ===' END AS note FROM documents")
def m19(spark, sf_dir):
    from ..functions.replies import cut_note

    n = F.length("text")
    return table(spark, sf_dir, "documents").select("doc_id", cut_note(F.least(n, F.lit(500)), n, 500).alias("note"))


@register("p11_range_checks", "SELECT o_orderkey, o_orderkey % 9 BETWEEN 1 AND 7 AND o_orderkey % 11 <> 0 AS valid FROM orders")
def p11(spark, sf_dir):
    from ..operators.reads import valid_range

    first, last = F.col("o_orderkey") % 9, F.col("o_orderkey") % 9 + F.when(F.col("o_orderkey") % 11 == 0, -1).otherwise(1)
    return table(spark, sf_dir, "orders").select("o_orderkey", valid_range(first, last, F.lit(8)).alias("valid"))


@register("s09_s11_claim_file", "SELECT 'c' || n_nationkey AS id, n_name AS component FROM nation")
def s09(spark, sf_dir):
    import json
    import tempfile
    from pathlib import Path

    from ..sources.claims_file import read

    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("a claim file is read by the driver and has at most 1000 claims")
    with tempfile.TemporaryDirectory() as folder:  # of the driver alone, which reads it at once
        path = Path(folder) / "claims.json"
        path.write_text(json.dumps([{"id": f"c{r['n_nationkey']}", "component": r["n_name"]} for r in rows]))
        return read(spark, path).select("id", "component")
