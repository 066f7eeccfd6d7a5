"""Queries over section trees; regions, nations and customers stand in for an outline of three levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import toc
from . import register

# An outline for each region: the region, its nations, their suppliers; pages rise with the place in it, with steps back and repeats.
_OUTLINE = """
WITH e AS (
  SELECT r_regionkey AS doc_id, 1 AS level, r_name AS title, -1 AS a, -1 AS b FROM region
  UNION ALL SELECT n_regionkey, 2, n_name, n_nationkey, -1 FROM nation
  UNION ALL SELECT n_regionkey, 3, concat(CAST(s_suppkey AS STRING), CASE WHEN s_suppkey % 3 = 0 THEN ' Ordering Information (Continued)' WHEN s_suppkey % 3 = 1 THEN ' Revision History' ELSE ' Section' END), n_nationkey, CAST(s_suppkey AS INT) FROM supplier JOIN nation ON s_nationkey = n_nationkey
), o AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a, b) AS seq, level, title FROM e
)
SELECT doc_id, seq, level, title, CASE WHEN seq % 17 = 0 THEN 0 ELSE CAST(floor((seq + (seq * 7) % 3) / 2) AS BIGINT) + 1 END AS start_page, CAST(40 AS BIGINT) AS total_pages FROM o
"""
_DUCK_OUTLINE = _OUTLINE.replace("AS STRING", "AS VARCHAR")

_TREE = f"""
v AS (SELECT * FROM ({_DUCK_OUTLINE}) WHERE start_page BETWEEN 1 AND total_pages),
p AS (SELECT x.*, (SELECT max(y.seq) FROM v y WHERE y.doc_id = x.doc_id AND y.seq < x.seq AND y.level < x.level) AS parent_seq FROM v x),
s AS (SELECT *, lead(start_page) OVER (PARTITION BY doc_id, parent_seq ORDER BY seq) AS nx FROM p),
t AS (
  SELECT doc_id, seq, level, title, start_page, total_pages, parent_seq, 1 AS depth, trim(title) AS breadcrumb,
         greatest(coalesce(nx - 1, total_pages), start_page) AS end_page FROM s WHERE parent_seq IS NULL
  UNION ALL
  SELECT s.doc_id, s.seq, s.level, s.title, s.start_page, s.total_pages, s.parent_seq, t.depth + 1, t.breadcrumb || ' > ' || trim(s.title),
         greatest(coalesce(s.nx - 1, t.end_page), s.start_page) FROM s JOIN t ON s.doc_id = t.doc_id AND s.parent_seq = t.seq
)"""


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    for table in ("region", "nation", "supplier"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(f"ql_{table}")
    sql = _OUTLINE
    for table in ("region", "nation", "supplier"):
        sql = sql.replace(f"FROM {table}", f"FROM ql_{table}").replace(f"JOIN {table}", f"JOIN ql_{table}")
    return spark.sql(sql)


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.with_breadcrumbs(toc.with_ids(toc.with_end_pages(toc.with_parents(toc.valid_entries(outline(spark, sf_dir))))))


@register("s05_outline_scan", f"SELECT * FROM ({_DUCK_OUTLINE})")
def s05(spark, sf_dir):
    return outline(spark, sf_dir)


@register("p01_p02_valid_entries", f"SELECT doc_id, seq, level, title, start_page FROM ({_DUCK_OUTLINE}) WHERE start_page BETWEEN 1 AND total_pages")
def p02(spark, sf_dir):
    return toc.valid_entries(outline(spark, sf_dir)).select("doc_id", "seq", "level", "title", "start_page")


@register("w01_parents", f"WITH RECURSIVE {_TREE} SELECT doc_id, seq, level, parent_seq, depth FROM t")
def w01(spark, sf_dir):
    return toc.with_parents(toc.valid_entries(outline(spark, sf_dir))).select("doc_id", "seq", "level", "parent_seq", "depth")


@register("w02_end_pages", f"WITH RECURSIVE {_TREE} SELECT doc_id, seq, start_page, end_page FROM t")
def w02(spark, sf_dir):
    return _tree(spark, sf_dir).select("doc_id", "seq", "start_page", "end_page")


@register("w03_node_ids", f"WITH RECURSIVE {_TREE} SELECT doc_id, seq, printf('%04d', row_number() OVER (PARTITION BY doc_id ORDER BY seq)) AS node_id FROM t")
def w03(spark, sf_dir):
    return _tree(spark, sf_dir).select("doc_id", "seq", "node_id")


@register("w04_breadcrumbs", f"WITH RECURSIVE {_TREE} SELECT doc_id, seq, breadcrumb FROM t")
def w04(spark, sf_dir):
    return _tree(spark, sf_dir).select("doc_id", "seq", "breadcrumb")


_CLASS = "CASE WHEN level = 3 AND regexp_matches(title, 'Ordering Information') THEN 'ordering' WHEN level = 3 AND regexp_matches(title, 'Revision History') THEN 'revision' ELSE '' END"


@register("w05_inherited_class", f"WITH RECURSIVE {_TREE} SELECT doc_id, seq, {_CLASS} AS boilerplate_category FROM t")
def w05(spark, sf_dir):
    return toc.with_classes(_tree(spark, sf_dir)).select("doc_id", "seq", "boilerplate_category")


@register("w05_family_class", f"WITH RECURSIVE {_TREE} SELECT doc_id, seq, CASE WHEN doc_id % 2 = 0 AND {_CLASS} = 'ordering' THEN '' ELSE {_CLASS} END AS boilerplate_category FROM t")
def w05_family(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    return toc.with_classes(tree, families=tree.filter("doc_id % 2 = 0").select("doc_id")).select("doc_id", "seq", "boilerplate_category")


@register("w06_flat_order", f"WITH RECURSIVE {_TREE} SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS place, title FROM t")
def w06(spark, sf_dir):
    return _tree(spark, sf_dir).select("doc_id", "seq", F.col("node_id").cast("long").alias("place"), "title")


_TABLES = "SELECT n_regionkey AS doc_id, CAST(c_custkey % 40 AS BIGINT) + 1 AS page, CAST(count(*) AS BIGINT) AS table_count FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY 1, 2"


def _page_tables(spark, sf_dir):
    customer, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation"))
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("doc_id"), (F.col("c_custkey") % 40 + 1).alias("page")).agg(F.count(F.lit(1)).alias("table_count"))


@register("a07_tables_by_page", _TABLES.format(customer="customer", nation="nation"))
def a07(spark, sf_dir):
    return _page_tables(spark, sf_dir)


@register("j01_tables_in_sections", f"WITH RECURSIVE {_TREE}, pt AS ({_TABLES.format(customer='customer', nation='nation')}) SELECT t.doc_id, t.seq, CAST(coalesce(sum(pt.table_count), 0) AS BIGINT) AS table_count FROM t LEFT JOIN pt ON pt.doc_id = t.doc_id AND pt.page BETWEEN t.start_page AND t.end_page GROUP BY 1, 2")
def j01(spark, sf_dir):
    return toc.sum_over_ranges(_tree(spark, sf_dir), _page_tables(spark, sf_dir), "table_count").select("doc_id", "seq", "table_count")


@register("j02_deepest_section", f"WITH RECURSIVE {_TREE}, g AS (SELECT t.doc_id, pg AS page, breadcrumb, row_number() OVER (PARTITION BY t.doc_id, pg ORDER BY level DESC, seq) AS rn FROM t, generate_series(1, 40) q(pg) WHERE pg BETWEEN start_page AND end_page) SELECT doc_id, page, breadcrumb FROM g WHERE rn = 1")
def j02(spark, sf_dir):
    return toc.deepest_for_page(_tree(spark, sf_dir))


@register("j05_containment", f"WITH RECURSIVE {_TREE}, a AS (SELECT * FROM t WHERE level = 2) SELECT x.doc_id, x.seq FROM t x WHERE x.level = 3 AND EXISTS (SELECT 1 FROM a WHERE a.doc_id = x.doc_id AND a.start_page <= x.start_page AND x.end_page <= a.end_page)")
def j05(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    outer = tree.filter("level = 2").select("doc_id", F.col("start_page").alias("a"), F.col("end_page").alias("b"))
    inner = tree.filter("level = 3")
    return inner.join(outer, (inner.doc_id == outer.doc_id) & (F.col("a") <= F.col("start_page")) & (F.col("end_page") <= F.col("b")), "left_semi").select("doc_id", "seq")


@register("a62_leaf_sections", f"WITH RECURSIVE {_TREE} SELECT doc_id, seq, start_page, end_page FROM t WHERE start_page <= end_page AND NOT EXISTS (SELECT 1 FROM t c WHERE c.doc_id = t.doc_id AND c.parent_seq = t.seq)")
def a62(spark, sf_dir):
    return toc.leaves(_tree(spark, sf_dir)).select("doc_id", "seq", "start_page", "end_page")


_QUALITY = f"""WITH RECURSIVE {_TREE},
cov AS (SELECT t.doc_id, count(DISTINCT pg) AS covered FROM t, generate_series(1, 40) q(pg) WHERE pg BETWEEN start_page AND end_page GROUP BY 1),
q AS (SELECT doc_id, count(*) AS n, max(level) AS d, max(total_pages) AS pages, avg(CASE WHEN length(trim(title)) >= 3 AND NOT regexp_full_match(trim(title), '[0-9.]+') THEN 1.0 ELSE 0.0 END) AS good,
      count(DISTINCT regexp_replace(trim(regexp_replace(breadcrumb, '\\s+', ' ', 'g')), '[0-9]+', '#', 'g')) AS k FROM t GROUP BY 1),
z AS (SELECT doc_id, n, d, k, least(1.0, covered / pages) AS c, (0.3 * CASE WHEN n < 3 THEN .2 WHEN n <= 5 THEN .6 WHEN n <= 30 THEN 1.0 WHEN n <= 60 THEN .7 ELSE .4 END + 0.3 * least(1.0, covered / pages) + 0.2 * CASE WHEN d >= 3 THEN 1.0 WHEN d = 2 THEN .7 ELSE .3 END + 0.2 * good) * k / n AS score FROM q JOIN cov USING (doc_id))
SELECT doc_id, n AS entry_count, d AS max_depth, round(c, 3) AS page_coverage, round(score, 3) AS score, round(score, 3) < 0.5 OR n > 40 AS recommend_summaries FROM z"""


@register("a03_a04_toc_quality", _QUALITY)
def a03(spark, sf_dir):
    return toc.quality(_tree(spark, sf_dir))


@register("m16_candidate_accepted", f"WITH z AS ({_QUALITY}) SELECT doc_id, score, score > 0.3 AS accepted FROM z")
def m16(spark, sf_dir):
    return toc.quality(_tree(spark, sf_dir)).select("doc_id", "score", toc.accepts(F.lit(0.3), F.col("score")).alias("accepted"))


@register("p12_slim_manifest", f"WITH RECURSIVE {_TREE} SELECT doc_id, seq, title, start_page, end_page, nullif(seq % 3, 0) AS table_count FROM t")
def p12(spark, sf_dir):
    return _tree(spark, sf_dir).withColumn("table_count", F.nullif(F.col("seq") % 3, F.lit(0))).select("doc_id", "seq", "title", "start_page", "end_page", "table_count")
