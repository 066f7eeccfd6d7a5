"""Queries over readings: events are channels of experiments (users), line items claims with measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sensors as s
from . import register, table

# rounded far below what counts, so that both engines give the same doubles
_STATS = "count(value) AS n, round(avg(value), 8) AS mean, round(coalesce(stddev_samp(value), 0), 8) AS std, min(value) AS least, max(value) AS most, round(quantile_cont(value, .5), 8) AS median, round(quantile_cont(value, .05), 8) AS p05, round(quantile_cont(value, .95), 8) AS p95"


@register("a49_a50_statistics", f"SELECT user_id, event_type, {_STATS} FROM events GROUP BY 1, 2")
def a49(spark, sf_dir):
    found = s.statistics(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value")
    return found.withColumns({c: F.round(c, 8) for c in ("mean", "std", "median", "p05", "p95")})


@register("p25_time_window", "SELECT event_id FROM events WHERE value BETWEEN 10 AND 20")
def p25(spark, sf_dir):
    return s.in_window(table(spark, sf_dir, "events"), "value", 10.0, 20.0).select("event_id")


@register("a51_varied_actuators", "SELECT o_custkey, count(*) AS rows, CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'o_orderstatus' ELSE '' END || CASE WHEN count(DISTINCT o_orderstatus) > 1 AND count(DISTINCT o_orderpriority) > 1 THEN ',' ELSE '' END || CASE WHEN count(DISTINCT o_orderpriority) > 1 THEN 'o_orderpriority' ELSE '' END AS varied FROM orders GROUP BY 1")
def a51(spark, sf_dir):
    return s.varied(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"]).withColumn("varied", F.array_join("varied", ","))


@register("a52_cross_sensor", "WITH x AS (SELECT l_orderkey AS k, l_quantity AS a, l_extendedprice / 1000 AS b, l_quantity + l_discount * 10 AS c FROM lineitem), y AS (SELECT *, (a + b + c) / 3 AS m FROM x) SELECT k, count(*) AS n, avg(a - (b + c) / 2) AS \"offset\", coalesce(stddev_samp(a - (b + c) / 2), 0) AS sigma, avg(sqrt(((a - m) * (a - m) + (b - m) * (b - m) + (c - m) * (c - m)) / 2)) AS spread FROM y GROUP BY 1")
def a52(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"), (F.col("l_quantity") + F.col("l_discount") * 10).alias("c"))
    return s.cross_check(rows, "k", ["a", "b", "c"])


_READINGS = "r AS (SELECT user_id AS k, event_id AS t, CAST(floor(value / 40) AS DOUBLE) AS act, value FROM events)"


def _readings(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("t"), F.floor(F.col("value") / 40).cast("double").alias("act"), "value")


@register("w09_steady_state", f"WITH {_READINGS}, m AS (SELECT *, coalesce(stddev_samp(act) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) < greatest(1e-6, 0.01 * (max(act) OVER (PARTITION BY k) - min(act) OVER (PARTITION BY k))), false) AS ok FROM r), e AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY k) >= 10 AS enough FROM m) SELECT k, t FROM e WHERE ok OR NOT enough")
def w09(spark, sf_dir):
    return s.steady(_readings(spark, sf_dir), "k", "t", "act", 10).select("k", "t")


@register("a54_std_of_std", f"WITH {_READINGS}, h AS (SELECT *, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY t) <= floor(count(*) OVER (PARTITION BY k) / 2) AS first_half FROM r) SELECT k, CASE WHEN max(n) < 4 THEN 0 ELSE abs(stddev_samp(value) FILTER (WHERE first_half) - stddev_samp(value) FILTER (WHERE NOT first_half)) / sqrt(2) END AS std_of_std FROM h GROUP BY 1")
def a54(spark, sf_dir):
    return s.std_of_std(_readings(spark, sf_dir), "k", "t", "value")


@register("a53_combined_uncertainty", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sqrt(l_tax * l_tax + l_discount * l_discount + 0.01 * 0.01) AS u FROM lineitem")
def a53(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", s.combined(F.col("l_tax"), F.col("l_discount"), F.lit(0.01)).alias("u"))


@register("p27_m03_conditions", f"WITH {_READINGS} SELECT k, bool_and(value BETWEEN 1 - 1e-6 AND 300 + 1e-6) AS met FROM r GROUP BY 1")
def p27(spark, sf_dir):
    return _readings(spark, sf_dir).groupBy("k").agg(s.holds(F.col("value"), F.lit(None).cast("double"), F.lit(1.0), F.lit(300.0)).alias("met"))


@register("a55_a56_measurements", f"WITH {_READINGS} SELECT k, avg(value) AS mean_offset, coalesce(stddev_samp(value), 0) AS precision FROM r GROUP BY 1")
def a55(spark, sf_dir):
    return s.statistics(_readings(spark, sf_dir), ["k"], "value").select("k", F.col("mean").alias("mean_offset"), F.col("std").alias("precision"))


# A part claims its retail price; the measurement is the mean unit price of its line items.
_CLAIMS = "m AS (SELECT l_partkey, avg(l_extendedprice / l_quantity) AS measured, coalesce(stddev_samp(l_extendedprice / l_quantity), 0) / sqrt(count(*)) AS sigma FROM lineitem GROUP BY 1), x AS (SELECT p_partkey, measured, sigma, p_size * 20.0 AS tol, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END AS claimed, p_retailprice * 0.8 AS lo, p_retailprice * 1.6 AS hi, p_partkey % 11 = 0 AS stub FROM part JOIN m ON l_partkey = p_partkey), y AS (SELECT *, sqrt(sigma * sigma + tol * tol + 1) AS u, greatest(lo - measured, measured - hi, 0) AS outside FROM x)"


def _claims(spark, sf_dir):
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.avg(unit).alias("measured"), (F.coalesce(F.stddev_samp(unit), F.lit(0.0)) / F.sqrt(F.count(F.lit(1)))).alias("sigma"))
    price = F.col("p_retailprice")
    return table(spark, sf_dir, "part").join(m, "p_partkey").select("p_partkey", "measured", "sigma", (F.col("p_size") * 20.0).alias("tol"), F.when(F.col("p_partkey") % 2 == 0, price).alias("claimed"), (price * 0.8).alias("lo"), (price * 1.6).alias("claimed_max"), (F.col("p_partkey") % 11 == 0).alias("stub"))


def _verdict():
    return s.verdict(*[F.col(x) for x in ("measured", "sigma", "tol")], F.lit(1.0), F.col("lo"), F.col("claimed_max"), F.col("claimed"), F.col("stub"), F.lit(False))


@register("m01_m02_verdicts", f"WITH {_CLAIMS} SELECT p_partkey, CASE WHEN stub THEN 'inconclusive' WHEN claimed IS NULL THEN CASE WHEN outside = 0 THEN 'pass' WHEN outside <= u THEN 'inconclusive' ELSE 'fail' END WHEN sigma > tol THEN 'inconclusive' WHEN abs(measured - claimed) <= tol THEN 'pass' WHEN abs(measured - claimed) <= u THEN 'inconclusive' ELSE 'fail' END AS verdict FROM y")
def m02(spark, sf_dir):
    return _claims(spark, sf_dir).select("p_partkey", _verdict().alias("verdict"))


@register("w17_bound_sweep", f"WITH {_CLAIMS}, z AS (SELECT y.*, k, hi * (0.5 + 0.7 * k / 20.0) AS h FROM y, range(0, 21) q(k) WHERE claimed IS NULL AND NOT stub), v AS (SELECT k, CASE WHEN greatest(lo - measured, measured - h, 0) = 0 THEN 'pass' WHEN greatest(lo - measured, measured - h, 0) <= u THEN 'inconclusive' ELSE 'fail' END AS verdict FROM z) SELECT CAST(k AS BIGINT) AS k, verdict, count(*) AS claims FROM v GROUP BY 1, 2")
def w17(spark, sf_dir):
    ranged = _claims(spark, sf_dir).filter("claimed IS NULL AND NOT stub")
    return s.sweep(ranged, 0.5, 1.2).select(F.col("k").cast("long").alias("k"), _verdict().alias("verdict")).groupBy("k", "verdict").agg(F.count(F.lit(1)).alias("claims"))


@register("m20_graph_listing", "SELECT n_regionkey, list_sort(list(n_nationkey)) AS nations FROM nation GROUP BY 1")
def m20(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("nations"))
