"""Queries over run records and traces; line items make the cells, events and conversations the traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells as c
from ..operators import claims, gates, reports
from ..operators import grading as g
from ..operators import stats as st
from ..operators import traces as tr
from . import register, table, view

# Cells by claim, engine, model and repeat; all values come from sums of whole quantities.
CELLS = """
SELECT claim_id, engine, model, repeat, n, q, q % 10 < 8 AS overall_pass, q % 10 < 9 AS found_correct, q % 5 <> 0 AS found_expected, q % 7 <> 0 AS value_pass, CAST(0.5 AS DOUBLE) + CAST(q % 50 AS DOUBLE) / 100 AS confidence, CAST(q AS DOUBLE) / 10 AS latency_s,
       CASE WHEN q % 13 = 0 THEN 'all pods are down' WHEN q % 17 = 0 THEN 'timeout' ELSE '' END AS engine_error, CASE WHEN q % 19 = 0 THEN 'not_applicable' ELSE 'ok' END AS status,
       CASE q % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'pass' WHEN 2 THEN 'inconclusive' ELSE 'fail' END AS verdict, q * 100 AS input_tokens, n * 10 AS output_tokens
FROM (SELECT l_partkey % 25 AS claim_id, l_linestatus AS engine, l_returnflag AS model, l_linenumber % 3 + 1 AS repeat, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2, 3, 4) x
"""
_C = f"cells AS ({CELLS})"
_OK = "coalesce(engine_error, '') = '' AND overall_pass"


def cells(spark, sf_dir):
    return view(spark, sf_dir, CELLS)


def _runs(spark, sf_dir):
    all_cells = cells(spark, sf_dir)
    return all_cells.filter("repeat = 1"), all_cells.filter("repeat = 2")


@register("p17_p18_clean_cells", f"WITH {_C} SELECT claim_id, engine, model, repeat, {_OK} AS clean FROM cells")
def p17(spark, sf_dir):
    return cells(spark, sf_dir).select("claim_id", "engine", "model", "repeat", c.passed().alias("clean"))


@register("p19_p21_ok_cells", f"WITH {_C} SELECT claim_id, engine, model, repeat FROM cells WHERE status = 'ok' AND engine_error = ''")
def p19(spark, sf_dir):
    return c.ok_cells(cells(spark, sf_dir)).select("claim_id", "engine", "model", "repeat")


@register("p20_headline_claims", f"WITH {_C} SELECT claim_id, model, repeat FROM cells WHERE engine = 'O' AND starts_with(CAST(claim_id AS VARCHAR), '1')")
def p20(spark, sf_dir):
    return cells(spark, sf_dir).filter((F.col("engine") == "O") & F.startswith(F.col("claim_id").cast("string"), F.lit("1"))).select("claim_id", "model", "repeat")


@register("p22_p23_outages", f"WITH {_C} SELECT engine, model, CAST(sum(CASE WHEN engine_error LIKE '%all pods are down%' THEN 1 ELSE 0 END) AS BIGINT) AS outages FROM cells GROUP BY 1, 2")
def p22(spark, sf_dir):
    return cells(spark, sf_dir).groupBy("engine", "model").agg(F.count_if(c.outage()).alias("outages"))


# The cells with what the gates read besides: protocol errors, measured values, steps, calls and errors of two tools.
_GATED = f"gated AS (SELECT *, CASE WHEN q % 29 = 0 THEN 'no data' END AS repro_error, CASE WHEN q % 23 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(q AS DOUBLE) END AS measured_value, CASE WHEN q % 2 = 0 THEN 'Stub' ELSE 'typical' END AS sigma_basis, n % 60 AS n_steps, q % 3 AS n_read, q % 2 AS n_verify, CASE WHEN q % 5 = 0 THEN 1 ELSE 0 END AS n_bad FROM cells), now AS (SELECT * FROM gated WHERE repeat = 2), base AS (SELECT * FROM gated WHERE repeat = 1)"


def gated(spark, sf_dir):
    rows = view(spark, sf_dir, f"WITH {_C}, {_GATED.split(', now AS')[0]} SELECT * FROM gated")
    calls = F.map_from_arrays(F.array(F.lit("get_section_text"), F.lit("search_text")), F.array(F.col("n_read").cast("int"), F.col("n_verify").cast("int")))
    return rows.withColumn("n_tool_calls_by_tool", calls).withColumn("n_tool_errors_by_tool", F.create_map(F.lit("search_text"), F.col("n_bad").cast("int")))


def _gates(spark, sf_dir):
    rows = gated(spark, sf_dir)
    now = rows.filter("repeat = 2")
    early = now.filter("engine = 'O' AND q % 4 <> 0").select("model", (F.col("q") % 6).alias("early_calls"))
    return gates.gate_rows(now, rows.filter("repeat = 1"), early, agentic="O")


_GATE_ROWS = f"""WITH {_C}, {_GATED},
own AS (SELECT model, coalesce(avg(CASE WHEN found_correct THEN 1.0 ELSE 0.0 END) FILTER (WHERE engine = 'O'), 0) AS H1_found_accuracy, coalesce(avg(CASE WHEN value_pass THEN 1.0 ELSE 0.0 END) FILTER (WHERE engine = 'O' AND found_expected), 1) AS H2_value_accuracy,
  count(*) FILTER (WHERE engine_error <> '') AS H4_engine_errors, count(*) FILTER (WHERE repro_error IS NOT NULL OR (isnan(measured_value) AND sigma_basis <> 'Stub')) AS H5_protocol_errors, coalesce(avg(CASE WHEN verdict = 'inconclusive' THEN 1.0 ELSE 0.0 END) FILTER (WHERE engine = 'O'), 0) AS S1_inconclusive_rate,
  sum(n_bad) FILTER (WHERE engine = 'O') / nullif(sum(n_verify) FILTER (WHERE engine = 'O'), 0) AS search_rate, sum(n_read) FILTER (WHERE engine = 'O') AS reads, avg(confidence) AS S3_mean_confidence, coalesce(avg(n_steps) FILTER (WHERE engine = 'O'), 0) AS S4_mean_trace_length,
  count(*) FILTER (WHERE engine = 'O' AND overall_pass AND (n_read + n_verify = 0 OR n_verify = 0)) AS S9_silent_failures, avg(CASE WHEN q % 6 > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE engine = 'O' AND q % 4 <> 0) AS S8_contamination_rate FROM now GROUP BY 1),
pair AS (SELECT model, claim_id, engine, b.verdict AS bv, n.verdict AS nv, b.status AS bs, b.q AS bq, n.q AS nq, n.engine_error <> '' AS broke FROM base b FULL JOIN now n USING (model, claim_id, engine)),
ch AS (SELECT model, count(*) FILTER (WHERE engine = 'O' AND bv IN ('pass', 'inconclusive') AND nv = 'fail') AS H3_regressions, count(*) FILTER (WHERE bs = 'ok' AND (broke OR (bv IN ('pass', 'inconclusive') AND nv = 'fail'))) AS H6_model_regressions,
  count(*) FILTER (WHERE engine = 'O' AND ((bv = 'pass' AND nv = 'inconclusive') OR (bv = 'inconclusive' AND nv = 'pass'))) AS S5_verdict_drift, count(*) FILTER (WHERE engine = 'O' AND (bq IS NULL OR nq IS NULL)) AS S6_coverage_gap, count(*) FILTER (WHERE bs = 'not_applicable' AND NOT broke) AS S7_improvements FROM pair GROUP BY 1),
wide AS (SELECT *, CASE WHEN search_rate IS NOT NULL THEN search_rate WHEN reads > 0 THEN 0 END AS S2_tool_error_rate FROM own LEFT JOIN ch USING (model)),
g AS ({" UNION ALL ".join(f"SELECT model, '{name}' AS gate, {str(hard).lower()} AS hard, CAST({name} AS DOUBLE) AS value, coalesce({name} {'<' if side == 'below' else '>'} {bound}, false) AS failed FROM wide" for name, hard, side, bound in gates.GATES)})"""


@register("a08_a14_gates", f"{_GATE_ROWS} SELECT model, gate, hard, value, failed FROM g")
def a08(spark, sf_dir):
    return _gates(spark, sf_dir).select("model", "gate", "hard", "value", "failed")


@register("a14_gate_outcome", f"{_GATE_ROWS} SELECT model, coalesce(string_agg(gate, ',' ORDER BY gate) FILTER (WHERE hard AND failed), '') AS hard_failures, coalesce(string_agg(gate, ',' ORDER BY gate) FILTER (WHERE NOT hard AND failed), '') AS warnings, CASE WHEN bool_or(hard AND failed) THEN 1 WHEN bool_or(failed) THEN 2 ELSE 0 END AS exit_code FROM g GROUP BY 1")
def a14(spark, sf_dir):
    return gates.outcome(_gates(spark, sf_dir)).select("model", F.array_join("hard_failures", ",").alias("hard_failures"), F.array_join("warnings", ",").alias("warnings"), "exit_code")


_STATS = ", ".join(f"{f}({x}) AS {x}_{n}" for x in ("passes", "confidence", "latency", "errors") for n, f in (("mean", "avg"), ("std", "stddev_samp")))


@register("a15_a30_repeat_variance", f"WITH {_C}, r AS (SELECT model, repeat, sum(CASE WHEN {_OK} THEN 1 ELSE 0 END) AS passes, avg(confidence) AS confidence, avg(latency_s) AS latency, sum(CASE WHEN engine_error <> '' THEN 1 ELSE 0 END) AS errors FROM cells GROUP BY 1, 2) SELECT model, count(*) AS repeats, {_STATS} FROM r GROUP BY 1")
def a15(spark, sf_dir):
    return c.variance(cells(spark, sf_dir))


@register("a16_claim_stability", f"WITH {_C}, e AS (SELECT model, claim_id, min(CASE WHEN {_OK} THEN 1 ELSE 0 END) = max(CASE WHEN {_OK} THEN 1 ELSE 0 END) AS stable FROM cells GROUP BY 1, 2) SELECT model, count(*) AS claims, CAST(sum(CASE WHEN stable THEN 1 ELSE 0 END) AS BIGINT) AS stable FROM e GROUP BY 1")
def a16(spark, sf_dir):
    return c.stability(cells(spark, sf_dir)).drop("flipped")


@register("a18_a19_a20_calibration", f"WITH {_C}, o AS (SELECT *, CASE WHEN {_OK} THEN 1.0 ELSE 0.0 END AS y FROM cells WHERE status = 'ok' AND engine_error = '') SELECT model, count(*) AS n, avg(confidence) AS mean, median(confidence) AS median, min(confidence) AS least, max(confidence) AS most, coalesce(stddev_samp(confidence), 0) AS std, avg((confidence - y) * (confidence - y)) AS brier, [quantile_cont(confidence, .25), quantile_cont(confidence, .5), quantile_cont(confidence, .75)] AS quartiles FROM o GROUP BY 1")
def a18(spark, sf_dir):
    return c.calibration(cells(spark, sf_dir))


@register("a24_a28_token_cost", f"WITH {_C} SELECT model, sum(input_tokens * CASE model WHEN 'A' THEN 3.0 WHEN 'N' THEN 1.25 ELSE 0.5 END + output_tokens * CASE model WHEN 'A' THEN 15.0 WHEN 'N' THEN 10.0 ELSE 1.5 END) / 1e6 AS dollars FROM cells GROUP BY 1")
def a24(spark, sf_dir):
    return c.cost(cells(spark, sf_dir), {"A": (3.0, 15.0), "N": (1.25, 10.0), "R": (0.5, 1.5)}).groupBy("model").agg(F.sum("dollars").alias("dollars"))


@register("a29_verdict_consistency", f"WITH {_C}, v AS (SELECT model, claim_id, count(DISTINCT verdict) AS kinds FROM cells GROUP BY 1, 2) SELECT model, kinds, count(*) AS claims FROM v GROUP BY 1, 2")
def a29(spark, sf_dir):
    return cells(spark, sf_dir).groupBy("model", "claim_id").agg(F.size(F.collect_set("verdict")).cast("long").alias("kinds")).groupBy("model", "kinds").agg(F.count(F.lit(1)).alias("claims"))


@register("a32_a33_rollup_totals", f"WITH {_C} SELECT model, count(*) AS cells, CAST(sum(CASE WHEN {_OK} THEN 1 ELSE 0 END) AS BIGINT) AS clean FROM cells GROUP BY ROLLUP (model)")
def a32(spark, sf_dir):
    return cells(spark, sf_dir).rollup("model").agg(F.count(F.lit(1)).alias("cells"), F.count_if(c.is_clean()).alias("clean"))


@register("a35_a36_probe_rates", f"WITH {_C} SELECT model, sum(CASE WHEN verdict = 'fail' AND overall_pass THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN verdict = 'fail' THEN 1 ELSE 0 END), 0) AS rate FROM cells GROUP BY 1")
def a35(spark, sf_dir):
    return cells(spark, sf_dir).groupBy("model").agg(c.share(F.col("overall_pass"), F.col("verdict") == "fail").alias("rate"))


@register("a37_a38_zero_bounds", f"WITH {_C}, u AS (SELECT model, 'cell' AS unit, count(*) AS n FROM cells GROUP BY 1 UNION ALL SELECT model, 'claim_and_model', count(DISTINCT claim_id) FROM cells GROUP BY 1 UNION ALL SELECT model, 'claim', count(DISTINCT claim_id) FROM cells GROUP BY 1) SELECT model, unit, n, 100 * (1 - pow(0.05, 1.0 / n)) AS bound FROM u")
def a37(spark, sf_dir):
    return reports.pooled_bounds(cells(spark, sf_dir))


@register("a46_cohens_kappa", "WITH t AS (SELECT count(*) AS n, sum(CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS b, sum(CASE WHEN quality = 0 AND toxic = 1 THEN 1 ELSE 0 END) AS c, sum(CASE WHEN quality = 0 AND toxic = 0 THEN 1 ELSE 0 END) AS d FROM labels), p AS (SELECT *, (a + d) / n AS p_o, ((a + b) * (a + c) + (d + c) * (d + b)) / (n * n) AS p_e FROM t) SELECT p_o, p_e, (p_o - p_e) / (1 - p_e) AS kappa FROM p")
def a46(spark, sf_dir):
    return st.kappa(table(spark, sf_dir, "labels"), "quality", "toxic").select("p_o", "p_e", "kappa")


@register("a60_nearest_rank", "SELECT l_returnflag, quantile_disc(l_extendedprice, 0.9) AS p90 FROM lineitem GROUP BY 1")
def a60(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(st.nearest_rank("l_extendedprice", 0.9).alias("p90"))


_ECONOMY = "WITH e AS (SELECT l_orderkey AS doc_id, CAST(sum(l_extendedprice) AS BIGINT) AS full_tokens, 500 AS manifest_tokens, list_sort(list(CAST(l_quantity AS BIGINT))) AS s FROM lineitem GROUP BY 1), m AS (SELECT *, CAST(floor(list_aggregate(s, 'median')) AS BIGINT) AS median_section, s[CAST(ceil(0.9 * len(s)) AS BIGINT)] AS p90_section FROM e), z AS (SELECT *, manifest_tokens + median_section AS answer_tokens, full_tokens / (manifest_tokens + median_section) AS ratio FROM m)"


def _economy(spark, sf_dir):
    docs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.round(F.sum("l_extendedprice")).cast("long").alias("full_tokens"), F.lit(500).alias("manifest_tokens"), F.collect_list(F.col("l_quantity").cast("long")).alias("section_tokens"))
    return st.token_economy(docs)


@register("a59_token_economy", f"{_ECONOMY} SELECT doc_id, median_section, p90_section, answer_tokens FROM z")
def a59(spark, sf_dir):
    return _economy(spark, sf_dir).select("doc_id", "median_section", "p90_section", "answer_tokens")


@register("a61_corpus_summary", f"{_ECONOMY} SELECT count(*) AS documents, count(ratio) AS priced, median(answer_tokens) AS median_answer FROM z")
def a61(spark, sf_dir):
    return st.corpus_summary(_economy(spark, sf_dir)).select("documents", "priced", "median_answer")


@register("a47_label_misses", "SELECT label, count(*) AS missed FROM (SELECT doc_id, 'quality' AS label FROM labels WHERE quality = 1 AND toxic = 0 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1 AND quality = 0) GROUP BY 1")
def a47(spark, sf_dir):
    both = table(spark, sf_dir, "labels").select(F.array_compact(F.array(F.when(F.col("quality") == 1, F.lit("quality")), F.when(F.col("toxic") == 1, F.lit("toxic")))).alias("gold"), F.when((F.col("quality") == 1) & (F.col("toxic") == 1), F.array(F.lit("quality"), F.lit("toxic"))).otherwise(F.expr("cast(array() as array<string>)")).alias("auto"))
    return st.label_f1(both)


# Orders as cells: gold labels of their status and priority, another annotator's of status alone for some, none for others.
_LABELS = "g AS (SELECT o_orderkey AS cell_id, CASE WHEN o_orderkey % 5 = 0 THEN [] ELSE list_distinct([o_orderstatus, o_orderpriority[1:1]]) END AS labels FROM orders), a AS (SELECT o_orderkey AS cell_id, CASE WHEN o_orderkey % 3 = 0 THEN [o_orderstatus] WHEN o_orderkey % 3 = 1 THEN [o_orderpriority[1:1], o_orderstatus, o_orderstatus] ELSE [] END AS labels FROM orders WHERE o_orderkey % 7 <> 0)"


def _labels(spark, sf_dir):
    k, status, priority = F.col("o_orderkey"), F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    none = F.expr("cast(array() as array<string>)")
    orders = table(spark, sf_dir, "orders")
    gold = orders.select(k.alias("cell_id"), F.when(k % 5 == 0, none).otherwise(F.array_distinct(F.array(status, priority))).alias("labels"))
    auto = orders.filter(k % 7 != 0).select(k.alias("cell_id"), F.when(k % 3 == 0, F.array(status)).when(k % 3 == 1, F.array(priority, status, status)).otherwise(none).alias("labels"))
    return gold, auto


@register("j20_gold_labels", f"WITH {_LABELS}, b AS (SELECT g.cell_id, g.labels AS g, coalesce(a.labels, []) AS a FROM g LEFT JOIN a USING (cell_id)), e AS (SELECT unnest(list_distinct(list_concat(g, a))) AS label, g, a FROM b) SELECT label, count(*) FILTER (WHERE list_contains(g, label) AND list_contains(a, label)) AS found, count(*) FILTER (WHERE list_contains(g, label) AND NOT list_contains(a, label)) AS missed, count(*) FILTER (WHERE NOT list_contains(g, label)) AS added FROM e GROUP BY 1")
def j20(spark, sf_dir):
    return reports.gold_against_auto(*_labels(spark, sf_dir))


@register("j21_annotators", f"WITH {_LABELS} SELECT count(*) AS both, count(*) FILTER (WHERE list_sort(g.labels) = list_sort(list_distinct(a.labels))) AS same_set, count(*) FILTER (WHERE (len(g.labels) > 0) = (len(a.labels) > 0)) AS same_sign FROM g JOIN a USING (cell_id)")
def j21(spark, sf_dir):
    return reports.annotator_agreement(*_labels(spark, sf_dir))


_PAIR = f"WITH {_C}, b AS (SELECT * FROM cells WHERE repeat = 1), n AS (SELECT * FROM cells WHERE repeat = 2)"


@register("j09_j12_regressions", f"{_PAIR} SELECT claim_id, engine, model, b.verdict AS before, n.verdict AS after FROM b JOIN n USING (claim_id, engine, model) WHERE b.status = 'ok' AND (n.engine_error <> '' OR (b.verdict IN ('pass', 'inconclusive') AND n.verdict = 'fail'))")
def j09(spark, sf_dir):
    return c.regressions(*_runs(spark, sf_dir)).drop("broke")


@register("j10_verdict_drift", f"{_PAIR} SELECT claim_id, engine, model, b.verdict AS before, n.verdict AS after FROM b JOIN n USING (claim_id, engine, model) WHERE (b.verdict = 'pass' AND n.verdict = 'inconclusive') OR (b.verdict = 'inconclusive' AND n.verdict = 'pass')")
def j10(spark, sf_dir):
    return c.drift(*_runs(spark, sf_dir))


@register("j11_u03_coverage", "SELECT c_custkey AS claim_id, 'base' AS only_in FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0) UNION ALL SELECT DISTINCT o_custkey, 'now' FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer)")
def j11(spark, sf_dir):
    return c.coverage(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("claim_id")), table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("claim_id")))


@register("j13_improvements", f"{_PAIR} SELECT claim_id, engine, model FROM b JOIN n USING (claim_id, engine, model) WHERE b.status = 'not_applicable' AND n.status = 'ok' AND n.engine_error = ''")
def j13(spark, sf_dir):
    return c.improvements(*_runs(spark, sf_dir))


# Results are the cells of repeat 1, some without usage; traces are those of repeat 2.
@register("j14_cost_fallback", f"WITH {_C}, r AS (SELECT model, engine, claim_id, CASE WHEN q % 3 <> 0 THEN input_tokens END AS i, CASE WHEN q % 3 <> 0 THEN output_tokens END AS o FROM cells WHERE repeat = 1 AND engine_error = '' AND q % 11 <> 0), t AS (SELECT model, 'O' AS engine, claim_id, input_tokens AS ti, output_tokens AS t_o FROM cells WHERE repeat = 2 AND engine = 'O') SELECT model, engine, claim_id, coalesce(i, ti) AS input_tokens, coalesce(o, t_o) AS output_tokens, CASE WHEN i IS NOT NULL THEN 'results' ELSE 'traces' END AS source FROM r LEFT JOIN t USING (model, engine, claim_id) WHERE coalesce(i, ti) IS NOT NULL UNION ALL SELECT model, engine, claim_id, ti, t_o, 'traces' FROM t ANTI JOIN r USING (model, engine, claim_id) WHERE ti <> 0 OR t_o <> 0")
def j14(spark, sf_dir):
    rows = cells(spark, sf_dir)
    usage = [F.when(F.col("q") % 3 != 0, F.col(x)).alias(x) for x in ("input_tokens", "output_tokens")]
    results = rows.filter("repeat = 1 AND q % 11 <> 0").select("model", "engine", "claim_id", "engine_error", *usage)
    return c.fallback_usage(results, rows.filter("repeat = 2 AND engine = 'O'"), agentic="O")


@register("j15_latest_source", f"WITH {_C}, r AS (SELECT *, row_number() OVER (PARTITION BY claim_id, engine, model ORDER BY repeat DESC) AS rn FROM cells) SELECT claim_id, engine, model, repeat, q FROM r WHERE rn = 1")
def j15(spark, sf_dir):
    return c.latest(cells(spark, sf_dir), c.KEY, "repeat").select("claim_id", "engine", "model", "repeat", "q")


@register("j16_dense_grid", f"{_PAIR}, a AS (SELECT DISTINCT engine, model FROM cells), k AS (SELECT DISTINCT claim_id FROM cells), f AS (SELECT * FROM n WHERE q % 3 = 0) SELECT claim_id, engine, model, coalesce(status, 'pending_rerun') AS status FROM k CROSS JOIN a LEFT JOIN f USING (claim_id, engine, model)")
def j16(spark, sf_dir):
    all_cells = cells(spark, sf_dir)
    now = all_cells.filter("repeat = 2 AND q % 3 = 0")
    return c.dense(now, all_cells.select("claim_id").distinct(), all_cells.select("engine", "model").distinct()).select("claim_id", "engine", "model", "status")


@register("j17_paired_verdicts", f"WITH {_C} SELECT a.model, count(*) AS pairs, CAST(sum(CASE WHEN a.verdict IS NOT DISTINCT FROM b.verdict THEN 1 ELSE 0 END) AS BIGINT) AS same FROM cells a JOIN cells b ON a.claim_id = b.claim_id AND a.model = b.model AND a.repeat = b.repeat WHERE a.engine = 'O' AND b.engine = 'F' GROUP BY 1")
def j17(spark, sf_dir):
    all_cells = cells(spark, sf_dir)
    side = lambda e, n: all_cells.filter(F.col("engine") == e).select("claim_id", "model", "repeat", F.col("verdict").alias(n))
    return side("O", "a").join(side("F", "b"), ["claim_id", "model", "repeat"]).groupBy("model").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("same"))


@register("j18_permutation_control", "SELECT a.item_id, count(*) AS others FROM benchmark a JOIN benchmark b ON a.item_id <> b.item_id WHERE list_bool_and(list_transform(string_split(a.text, ' ')[1:2], lambda w: contains(lower(b.text), lower(w)))) GROUP BY 1")
def j18(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    needles = b.select("item_id", F.explode(F.array_distinct(F.transform(F.slice(F.split("text", " "), 1, 2), F.lower))).alias("needle"))
    return claims.permutation_control(needles, b.select("item_id", "text"))


# A step for each unit of a cell's calls; the cell's own map is that of repeat 1, so other repeats match it where their calls are the same.
@register("j19_fingerprint_join", f"WITH {_C}, k AS (SELECT model, engine || claim_id AS claim_id, repeat, q % 3 AS a, q % 2 AS b, q FROM cells), r AS (SELECT *, CAST(a * (q % 100) + b * (q % 100) AS DOUBLE) AS ms FROM k WHERE a + b > 0) SELECT r.model, r.claim_id, count(*) AS attempts, min(r.ms) AS least_ms, max(r.ms) AS most_ms, max(r.ms) - min(r.ms) AS spread_ms FROM r JOIN k c ON c.repeat = 1 AND c.model = r.model AND c.claim_id = r.claim_id AND c.a = r.a AND c.b = r.b GROUP BY 1, 2")
def j19(spark, sf_dir):
    rows = cells(spark, sf_dir).select("model", F.concat("engine", "claim_id").alias("claim_id"), F.col("repeat").alias("run_id"), (F.col("q") % 3).cast("int").alias("a"), (F.col("q") % 2).cast("int").alias("b"), (F.col("q") % 100).cast("double").alias("latency_ms"))
    calls = F.concat(F.array_repeat(F.lit("search_text"), F.col("a")), F.array_repeat(F.lit("inspect_page"), F.col("b")), F.array(F.lit("submit")))
    steps_ = rows.select("model", "claim_id", "run_id", "latency_ms", F.explode(calls).alias("tool_name"))
    own = F.map_filter(F.map_from_arrays(F.array(F.lit("search_text"), F.lit("inspect_page"), F.lit("submit")), F.array("a", "b", F.lit(1))), lambda _, n: n > 0)
    return c.matched_attempts(steps_, rows.filter("run_id = 1").select("model", "claim_id", own.alias("n_tool_calls_by_tool")), ["search_text", "inspect_page"])


@register("j26_patch_merge", f"WITH {_C}, r AS (SELECT claim_id, engine, model, repeat, true AS p FROM cells WHERE engine_error = 'all pods are down' AND q % 2 = 0) SELECT claim_id, engine, model, repeat, coalesce(r.p, overall_pass) AS overall_pass, CASE WHEN r.p THEN '' ELSE engine_error END AS engine_error FROM cells LEFT JOIN r USING (claim_id, engine, model, repeat)")
def j26(spark, sf_dir):
    all_cells = cells(spark, sf_dir)
    retries = all_cells.filter("engine_error = 'all pods are down' AND q % 2 = 0").withColumn("overall_pass", F.lit(True)).withColumn("engine_error", F.lit(""))
    return c.patched(all_cells, retries).select("claim_id", "engine", "model", "repeat", "overall_pass", "engine_error")


@register("j27_carried_forward", f"WITH {_C} SELECT claim_id, engine, model, repeat FROM cells WHERE (repeat = 2 AND model <> 'R') OR (repeat = 1 AND model = 'R')")
def j27(spark, sf_dir):
    before, now = _runs(spark, sf_dir)
    return c.carried_forward(before, now.filter("model <> 'R'")).select("claim_id", "engine", "model", "repeat")


@register("u01_u02_union_arms", f"WITH {_C} SELECT model, count(*) AS cells FROM (SELECT * FROM cells WHERE engine = 'O' UNION ALL SELECT * FROM cells WHERE engine = 'F' AND repeat <> 1) GROUP BY 1")
def u01(spark, sf_dir):
    all_cells = cells(spark, sf_dir)
    return all_cells.filter("engine = 'O'").unionByName(all_cells.filter("engine = 'F' AND repeat <> 1")).groupBy("model").agg(F.count(F.lit(1)).alias("cells"))


@register("u04_intersection", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def u04(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem")
    return item.filter("l_returnflag = 'A'").select("l_partkey").intersect(item.filter("l_returnflag = 'R'").select("l_partkey"))


@register("w12_stratified_sample", None)
def w12(spark, sf_dir):
    return st.stratified(table(spark, sf_dir, "customer"), 60, "c_mktsegment", "c_nationkey", "c_custkey", 7).select("c_custkey", "c_mktsegment", "c_nationkey")


# Trace steps: events of a user are a run, in order of time; event types are tools.
TOOLS = "CASE event_type WHEN 'error' THEN 'search_text' WHEN 'click' THEN 'get_section_text' WHEN 'purchase' THEN 'submit_claim_result' WHEN 'signup' THEN 'inspect_page' WHEN 'view' THEN 'build_datasheet' ELSE 'query_dataset' END"
STEPS = f"SELECT user_id AS run_id, user_id % 50 AS claim_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, event_id % 4 AS turn_idx, CASE WHEN event_id % 11 = 0 THEN 'final_output' ELSE 'tool_call' END AS kind, {TOOLS} AS tool_name, CASE WHEN value < 1 THEN 'E' ELSE '' END AS error, event_id % 100 AS input_tokens, event_id % 10 AS output_tokens, event_id FROM events"
_S = f"steps AS ({STEPS})"


def steps(spark, sf_dir):
    return view(spark, sf_dir, STEPS)


@register("s08_k07_trace_steps", f"WITH {_S} SELECT run_id, step, kind, tool_name FROM steps")
def s08(spark, sf_dir):
    return steps(spark, sf_dir).select("run_id", F.col("step").cast("long").alias("step"), "kind", "tool_name")


@register("a21_a67_tool_counts", f"WITH {_S} SELECT run_id, count(*) AS n_steps, CAST(sum(CASE WHEN kind = 'tool_call' THEN 1 ELSE 0 END) AS BIGINT) AS calls, CAST(sum(CASE WHEN kind = 'tool_call' AND tool_name = 'search_text' THEN 1 ELSE 0 END) AS BIGINT) AS searches FROM steps GROUP BY 1")
def a67(spark, sf_dir):
    t = tr.tool_counts(steps(spark, sf_dir), "run_id")
    return t.select("run_id", "n_steps", F.coalesce(F.aggregate(F.map_values("n_tool_calls_by_tool"), F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("calls"), F.coalesce(F.try_element_at("n_tool_calls_by_tool", F.lit("search_text")), F.lit(0)).cast("long").alias("searches"))


@register("a22_a42_tool_grid", f"WITH {_S}, x AS (SELECT CASE claim_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS model, run_id, tool_name FROM steps WHERE kind = 'tool_call'), t AS (SELECT CASE (user_id % 50) % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS model, count(DISTINCT user_id) AS n FROM events GROUP BY 1) SELECT tool_name AS tool, coalesce(sum(CASE WHEN model = 'even' THEN 1.0 END) / max(CASE WHEN model = 'even' THEN n END), 0) AS even, coalesce(sum(CASE WHEN model = 'odd' THEN 1.0 END) / max(CASE WHEN model = 'odd' THEN n END), 0) AS odd FROM x JOIN t USING (model) GROUP BY 1")
def a22(spark, sf_dir):
    per_run = tr.tool_counts(steps(spark, sf_dir), "run_id", "claim_id").withColumn("model", F.when(F.col("claim_id") % 2 == 0, "even").otherwise("odd"))
    return c.tool_grid(per_run, ["even", "odd"])


@register("a10_tool_error_rates", f"WITH {_S} SELECT tool_name AS tool, count(*) AS calls, CAST(sum(CASE WHEN error <> '' THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM steps WHERE kind = 'tool_call' GROUP BY 1")
def a10(spark, sf_dir):
    s = steps(spark, sf_dir)
    calls = tr.tool_counts(s, "run_id")
    errors = tr.tool_counts(s.filter("error <> ''"), "run_id").select("run_id", F.col("n_tool_calls_by_tool").alias("n_tool_errors_by_tool"))
    return c.tool_errors(calls.join(errors, "run_id", "left")).select("tool", "calls", "errors")


@register("a27_turn_usage", f"WITH {_S}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id, turn_idx, kind ORDER BY step) AS rn FROM steps) SELECT run_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM r WHERE kind = 'final_output' OR rn = 1 GROUP BY 1")
def a27(spark, sf_dir):
    return tr.usage(steps(spark, sf_dir), "run_id")


@register("a58_contamination", f"WITH {_S}, f AS (SELECT run_id, min(step) AS freeze_step FROM steps WHERE tool_name = 'submit_claim_result' GROUP BY 1) SELECT f.run_id, freeze_step, CAST(count(s.run_id) AS BIGINT) AS early_calls FROM f LEFT JOIN steps s ON s.run_id = f.run_id AND s.step < freeze_step AND s.tool_name = 'query_dataset' GROUP BY 1, 2")
def a58(spark, sf_dir):
    return tr.contamination(steps(spark, sf_dir), "run_id", chamber=F.col("tool_name") == "query_dataset").select("run_id", F.col("freeze_step").cast("long").alias("freeze_step"), "early_calls")


@register("m13_silent_failures", f"WITH {_S}, n AS (SELECT run_id, sum(CASE WHEN tool_name IN ('build_datasheet', 'get_section_text', 'search_text', 'inspect_page') THEN 1 ELSE 0 END) AS rd, sum(CASE WHEN tool_name IN ('search_text', 'inspect_page') THEN 1 ELSE 0 END) AS vf FROM steps WHERE kind = 'tool_call' GROUP BY 1) SELECT run_id, CASE WHEN rd = 0 THEN 'tool_bypass' WHEN vf = 0 THEN 'verification_skipped' ELSE '' END AS flags FROM n")
def m13(spark, sf_dir):
    t = tr.tool_counts(steps(spark, sf_dir), "run_id").filter("n_tool_calls_by_tool IS NOT NULL")
    return t.select("run_id", F.array_join(tr.silent_failure(F.lit(True), F.col("n_tool_calls_by_tool")), ",").alias("flags"))


@register("m14_m15_attribution", f"WITH {_S}, v AS (SELECT *, max(CASE WHEN tool_name IN ('search_text', 'inspect_page') THEN step END) OVER (PARTITION BY run_id) AS later FROM steps), a AS (SELECT CASE WHEN error <> '' THEN 'tool_error' WHEN tool_name = 'submit_claim_result' THEN CASE WHEN later IS NULL THEN 'submitted_unverified' ELSE 'submitted_verified' END WHEN tool_name IN ('search_text', 'inspect_page') THEN 'verification' WHEN tool_name IN ('build_datasheet', 'get_section_text') THEN CASE WHEN later > step THEN 'read_then_verified' ELSE 'read_only' END ELSE 'other' END AS attribution FROM v) SELECT attribution, count(*) AS n FROM a GROUP BY 1")
def m14(spark, sf_dir):
    return tr.attributed(steps(spark, sf_dir), "run_id").groupBy("attribution").agg(F.count(F.lit(1)).alias("n"))


@register("w10_attempts", f"WITH {_S}, f AS (SELECT claim_id, run_id, min(event_id) AS first, count(*) AS steps FROM steps GROUP BY 1, 2) SELECT claim_id, run_id, steps, row_number() OVER (PARTITION BY claim_id ORDER BY first, run_id) AS attempt FROM f")
def w10(spark, sf_dir):
    return tr.attempts(steps(spark, sf_dir), ["claim_id"], "run_id", "event_id").select("claim_id", "run_id", "steps", "attempt")


@register("w11_keep_first", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS rn FROM conversations) WHERE rn = 1")
def w11(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("o", F.struct("role", "text"))
    return tr.keep_first(rows, ["conv_id", "turn"], "o").select("conv_id", "turn", "role")


@register("a69_event_groups", f"WITH {_S}, e AS (SELECT 'm' || run_id % 3 AS model, CASE WHEN claim_id % 7 <> 0 THEN 'c' || claim_id END AS claim_id, CASE WHEN run_id % 2 = 0 THEN 'agentic' ELSE '' END AS engine, CASE WHEN step = 1 THEN 'session_start' ELSE kind END AS kind, run_id * 100000 + step AS step FROM steps) SELECT model, claim_id, engine, count(*) AS events, list(kind ORDER BY step) AS kinds FROM e WHERE kind <> 'session_start' AND claim_id IS NOT NULL AND engine <> '' GROUP BY 1, 2, 3")
def a69(spark, sf_dir):
    run, claim = F.col("run_id"), F.col("claim_id")
    events = steps(spark, sf_dir).select(F.concat(F.lit("m"), (run % 3).cast("string")).alias("model"), F.when(claim % 7 != 0, F.concat(F.lit("c"), claim.cast("string"))).alias("claim_id"), F.when(run % 2 == 0, "agentic").otherwise("").alias("engine"), F.when(F.col("step") == 1, "session_start").otherwise(F.col("kind")).alias("kind"), (run * 100000 + F.col("step")).alias("step"))
    return reports.grouped_events(events)


# Extractions and expectations from parts.
@register("f28_f31_numeric_needles", "SELECT p_partkey, p_size % 3 <> 0 AS number_hit, contains(lower(p_type), 'steel') OR contains(lower(p_name), 'ring') AS word_hit FROM part")
def f31(spark, sf_dir):
    text = F.concat(g.shown_value(F.lit(None).cast("string"), F.when(F.col("p_size") % 3 != 0, F.format_string("1,2%d0.0", F.col("p_size") % 10)).otherwise("7"), F.lit(None).cast("string"), F.lit("mV")))
    needle = F.format_string("12%d0", F.col("p_size") % 10)
    word = g.needle_hit(F.concat_ws(" ", "p_type", "p_name"), F.lit("Steel")) | g.needle_hit(F.col("p_name"), F.lit("RING"))
    return table(spark, sf_dir, "part").select("p_partkey", g.needle_hit(text, needle).alias("number_hit"), word.alias("word_hit"))


# Parts are claims, line items of some of them archived extractions; needles are the part's size.
_ARCHIVE = "claims AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN [] ELSE [CAST(p_size AS VARCHAR)] END AS needles FROM part WHERE p_partkey % 13 <> 0), archive AS (SELECT l_partkey AS claim_id, l_returnflag AS model, l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 = 0 THEN ' ' WHEN l_orderkey % 2 = 0 THEN 'found ' || p_size || '.0 V' ELSE 'found none' END AS extraction, p_size, l_linenumber % 3 <> 0 AS overall_pass FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_partkey % 4 <> 0)"


def _archive(spark, sf_dir):
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    claimed = part.filter(k % 13 != 0).select(k.alias("id"), F.when(k % 6 != 0, F.array(F.col("p_size").cast("string"))).otherwise(F.expr("cast(array() as array<string>)")).alias("value_contains"))
    order = F.col("l_orderkey")
    text = F.when(order % 5 == 0, " ").when(order % 2 == 0, F.concat(F.lit("found "), F.col("p_size").cast("string"), F.lit(".0 V"))).otherwise("found none")
    cells_ = table(spark, sf_dir, "lineitem").filter("l_partkey % 4 <> 0").join(part.select(k.alias("l_partkey"), "p_size"), "l_partkey")
    return cells_.select(F.col("l_partkey").alias("claim_id"), F.col("l_returnflag").alias("model"), text.alias("extraction"), (F.col("l_linenumber") % 3 != 0).alias("overall_pass")), claimed


@register("j23_regrade", f"WITH {_ARCHIVE}, b AS (SELECT a.model, CASE WHEN c.id IS NULL THEN 'no_claim' WHEN trim(extraction) = '' THEN 'no_extraction' WHEN len(needles) = 0 THEN 'ungradable' WHEN (extraction <> 'found none') = overall_pass THEN 'agree' ELSE 'disagree' END AS bucket FROM archive a LEFT JOIN claims c ON c.id = a.claim_id) SELECT model, bucket, count(*) AS n FROM b GROUP BY 1, 2")
def j23(spark, sf_dir):
    return claims.regraded(*_archive(spark, sf_dir)).groupBy("model", "bucket").agg(F.count(F.lit(1)).alias("n"))


@register("j23_uncovered_claims", f"WITH {_ARCHIVE} SELECT id FROM claims WHERE id NOT IN (SELECT claim_id FROM archive)")
def j23_uncovered(spark, sf_dir):
    archived, claimed = _archive(spark, sf_dir)
    return claims.uncovered(claimed, archived).select("id")


@register("f29_f30_j23_grading", "SELECT p_partkey, CASE WHEN f <> e THEN 'Found mismatch: ' || CASE WHEN e THEN 'expected' ELSE 'not expected' END WHEN e AND c < 0.7 AND NOT v THEN 'confidence too low; value mismatch' WHEN e AND c < 0.7 THEN 'confidence too low' WHEN e AND NOT v THEN 'value mismatch' ELSE '' END AS reason FROM (SELECT p_partkey, p_partkey % 3 <> 0 AS f, p_partkey % 4 <> 0 AS e, (p_size % 10) / 10.0 AS c, p_retailprice > 950 AS v FROM part)")
def f30(spark, sf_dir):
    k = F.col("p_partkey")
    result = g.graded(F.when(k % 3 != 0, F.lit(True)), k % 4 != 0, (F.col("p_size") % 10) / 10, F.col("p_retailprice") > 950)
    return table(spark, sf_dir, "part").select("p_partkey", result.alias("r")).select("p_partkey", "r.reason")


@register("f27_list_share", "SELECT l_orderkey, (CASE WHEN max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) = 1 THEN 1 ELSE 0 END + CASE WHEN max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) = 1 THEN 1 ELSE 0 END) / 2.0 AS share FROM lineitem GROUP BY 1")
def f27b(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("s"))
    return found.select("l_orderkey", g.list_share(F.col("s"), F.array(F.lit("a"), F.lit("n"))).alias("share"))


# Claims from parts: needles of the brand, the size and words of the type; the second annotator's differ for some.
@register("j22_rederivation", """WITH p AS (SELECT p_partkey AS id, list_sort(list_distinct([CAST(p_size AS VARCHAR), p_brand])) AS num, list_sort(list_distinct([lower(x) FOR x IN string_split(p_type, ' ')])) AS words,
  CASE WHEN p_partkey % 7 = 0 THEN [] ELSE list_sort(list_distinct([CAST(p_size + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS VARCHAR), p_brand])) END AS num2, CASE WHEN p_partkey % 5 = 0 THEN list_sort(list_distinct([lower(x) FOR x IN string_split(p_type, ' ')][1:1])) ELSE list_sort(list_distinct([lower(x) FOR x IN string_split(p_type, ' ')])) END AS words2 FROM part),
s AS (SELECT id, id % 7 <> 0 AS answered, id % 7 <> 0 AND num = num2 AS same_numbers, id % 7 <> 0 AND words = words2 AS same_words, id % 7 <> 0 AND CASE id % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE id % 2 = 0 END AS same_floor FROM p) SELECT *, same_numbers AND same_words AND same_floor AS exact FROM s""")
def j22(spark, sf_dir):
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    words = F.split("p_type", " ")
    ours = part.select(k.alias("id"), F.concat(F.array(F.col("p_size").cast("string"), F.concat(F.lit(" "), "p_brand")), words).alias("value_contains"), F.when(k % 4 != 0, F.lit(0.5)).alias("confidence_min"))
    their_words = F.transform(F.when(k % 5 == 0, F.slice(words, 1, 1)).otherwise(words), F.lower)
    given = F.concat(F.array((F.col("p_size") + F.when(k % 3 == 0, 1).otherwise(0)).cast("string"), F.col("p_brand")), their_words)
    floor = F.when(k % 4 == 0, F.lit(0.85)).when(k % 4 == 1, F.lit(None)).when(k % 2 == 0, F.lit(0.5)).otherwise(F.lit(0.6))
    theirs = part.filter(k % 7 != 0).select(k.alias("id"), given.alias("value_contains"), floor.alias("confidence_min"))
    return claims.rederivation(ours, theirs)


@register("j28_two_phase_merge", "SELECT o_orderkey, o_orderstatus, o_totalprice, l.n AS measured FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l_orderkey = o_orderkey")
def j28(spark, sf_dir):
    first = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.lit(-1).alias("measured"))
    second = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("measured"))
    return claims.merged_phases(first, second, "o_orderkey", ["measured"])


@register("a44_chronology", "SELECT o_orderstatus, count(*) FILTER (WHERE s <= TIMESTAMP '1997-01-01') AS before, count(*) FILTER (WHERE s > TIMESTAMP '1997-01-01') AS after, count(*) FILTER (WHERE s IS NULL) AS unknown, epoch(min(s)) AS first, epoch(max(s)) AS last FROM (SELECT o_orderstatus, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate END AS s FROM orders) GROUP BY 1")
def a44(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select("o_orderstatus", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate").cast("timestamp")).alias("started"))
    found = reports.chronology(runs, F.lit("1997-01-01").cast("timestamp"), "o_orderstatus")
    return found.withColumns({c: F.unix_timestamp(c).cast("double") for c in ("first", "last")})


@register("a41_needle_lengths", "WITH n AS (SELECT unnest([CAST(p_size AS VARCHAR), p_brand, p_name]) AS needle FROM part) SELECT length(needle) AS chars, count(*) FILTER (WHERE regexp_matches(needle, '[0-9]')) AS numeric, count(*) FILTER (WHERE NOT regexp_matches(needle, '[0-9]')) AS words FROM n GROUP BY 1")
def a41(spark, sf_dir):
    return reports.needle_lengths(table(spark, sf_dir, "part").select(F.array(F.col("p_size").cast("string"), "p_brand", "p_name").alias("value_contains"))).withColumn("chars", F.col("chars").cast("long"))


@register("l06_claim_order", f"WITH {_C}, d AS (SELECT DISTINCT claim_id, engine FROM cells) SELECT claim_id, engine, row_number() OVER (ORDER BY CASE engine WHEN 'O' THEN 0 ELSE 1 END, claim_id) AS place FROM d")
def l06(spark, sf_dir):
    return c.claim_order(cells(spark, sf_dir).select("claim_id", "engine").distinct(), F.when(F.col("engine") == "O", 0).otherwise(1))


_WHY = "CASE WHEN q % 6 = 0 THEN 'an engagement-diagnostic run' WHEN q % 6 = 1 THEN 'the setup cannot resolve this claim' ELSE 'conditions differ' END"
_UNMATCHED = "CASE q % 4 WHEN 0 THEN 'Reference diode' WHEN 1 THEN 'supply ripple' WHEN 2 THEN 'die temperature' ELSE 'controlled load' END"


@register("a31_inconclusive_taxonomy", f"WITH {_C}, one AS (SELECT *, {_WHY} AS why, lower({_UNMATCHED}) AS names, row_number() OVER (PARTITION BY claim_id ORDER BY CASE engine WHEN 'O' THEN 0 ELSE 1 END, model) AS rn FROM cells WHERE repeat = 1), k AS (SELECT claim_id, CASE WHEN contains(why, 'engagement-diagnostic') THEN 'engagement_only' WHEN contains(why, 'cannot resolve this claim') THEN 'resolution_limited' WHEN contains(names, 'reference') THEN 'no_reference' ELSE 'unmatched_condition' END AS class, CASE WHEN contains(why, 'engagement-diagnostic') THEN 'engagement_only' WHEN contains(why, 'cannot resolve this claim') THEN 'resolution_limited' WHEN contains(names, 'reference') THEN 'no_reference' WHEN regexp_matches(names, 'controlled|ripple|sweep') THEN 'uncontrolled_stimulus' ELSE 'unobservable_internal' END AS sub_class FROM one WHERE rn = 1 AND verdict = 'inconclusive') SELECT class, sub_class, count(*) AS claims, string_agg(claim_id, ',' ORDER BY claim_id) AS claim_ids FROM k GROUP BY 1, 2")
def a31(spark, sf_dir):
    rows = cells(spark, sf_dir).filter("repeat = 1").withColumn("rationale", F.expr(_WHY)).withColumn("unmatched_conditions", F.array(F.expr(_UNMATCHED)))
    return claims.inconclusive_taxonomy(rows, ("O", "F")).withColumn("claim_ids", F.array_join("claim_ids", ","))
