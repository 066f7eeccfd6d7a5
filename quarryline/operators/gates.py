"""The gates of a run: hard ones that fail it, soft ones that warn.  A row for each model and gate.

Cells have the columns of ``cells.py`` and also repro_error, measured_value, sigma_basis, n_steps and
the maps n_tool_calls_by_tool and n_tool_errors_by_tool; null counts as nothing recorded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import traces
from .cells import has_error, share

# The gates, whether they are hard, whether a value below or above the bound fails, and the bound.
GATES = [
    ("H1_found_accuracy", True, "below", 0.90),
    ("H2_value_accuracy", True, "below", 0.80),
    ("H3_regressions", True, "above", 0.0),
    ("H4_engine_errors", True, "above", 0.0),
    ("H5_protocol_errors", True, "above", 0.0),
    ("H6_model_regressions", True, "above", 0.0),
    ("S1_inconclusive_rate", False, "above", 0.85),
    ("S2_tool_error_rate", False, "above", 0.20),
    ("S3_mean_confidence", False, "below", 0.80),
    ("S4_mean_trace_length", False, "above", 25.0),
    ("S5_verdict_drift", False, "above", 0.0),
    ("S6_coverage_gap", False, "above", 0.0),
    ("S7_improvements", False, "above", 0.0),
    ("S8_contamination_rate", False, "above", 0.90),
    ("S9_silent_failures", False, "above", 0.0),
]


def protocol_error() -> Column:
    """An error of the protocol, or a measured value that is no number where the protocol did not stop on purpose."""
    value = F.col("measured_value").cast("double")
    odd = F.isnan(value) | F.coalesce(F.abs(value) == float("inf"), F.lit(False))
    return (F.coalesce("repro_error", F.lit("")) != "") | (odd & (F.lower(F.coalesce("sigma_basis", F.lit(""))) != "stub"))


def error_rows(cells: DataFrame) -> DataFrame:
    """claim_id, engine, model, kind and message of each error of an engine or a protocol, and of each silent failure."""
    value = F.col("measured_value").cast("double")
    protocol = F.when(F.coalesce("repro_error", F.lit("")) != "", F.col("repro_error")).otherwise(F.concat(F.lit("non_finite_measurement="), value.cast("string")))
    flags = traces.silent_failure(F.coalesce("overall_pass", F.lit(False)), F.coalesce("n_tool_calls_by_tool", F.expr("map()")))
    found = [F.when(has_error(), F.struct(F.lit("engine").alias("kind"), F.col("engine_error").alias("message"))), F.when(protocol_error(), F.struct(F.lit("protocol").alias("kind"), protocol.alias("message"))), F.when(F.size(flags) > 0, F.struct(F.lit("silent").alias("kind"), F.array_join(flags, ", ").alias("message")))]
    return cells.select("claim_id", "engine", "model", F.inline(F.array_compact(F.array(*found))))


def contamination_rate(early: DataFrame, by: str = "model") -> DataFrame:
    """The share of cells that called measuring tools before they handed in, from a row (early_calls) for each cell that did hand in."""
    return early.groupBy(by).agg(share(F.col("early_calls") > 0).alias("S8_contamination_rate"))


def _own(now: DataFrame, by: str, agentic: str) -> DataFrame:
    mine, verdict = F.col("engine") == agentic, F.lower(F.coalesce("verdict", F.lit("")))
    silent = F.size(traces.silent_failure(F.coalesce("overall_pass", F.lit(False)), F.coalesce("n_tool_calls_by_tool", F.expr("map()")))) > 0
    return now.groupBy(by).agg(
        F.coalesce(share(F.coalesce("found_correct", F.lit(False)), mine), F.lit(0.0)).alias("H1_found_accuracy"),
        F.coalesce(share(F.coalesce("value_pass", F.lit(False)), mine & F.coalesce("found_expected", F.lit(False))), F.lit(1.0)).alias("H2_value_accuracy"),
        F.count_if(has_error()).alias("H4_engine_errors"), F.count_if(protocol_error()).alias("H5_protocol_errors"),
        F.coalesce(share(verdict == "inconclusive", mine & (verdict != "")), F.lit(0.0)).alias("S1_inconclusive_rate"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("S3_mean_confidence"),
        F.coalesce(F.avg(F.when(mine, F.coalesce("n_steps", F.lit(0)))), F.lit(0.0)).alias("S4_mean_trace_length"),
        F.count_if(mine & silent).alias("S9_silent_failures"),
    )


def _tools(now: DataFrame, by: str, agentic: str) -> DataFrame:
    mine = now.filter(F.col("engine") == agentic)
    each = lambda column, name: mine.select(by, F.explode(column).alias("tool", "n")).groupBy(by, "tool").agg(F.sum("n").alias(name))
    rates = each("n_tool_calls_by_tool", "calls").filter("calls > 0").join(each("n_tool_errors_by_tool", "errors"), [by, "tool"], "left")
    return rates.groupBy(by).agg(F.max(F.coalesce("errors", F.lit(0)) / F.col("calls")).alias("S2_tool_error_rate"))


def _against(now: DataFrame, base: DataFrame, by: str, agentic: str) -> DataFrame:
    """Counts of what has changed between the runs, over the cells of either."""
    side = lambda cells, name: cells.select(by, "claim_id", "engine", F.struct(F.lower(F.coalesce("verdict", F.lit(""))).alias("verdict"), F.coalesce("status", F.lit("ok")).alias("status"), has_error().alias("broke")).alias(name))
    both = side(base, "b").join(side(now, "n"), [by, "claim_id", "engine"], "full")
    b, n, mine = F.col("b"), F.col("n"), F.col("engine") == agentic
    failed = b.verdict.isin("pass", "inconclusive") & (n.verdict == "fail")
    drifted = ((b.verdict == "pass") & (n.verdict == "inconclusive")) | ((b.verdict == "inconclusive") & (n.verdict == "pass"))
    return both.groupBy(by).agg(
        F.count_if(mine & failed).alias("H3_regressions"), F.count_if((b.status == "ok") & (n.broke | failed)).alias("H6_model_regressions"),
        F.count_if(mine & drifted).alias("S5_verdict_drift"), F.count_if(mine & (b.isNull() | n.isNull())).alias("S6_coverage_gap"),
        F.count_if((b.status == "not_applicable") & ~n.broke).alias("S7_improvements"),
    )


def gate_rows(now: DataFrame, base: DataFrame | None = None, early: DataFrame | None = None, by: str = "model", agentic: str = "agentic") -> DataFrame:
    """gate, hard, value and failed for each model of the run; a gate without its input (``base``, ``early``) has no value and does not fail."""
    parts = [_own(now, by, agentic), _tools(now, by, agentic)]
    if base is not None:
        parts.append(_against(now, base, by, agentic))
    if early is not None:
        parts.append(contamination_rate(early, by))
    wide = reduce(lambda a, b: a.join(b, by, "left"), parts)
    row = []
    for name, hard, side, bound in GATES:
        value = F.col(name).cast("double") if name in wide.columns else F.lit(None).cast("double")
        row.append(F.struct(F.lit(name).alias("gate"), F.lit(hard).alias("hard"), value.alias("value"), F.coalesce(value < bound if side == "below" else value > bound, F.lit(False)).alias("failed")))
    return wide.select(by, F.inline(F.array(*row)))


def outcome(rows: DataFrame, by: str = "model") -> DataFrame:
    """The names of failed gates, and 1 where a hard one failed, 2 where a soft one did, else 0."""
    names = lambda hard: F.array_sort(F.collect_list(F.when((F.col("hard") == hard) & F.col("failed"), F.col("gate"))))
    found = rows.groupBy(by).agg(names(True).alias("hard_failures"), names(False).alias("warnings"))
    return found.withColumn("exit_code", F.when(F.size("hard_failures") > 0, 1).when(F.size("warnings") > 0, 2).otherwise(0))
