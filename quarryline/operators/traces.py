"""Trace steps: from tool calls to cells, usage, attempts, silent failures, contamination, attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tools by what they are for.
SUBMIT = ["submit_claim_result", "submit_chamber_outcome"]
READ = ["build_datasheet", "get_section_text", "search_text", "inspect_page", "extract_table_markdown"]
VERIFY = ["search_text", "inspect_page"]


def tool_counts(steps: DataFrame, *cell: str) -> DataFrame:
    """Calls of each tool by cell as a map, and the number of steps."""
    calls = steps.filter("kind = 'tool_call' AND tool_name <> ''").groupBy(*cell, "tool_name").agg(F.count(F.lit(1)).cast("int").alias("n"))
    maps = calls.groupBy(*cell).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool_name", "n")))).alias("n_tool_calls_by_tool"))
    return steps.groupBy(*cell).agg(F.count(F.lit(1)).alias("n_steps")).join(maps, list(cell), "left")


def usage(steps: DataFrame, *cell: str) -> DataFrame:
    """Tokens by cell: of the tool calls of one turn only the first reports its usage; final outputs all do."""
    order = Window.partitionBy(*cell, "turn_idx", "kind").orderBy("step")
    once = steps.filter("kind IN ('tool_call', 'final_output')").withColumn("_n", F.row_number().over(order)).filter("kind = 'final_output' OR _n = 1")
    return once.groupBy(*cell).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def contamination(steps: DataFrame, *cell: str, chamber: Column) -> DataFrame:
    """Calls of measuring tools before the extraction was handed in; cells that never hand in are not counted."""
    freeze = steps.filter(F.col("tool_name").isin(SUBMIT)).groupBy(*cell).agg(F.min("step").alias("freeze_step"))
    early = steps.join(freeze, list(cell)).filter(chamber & (F.col("step") < F.col("freeze_step"))).groupBy(*cell).agg(F.count(F.lit(1)).alias("early_calls"), F.array_sort(F.collect_set("tool_name")).alias("tools"))
    return freeze.join(early, list(cell), "left").withColumn("early_calls", F.coalesce("early_calls", F.lit(0)))


def silent_failure(passed: Column, calls: Column) -> Column:
    """Flags of a cell that passed: no reading tool at all, or reading without verifying."""
    n = lambda tools: F.aggregate(F.map_values(F.map_filter(calls, lambda k, _: k.isin(tools))), F.lit(0), lambda a, x: a + x)
    flags = F.array_compact(F.array(F.when(n(READ) == 0, F.lit("tool_bypass")), F.when((n(READ) > 0) & (n(VERIFY) == 0), F.lit("verification_skipped"))))
    return F.when(passed, flags).otherwise(F.expr("cast(array() as array<string>)"))


def attempts(steps: DataFrame, cell: list[str], run: str, order: str) -> DataFrame:
    """The runs of each cell, numbered by their first step."""
    first = steps.groupBy(*cell, run).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("steps"))
    return first.withColumn("attempt", F.row_number().over(Window.partitionBy(*cell).orderBy("first", run)))


def keep_first(steps: DataFrame, key: list[str], order: str) -> DataFrame:
    """One step for each key, the first; steps without a run all stay."""
    known = steps.filter(F.col(key[0]).isNotNull())
    once = known.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).filter("_n = 1").drop("_n")
    return once.unionByName(steps.filter(F.col(key[0]).isNull()))


def attributed(steps: DataFrame, *cell: str) -> DataFrame:
    """A label for each step: an error, a hand-in, a reading that a later verification follows or not, or other."""
    later = F.max(F.when(F.col("tool_name").isin(VERIFY), F.col("step"))).over(Window.partitionBy(*cell))
    label = (
        F.when(F.coalesce("error", F.lit("")) != "", "tool_error")
        .when(F.col("tool_name").isin(SUBMIT), F.when(later.isNull(), "submitted_unverified").otherwise("submitted_verified"))
        .when(F.col("tool_name").isin(VERIFY), "verification")
        .when(F.col("tool_name").isin(READ), F.when(later > F.col("step"), "read_then_verified").otherwise("read_only"))
        .otherwise("other")
    )
    return steps.withColumn("attribution", label)


def attribution_rollup(steps: DataFrame, *cell: str) -> DataFrame:
    counts = steps.groupBy(*cell, "attribution").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*cell).agg(F.array_sort(F.collect_list("attribution")).alias("labels"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("attribution", "n")))).alias("attribution_counts"))
