"""Run records ("cells"): one for each claim, engine, model and repeat.  Filters, rollups, joins between runs, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["claim_id", "engine", "model"]

def has_error(c: str = "engine_error") -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def passed() -> Column:
    """A cell that broke did not pass."""
    return ~has_error() & F.col("overall_pass")


def is_clean() -> Column:
    return F.col("overall_pass") & ~has_error()


def outage() -> Column:
    return F.rlike(F.lower(F.coalesce("engine_error", F.lit(""))), F.lit("not serving requests|all pods are down"))


def ok_cells(cells: DataFrame) -> DataFrame:
    return cells.filter((F.col("status") == "ok") & ~has_error() & F.col("confidence").isNotNull())


def share(condition: Column, of: Column | None = None) -> Column:
    """The share of rows that meet the condition among those in ``of``; null where there are none."""
    of = F.lit(True) if of is None else of
    return F.try_divide(F.count_if(of & condition).cast("double"), F.count_if(of).cast("double"))


def variance(cells: DataFrame) -> DataFrame:
    """For each model the mean and the sample deviation over its repeats of passes, confidence, latency and errors; no deviation of one repeat."""
    runs = cells.groupBy("model", "repeat").agg(F.count_if(passed()).alias("passes"), F.avg("confidence").alias("confidence"), F.avg("latency_s").alias("latency"), F.count_if(has_error()).alias("errors"))
    stats = [f(c).alias(f"{c}_{n}") for c in ("passes", "confidence", "latency", "errors") for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return runs.groupBy("model").agg(F.count(F.lit(1)).alias("repeats"), *stats)


def stability(cells: DataFrame) -> DataFrame:
    """For each model the claims whose outcome is the same in all repeats."""
    each = cells.groupBy("model", "claim_id").agg((F.min(passed()) == F.max(passed())).alias("stable"))
    return each.groupBy("model").agg(F.count(F.lit(1)).alias("claims"), F.count_if("stable").alias("stable"), F.array_sort(F.collect_list(F.when(~F.col("stable"), F.col("claim_id")))).alias("flipped"))


def calibration(cells: DataFrame) -> DataFrame:
    """Confidence against outcome for each model; the deviation of one cell is 0."""
    o = passed().cast("double")
    q = F.percentile("confidence", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return ok_cells(cells).groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean"), F.median("confidence").alias("median"), F.min("confidence").alias("least"), F.max("confidence").alias("most"),
        F.coalesce(F.stddev_samp("confidence"), F.lit(0.0)).alias("std"), F.coalesce(F.avg(F.pow(F.col("confidence") - o, 2)), F.lit(0.0)).alias("brier"), q.alias("quartiles"),
    )


def regressions(base: DataFrame, now: DataFrame) -> DataFrame:
    """Cells that have come to fail or to break, where the base's is ok."""
    b = base.filter("status = 'ok'").select(*KEY, F.col("verdict").alias("before"))
    n = now.select(*KEY, F.col("verdict").alias("after"), has_error().alias("broke"))
    return b.join(n, KEY).filter(F.col("broke") | (F.col("before").isin("pass", "inconclusive") & (F.col("after") == "fail")))


def drift(base: DataFrame, now: DataFrame) -> DataFrame:
    pair = base.select(*KEY, F.col("verdict").alias("before")).join(now.select(*KEY, F.col("verdict").alias("after")), KEY)
    return pair.filter("(before = 'pass' AND after = 'inconclusive') OR (before = 'inconclusive' AND after = 'pass')")


def improvements(base: DataFrame, now: DataFrame) -> DataFrame:
    return base.filter("status = 'not_applicable'").select(*KEY).join(now.filter((F.col("status") == "ok") & ~has_error()).select(*KEY), KEY)


def coverage(base: DataFrame, now: DataFrame, key: str = "claim_id") -> DataFrame:
    """Keys that only one of the runs has."""
    b, n = base.select(key).distinct(), now.select(key).distinct()
    return b.join(n, key, "left_anti").withColumn("only_in", F.lit("base")).unionByName(n.join(b, key, "left_anti").withColumn("only_in", F.lit("now")))


def latest(sources: DataFrame, key: list[str], priority: str) -> DataFrame:
    """Of several sources the row of the highest priority for each key."""
    return sources.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(priority)))).filter("_n = 1").drop("_n")


#: Arms (engine and model) of a study at most.
MOST_ARMS = 1000


def dense(cells: DataFrame, claims: DataFrame, arms: DataFrame) -> DataFrame:
    """A cell for each claim and arm (engine, model): those that are missing are pending."""
    listed = arms.limit(MOST_ARMS + 1).collect()
    if len(listed) > MOST_ARMS:
        raise ValueError(f"more than {MOST_ARMS} arms")
    every = F.array(*[F.struct(F.lit(r["engine"]).alias("engine"), F.lit(r["model"]).alias("model")) for r in listed])
    return claims.select("claim_id", F.inline(every)).join(cells, KEY, "left").withColumn("status", F.coalesce("status", F.lit("pending_rerun")))


def patched(cells: DataFrame, retries: DataFrame) -> DataFrame:
    """Cells of an outage take their retry's outcome."""
    r = retries.select(*KEY, "repeat", F.col("overall_pass").alias("_pass"), F.col("engine_error").alias("_error"), F.lit(True).alias("_retry"))
    joined = cells.join(r, [*KEY, "repeat"], "left")
    take = outage() & F.coalesce("_retry", F.lit(False))
    return joined.withColumn("overall_pass", F.when(take, F.col("_pass")).otherwise(F.col("overall_pass"))).withColumn("engine_error", F.when(take, F.col("_error")).otherwise(F.col("engine_error"))).drop("_pass", "_error", "_retry")


def carried_forward(prior: DataFrame, now: DataFrame, key: str = "model") -> DataFrame:
    return now.unionByName(prior.join(now.select(key).distinct(), key, "left_anti").select(*now.columns))


def tool_grid(cells: DataFrame, models: list[str]) -> DataFrame:
    """Mean calls of each tool for each model; a cell that did not call a tool counts as 0."""
    totals = cells.groupBy("model").agg(F.count(F.lit(1)).alias("cells"))
    calls = cells.select("model", F.explode("n_tool_calls_by_tool").alias("tool", "n")).groupBy("model", "tool").agg(F.sum("n").alias("n")).join(totals, "model")
    return calls.groupBy("tool").pivot("model", models).agg(F.first(F.col("n") / F.col("cells"))).na.fill(0.0, models)


def tool_errors(cells: DataFrame) -> DataFrame:
    """Errors by calls for each tool that was called."""
    calls = cells.select(F.explode("n_tool_calls_by_tool").alias("tool", "n")).groupBy("tool").agg(F.sum("n").alias("calls"))
    errors = cells.select(F.explode("n_tool_errors_by_tool").alias("tool", "n")).groupBy("tool").agg(F.sum("n").alias("errors"))
    return calls.filter("calls > 0").join(errors, "tool", "left").select("tool", "calls", F.coalesce("errors", F.lit(0)).alias("errors")).withColumn("rate", F.col("errors") / F.col("calls"))


def cost(cells: DataFrame, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """Dollars from tokens by each model's prices for a million (in, out)."""
    table = F.create_map(*[x for m, (a, b) in prices.items() for x in (F.lit(m), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")))])
    p = table[F.col("model")]
    return cells.withColumn("dollars", (F.col("input_tokens") * p.a + F.col("output_tokens") * p.b) / 1e6)


def fallback_usage(results: DataFrame, traces: DataFrame, agentic: str = "agentic") -> DataFrame:
    """Usage (input_tokens, output_tokens) by model, engine and claim with its source: a result's own, else its trace's.

    Results that broke give none, and only agentic cells have traces.  Traces whose claim has no result that
    was read are appended, unless they used nothing.
    """
    key = ["model", "engine", "claim_id"]
    read = results.filter(~has_error()).select(*key, "input_tokens", "output_tokens")
    traced = traces.select("model", F.lit(agentic).alias("engine"), "claim_id", F.col("input_tokens").alias("_in"), F.col("output_tokens").alias("_out"))
    own = F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()
    joined = read.join(traced, key, "left").select(*key, F.when(own, F.col("input_tokens")).otherwise(F.col("_in")).alias("input_tokens"), F.when(own, F.col("output_tokens")).otherwise(F.col("_out")).alias("output_tokens"), F.when(own, "results").otherwise("traces").alias("source"))
    alone = traced.join(read.select(*key), key, "left_anti").filter("_in <> 0 OR _out <> 0").select(*key, F.col("_in").alias("input_tokens"), F.col("_out").alias("output_tokens"), F.lit("traces").alias("source"))
    return joined.filter("input_tokens IS NOT NULL").unionByName(alone)


def matched_attempts(steps: DataFrame, cells: DataFrame, tools: list[str]) -> DataFrame:
    """Attempts joined with the cell (model, claim_id) whose calls of the given tools are the same, counted by tool.

    ``steps``: model, claim_id, run_id, tool_name, latency_ms; ``cells``: model, claim_id, n_tool_calls_by_tool.  For each
    cell the number of attempts that match it, the least and the most of their tool time, and the spread of a tie.
    """
    local = steps.filter(F.col("tool_name").isin(tools) & F.col("latency_ms").isNotNull())
    counts = local.groupBy("model", "claim_id", "run_id", "tool_name").agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum("latency_ms").alias("ms"))
    runs = counts.groupBy("model", "claim_id", "run_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("tool_name", "n")))).alias("print"), F.sum("ms").alias("ms"))
    wanted = F.filter(F.map_entries("n_tool_calls_by_tool"), lambda e: e.key.isin(tools))
    asked = cells.select("model", "claim_id", F.to_json(F.array_sort(F.transform(wanted, lambda e: F.struct(e.key.alias("tool_name"), e.value.cast("int").alias("n"))))).alias("print"))
    return runs.join(asked, ["model", "claim_id", "print"]).groupBy("model", "claim_id").agg(F.count(F.lit(1)).alias("attempts"), F.min("ms").alias("least_ms"), F.max("ms").alias("most_ms"), (F.max("ms") - F.min("ms")).alias("spread_ms"))


def claim_order(claims: DataFrame, component: Column) -> DataFrame:
    """``place`` of each row by component and claim: its place in the component, which is a partition of its own, after the rows of the components before, of which there are few."""
    rows = claims.withColumn("_component", component)
    own = F.row_number().over(Window.partitionBy("_component").orderBy("claim_id"))
    sizes = rows.groupBy("_component").agg(F.count(F.lit(1)).alias("_n"))
    # a row for each component: the only window without a partition is over these
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_component")) - F.col("_n")).select("_component", "_before")
    return rows.join(before, "_component").withColumn("place", own + F.col("_before")).drop("_component", "_before")
