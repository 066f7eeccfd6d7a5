"""Reports over cells and annotations: bounds by pooling unit, agreement of annotators, re-scores, summaries by model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import has_error, share
from .claims import is_numeric
from .grading import needle_hit
from .stats import upper_bound

#: The engine that summaries at a key of their own stand for, and its model.
DEFAULT_MODEL = "default"


def pooled_bounds(cells: DataFrame, by: str = "model") -> DataFrame:
    """The bound of a rate that was 0, for each unit that cells may be pooled by: the cell, the claim and model, the claim."""
    units = {"cell": F.count(F.lit(1)), "claim_and_model": F.count_distinct(F.struct("model", "claim_id")), "claim": F.count_distinct("claim_id")}
    counted = cells.groupBy(by).agg(*[n.alias(unit) for unit, n in units.items()])
    rows = F.array(*[F.struct(F.lit(unit).alias("unit"), F.col(unit).alias("n"), upper_bound(F.lit(0), F.col(unit)).alias("bound")) for unit in units])
    return counted.select(by, F.inline(rows))


def annotator_agreement(a: DataFrame, b: DataFrame, key: str = "cell_id") -> DataFrame:
    """One row over the cells that both have labelled (``labels``: an array): how many, how many with the same set, how many where both or neither say anything."""
    as_set = lambda c: F.array_sort(F.array_distinct(c))
    both = a.filter(F.col("labels").isNotNull()).select(key, F.col("labels").alias("a")).join(b.filter(F.col("labels").isNotNull()).select(key, F.col("labels").alias("b")), key)
    return both.agg(F.count(F.lit(1)).alias("both"), F.count_if(as_set("a") == as_set("b")).alias("same_set"), F.count_if((F.size("a") > 0) == (F.size("b") > 0)).alias("same_sign"))


def gold_against_auto(gold: DataFrame, auto: DataFrame, key: str = "cell_id") -> DataFrame:
    """Gold labels against a classifier's by label: found, missed and added, over all gold cells; a cell without an automatic label has none of them."""
    none = F.expr("cast(array() as array<string>)")
    both = gold.select(key, F.coalesce("labels", none).alias("g")).join(auto.select(key, F.coalesce("labels", none).alias("a")), key, "left").withColumn("a", F.coalesce("a", none))
    each = both.select(F.explode(F.array_union("g", "a")).alias("label"), "g", "a")
    held = lambda c: F.array_contains(c, F.col("label"))
    return each.groupBy("label").agg(F.count_if(held("g") & held("a")).alias("found"), F.count_if(held("g") & ~held("a")).alias("missed"), F.count_if(~held("g") & held("a")).alias("added"))


def needle_lengths(claims: DataFrame, column: str = "value_contains") -> DataFrame:
    """How many needles there are of each length, numeric ones and others."""
    each = claims.select(F.explode(column).alias("needle"))
    return each.groupBy(F.length("needle").alias("chars")).agg(F.count_if(is_numeric(F.col("needle"))).alias("numeric"), F.count_if(~is_numeric(F.col("needle"))).alias("words"))


def envelope(arms: DataFrame, unit: str = "claim_id", arm: str = "arm") -> DataFrame:
    """Units that each pair of arms got right: both, only one, only the other; sets are met, sizes never taken from each other."""
    held = arms.select(arm, unit).distinct()
    left, right = held.select(F.col(arm).alias("a"), unit), held.select(F.col(arm).alias("b"), unit)
    names = held.select(arm).distinct()
    pairs = names.select(F.col(arm).alias("a")).join(names.select(F.col(arm).alias("b")), F.col("a") < F.col("b"))  # a few arms
    met = left.join(right, unit).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    sizes = held.groupBy(arm).agg(F.count(F.lit(1)).alias("n"))
    out = pairs.join(met, ["a", "b"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    out = out.join(sizes.select(F.col(arm).alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col(arm).alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", "both", (F.col("na") - F.col("both")).alias("only_a"), (F.col("nb") - F.col("both")).alias("only_b"), (F.col("na") + F.col("nb") - F.col("both")).alias("either"))


def rescored(cells: DataFrame, by: str = "model") -> DataFrame:
    """Strict re-scores of extractions: cells have value_contains (needles), values and prose (the parts of an extraction), unit and overall_pass.

    ``strict``: all needles stand in the values; ``prose_only``: a pass whose needles stand in all of the
    extraction, but not in its values; ``unit_held``: the unit stands in the values; ``covered``: there is a needle at all.
    """
    every = lambda text: F.forall("value_contains", lambda n: needle_hit(text, n))
    values, whole = F.coalesce("values", F.lit("")), F.concat_ws(" ", "values", "prose")
    covered = F.coalesce(F.size("value_contains") > 0, F.lit(False))
    unit = F.coalesce(F.contains(F.lower(values), F.lower("unit")), F.lit(False))
    return cells.groupBy(by).agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(covered).alias("covered"), F.count_if(covered & every(values)).alias("strict"),
        F.count_if(covered & F.col("overall_pass") & every(whole) & ~every(values)).alias("prose_only"), F.count_if(unit).alias("unit_held"),
    )


def _calls(only: list[str] | None = None) -> Column:
    counts = F.coalesce("n_tool_calls_by_tool", F.expr("cast(map() as map<string,int>)"))
    some = F.map_filter(counts, lambda tool, _: tool.isin(only)) if only else counts
    return F.aggregate(F.map_values(some), F.lit(0), lambda a, n: a + n)


def model_summary(cells: DataFrame, tools: list[str], flagged: Column, by: str = "model") -> DataFrame:
    """Completed cells (ok and not broken) of each model: passes, strict passes, flags, and mean calls of all tools and of those that navigate."""
    done = cells.filter((F.col("status") == "ok") & ~has_error())
    return done.groupBy(by).agg(
        F.count(F.lit(1)).alias("completed"), share(F.col("overall_pass")).alias("fidelity"), share(F.col("overall_pass") & F.col("value_pass")).alias("strict"),
        F.count_if(flagged).alias("flags"), F.avg(_calls()).alias("mean_calls"), F.avg(_calls(tools)).alias("mean_nav_calls"),
    )


def imported_repeat(cells: DataFrame, wanted: DataFrame, repeat: int = 1) -> DataFrame:
    """A cell of one repeat for each wanted claim, engine and model: the cell that there is, or a failed one that says so."""
    key = ["claim_id", "engine", "model"]
    have = cells.select(*key, F.struct("overall_pass", "confidence", "verdict", "engine_error").alias("cell"))
    failed = F.struct(F.lit(False).alias("overall_pass"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("verdict"), F.lit("no cell").alias("engine_error"))
    return wanted.select(*key).join(have, key, "left").select(*key, F.lit(repeat).alias("repeat"), F.coalesce("cell", failed).alias("cell")).select(*key, "repeat", "cell.*")


def summary_entries(cells: DataFrame, default_model: str) -> DataFrame:
    """model, key ('claim|engine') and the cell as JSON; the default model's entries also stand under DEFAULT_MODEL."""
    fields = [c for c in cells.columns if c not in ("claim_id", "engine", "model")]
    rows = cells.select("model", F.concat_ws("|", "claim_id", "engine").alias("key"), F.to_json(F.struct(*fields)).alias("cell"))
    return rows.unionByName(rows.filter(F.col("model") == default_model).withColumn("model", F.lit(DEFAULT_MODEL)))


def section_numbers(sections: DataFrame, doc: str = "doc_id") -> DataFrame:
    """number and node_id of the titles that open with a number of two places or more; of equal ones the last."""
    number = F.regexp_extract(F.trim("title"), r"^([0-9]+(?:\.[0-9]+)+)", 1)
    return sections.withColumn("number", number).filter("number <> ''").groupBy(doc, "number").agg(F.max_by("node_id", "seq").alias("node_id"))


def resolved_references(references: DataFrame, sections: DataFrame, doc: str = "doc_id") -> DataFrame:
    """References (type, target) with the node of the section that they name; null for figures, tables and unknown numbers."""
    numbers = section_numbers(sections, doc).withColumn("type", F.lit("section")).withColumnRenamed("number", "target")
    return references.join(numbers, [doc, "type", "target"], "left")


def revision_means(cells: DataFrame, tools: list[str]) -> DataFrame:
    """Mean calls of the given tools over the passing cells of each model and revision, and their number; a revision without any has a mean of 0."""
    passing = F.col("overall_pass") & ~has_error()
    return cells.groupBy("model", "revision").agg(F.count_if(passing).alias("cells"), F.coalesce(F.avg(F.when(passing, _calls(tools))), F.lit(0.0)).alias("mean_calls"))


def chronology(runs: DataFrame, cut: Column, by: str = "model") -> DataFrame:
    """Runs that started before and after a point in time, and the first and last start; a run without a time is counted apart."""
    at = F.col("started")
    return runs.groupBy(by).agg(F.count_if(at <= cut).alias("before"), F.count_if(at > cut).alias("after"), F.count_if(at.isNull()).alias("unknown"), F.min(at).alias("first"), F.max(at).alias("last"))


def batch_outcomes(results: DataFrame, error: str = "error") -> DataFrame:
    """How many documents of a batch there are, how many were built and how many failed."""
    failed = F.coalesce(F.col(error), F.lit("")) != ""
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if(~failed).alias("success_count"), F.count_if(failed).alias("failure_count"))


def divergence(measured: DataFrame) -> DataFrame:
    """One row: claims by verdict (null where a claim's data could not be loaded), and whether the scan is a result at all: only if none was left out."""
    verdicts = [F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("pass", "inconclusive", "fail")]
    skipped = F.count_if(F.col("verdict").isNull())
    return measured.agg(*verdicts, skipped.alias("n_skipped"), (skipped == 0).alias("complete"))


def clean_arm(cells: DataFrame, flagged: Column, agentic: str = "agentic") -> DataFrame:
    """The detector over clean cells: how many agentic ones, how many it looks at (they passed and did not break), how many it flags, and that rate."""
    arm = cells.filter(F.col("engine") == agentic)
    engaged = F.coalesce("overall_pass", F.lit(False)) & ~has_error()
    out = arm.agg(F.count(F.lit(1)).alias("total"), F.count_if(engaged).alias("evaluated"), F.count_if(engaged & flagged).alias("flagged"))
    return out.withColumn("fp_rate", F.coalesce(F.try_divide("flagged", "evaluated"), F.lit(0.0)))


def corpus_shape(documents: DataFrame, figures: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Pages, figures, pictures, captions and whole characters a page of each document; -1 characters where pages or text are unknown."""
    counts = figures.groupBy(doc).agg(F.count(F.lit(1)).alias("figures"), F.count_if(F.col("kind") == "raster").alias("raster"), F.count_if(F.trim("caption") != "").alias("captioned"))
    density = F.when((F.col("total_pages") > 0) & F.col("n_chars").isNotNull(), F.floor(F.col("n_chars") / F.col("total_pages"))).otherwise(-1)
    zero = {c: 0 for c in ("figures", "raster", "captioned")}
    return documents.join(counts, doc, "left").select(doc, "total_pages", *zero, density.cast("long").alias("chars_per_page")).na.fill(zero)


def grouped_events(events: DataFrame) -> DataFrame:
    """Events by model, claim and engine in order of step, without session marks and events of no claim: the kinds of each group, and how many."""
    known = events.filter((F.col("kind") != "session_start") & (F.coalesce("claim_id", F.lit("")) != "") & (F.coalesce("engine", F.lit("")) != ""))
    return known.groupBy("model", "claim_id", "engine").agg(F.count(F.lit(1)).alias("events"), F.transform(F.array_sort(F.collect_list(F.struct("step", "kind"))), lambda x: x.kind).alias("kinds"))
