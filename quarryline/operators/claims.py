"""Claims: what an agent may see of them, and leaks of their numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grading import all_needles
from .search import MOST_PATTERNS, search


def visible(claims: DataFrame, allowed: list[str]) -> DataFrame:
    """Only the columns of the list: a new column stays hidden until it is entered there."""
    return claims.select(*[c for c in claims.columns if c in allowed])


def leaks_number(text: Column, number: Column) -> Column:
    """The number stands in the text with no digit on either side."""
    return F.rlike(text, F.concat(F.lit(r"(?<!\d)\Q"), number, F.lit(r"\E(?!\d)")))


def without_sentences(text: Column, pattern: str) -> Column:
    """Sentences that match go."""
    return F.array_join(F.filter(F.split(text, r"(?<=[.])\s+"), lambda s: ~F.rlike(s, F.lit(pattern))), " ")


def unique_ids(claims: DataFrame, key: str = "id") -> DataFrame:
    """The claims, or an error at run time where two share an id."""
    twice = claims.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    checked = twice.select(key, F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("two claims share the id "), F.col(key).cast("string")))).otherwise(F.col("_n")).alias("_n"))
    return claims.join(checked.filter("_n = 1").select(key), key)


def found_in(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """needle and item_id of the texts (item_id, text) that hold it in either case; needles are searched in parts of a bounded number."""
    each = needles.select("needle").filter("needle <> ''").distinct()
    parts = 1 + 2 * each.count() // MOST_PATTERNS
    numbered = each.withColumn("pattern_id", F.xxhash64("needle"))
    pages = texts.select(F.col("item_id").alias("doc_id"), F.lit(0).alias("page"), F.col("text").alias("page_text"))
    hits = [search(pages, numbered.filter(F.pmod("pattern_id", F.lit(parts)) == k).select("pattern_id", F.col("needle").alias("pattern")), None, levels=1).select("pattern_id", "doc_id").distinct() for k in range(parts)]
    return reduce(DataFrame.unionByName, hits).join(numbered, "pattern_id").select("needle", F.col("doc_id").alias("item_id"))


def permutation_control(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """For each claim (item_id, needle) how many texts of other claims hold all of its needles."""
    own = needles.groupBy("item_id").agg(F.count_distinct("needle").alias("all_needles"))
    hits = found_in(needles, texts).withColumnRenamed("item_id", "other_id")
    met = needles.distinct().join(hits, "needle").filter("item_id <> other_id").groupBy("item_id", "other_id").agg(F.count(F.lit(1)).alias("held"))
    return met.join(own, "item_id").filter("held = all_needles").groupBy("item_id").agg(F.count(F.lit(1)).alias("others"))


def is_numeric(needle: Column) -> Column:
    return F.rlike(needle, F.lit(r"\d"))


def leak_audit(needles: DataFrame, files: DataFrame, least: int = 3) -> DataFrame:
    """For each file (file_id, text) the needles of ``least`` characters and more that stand in it, exact, with no digit on either side and no full stop before them.

    ``leaked`` are those with a digit, which are answers; ``exposed`` the others, which are meant to be seen.
    """
    asked = needles.filter(F.length("needle") >= least).select("needle").distinct().withColumn("pattern_id", F.xxhash64("needle"))
    parts = 1 + 2 * asked.count() // MOST_PATTERNS
    pages = files.select(F.col("file_id").alias("doc_id"), F.lit(0).alias("page"), F.col("text").alias("page_text"))
    hits = reduce(DataFrame.unionByName, [search(pages, asked.filter(F.pmod("pattern_id", F.lit(parts)) == k).select("pattern_id", F.col("needle").alias("pattern")), None, levels=1) for k in range(parts)])
    # the search folds case and skips overlapping places: candidates, which the file's text confirms
    found = hits.select("pattern_id", F.col("doc_id").alias("file_id")).distinct().join(asked, "pattern_id").join(files, "file_id")
    exact = found.filter(F.rlike("text", F.concat(F.lit(r"(?<![\d.])\Q"), F.replace("needle", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\d)"))))
    names = lambda numeric: F.array_sort(F.collect_set(F.when(is_numeric(F.col("needle")) == numeric, F.col("needle"))))
    return exact.groupBy("file_id").agg(names(True).alias("leaked"), names(False).alias("exposed"))


#: The confidence that a claim asks for where it states none.
DEFAULT_FLOOR = 0.85


def rederivation(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Our claims with a second annotator's, who saw none of ours: which parts are the same.

    Both have id, value_contains (an array) and confidence_min.  Needles with a digit and those without are
    compared apart, the latter in lower case; a floor that ours doesn't state is DEFAULT_FLOOR, one that theirs
    doesn't state is not the same.  ``answered`` is false where they gave no needle.
    """
    trimmed = lambda c: F.transform(F.coalesce(c, F.expr("cast(array() as array<string>)")), lambda n: F.trim(n))
    kind = lambda c, numeric: F.array_sort(F.array_distinct(F.transform(F.filter(trimmed(c), lambda n: is_numeric(n) == numeric), lambda n: n if numeric else F.lower(n))))
    both = ours.select("id", F.col("value_contains").alias("a"), F.col("confidence_min").alias("floor")).join(theirs.select("id", F.col("value_contains").alias("b"), F.col("confidence_min").alias("their_floor")), "id", "left")
    answered = F.size(F.coalesce("b", F.expr("cast(array() as array<string>)"))) > 0
    same_floor = F.coalesce(F.abs(F.col("their_floor") - F.coalesce("floor", F.lit(DEFAULT_FLOOR))) < 1e-9, F.lit(False))
    same = lambda numeric: kind(F.col("a"), numeric) == kind(F.col("b"), numeric)
    return both.select("id", answered.alias("answered"), (answered & same(True)).alias("same_numbers"), (answered & same(False)).alias("same_words"), (answered & same_floor).alias("same_floor")).withColumn("exact", F.col("same_numbers") & F.col("same_words") & F.col("same_floor"))


def merged_phases(first: DataFrame, second: DataFrame, key: str, second_fields: list[str]) -> DataFrame:
    """Records of two phases: every field from the first but ``second_fields``, which only the second may set; claims that it lacks have none."""
    own = [c for c in first.columns if c not in second_fields]
    return first.select(*own).join(second.select(key, *second_fields), key, "left").select(*own, *second_fields)


# Parts of rationales and of condition names that sort inconclusive verdicts.
ENGAGEMENT, RESOLUTION = "engagement-diagnostic", "cannot resolve this claim"
REFERENCE_MARKS, STIMULUS_MARKS = ("reference", "calibration"), ("controlled", "ripple", "sweep")


def inconclusive_class(rationale: Column, unmatched: Column) -> Column:
    """(class, sub_class) of an inconclusive verdict, from its rationale and the names of the conditions that were not met."""
    names = F.lower(F.array_join(F.coalesce(unmatched, F.expr("cast(array() as array<string>)")), " "))
    why = F.coalesce(rationale, F.lit(""))
    held = lambda marks: reduce(lambda a, b: a | b, [F.contains(names, F.lit(m)) for m in marks])
    both = lambda a, b: F.struct(F.lit(a).alias("class"), F.lit(b).alias("sub_class"))
    return (
        F.when(F.contains(why, F.lit(ENGAGEMENT)), both("engagement_only", "engagement_only"))
        .when(F.contains(why, F.lit(RESOLUTION)), both("resolution_limited", "resolution_limited"))
        .when(held(REFERENCE_MARKS), both("no_reference", "no_reference"))
        .when(held(STIMULUS_MARKS), both("unmatched_condition", "uncontrolled_stimulus"))
        .otherwise(both("unmatched_condition", "unobservable_internal"))
    )


def inconclusive_taxonomy(cells: DataFrame, engines: tuple[str, ...] = ("agentic", "baseline")) -> DataFrame:
    """Claims by class of their inconclusive verdict; a verdict is a claim's, so any cell tells it: the first by engine, then by model."""
    rank = F.coalesce(*[F.when(F.col("engine") == e, F.lit(k)) for k, e in enumerate(engines)])
    one = cells.filter(rank.isNotNull()).groupBy("claim_id").agg(F.min_by(F.struct("verdict", "rationale", "unmatched_conditions"), F.struct(rank, F.col("model"))).alias("cell"))
    kind = inconclusive_class(F.col("cell.rationale"), F.col("cell.unmatched_conditions"))
    sorted_ = one.filter("cell.verdict = 'inconclusive'").select("claim_id", kind.alias("kind"))
    return sorted_.groupBy("kind.class", "kind.sub_class").agg(F.count(F.lit(1)).alias("claims"), F.array_sort(F.collect_list("claim_id")).alias("claim_ids"))


def verdict_flips(cells: DataFrame, by: str = "model") -> DataFrame:
    """Cells graded by our needles and by another annotator's: cells have extraction, ours, theirs (arrays) and overall_pass, the archived verdict.

    Only where our own needles give the archived verdict again (``reproduced``, the control) does a different one by
    theirs count as a flip, to a pass or to a failure; a cell without needles of theirs is not graded.
    """
    by_ours, by_theirs = all_needles(F.col("extraction"), F.col("ours")), all_needles(F.col("extraction"), F.col("theirs"))
    known = F.coalesce(F.size("theirs") > 0, F.lit(False))
    same = F.coalesce(by_ours == F.col("overall_pass"), F.lit(False))
    return cells.groupBy(by).agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(known & same).alias("reproduced"),
        F.count_if(known & same & F.col("overall_pass") & ~by_theirs).alias("to_fail"), F.count_if(known & same & ~F.col("overall_pass") & by_theirs).alias("to_pass"),
    )


def regraded(archived: DataFrame, claims: DataFrame) -> DataFrame:
    """Archived cells (claim_id, model, extraction, overall_pass) graded again by their claims (id, value_contains): ``bucket`` says how that went.

    no_claim, no_extraction, ungradable (the claim has no needle), agree or disagree.
    """
    joined = archived.join(claims.select(F.col("id").alias("claim_id"), F.lit(True).alias("_known"), "value_contains"), "claim_id", "left")
    again = all_needles(F.col("extraction"), F.col("value_contains"))
    bucket = (
        F.when(F.col("_known").isNull(), "no_claim")
        .when(F.trim(F.coalesce("extraction", F.lit(""))) == "", "no_extraction")
        .when(F.coalesce(F.size("value_contains"), F.lit(0)) <= 0, "ungradable")
        .when(again.eqNullSafe(F.col("overall_pass")), "agree")
        .otherwise("disagree")
    )
    return joined.withColumn("bucket", bucket).drop("_known")


def uncovered(claims: DataFrame, archived: DataFrame) -> DataFrame:
    """Claims that no archived cell is of."""
    return claims.join(archived.select(F.col("claim_id").alias("id")).distinct(), "id", "left_anti")
