"""Grading of extractions against what was expected."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONFIDENCE_FLOOR, LIST_SHARE = 0.7, 0.7


def number_tokens(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"([-+]?\d[\d,]*(?:\.\d+)?(?:[eE][-+]?\d+)?)"), 1)
    return F.filter(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")), lambda v: v.isNotNull())


def needle_hit(text: Column, needle: Column) -> Column:
    """A number must stand there as a number, anything else as a part of the text in any case."""
    number = F.replace(needle, F.lit(","), F.lit("")).try_cast("double")
    return F.when(number.isNotNull(), F.exists(number_tokens(text), lambda v: F.abs(v - number) < 1e-9)).otherwise(F.contains(F.lower(text), F.lower(needle)))


def all_needles(text: Column, needles: Column) -> Column:
    return F.forall(needles, lambda n: needle_hit(text, n))


def list_share(found: Column, expected: Column) -> Column:
    """The share of expected entries that some found entry holds; nothing expected is all of it."""
    hit = F.size(F.filter(expected, lambda e: F.exists(found, lambda x: F.contains(F.lower(x), F.lower(e)))))
    return F.coalesce(F.try_divide(hit.cast("double"), F.size(expected).cast("double")), F.lit(1.0))


def shown_value(low: Column, typical: Column, high: Column, unit: Column) -> Column:
    return F.concat_ws(" ", low.cast("string"), typical.cast("string"), high.cast("string"), unit)


def graded(found: Column, expected: Column, confidence: Column, value_ok: Column, floor: float = CONFIDENCE_FLOOR) -> Column:
    """overall_pass and its reasons: a missing result is no finding; values count only where something is to be found."""
    actual = F.coalesce(found, F.lit(False))
    reasons = F.array_compact(
        F.array(
            F.when(actual != expected, F.concat(F.lit("Found mismatch: "), F.when(expected, "expected").otherwise("not expected"))),
            F.when(expected & actual & (F.coalesce(confidence, F.lit(0.0)) < floor), F.lit("confidence too low")),
            F.when(expected & actual & ~value_ok, F.lit("value mismatch")),
        )
    )
    return F.struct((F.size(reasons) == 0).alias("overall_pass"), F.array_join(reasons, "; ").alias("reason"))
