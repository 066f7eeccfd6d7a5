"""Payloads of models as nested columns: fields dropped and filled at every depth, short renderings, bounded context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

# What stands for a number that a model left out, and the tools that are never excluded.
NO_NUMBER = -999.0
SUBMIT_TOOLS = ("submit_claim_result", "submit_extraction")

#: Bounds of a rendering and of the entries that are shown to a model again.
MOST_SHOWN, MOST_CHARS, MOST_ENTRIES, MOST_CONTEXT = 2, 240, 50, 4000


def rebuilt(value: Column, kind: DataType, field: Callable[[str, Column, DataType], Column | None]) -> Column:
    """The value with each field of its structs, at every depth, put through ``field`` (None drops it), the inner ones first."""
    if isinstance(kind, StructType):
        kept = []
        for f in kind.fields:
            new = field(f.name, rebuilt(value[f.name], f.dataType, field), f.dataType)
            if new is not None:
                kept.append(new.alias(f.name))
        return F.when(value.isNotNull(), F.struct(*kept)) if kept else F.lit(None)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: rebuilt(x, kind.elementType, field))
    return value


def without_fields(rows: DataFrame, names: set[str]) -> DataFrame:
    """The rows without the named fields, at every depth of structs and arrays."""
    keep = lambda name, value, _: None if name in names else value
    return rows.select(*[rebuilt(F.col(f"`{f.name}`"), f.dataType, keep).alias(f.name) for f in rows.schema.fields if f.name not in names])


def filled(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """The rows with nulls of the named fields, at every depth, replaced by their defaults."""
    fill = lambda name, value, _: F.coalesce(value, defaults[name]) if name in defaults else value
    return rows.select(*[fill(f.name, rebuilt(F.col(f"`{f.name}`"), f.dataType, fill), f.dataType).alias(f.name) for f in rows.schema.fields])


def offered(tools: Column, excluded: list[str], kept: tuple[str, ...] = SUBMIT_TOOLS) -> Column:
    """Tools of an array without the excluded ones; those that hand in an answer always stay."""
    return F.filter(tools, lambda t: t.isin(*kept) | ~t.isin(*excluded) if excluded else F.lit(True))


def shown_values(values: Column, fields: list[str], most: int = MOST_SHOWN, chars: int = MOST_CHARS) -> Column:
    """The first values of an array of structs as 'k=v, ...; ...', without null fields, cut to a number of characters."""
    one = lambda v: F.concat_ws(", ", *[F.when(v[f].isNotNull(), F.concat(F.lit(f"{f}="), v[f].cast("string"))) for f in fields])
    return F.substring(F.array_join(F.transform(F.slice(values, F.lit(1), F.lit(most)), one), "; "), 1, chars)


def tail_context(entries: Column, most: int = MOST_ENTRIES, chars: int = MOST_CONTEXT) -> Column:
    """The last entries of an array of JSON texts as one JSON array: as many as fit, ``most`` at most; '[]' where not even one does."""
    last = F.slice(entries, F.greatest(F.lit(1), F.size(entries) - most + 1), F.lit(most))
    # from the end on, the length of the array that starts with each entry: its brackets, the entries and the commas
    start = F.struct(F.lit(1).alias("n"), F.expr("cast(array() as array<string>)").alias("kept"))

    def step(s: Column, e: Column) -> Column:
        longer = s.n + F.length(e) + 1
        fits = (longer <= chars) & (s.n > 0)
        return F.struct(F.when(fits, longer).otherwise(F.lit(-1)).alias("n"), F.when(fits, F.concat(F.array(e), s.kept)).otherwise(s.kept).alias("kept"))

    return F.concat(F.lit("["), F.array_join(F.aggregate(F.reverse(last), start, step, lambda s: s.kept), ","), F.lit("]"))


def attested(entries: Column, text: Column, total_pages: Column) -> Column:
    """Entries (an array with start_page) whose page has a mark in the text and lies in the document."""
    marks = F.transform(F.regexp_extract_all(text, F.lit(r"--- PAGE (\d+) ---"), 1), lambda m: m.try_cast("long"))
    return F.filter(entries, lambda e: F.coalesce(F.array_contains(marks, e.start_page.cast("long")) & e.start_page.between(1, total_pages), F.lit(False)))


def described_marks(text: Column) -> Column:
    """The range of a text's page marks, honest about gaps."""
    marks = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"--- PAGE (\d+) ---"), 1), lambda m: m.try_cast("long")))
    span = F.concat(F.array_min(marks).cast("string"), F.lit("-"), F.array_max(marks).cast("string"))
    gaps = F.size(marks) != F.array_max(marks) - F.array_min(marks) + 1
    return F.when(F.size(marks) == 0, "none").otherwise(F.concat(span, F.when(gaps, " (gaps)").otherwise("")))


# Statuses of a call that no retry mends.
PERMANENT_STATUS = (401, 403)


def fails_for_good(status: Column, error: Column) -> Column:
    """Refused by status, or by a certificate."""
    return F.coalesce(status.isin(*PERMANENT_STATUS), F.lit(False)) | F.coalesce(F.rlike(error, F.lit(r"(?i)certificate|\bssl\b|\btls\b")), F.lit(False))


def as_flag(value: Column) -> Column:
    """true and false from a model's words; null for others, such as not_specified."""
    word = F.lower(F.trim(value))
    return F.when(word.isin("true", "yes"), F.lit(True)).when(word.isin("false", "no"), F.lit(False))
