"""Text as column expressions: normal forms, predicates, annotations.  All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dashes that count as a hyphen.
DASHES = "‐‑‒–—―−"

# What marks a line as a bullet.
BULLET = r"(?U)^\s*(?:[•▪○◦‣·∙*]|[-–—](?:\s|$))"

# Headings of a features page.
FEATURES_HEADINGS = ["features", "general description"]

# Openings of a caption, and the longest block that can be furniture.
CAPTION_OPENING = r"(?i)^(figure\b|fig\.|table\b|chart\b)"
LONGEST_FURNITURE = 200


def one_spaced(text: Column) -> Column:
    """Runs of white space as one space, without any at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def furniture_key(text: Column) -> Column:
    """One-spaced, with each run of digits as '#', so page numbers do not tell recurring lines apart."""
    return F.regexp_replace(one_spaced(text), r"(?U)\d+", "#")


def has_letter(text: Column) -> Column:
    return F.rlike(text, F.lit(r"\p{L}"))


def may_be_furniture(text: Column) -> Column:
    """Not empty, not too long and not the opening of a caption."""
    plain = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return (F.length(plain) > 0) & (F.length(plain) <= LONGEST_FURNITURE) & ~F.rlike(plain, F.lit(CAPTION_OPENING))


def fold_dashes(text: Column) -> Column:
    return F.translate(text, DASHES, "-" * len(DASHES))


def search_token(token: Column, case_sensitive: bool = False) -> Column:
    """A token as search compares it: plain hyphens, no closing punctuation, lower case."""
    plain = F.btrim(fold_dashes(token), F.lit(".,;:!?"))
    return plain if case_sensitive else F.lower(plain)


def lines(text: Column) -> Column:
    return F.split(text, r"\R")


def bullet_count(text: Column) -> Column:
    return F.size(F.filter(lines(text), lambda x: F.rlike(x, F.lit(BULLET))))


def clipped(text: Column, most: int) -> Column:
    """Cut to ``most`` characters with '...' at the end where it is longer."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("..."))).otherwise(text)


# Characters that a file name does not take, and its longest length.
FILE_NAME_BAD = r'[<>:"/\\|?*\x00-\x1F]'
FILE_NAME_LONGEST = 200


def file_name(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, FILE_NAME_BAD, "_"), 1, FILE_NAME_LONGEST)


# Patterns of footnote marks, of references to other places, and of tables that go on.
MARK_BARE = r"(?<!\d)([1-9]\d?)\)"
MARK_NOTE = r"(Note\s+\d+)"
MARK_PAREN = r"\((\d+)\)"
REF_FIGURE = r"(?:[Ss]ee|[Rr]efer\s+to)\s+((?:Figure|Fig\.)\s+[\d\-\.]+)"
REF_TABLE = r"(?:[Ss]ee|[Rr]efer\s+to)\s+(Table\s+[\d\-\.]+)"
REF_SECTION = r"(?:[Ss]ee|[Rr]efer\s+to)\s+[Ss]ection\s+([\d]+(?:\.[\d]+)+)"
CONTINUED_TABLE = r"(Table\s+[\d\-\.]+\s+.+?)\s*\((?:[Cc]ontinued|[Cc]ont\.)\)"
CONTINUATION_LINE = r"(?i)[ \t]*(\S.{2,200}?)[ \t]*\((?:continued|cont\.)\)[ \t]*$"


def footnote_marks(text: Column) -> Column:
    """Bare marks, then notes, then marks in parentheses up to 20; each once."""
    bare = F.transform(F.regexp_extract_all(text, F.lit(MARK_BARE), 1), lambda x: F.concat(x, F.lit(")")))
    notes = F.regexp_extract_all(text, F.lit(MARK_NOTE), 1)
    inner = F.filter(F.regexp_extract_all(text, F.lit(MARK_PAREN), 1), lambda x: (F.length(x) <= 2) & (x.cast("int") <= 20))
    return F.array_distinct(F.concat(bare, notes, F.transform(inner, lambda x: F.concat(F.lit("("), x, F.lit(")")))))


def cross_references(text: Column) -> Column:
    """An array of (type, target): figures, then tables, then sections; each once."""

    def found(pattern: str, kind: str) -> Column:
        # a closing full stop or hyphen ends the sentence, not the number
        targets = F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda x: F.regexp_replace(x, r"[.\-]+$", ""))
        return F.transform(F.array_distinct(targets), lambda x: F.struct(F.lit(kind).alias("type"), x.alias("target")))

    return F.concat(found(REF_FIGURE, "figure"), found(REF_TABLE, "table"), found(REF_SECTION, "section"))


def continued_tables(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CONTINUED_TABLE), 1))


def boundary_titles(next_page: Column) -> Column:
    """Titles marked as continued in the first five lines that are not blank."""
    first = F.slice(F.filter(lines(next_page), lambda x: F.trim(x) != ""), 1, 5)
    return F.filter(F.transform(first, lambda x: F.regexp_extract(x, CONTINUATION_LINE, 1)), lambda x: x != "")


def framed(text: Column, tag: str) -> Column:
    """Text from outside in its own tag, which it cannot close."""
    return F.concat(F.lit(f"<{tag}>\n"), F.regexp_replace(text, rf"(?i)<(/?{tag})", "&lt;$1"), F.lit(f"\n</{tag}>"))


def contains_all(text: Column, terms: Column) -> Column:
    return F.forall(terms, lambda t: F.contains(F.lower(text), F.lower(t)))
