"""Search over all pages of all documents at once, in three levels of exactness.

Level 1 finds a pattern as it is, level 2 lets any white space stand between its words, level 3 finds
its words in order with a bounded number of others between them.  A level counts for a document and a
pattern only where the level before has found nothing in the whole document.

A page is read once, for all patterns together: an automaton over the patterns finds levels 1 and 2
in time that grows with the page and its hits, not with the number of patterns, and level 3 looks at a
pattern only where its longest word stands in the page.  So pages are neither joined with patterns nor
shuffled; only hits are, by pattern and document.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import DASHES
from ..session import ship

#: Patterns are a query's own input: a set of more rows than this is refused, so what is sent to all tasks stays small.
MOST_PATTERNS = 10_000

#: Parts that the hits of one pattern are ranked in before they are ranked together.
SALTS = 64

MATCHES = "pattern_id long, doc_id long, page long, start int, end int, level int"


def _quoted(text: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


class _Folded(dict):
    """Maps each character to one that stands for it in either case, dashes to a hyphen; texts keep their length."""

    def __missing__(self, code: int) -> int:
        folded = chr(code).upper()
        folded = folded.lower() if len(folded) == 1 else folded
        self[code] = ord(folded) if len(folded) == 1 else code
        return self[code]


_FOLDED = _Folded(dict.fromkeys(map(ord, DASHES), ord("-")))
_SPACES = re.compile(r"\s+")


def collapsed(text: str) -> tuple[str, list[int]]:
    """The text with runs of white space as one space, and where each of its characters stood."""
    out, places, at = [], [], 0
    for gap in _SPACES.finditer(text):
        out += [text[at : gap.start()], " "]
        places += range(at, gap.start() + 1)
        at = gap.end()
    return "".join([*out, text[at:]]), [*places, *range(at, len(text))]


def ordered_path(tokens: list[str], wanted: list[str], first: int, gap: int) -> list[int] | None:
    """The first way to find the words in order from a given first one, with at most ``gap`` tokens between two: their places."""
    stack = [[first]]
    tried = set()
    while stack:
        path = stack.pop()
        if len(path) == len(wanted):
            return path
        at = path[-1]
        if (at, len(path)) in tried:
            continue
        tried.add((at, len(path)))
        nexts = [j for j in range(at + 1, min(at + gap + 2, len(tokens))) if tokens[j] == wanted[len(path)]]
        stack.extend([*path, j] for j in reversed(nexts))
    return None


def ordered_span(tokens: list[str], wanted: list[str], first: int, gap: int) -> int | None:
    """The place of the last word of that way."""
    path = ordered_path(tokens, wanted, first, gap)
    return path and path[-1]


def _tokens(folded: str) -> tuple[list[str], list[tuple[int, int]]]:
    found = [(m.group().strip(".,;:!?"), m.span()) for m in re.finditer(r"\S+", folded)]
    return [t for t, _ in found if t], [place for t, place in found if t]


def _automaton(words: dict[str, list[int]]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for word, ids in words.items():
        made.add_word(word, (len(word), ids))
    if words:
        made.make_automaton()
    return made


class Patterns:
    """What a worker needs to read pages for all patterns (pattern_id, pattern), up to a level."""

    def __init__(self, asked: list[tuple[int, str]], most_level: int = 3):
        literal, spaced, self.ordered, self.levels = {}, {}, {}, most_level
        for pattern_id, pattern in asked:
            folded = pattern.translate(_FOLDED)
            literal.setdefault(folded, []).append(pattern_id)
            words = _SPACES.sub(" ", folded).strip()
            if " " in words and most_level > 1:
                spaced.setdefault(words, []).append(pattern_id)
            tokens = _tokens(folded)[0]
            if len(tokens) > 2 and most_level > 2:
                self.ordered.setdefault(max(tokens, key=len), []).append((pattern_id, tokens, frozenset(tokens)))
        self.literal, self.spaced = _automaton(literal), _automaton(spaced)

    @staticmethod
    def _spans(automaton, text: str) -> Iterator[tuple[int, int, int]]:
        """pattern_id, start and end; those of one pattern do not overlap."""
        if not len(automaton):
            return
        after: dict[int, int] = {}
        for last, (size, ids) in automaton.iter(text):
            start = last + 1 - size
            for i in ids:
                if start >= after.get(i, 0):
                    after[i] = last + 1
                    yield i, start, last + 1

    def hits(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """pattern_id, start, end and level; of the levels of a pattern the first that finds something in the page."""
        folded, found = text.translate(_FOLDED), set()
        for i, start, end in self._spans(self.literal, folded):
            found.add(i)
            yield i, start, end, 1
        if len(self.spaced):
            one_spaced, places = collapsed(folded)
            second = [x for x in self._spans(self.spaced, one_spaced) if x[0] not in found]
            found.update(i for i, _, _ in second)
            for i, start, end in second:
                yield i, places[start], places[end - 1] + 1, 2
        if not self.ordered:
            return
        tokens, spans = _tokens(folded)
        held = set(tokens)
        for i, wanted, distinct in chain.from_iterable(self.ordered[t] for t in held if t in self.ordered):
            if i in found or not distinct <= held:
                continue
            gap = max(8, 2 * len(wanted))
            for first, token in enumerate(tokens):
                if token == wanted[0] and (last := ordered_span(tokens, wanted, first, gap)) is not None:
                    yield i, spans[first][0], spans[last][1], 3


@functools.lru_cache(4)
def _held(asked: tuple[tuple[int, str], ...], levels: int) -> Patterns:
    return Patterns(list(asked), levels)


def _found(asked: Broadcast, levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = _held(asked.value, levels)
        for batch in batches:
            out = [(i, doc_id, page, start, end, level) for doc_id, page, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for i, start, end, level in patterns.hits(text)]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in MATCHES.split(", ")])

    return run


def search(pages: DataFrame, patterns: DataFrame, most: int | None = 50, levels: int = 3) -> DataFrame:
    """Matches of patterns (pattern_id, pattern) in pages (doc_id, page, page_text), up to ``most`` of each pattern (None: all).

    An empty pattern is an error; each match has its level, and no level beyond ``levels`` is tried.  A page
    without text has no match, a null pattern none either.  Offsets count code points, the end is exclusive.
    """
    spark = ship(pages.sparkSession)
    rows = patterns.select(F.col("pattern_id").cast("long"), F.col("pattern").cast("string")).filter("pattern IS NOT NULL").limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns; search in parts")
    if any(not r[1].strip() for r in rows):
        raise ValueError("a pattern must not be empty")
    asked = spark.sparkContext.broadcast(tuple((r[0], r[1]) for r in rows))
    text = pages.select(F.col("doc_id").cast("long"), F.col("page").cast("long"), F.col("page_text").cast("string")).filter("page_text IS NOT NULL")
    every = text.mapInArrow(_found(asked, levels), MATCHES)
    if levels > 1:  # a document's first level counts for all its pages
        every = every.withColumn("best", F.min("level").over(Window.partitionBy("pattern_id", "doc_id"))).filter("level = best").drop("best")
    if most is None:
        return every
    order = ["level", "doc_id", "page", "start", "end"]
    salted = every.withColumn("salt", F.pmod(F.xxhash64("doc_id", "page"), F.lit(SALTS)))
    part = salted.withColumn("rank", F.row_number().over(Window.partitionBy("pattern_id", "salt").orderBy(*order))).filter(F.col("rank") <= most)
    return part.drop("salt").withColumn("rank", F.row_number().over(Window.partitionBy("pattern_id").orderBy(*order))).filter(F.col("rank") <= most)


def distinct_spans(matches: DataFrame, most: int) -> DataFrame:
    """Matches of several patterns: a span counts once, for the first pattern, and a document has at most ``most``."""
    once = matches.groupBy("doc_id", "page", "start", "end").agg(F.min("pattern_id").alias("pattern_id"))
    ranked = once.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "start", "end")))
    return ranked.filter(F.col("place") <= most)


def snippet(text: Column, start: Column, end: Column, around: int = 80) -> Column:
    """The match with what stands around it, one-spaced, with dots where the page goes on."""
    a, b = F.greatest(F.lit(0), start - around), F.least(F.length(text), end + around)
    middle = F.trim(F.regexp_replace(F.substring(text, a + 1, b - a), r"(?U)\s+", " "))
    return F.concat(F.when(a > 0, "...").otherwise(""), middle, F.when(b < F.length(text), "...").otherwise(""))


# What may stand between a line's start and a heading's title.
HEADING_START = r"(?i)(?:^|\n)[ \t]*(?:(?:chapter|section|appendix|part)\s+)?(?:(?:\d+(?:\.\d+)*|[A-Z](?:\.\d+)*)[.:)]*[ \t]+)?"


def heading_offset(text: Column, title: Column) -> Column:
    """0-based start of the line that is the title alone, or else of the last line that starts with it; null if there is none."""
    words = F.filter(F.split(title, r"\s+"), lambda w: w != "")
    body = F.concat(F.lit(HEADING_START), F.array_join(F.transform(words, _quoted), r"\s+"))
    alone = F.regexp_instr(text, F.concat(body, F.lit(r"(?=[ \t]*(?:\n|\z))")))
    before = F.regexp_extract_all(text, F.concat(F.lit(r"(?s)\A(.*)"), F.replace(body, F.lit("(?:^|\\n)"), F.lit("(?:\\A|\\n)")), F.lit(r"(?=\s|\z)")), 1)
    at = F.when(alone > 0, alone - 1).when(F.size(before) > 0, F.length(before[0]))
    # the offset is the line's own start, past the line break before it
    return F.when(at.isNotNull() & (F.substring(text, at + 1, F.lit(1)) == "\n"), at + 1).otherwise(at)


def section_at(matches: DataFrame, sections: DataFrame) -> DataFrame:
    """For each match the section that it lies in: of those that reach the page before its own, or start on its page at or before it, the last.

    ``sections``: doc_id, seq, start_page, end_page and ``offset`` of the heading in its page (null: not found).
    Both cases are joins by key: the pages that a section reaches, and the one after them, are exploded; its
    own first page is one row.  The last by page, offset (a section of an earlier page has 0) and seq counts.
    """
    reach = sections.filter("end_page >= start_page").select("doc_id", "seq", "start_page", F.lit(0).alias("offset"), F.explode(F.sequence(F.col("start_page") + 1, F.col("end_page") + 1)).alias("page"))
    own = sections.filter("offset IS NOT NULL").select("doc_id", "seq", "start_page", F.col("offset").cast("int").alias("offset"), F.col("start_page").alias("page"))
    best = F.max(F.struct("start_page", "offset", "seq")).alias("b")
    key = ["doc_id", "page", "start"]
    places = matches.select(*key).distinct()
    through = places.join(reach, ["doc_id", "page"]).groupBy(*key).agg(best)
    at = places.join(own, ["doc_id", "page"]).filter(F.col("offset") <= F.col("start")).groupBy(*key).agg(best)
    joined = through.unionByName(at).groupBy(*key).agg(F.max("b").alias("b"))
    return matches.join(joined.select(*key, F.col("b.seq").alias("seq")), key, "left")


def continued(next_page: Column, first_heading: Column) -> Column:
    """What of the next page still belongs to a section: all up to the first heading there; nothing if that stands at the top."""
    head = F.regexp_replace(F.substring(next_page, F.lit(1), first_heading), r"\s+\z", "")
    return F.when(first_heading > 0, F.when(head != "", head))
