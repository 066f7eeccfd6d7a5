"""Secret scans by a trigram inverted index, in DataFrame operations only.

``trigram_query`` derives from a rule's regular expression the trigrams that each match must
hold: a choice of sets, one of which must be in the text.  The index has postings (trigram,
document) of the trigrams that some rule asks for, and is dealt by document; the postings of a
document are intersected into a bit mask and give the rules for which the document is a candidate.  Candidates are then
verified by the expression itself over the whole text.  A rule without mandatory trigrams scans
all texts.

Matches are leftmost and do not overlap within a rule.  Positions count code points, the end
exclusive.  They are found by marking each match with a character that the text does not hold
(where it holds it, a copy for scanning has another one in its place) and summing up the lengths
of the parts.  A null text counts as empty: no spans.  Rows that share a doc_id, or have none,
are scanned one by one; the index only ever offers more candidates.  An empty table gives an
empty result.  Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, texts


@dataclass(frozen=True)
class Rule:
    """``valued``: the number of a group of which a match needs ``least`` characters; matches with fewer are dropped."""

    kind: str
    pattern: str
    valued: int = 0
    least: int = 0


#: The base rules.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)

#: Formats that their issuers document.
MORE_RULES = (
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)

RULES = BASE_RULES + MORE_RULES

#: Strings that a part of an expression may stand for, at most, before they are given up for their trigrams.
MOST_STRINGS = 64

#: Trigrams that a set keeps, at most: a match holds them all, so it holds some of them as well.
MOST_TRIGRAMS = 4

Choice = frozenset  # of sets of trigrams: the text must hold all of one set


def _all_of(a: Choice | None, b: Choice | None) -> Choice | None:
    if a is None or b is None:
        return a if b is None else b
    return _absorbed({x | y for x, y in product(a, b)})


def _absorbed(sets) -> Choice | None:
    """Without the sets that hold another one; None (anything may match) if one set is empty."""
    least = frozenset(s for s in map(frozenset, sets) if not any(t < s for t in map(frozenset, sets)))
    return None if frozenset() in least else least


def _trigrams(strings: set[str]) -> Choice | None:
    return _absorbed([{s[k : k + 3] for k in range(len(s) - 2)} for s in strings])


def _parts(items) -> tuple[set[str] | None, Choice | None]:
    """The strings that a sequence may stand for (None: too many), and what its matches must hold besides."""
    strings, needed, whole = {""}, None, True
    for item in items:
        some, more = _part(item)
        needed = _all_of(needed, more)
        joined = {a + b for a, b in product(strings, some)} if some is not None and len(strings) * len(some) <= MOST_STRINGS else None
        if joined is None:
            needed, strings, whole = _all_of(needed, _trigrams(strings)), some if some is not None else {""}, False
        else:
            strings = joined
    return (strings, needed) if whole else (None, _all_of(needed, _trigrams(strings)))


def _part(item) -> tuple[set[str] | None, Choice | None]:
    op, value = item
    if op is C.LITERAL:
        return {chr(value).lower()}, None
    if op is C.IN:
        found: set[str] = set()
        for kind, x in value:
            if kind is C.LITERAL:
                found.add(chr(x).lower())
            elif kind is C.RANGE and x[1] - x[0] < 8:
                found |= {chr(k).lower() for k in range(x[0], x[1] + 1)}
            else:
                return None, None
        return (found, None) if len(found) <= 8 else (None, None)
    if op is C.SUBPATTERN:
        return _parts(value[-1])
    if op is C.BRANCH:
        each = [_parts(x) for x in value[1]]
        if all(s is not None and n is None for s, n in each) and len(set().union(*(s for s, _ in each))) <= MOST_STRINGS:
            return set().union(*(s for s, _ in each)), None
        needs = [_all_of(n, _trigrams(s)) if s is not None else n for s, n in each]
        return None, None if None in needs else _absorbed(set().union(*needs))
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        least, most, inner = value
        some, needed = _parts(inner)
        if (least, most) == (0, 1) and some is not None and needed is None:
            return some | {""}, None
        return (None, _all_of(needed, _trigrams(some)) if some is not None else needed) if least else (None, None)
    return (set(), None) if op is C.AT else (None, None)


def trigram_query(pattern: str) -> Choice | None:
    """Sets of lower-case trigrams, one of which each match holds whole; None where a match needs none."""
    strings, needed = _parts(_parser.parse(pattern))
    query = _all_of(needed, _trigrams(strings)) if strings is not None else needed
    return query and frozenset(frozenset(sorted(s)[:: -(-len(s) // MOST_TRIGRAMS)]) for s in query)


def _key() -> Column:
    """By which postings find their rows: rows equal in doc_id and text share one, and have the same postings."""
    return F.xxhash64("doc_id", "text")


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """gram (its number in ``grams``) and doc_key, once for each row of ``docs`` that holds it in either case."""
    lower = F.lower("text")
    held = F.array(*[F.when(F.contains(lower, F.lit(g)), F.lit(k)) for k, g in enumerate(grams)])
    return docs.select(_key().alias("doc_key"), F.explode(F.array_compact(held)).alias("gram"))


def candidates(index: DataFrame, grams: list[str], rules: tuple[Rule, ...]) -> DataFrame:
    """doc_key and a bit for each rule that the document's postings allow."""
    number = {g: k for k, g in enumerate(grams)}
    bits = index.groupBy("doc_key").agg(F.bit_or(F.expr("shiftleft(1L, gram)")).alias("held"))
    rule_bits = F.lit(0).cast("long")
    for k, rule in enumerate(rules):
        masks = [sum(1 << number[g] for g in s) for s in trigram_query(rule.pattern) or ()]
        if masks:
            allowed = reduce(lambda a, b: a | b, [F.col("held").bitwiseAND(F.lit(m)) == F.lit(m) for m in masks])
            rule_bits = rule_bits + F.when(allowed, F.lit(1 << k)).otherwise(F.lit(0))
    return bits.select("doc_key", rule_bits.alias("rule_bits")).filter("rule_bits > 0")


#: The mark of a match, and what stands for it where a text holds it; no rule's pattern can match either.
_MARK, _OTHER = "\ue000", "\ue001"

SPAN = "struct<start:int,kind_no:int,stop:int,kind:string>"

#: Elements that are summed up in one go; arrays grow by copies, so longer ones are summed in two levels.
CHUNK = 128


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often it is named there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def before_each(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each number of an array the sum (by ``add``, from 0) of those before it, in time that grows little faster than the array."""

    def running(numbers: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(numbers, start, lambda s, x: F.struct(add(s.at, x).alias("at"), F.concat(s.out, F.array(s.at)).alias("out")), lambda s: s.out)

    def two_levels(v: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda k: F.slice(v, k * CHUNK + 1, F.lit(CHUNK)))
        return _bound(chunks, lambda c: F.flatten(F.zip_with(c, running(F.transform(c, lambda x: F.aggregate(x, F.lit(0), add)), F.lit(0)), running)))

    return _bound(values, lambda v: F.when(F.size(v) > CHUNK, two_levels(v)).when(F.size(v) > 0, running(v, F.lit(0))).otherwise(F.expr("cast(array() as array<int>)")))


def spans_of(text: Column, rule: Rule, number: int, measure: Callable[[Column], Column] = F.length) -> Column:
    """An array of the rule's spans in the text; ``measure`` says what positions count."""
    parts = F.split(F.regexp_replace(F.translate(text, _MARK, _OTHER), rule.pattern, f"{_MARK}$0{_MARK}"), _MARK)
    value = lambda part: F.length(F.regexp_extract(part, rule.pattern, rule.valued)) >= rule.least
    none = F.expr(f"cast(array() as array<{SPAN}>)")

    def found(p: Column) -> Column:
        places = F.transform(before_each(F.transform(p, measure), lambda a, x: a + x), lambda at, i: F.struct(at.alias("at"), (i % 2 == 1).alias("inside")))
        each = F.zip_with(p, places, lambda part, at: F.when(at.inside & value(part), F.struct(at.at.alias("start"), F.lit(number).alias("kind_no"), (at.at + measure(part)).alias("stop"), F.lit(rule.kind).alias("kind"))))
        return F.array_compact(each)

    # a rule with a least length of the whole match needs no look at shorter ones
    return F.when(F.rlike(text, F.lit(rule.pattern)), _bound(parts, found)).otherwise(none)


def _narrowed(rule: Rule) -> Rule:
    """The same spans with the least length inside the expression: where a whole match is one run of a class, a run that is too short has no longer part."""
    if rule.valued == 0 and rule.pattern.endswith("]+") and rule.least > 1:
        head = rule.pattern[: rule.pattern.rindex("[")]
        if re.fullmatch(r"\w*", head):
            return Rule(rule.kind, f"{rule.pattern[:-1]}{{{rule.least - len(head)},}}", 0, rule.least)
    return rule


def _spans_of_rows(rows: DataFrame, rules: tuple[Rule, ...], measure: Callable[[Column], Column]) -> DataFrame:
    """The rows (doc_id, text and others) with ``found``: the spans of all rules, by start and then by the rules' order."""
    queries = [trigram_query(rule.pattern) for rule in rules]
    grams = sorted(set().union(*(s for q in queries if q for s in q)))
    if len(grams) > 62:
        raise ValueError("more trigrams than a mask has bits; split the rules")
    may = candidates(postings(rows, grams), grams, rules)
    joined = rows.withColumn("doc_key", _key()).join(may, "doc_key", "left")
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    each = []
    for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        spans = spans_of(F.col("text"), _narrowed(rule), k, measure)
        each.append(spans if query is None else F.when(F.coalesce(F.col("rule_bits"), F.lit(0)).bitwiseAND(F.lit(1 << k)) > 0, spans).otherwise(none))
    return joined.select(*rows.columns, F.array_sort(F.concat(*each)).alias("found"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, text and ``found``: the spans of all rules, by start and then by the rules' order."""
    return _spans_of_rows(texts(docs), rules, F.length)


def span_list(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat(s.kind, F.lit(":"), s.start, F.lit(":"), s.stop)), ",")


def without_spans(text: Column, found: Column, by: str) -> Column:
    """The text with ``by`` in place of each span; spans count bytes, and those that overlap are replaced as one."""
    data = text.cast("binary")  # a part of a binary value is cut out without counting characters up to it

    def pieces(spans: Column) -> Column:
        ends = before_each(F.transform(spans, lambda s: s.stop), lambda a, x: F.greatest(a, x))
        kept = F.zip_with(spans, ends, lambda s, end: F.when(s.start >= end, F.substring(data, end + 1, s.start - end).cast("string")))
        last = F.array_max(F.transform(spans, lambda s: s.stop))
        return F.array_join(F.array_compact(F.concat(kept, F.array(F.substring(data, last + 1, F.octet_length(text)).cast("string")))), by)

    return _bound(found, pieces)


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, by: str = "[secret]") -> DataFrame:
    """``docs`` with each span of the rules replaced in the text; texts without spans stay as they are.

    Spans that overlap are replaced as one.  A column ``n_chars`` follows its text.
    """
    columns = docs.columns
    whole = docs.withColumn("_row", F.struct(*[F.col(c) for c in columns])).select("doc_id", "text", "_row")
    rows = whole.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "_row")
    found = _spans_of_rows(rows, rules, F.octet_length)
    done = found.select("_row", F.when(F.size("found") > 0, without_spans(F.col("text"), F.col("found"), by)).otherwise(F.col("_row.text")).alias("_text"))
    changed = {"text": F.col("_text"), "n_chars": F.when(F.col("_text").eqNullSafe(F.col("_row.text")), F.col("_row.n_chars")).otherwise(F.length("_text")).cast("long") if "n_chars" in columns else None}
    return done.select(*[changed[c].alias(c) if changed.get(c) is not None else F.col(f"_row.`{c}`") for c in columns])


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("found", lambda s: s.kind_no < len(BASE_RULES))
    n = lambda rule: F.size(F.filter("found", lambda s: s.kind == rule.kind)).cast("long").alias(f"n_{rule.kind}")
    return scan(documents(spark, sf_dir)).select("doc_id", *[n(r) for r in BASE_RULES], F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("found")).alias("spans"))
