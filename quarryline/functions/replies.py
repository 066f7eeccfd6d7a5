"""Replies of a language model as rows, and the notes that frame what is shown to one."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import ship

# Literals of the calling notation, and fences around JSON, the more exact first.
LITERALS = {"True": "true", "False": "false", "None": "null"}
FENCES = ["```json", "```"]

_CALL = re.compile(r"\s*[A-Za-z_]\w*\s*\((?P<inner>.*)\)\s*\Z", re.S)
_PIECE = re.compile(r"""(?P<text>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<word>[A-Za-z_]\w*)(?P<set>\ *=(?!=))?|.""", re.S)


def call_as_json(reply: str) -> str | None:
    """The keyword arguments of one call, as a JSON object; null for what is no call.

    Strings stay as they are, whatever they hold; only names before '=' outside of all brackets become keys.
    """
    call = _CALL.match(reply)
    if not call:
        return None
    out, depth = [], 0
    for piece in _PIECE.finditer(call["inner"].strip()):
        depth += bool(piece["open"]) - bool(piece["close"])
        word = piece["word"]
        if word and word in LITERALS:
            out.append(LITERALS[word] + (piece["set"] or ""))
        elif word and piece["set"] and depth == 0:
            out.append(f'"{word}":')
        else:
            out.append(piece[0])
    return "{" + "".join(out) + "}"


def fenced(reply: str) -> list[str]:
    """What stands between fences, for each kind of fence that is closed."""
    found = []
    for fence in FENCES:
        _, opened, rest = reply.partition(fence)
        body, closed, _ = rest.partition("```")
        if opened and closed:
            found.append(body.strip())
    return found


def reply_json(reply: str | None) -> str | None:
    """The JSON in a reply: all of it, or what is fenced, or the arguments of a call; null where there is none."""
    if reply is None:
        return None
    for body in (reply.strip(), *fenced(reply), call_as_json(reply)):
        try:
            json.loads(body or "")
            return body
        except ValueError:
            continue
    return None


def _parsed(reply: pd.Series) -> pd.Series:
    return reply.map(reply_json)


def parsed_reply(reply: Column) -> Column:
    """``reply_json`` over Arrow batches: strings and brackets are told apart as they come, which no expression does."""
    ship(SparkSession.active())
    return F.pandas_udf(_parsed, "string")(reply)


def reply_label(reply: Column, labels: list[str]) -> Column:
    """(label, note) of a judge's reply: the first fenced body, or all of it; no label where it is none of ``labels``, no note where it is no JSON."""
    fence = F.regexp_extract(reply, r"(?s)```(?:json)?(.*?)```", 1)
    read = F.from_json(F.trim(F.when(F.rlike(reply, F.lit(r"(?s)```.*?```")), fence).otherwise(reply)), "struct<label:string,note:string>")
    return F.struct(F.when(read.label.isin(labels), read.label).alias("label"), F.coalesce(read.note, F.lit("")).alias("note"))


def stringified_results(payload: Column, schema: str) -> Column:
    """The array ``results`` of a payload, also where it came as a string of JSON; null where it is neither."""
    inner = F.get_json_object(payload, "$.results")
    return F.from_json(F.when(F.rlike(inner, F.lit(r"(?s)^\s*\[")), inner), schema)


def outline_entries(reply: Column) -> Column:
    """Entries (level, title, page) of the first JSON array in a reply, fenced or not; those without a title or a page are dropped.

    Numbers may come as strings; a level that is missing or below 1 is 1.
    """
    body = F.regexp_extract(reply, r"(?s)(\[.*\])", 1)
    entries = F.coalesce(F.from_json(body, "array<struct<level:string,title:string,page:string>>"), F.expr("cast(array() as array<struct<level:string,title:string,page:string>>)"))
    typed = F.transform(entries, lambda e: F.struct(F.greatest(F.lit(1), F.coalesce(e.level.try_cast("int"), F.lit(1))).alias("level"), F.trim(e.title).alias("title"), e.page.try_cast("int").alias("page")))
    return F.filter(typed, lambda e: e.page.isNotNull() & (e.title != ""))


def cut_note(shown: Column, extracted: Column, limit: int) -> Column:
    """Says that a text was cut, and by how much; null where it wasn't."""
    return F.when(shown < extracted, F.concat(F.lit("=== NOTE: "), shown.cast("string"), F.lit(" of "), extracted.cast("string"), F.lit(f" characters are shown (limit {limit}) ===")))


def page_note(read: Column, total: Column) -> Column:
    phrase = F.when(read == 1, F.lit("page 1")).otherwise(F.concat(F.lit("pages 1-"), read.cast("string")))
    return F.when(total > read, F.concat(F.lit("=== NOTE: only "), phrase, F.lit(" of "), total.cast("string"), F.lit(" are shown ===")))
