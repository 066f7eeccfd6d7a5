"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  A trigram's vector binds the vectors of its three
letters, the first permuted twice, the second once (a cyclic shift), by multiplication.  A text is
the bundle (sum) of its trigrams' vectors, a language's prototype the bundle of all its training
texts, and a text gets the language whose prototype has the largest cosine with its own vector.

Bundles are sums, so each task adds up its own texts and Spark adds up the tasks' sums: all
training rows count, and the driver gets one vector for each language.  Letters are lower-cased;
whatever is no letter becomes one space between words.  Letters outside a-z share 37 symbols by
code point (all of Latin-1 apart).

A null text, or one without a letter, is ``und`` with score 0; so is every text where nothing could
be learned.  Rows that share a doc_id are treated one by one; a row without doc_id is neither
learned from nor held out.  Ties go to the language that comes first in order.  An empty table
gives an empty result.  Columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import blocks
from .common import crc_mod, documents, texts, tuned

#: Dimensions of a vector, symbols, and the seed of the letters' vectors.
DIMENSIONS, SYMBOLS, SEED = 512, 64, 7

_TABLE = 0x250


def _symbol(code: int) -> int:
    c = chr(code)
    if "a" <= c <= "z":
        return code - 96
    return 27 + code % 37 if c.isalpha() else 0


@functools.lru_cache(1)
def _symbols() -> np.ndarray:
    return np.array([_symbol(k) for k in range(_TABLE)], np.int32)


@functools.lru_cache(1)
def _shifted() -> list[np.ndarray]:
    """The letters' vectors as first, second and third of a trigram."""
    letters = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIMENSIONS))
    return [np.roll(letters, k, axis=1) for k in (2, 1, 0)]


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    first, second, third = _shifted()
    out = first[codes >> 12]
    out *= second[codes >> 6 & 63]
    out *= third[codes & 63]
    return out


def trigram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, trigram code, count) of all texts, and whether each text has a letter."""
    low = [f" {t.lower()} " if t else " " for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "replace"), np.uint32)
    lengths = np.fromiter(map(len, low), np.int64, len(low))
    symbols = _symbols()[np.minimum(codes, _TABLE - 1)]
    rare = np.flatnonzero(codes >= _TABLE)
    if len(rare):
        distinct, back = np.unique(codes[rare], return_inverse=True)
        symbols[rare] = np.array([_symbol(int(c)) for c in distinct], np.int32)[back]
    owner = np.repeat(np.arange(len(low)), lengths)
    lettered = np.bincount(owner, weights=symbols > 0, minlength=len(low)) > 0
    stay = np.ones(len(symbols), bool)
    stay[1:] = (symbols[1:] > 0) | (symbols[:-1] > 0) | (owner[1:] != owner[:-1])
    symbols, owner = symbols[stay], owner[stay]
    trigrams = (symbols[:-2] << 12 | symbols[1:-1] << 6 | symbols[2:]) if len(symbols) > 2 else symbols[:0]
    inside = owner[:-2] == owner[2:] if len(symbols) > 2 else owner[:0].astype(bool)
    keys, counts = np.unique(owner[: len(inside)][inside] << 18 | trigrams[inside], return_counts=True)
    return keys >> 18, keys & (1 << 18) - 1, counts, lettered


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        at = 0
        for part in blocks(batch.column(0)):
            langs = np.array(batch.column(1).slice(at, len(part)).to_pylist(), object)
            at += len(part)
            owner, codes, counts, _ = trigram_counts(part.to_pylist())
            for lang in sorted(set(langs)):
                mine = langs[owner] == lang
                distinct, back = np.unique(codes[mine], return_inverse=True)
                total = np.bincount(back, weights=counts[mine], minlength=len(distinct))
                vector = sums.setdefault(lang, np.zeros(DIMENSIONS))
                for k in range(0, len(distinct), 4096):
                    vector += total[k : k + 4096] @ trigram_vectors(distinct[k : k + 4096])
    for lang, vector in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS)), pa.array(np.rint(vector).astype(np.int64))], ["lang", "k", "v"])


def learn(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes of length 1, from all rows of (text, lang)."""
    sums = rows.select("text", "lang").mapInArrow(_bundled, "lang string, k long, v long").groupBy("lang", "k").agg(F.sum("v").alias("v")).toArrow()
    langs = sorted(set(sums.column("lang").to_pylist()))
    out = np.zeros((len(langs), DIMENSIONS))
    if langs:
        out[[langs.index(x) for x in sums.column("lang").to_pylist()], sums.column("k").to_numpy()] = sums.column("v").to_numpy()
    return langs, (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _compared(langs: list[str], prototypes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in blocks(batch.column(1)):
                owner, codes, counts, lettered = trigram_counts(part.to_pylist())
                distinct, back = np.unique(codes, return_inverse=True)
                vectors = trigram_vectors(distinct)
                ends = np.searchsorted(owner, np.arange(len(part) + 1))
                names, scores = ["und"] * len(part), np.zeros(len(part))
                for k in np.flatnonzero(lettered) if langs else ():
                    mine = slice(ends[k], ends[k + 1])
                    vector = counts[mine].astype(np.float32) @ vectors[back[mine]].astype(np.float32)
                    cosines = prototypes @ vector / max(float(np.linalg.norm(vector)), 1e-9)
                    best = int(np.argmax(cosines))
                    names[k], scores[k] = langs[best], min(max(float(cosines[best]), 0.0), 1.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), batch.column(2).slice(at, len(part)), pa.array(names), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])
                at += len(part)

    return run


def identify(docs: DataFrame, langs: list[str], prototypes: np.ndarray, held_out=None) -> DataFrame:
    marked = texts(docs).select("doc_id", "text", (F.lit(False) if held_out is None else held_out).alias("held_out"))
    return marked.mapInArrow(_compared(langs, prototypes), "doc_id long, held_out boolean, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(tuned(spark), sf_dir)
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    train = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", 4) != 2)).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return identify(docs, *learn(train), held_out)
