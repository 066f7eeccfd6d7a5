"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary text, one on windows of toxic
text.  A text is cut into windows of about ``WINDOW`` bytes at word ends, and each is compressed with
either dictionary.  A window counts where the toxic dictionary saves more than ``margin`` bytes; the
bytes beyond it, a window on average, are the text's distance.  The score is a logistic curve
through 0.5 at the threshold.

Labels mark whole documents, and most of a toxic document is ordinary text.  So

*   the windows to train on are found first.  Texts are cut at words that their own bytes choose, so
    copies give the same windows, and each distinct window counts once; windows that either side
    holds are left out.  A toxic sample is the shortest run of whole words around bytes (``GRAM`` of
    them) that LEAST toxic windows hold, and toxic windows more often than ordinary ones by a log
    ratio.  Stems that stand in ever changing words are found as well as words;
*   the toxic dictionary goes on with the ordinary one's content, as a toxic text's language does:
    on ordinary windows both find the same matches and the difference is 0.

The log ratio, the level of compression, the margin and the threshold are calibrated: each half of
the sample is measured with dictionaries trained on the other one, and the setting and threshold of
the least cost are taken, a toxic text that is missed counting as ``MISS`` ordinary ones that are
rejected, at the labels' own rate of toxic rows.  The dictionaries are then trained on the sample.

Fitting reads a sample of labelled rows, at most PER_CLASS of either label, those with the least
hash of doc_id, and their whole texts; scoring reads every whole text.  Without a toxic and an
ordinary row in the sample every score is 0; where nothing tells them apart no text reaches the
threshold.  A null or empty text has one empty window and so a distance of 0.  Rows that share a
doc_id are scored one by one; a row without doc_id is not held out.  An empty table gives an empty
result.  Of labels only doc_id and toxic are read, of documents only doc_id and text.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import blocks
from .common import crc_mod, documents, small_table, texts, tuned

#: The sample's bound: rows of either label.
PER_CLASS = 1500

#: Bytes of a window and of the two dictionaries.
WINDOW, ORDINARY_BYTES, TOXIC_BYTES = 128, 131_072, 4096

#: Bytes that mark a toxic window, and distinct windows that must hold them.
GRAM, LEAST = 6, 6

#: The settings that are compared: log ratios, levels and margins.
RATIOS, LEVELS, MARGINS = (2.0, 2.3, 2.7), (9, 12), (0.5, 1.0, 2.0)

#: Ordinary texts rejected that a missed toxic one counts as.
MISS = 3

_WORD = re.compile(rb"[^\t-\r ]+")


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    level: int
    margin: float
    threshold: float
    scale: float

    def distance(self, text: str) -> float:
        return float(distances([text], self.ordinary, self.toxic, self.level, (self.margin,))[0, 0])


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    data, out, at = _bytes(text), [], 0
    while at < len(data):
        end = min(at + size, len(data))
        if end < len(data) and (space := data.rfind(b" ", at, end)) > at + size // 2:
            end = space + 1
        out.append(data[at:end])
        at = end
    return out or [b""]


def spans(text: str) -> list[bytes]:
    """Runs of words with a space before each and after the last, that end at words chosen by their own bytes: two words on average."""
    out, held = [], []
    for word in _WORD.findall(_bytes(text)):
        held.append(word)
        if zlib.crc32(word) % 2 == 0:
            out.append(b" %b " % b" ".join(held))
            held = []
    return [*out, b" %b " % b" ".join(held)] if held else out


@functools.lru_cache(8)
def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=False, write_dict_id=False)


def distances(some: list[str], ordinary: bytes, toxic: bytes, level: int, margins: tuple[float, ...]) -> np.ndarray:
    """Bytes that the toxic dictionary saves beyond each margin, a window on average: a row for each text, a column for each margin."""
    plain, other = _compressor(ordinary, level).compress, _compressor(toxic, level).compress
    out = np.zeros((len(some), len(margins)))
    for k, text in enumerate(some):
        parts = windows(text)
        saved = [x for w in parts if (x := len(plain(w)) - len(other(w))) > 0]
        for m, margin in enumerate(margins):
            out[k, m] = sum(x - margin for x in saved if x > margin) / len(parts)
    return out


def _trained(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, k=32, d=GRAM, level=LEVELS[0]).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their own bytes
        return b" ".join(samples)[-size:]


def _grams(some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The gram at each byte of the windows, and the window that holds it whole (-1: none)."""
    data = np.frombuffer(b"".join(some), np.uint8)
    owner = np.repeat(np.arange(len(some)), [len(w) for w in some])
    n = max(len(data) - GRAM + 1, 0)
    found = np.zeros(n, np.uint64)
    for k in range(GRAM):
        found = (found << np.uint64(8)) | data[k : k + n]
    return found, np.where(owner[:n] == owner[len(owner) - n :], owner[:n], -1)


def _held(grams: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams and the number of windows that hold each."""
    order = np.lexsort((grams, owner))
    g, o = grams[order], owner[order]
    new = o >= 0
    new[1:] &= (g[1:] != g[:-1]) | (o[1:] != o[:-1])
    return np.unique(g[new], return_counts=True)


def toxic_samples(toxic: list[bytes], ordinary: list[bytes], ratios: tuple[float, ...]) -> list[list[bytes]]:
    """For each log ratio the runs of whole words around the bytes that mark toxic windows."""
    grams, owner = _grams(toxic)
    marks, often = _held(grams, owner)
    else_, n = _held(*_grams(ordinary))
    place = np.minimum(np.searchsorted(else_, marks), max(len(else_) - 1, 0))
    rare = np.where(else_[place] == marks, n[place], 0) if len(else_) else np.zeros(len(marks))
    ratio = np.log((often + 0.5) / (len(toxic) + 1)) - np.log((rare + 0.5) / (len(ordinary) + 1))
    data, out = b"".join(toxic), []
    for least in ratios:
        chosen = marks[(often >= LEAST) & (ratio >= least)]
        runs, upto = [], -1
        for at in np.flatnonzero((owner >= 0) & np.isin(grams, chosen)).tolist():
            if at + GRAM > upto:
                upto = data.index(b" ", at + GRAM - 1) + 1
                runs.append(data[data.rindex(b" ", 0, at + 1) : upto])
        out.append(runs)
    return out


def _dictionaries(toxic: list[str], ordinary: list[str], ratios: tuple[float, ...]) -> list[tuple[bytes, bytes]]:
    """The ordinary dictionary and the toxic one for each log ratio."""
    sides = [list(dict.fromkeys(w for t in side for w in spans(t))) for side in (toxic, ordinary)]
    both = set(sides[0]) & set(sides[1])
    sides = [[w for w in side if w not in both] for side in sides]
    base = _trained(sides[1] or [w for t in ordinary for w in windows(t)], ORDINARY_BYTES)
    return [(base, _trained(runs or sides[0] or [w for t in toxic for w in windows(t)], TOXIC_BYTES) + base) for runs in toxic_samples(*sides, ratios)]


def _cut(x: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """The greatest sum of the weights above a threshold, and that threshold."""
    order = np.argsort(-x, kind="stable")
    gain, value = np.cumsum(weight[order]), x[order]
    ends = np.flatnonzero(np.append(value[1:] != value[:-1], True))
    best = ends[np.argmax(gain[ends])]
    below = value[best + 1] if best + 1 < len(value) else value[best] - 1
    return float(gain[best]), float(value[best] + below) / 2


def fit(toxic: list[str], ordinary: list[str], rate: float) -> Model | None:
    """From texts of either label, and the rate of toxic labels."""
    if not toxic or not ordinary:
        return None
    halves = [(toxic[k::2], ordinary[k::2]) for k in (0, 1)] if min(len(toxic), len(ordinary)) > 1 else [(toxic, ordinary)] * 2
    found: dict[tuple[float, int], list[np.ndarray]] = {}
    for k, (bad, good) in enumerate(halves):
        for (ratio, dictionaries), level in product(zip(RATIOS, _dictionaries(*halves[1 - k], RATIOS), strict=True), LEVELS):
            found.setdefault((ratio, level), []).append(distances(bad + good, *dictionaries, level, MARGINS))
    weight = np.concatenate([x for bad, good in halves for x in (np.full(len(bad), MISS * rate / len(toxic)), np.full(len(good), -(1 - rate) / len(ordinary)))])
    settings = [(*_cut(np.concatenate(each)[:, m], weight), ratio, level, margin) for (ratio, level), each in found.items() for m, margin in enumerate(MARGINS)]
    gain, threshold, ratio, level, margin = max(settings, key=lambda s: s[0])
    [(base, other)] = _dictionaries(toxic, ordinary, (ratio,))
    if gain <= 0 or threshold <= 0:  # nothing is told apart better than by no prediction at all
        threshold = float("inf")
    return Model(base, other, level, margin, threshold, max(threshold / 2, 0.02))


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[list[str], list[str], float]:
    """Texts of either label and the rate of label 1, from rows of labels that are not held out."""
    spark = docs.sparkSession
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(crc_mod("doc_id", 5) != 0)
    counts = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    ids = [own.filter(F.col("toxic") == toxic).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).toArrow() for toxic in (1, 0)]
    wanted = F.broadcast(small_table(spark, pa.concat_tables(ids)))  # at most per_class ids of either label
    rows = texts(docs).join(wanted, "doc_id").orderBy(F.xxhash64("doc_id"), "text").limit(4 * per_class).collect()
    total = sum(counts.values())
    return [r["text"] for r in rows if r["toxic"]], [r["text"] for r in rows if not r["toxic"]], counts.get(1, 0) / total if total else 0.0


def _scored(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in blocks(batch.column(1)):
                scores = np.zeros(len(part))
                if model:
                    x = distances(part.to_pylist(), model.ordinary, model.toxic, model.level, (model.margin,))[:, 0]
                    scores = 1 / (1 + np.exp(-np.clip((x - model.threshold) / model.scale, -50, 50))) if np.isfinite(model.threshold) else scores
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), batch.column(2).slice(at, len(part)), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
                at += len(part)

    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    marked = texts(docs).select("doc_id", "text", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"))
    return marked.mapInArrow(_scored(model), "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with all their columns; the text is judged in place, so nothing is joined."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = [not model or t is None or model.distance(t) < model.threshold for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(run, schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(tuned(spark), sf_dir)
    return score(docs, fit(*sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))))
