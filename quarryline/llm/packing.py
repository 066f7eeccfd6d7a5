"""Packing by concatenating and cutting.

All documents stand one after another in one stream of ids, and the stream is cut every
``size`` ids.  Pass one encodes each text once into a table and keeps running counts inside
each of its parts; the totals of the parts (one row each) are summed up on the driver and
give each part its place in the stream.  Pass two cuts: each document gives a boundary record
for each window that it touches.  No row depends on another one, so no key can be hot.

Every window but the last is full; the last has a padded length of ``size``, or of its own
length where that is a power of two.  A null text counts as empty and has the end id alone;
rows that share a doc_id, or have none, are packed one by one.  An empty table gives no piece.
Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import blocks, word_encoder
from .common import documents, small_table, texts, tuned, written

#: Ids of a sequence.
SIZE = 4096

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _encoded(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        kind = "<u2" if width == 2 else "<u4"
        end = np.array([end_id], kind).tobytes()
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            at = 0
            for texts in blocks(batch.column(1), 2 << 20):
                ids, counts = encoder.encode(texts)
                ids, upto = ids.astype(kind), np.cumsum(counts)
                data = [ids[a:b].tobytes() + end for a, b in zip(upto - counts, upto, strict=True)]
                after = before + np.cumsum(counts + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(data), part)), pa.array(after - counts - 1), batch.column(0).slice(at, len(texts)), pa.array(counts + 1), pa.array(np.full(len(data), width)), pa.array(data, pa.binary())],
                    ["part", "local_start", "doc_id", "doc_tokens", "width", "ids"],
                )
                before, at = int(after[-1]), at + len(texts)

    return run


def encode_parts(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Pass one, as a written table: the ids of each text and how many ids stand before it in its part."""
    return written(texts(docs).mapInArrow(_encoded(tokenizer, end_id), "part long, local_start long, doc_id long, doc_tokens long, width long, ids binary"), "packing")


def with_places(parts: DataFrame) -> DataFrame:
    """``place``: the ids of all documents before this one, over all parts."""
    totals = parts.groupBy("part").agg(F.max(F.col("local_start") + F.col("doc_tokens")).alias("n")).toArrow().sort_by("part")
    n = totals.column("n").to_numpy()
    bases = pa.table({"part": totals.column("part"), "base": np.cumsum(n) - n})
    return parts.join(small_table(parts.sparkSession, bases), "part").withColumn("place", F.col("base") + F.col("local_start"))


def _cut(size: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, total, width = (np.asarray(batch.column(k)) for k in ("place", "doc_tokens", "width"))
            first = place // size
            count = (place + total - 1) // size - first + 1
            row = np.repeat(np.arange(len(place)), count)
            window = np.repeat(first, count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = np.maximum(window * size, place[row]) - place[row]
            stop = np.minimum((window + 1) * size, place[row] + total[row]) - place[row]
            crc, kept, data, at = np.zeros(len(row), np.int64), [], batch.column("ids"), -1
            for k, r in enumerate(row):
                if r != at:
                    ids, at = np.frombuffer(data[int(r)].as_buffer(), "<u2" if width[r] == 2 else "<u4"), r
                piece = ids[start[k] : stop[k]].astype("<u4").tobytes()
                crc[k] = zlib.crc32(piece)
                if keep_ids:
                    kept.append(piece)
            arrays = [batch.column("doc_id").take(pa.array(row)), *(pa.array(x) for x in (start, stop - start, crc, total[row], window, place[row] + start - window * size))]
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(kept, pa.binary())] if keep_ids else arrays, [*names, "ids"] if keep_ids else names)

    return run


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """A boundary record for each piece of a document; with ``keep_ids`` also the piece's ids as 32-bit integers."""
    return with_places(encode_parts(docs, tokenizer, end_id)).select("place", "doc_id", "doc_tokens", "width", "ids").mapInArrow(_cut(size, keep_ids), PIECES + (", ids binary" if keep_ids else ""))


def sequences(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """The sequences themselves from pieces with ids: at most ``size`` pieces each, so a group is bounded."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))), lambda x: x.ids)
    whole = pieces.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"), F.sum("length").alias("length"))
    power = F.pow(F.lit(2.0), F.floor(F.log2(F.col("length"))))
    return whole.withColumn("padded_length", F.when(F.col("length") == power, F.col("length")).otherwise(F.lit(size)).cast("long"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(tuned(spark), sf_dir), public_tokenizers.path("word_bpe_49k.json"))
