"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

Format of a shard, all numbers little-endian:

    frame   := length u64, mask(crc32(length)) u32, payload, mask(crc32(payload)) u32
    payload := doc_id known u8, bytes of an id u8 (2 or 4), doc_id i64, number of ids u64, ids
    mask(c) := ((c >> 15 | c << 17) + 0xa282ead8) mod 2**32

A frame of length 0 is padding and is skipped.  Spark's own writer commits the shards: each
row is a block of frames and the writer's line separator is the empty frame, so a shard is a
plain sequence of frames on any file system, and a task that is tried again replaces its file.
The index is made from the shards as they lie on disk, each checksum being verified, and lies
beside them as a table (``index_folder``).  With it ``read_at`` takes one record out of an open shard
by its offset, and ``read_shuffled`` gives all records in another order for each seed.

Documents lie in ascending doc_id order over the shards in name order (a null doc_id first;
rows that share a doc_id are ordered by text).  A null text counts as empty and has the end id
alone.  An empty table gives no frame.  Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import blocks, word_encoder
from .common import documents, shared_folder, small_table, texts, tuned

#: Bytes of frames in a row that the writer gets, and rows in a shard at most.
BLOCK, BLOCKS_A_SHARD = 4 << 20, 8

_HEAD = struct.Struct("<BBqQ")
INDEX_SCHEMA = "shard string, offset long, length long, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def mask(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", mask(zlib.crc32(length))), payload, struct.pack("<I", mask(zlib.crc32(payload)))))


EMPTY_FRAME = frame(b"")


def _length(head, at: int) -> int:
    """Of the payload, from the 12 bytes at the front of a frame."""
    if len(head) < 12:
        raise ValueError(f"the head of the frame at {at} is cut off")
    length, crc = struct.unpack("<QI", head)
    if crc != mask(zlib.crc32(head[:8])):
        raise ValueError(f"wrong checksum of the length at {at}")
    return length


def _payload(rest, length: int, at: int):
    if len(rest) < length + 4:
        raise ValueError(f"the frame at {at} is cut off")
    if struct.unpack("<I", rest[length : length + 4])[0] != mask(zlib.crc32(rest[:length])):
        raise ValueError(f"wrong checksum of the payload at {at}")
    return rest[:length]


def frames(data) -> Iterator[tuple[int, int, memoryview]]:
    """(offset, length, payload) of each frame but padding; raises ValueError where a checksum is wrong or the data end early."""
    view, at = memoryview(data), 0
    while at < len(view):
        length = _length(view[at : at + 12], at)
        payload = _payload(view[at + 12 : at + 16 + length], length, at)
        if length:
            yield at, length + 16, payload
        at += length + 16


def read_at(file, offset: int) -> tuple[int | None, np.ndarray]:
    """doc_id and ids of the record at an offset of the index, from a shard that is open for binary reading; nothing else of it is read."""
    file.seek(offset)
    length = _length(file.read(12), offset)
    return unpack(_payload(file.read(length + 4), length, offset))


def pack(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return _HEAD.pack(doc_id is not None, width, doc_id or 0, len(ids)) + ids.astype("<u2" if width == 2 else "<u4").tobytes()


def unpack(payload) -> tuple[int | None, np.ndarray]:
    known, width, doc_id, n = _HEAD.unpack(payload[: _HEAD.size])
    ids = np.frombuffer(payload, "<u2" if width == 2 else "<u4", count=n, offset=_HEAD.size).astype("<u4")
    return (doc_id if known else None), ids


def _framed(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], np.uint32)
        held, size = [], 0
        for batch in batches:
            at = 0
            for part in blocks(batch.column(1), 2 << 20):
                ids, counts = encoder.encode(part)
                upto = np.cumsum(counts)
                for doc_id, a, b in zip(batch.column(0).slice(at, len(part)).to_pylist(), upto - counts, upto, strict=True):
                    held.append(frame(pack(doc_id, np.concatenate([ids[a:b], end]), width)))
                    size += len(held[-1])
                    if size >= BLOCK:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])
                        held, size = [], 0
                at += len(part)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])

    return run


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2) -> None:
    """Writes the ids of each document's whole text, and ``end_id`` after them, in ascending doc_id order.

    The texts are dealt by ranges of doc_id before they are encoded, so each is encoded once.
    """
    ordered = texts(docs).repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    rows = ordered.mapInArrow(_framed(tokenizer, end_id), "value binary")
    rows.select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_FRAME.decode("latin-1")).option("maxRecordsPerFile", BLOCKS_A_SHARD).text(folder)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            name, before, rows = path.as_py().rpartition("/")[2], 0, []
            for offset, length, payload in frames(content.as_buffer()):
                doc_id, ids = unpack(payload)
                rows.append((name, offset, length, doc_id, before, len(ids), zlib.crc32(ids.tobytes())))
                before += len(ids)
            if rows:
                kinds = [pa.string(), *[pa.int64()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in INDEX_SCHEMA.split(", ")])


def _shards(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")


def index_folder(folder: str) -> str:
    return f"{folder.rstrip('/')}.index"


def write_index(spark: SparkSession, folder: str) -> None:
    """The offset index of the shards in ``folder``, as a table beside them."""
    _shards(spark, folder).mapInArrow(_indexed, INDEX_SCHEMA).write.parquet(index_folder(folder))


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each frame on disk: its place in its shard and ``start``, the ids of all documents before it.

    Sums in two levels: over the shards of a writer's task, in a window of its own, and over the tasks, of
    which the driver gets one row each.
    """
    index = spark.read.parquet(index_folder(folder))
    task = F.regexp_extract("shard", r"^part-(\d+)", 1).cast("long")
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("task", task)
    totals = shards.groupBy("task").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("shards")).toArrow().sort_by("task")
    n, held = (totals.column(c).to_numpy() for c in ("n", "shards"))
    bases = pa.table({"task": totals.column("task"), "task_base": np.cumsum(n) - n, "task_shards": np.cumsum(held) - held})
    order = Window.partitionBy("task").orderBy("shard")
    own = shards.withColumns({"before": F.sum("n").over(order) - F.col("n"), "no": F.row_number().over(order) - 1})
    placed = own.join(small_table(spark, bases), "task").select("shard", (F.col("task_shards") + F.col("no")).alias("shard_no"), (F.col("task_base") + F.col("before")).alias("base"))
    return index.join(placed, "shard").withColumn("start", F.col("base") + F.col("local_start"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            for offset, _, payload in frames(content.as_buffer()):
                doc_id, ids = unpack(payload)
                yield pa.RecordBatch.from_pydict({"shard": [path.as_py().rpartition("/")[2]], "offset": [offset], "doc_id": pa.array([doc_id], pa.int64()), "ids": pa.array([ids.tolist()], pa.list_(pa.int64()))})


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """shard, offset, doc_id and ids of each record."""
    return _shards(spark, folder).mapInArrow(_read, "shard string, offset long, doc_id long, ids array<long>")


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content, offsets in zip(batch.column("shard"), batch.column("content"), batch.column("offsets"), strict=True):
            file = pa.BufferReader(content.as_buffer())
            for offset in offsets.as_py():
                doc_id, ids = read_at(file, offset)
                yield pa.RecordBatch.from_pydict({"shard": [path.as_py()], "offset": [offset], "doc_id": pa.array([doc_id], pa.int64()), "ids": pa.array([ids.tolist()], pa.list_(pa.int64()))})


def read_shuffled(spark: SparkSession, folder: str, seed: int = 0) -> DataFrame:
    """All records, dealt and ordered by a hash of seed, shard and offset: each shard is read once, at the offsets of the index."""
    offsets = spark.read.parquet(index_folder(folder)).groupBy("shard").agg(F.collect_list("offset").alias("offsets"))  # a shard is of bounded size
    shards = _shards(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content")
    rows = shards.join(offsets, "shard").mapInArrow(_sliced, "shard string, offset long, doc_id long, ids array<long>")
    key = F.xxhash64(F.lit(seed), "shard", "offset")
    return rows.withColumn("_key", key).repartitionByRange("_key").sortWithinPartitions("_key").drop("_key")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_folder(tuned(spark), "records")
    write_records(documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json"))
    write_index(spark, folder)
    return read_index(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32", "shard_no", "offset", "length")
