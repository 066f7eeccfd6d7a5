"""Media columns: texts stored losslessly as grey PNG pictures in a binary column, and features of them.

The payload of a text is its UTF-8 with bytes 0 appended up to a positive multiple of 64; it is
a picture of 64 columns with 8-bit samples.  The writer takes, of the row filters None, Sub and
Up, the one with the least byte entropy over the picture, and cuts the zlib stream into chunks;
the reader tests each chunk's checksum, joins the chunks, and undoes all five row filters with
numpy.  The feature is a 64-bit hash: signs, against their median, of the 8 x 8 lowest
frequencies of the cosine transform of the picture brought down to 32 x 32 by area means.

A null text counts as empty (one row of zeros).  Equal texts give equal values.  Rows that share
a doc_id are stored one by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, texts, tuned, written

#: Samples of a row, and bytes of a zlib chunk at most.
WIDTH, CHUNK = 64, 1 << 16

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload(text: str) -> bytes:
    data = text.encode("utf-8")
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _entropy(data: np.ndarray) -> float:
    n = np.bincount(data.ravel(), minlength=256)
    p = n[n > 0] / data.size
    return float(-(p * np.log2(p)).sum())


def write_png(data: bytes, width: int = WIDTH, filter_type: int | None = None, level: int = 4) -> bytes:
    """``filter_type``: 0 None, 1 Sub, 2 Up; the one with the least entropy if it isn't given."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, width)
    sub = rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up = rows.copy()
    up[1:] -= rows[:-1]
    choices = (rows, sub, up)
    if filter_type is None:
        filter_type = int(np.argmin([_entropy(x) for x in choices]))
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = filter_type
    lines[:, 1:] = choices[filter_type]
    stream = zlib.compress(lines.tobytes(), level)
    parts = [_chunk(b"IDAT", stream[k : k + CHUNK]) for k in range(0, len(stream), CHUNK)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)), *parts, _chunk(b"IEND", b"")])


def _average_row(line: np.ndarray, above: np.ndarray) -> np.ndarray:
    out, left = np.empty_like(line), 0
    for k, (x, b) in enumerate(zip(line.tolist(), above.tolist(), strict=True)):
        left = (x + (left + b) // 2) & 255
        out[k] = left
    return out


def _paeth_row(line: np.ndarray, above: np.ndarray) -> np.ndarray:
    out, a, c = np.empty_like(line), 0, 0
    for k, (x, b) in enumerate(zip(line.tolist(), above.tolist(), strict=True)):
        pa_, pb, pc_ = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        near = a if pa_ <= pb and pa_ <= pc_ else b if pb <= pc_ else c
        a, c = (x + near) & 255, b
        out[k] = a
    return out


def unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Rows of samples from filtered rows, of one byte a sample; whole runs of rows at once where the filter allows it."""
    rows = lines.copy()
    rows[kinds == 1] = np.cumsum(lines[kinds == 1], axis=1, dtype=np.uint8)
    ends = np.flatnonzero(np.diff(kinds, append=-1)) + 1
    first = 0
    for last in ends.tolist():
        kind = int(kinds[first])
        above = rows[first - 1] if first else np.zeros(lines.shape[1], np.uint8)
        if kind == 2:
            rows[first:last] = np.cumsum(np.vstack([above[None], lines[first:last]]), axis=0, dtype=np.uint8)[1:]
        elif kind in (3, 4):
            for k in range(first, last):
                rows[k] = above = (_average_row if kind == 3 else _paeth_row)(lines[k], above)
        elif kind > 4:
            raise ValueError(f"no such row filter: {kind}")
        first = last
    return rows


def read_png(data: bytes) -> np.ndarray:
    """Samples of a grey 8-bit picture; raises ValueError where a checksum or the layout is wrong."""
    view = memoryview(data)
    if bytes(view[:8]) != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, stream, ended = 8, None, [], False
    while at < len(view) and not ended:
        if at + 12 > len(view):
            raise ValueError("a chunk is cut off")
        (n,), kind = struct.unpack(">I", view[at : at + 4]), bytes(view[at + 4 : at + 8])
        if at + 12 + n > len(view):
            raise ValueError("a chunk is cut off")
        if zlib.crc32(view[at + 4 : at + 8 + n]) != struct.unpack(">I", view[at + 8 + n : at + 12 + n])[0]:
            raise ValueError(f"wrong checksum of the chunk {kind!r}")
        body = view[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            if n != 13:
                raise ValueError("the head has a wrong length")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            stream.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if not ended or head is None:
        raise ValueError("a chunk is missing")
    width, height, *layout = head
    if layout != [8, 0, 0, 0, 0]:
        raise ValueError(f"not a plain grey 8-bit picture: {layout}")
    try:
        lines = np.frombuffer(zlib.decompress(b"".join(stream)), np.uint8)
    except zlib.error as e:
        raise ValueError(f"the samples cannot be unpacked: {e}") from e
    if lines.size != height * (width + 1):
        raise ValueError("the samples do not fill the picture")
    lines = lines.reshape(height, width + 1)
    return unfilter(lines[:, 0].astype(np.int64), np.ascontiguousarray(lines[:, 1:]))


def _cosines(n: int, low: int) -> np.ndarray:
    k = np.arange(low)[:, None]
    return np.cos(np.pi * k * (2 * np.arange(n)[None] + 1) / (2 * n))


_LOW = _cosines(32, 8)


def area_means(picture: np.ndarray, size: int = 32) -> np.ndarray:
    out = picture.astype(np.float64)
    for axis in (0, 1):
        n = out.shape[axis]
        starts = np.arange(size) * n // size
        counts = np.maximum(np.diff(starts, append=n), 1)
        out = np.add.reduceat(out, starts, axis=axis) / (counts[:, None] if axis == 0 else counts[None])
    return out


def cosine_hash(picture: np.ndarray) -> str:
    low = np.round(_LOW @ area_means(picture) @ _LOW.T, 6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, media = [], []
        for text in batch.column(1).to_pylist():
            data = payload(text)
            n.append(len(text.encode("utf-8")))
            media.append(write_png(data))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: one PNG for each document."""
    return texts(docs).mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, n, media in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            picture = read_png(media)
            data = picture.tobytes()
            rows.append((doc_id, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(picture)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if "string" in x else pa.int64()) for c, x in zip(zip(*rows, strict=True), FEATURES.split(", "), strict=True)], [x.split()[0] for x in FEATURES.split(", ")])


def features(media: DataFrame) -> DataFrame:
    """What the stored pictures hold, read back from the media column."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, FEATURES)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(written(store(documents(tuned(spark), sf_dir)), "media"))
