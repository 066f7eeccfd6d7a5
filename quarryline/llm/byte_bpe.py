"""Byte-level BPE by the ``tokenizers`` library, from a table of ranks.

``encoder(ranks)`` gives a library tokenizer the same merges that a rank table means: a pair
of neighbours may merge when their bytes together have a rank, the lowest rank first.  Bytes
stand in the library's table as printable characters; ``byte_characters`` is that mapping, and
decoding goes back through it.  A character of several bytes can be split between tokens:
decoding joins bytes first and reads characters last, and offsets name both the byte and the
character, with a mark on tokens that start or end inside one.

A null text counts as empty: no ids, and the digests of no bytes.  Rows that share a doc_id are
encoded one by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .chunks import ChunkEncoder, blocks, byte_characters, split_bytes
from .common import documents, texts, tuned


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class ByteBpe:
    """One for each Python worker."""

    def __init__(self, ranks_path: str, pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(ranks_path)
        shown = byte_characters()
        name = {token: "".join(shown[b] for b in token) for token in ranks}
        merges = [(name[token[:k]], name[token[k:]]) for token in sorted(ranks, key=ranks.get) for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks]
        self.tokenizer = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.encoder = ChunkEncoder(self.tokenizer, split_bytes)
        # the byte table in reverse, read from the library's own vocabulary
        value = {c: b for b, c in enumerate(shown)}
        vocabulary = self.tokenizer.get_vocab()
        tokens = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for text, i in vocabulary.items():
            tokens[i] = bytes(value[c] for c in text)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids."""
        n = self.lengths[ids]
        after = np.cumsum(n)
        return self.bytes[np.repeat(self.starts[ids] - after + n, n) + np.arange(int(after[-1]) if len(after) else 0)]

    def decode_text(self, ids: np.ndarray) -> str:
        """Characters are read once all bytes are joined; bytes that make no character become U+FFFD."""
        return self.decode(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace")

    def offsets(self, ids: np.ndarray) -> dict[str, np.ndarray]:
        """For each id: its bytes' range, the range of the characters that it touches, and whether it starts or ends inside one."""
        data = self.decode(ids)
        n = self.lengths[ids]
        stop = np.cumsum(n)
        start = stop - n
        lead = (data & 0xC0) != 0x80
        char = np.cumsum(lead) - 1
        inner_stop = (stop < len(data)) & ~np.append(lead, True)[stop]
        return {"byte_start": start, "byte_end": stop, "char_start": char[start], "char_end": char[stop - 1] + 1, "split_start": ~lead[start], "split_end": inner_stop}


@functools.lru_cache(2)
def byte_bpe(ranks_path: str, pattern: str) -> ByteBpe:
    return ByteBpe(ranks_path, pattern)


def _encoded(ranks_path: str, pattern: str, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks_path, pattern)
        for batch in batches:
            at = 0
            for part in blocks(batch.column(1)):
                ids, counts = bpe.encoder.encode(part)
                data = bpe.decode(ids)
                lead = (data & 0xC0) != 0x80
                n = bpe.lengths[ids]
                split = np.concatenate([[0], np.cumsum(~lead[np.cumsum(n) - n])])
                upto, little = np.cumsum(counts), ids.astype("<u4")
                ends = np.concatenate([[0], np.cumsum(n)])
                rows = list(zip(upto - counts, upto, strict=True))
                out = {
                    "doc_id": batch.column(0).slice(at, len(part)),
                    "n_tokens": pa.array(counts),
                    "ids_sha256": [hashlib.sha256(little[a:b].tobytes()).hexdigest() for a, b in rows],
                    "decoded_sha256": [hashlib.sha256(data[ends[a] : ends[b]].tobytes()).hexdigest() for a, b in rows],
                    "n_split": pa.array([int(split[b] - split[a]) for a, b in rows], pa.int64()),
                }
                if full:
                    marks = [bpe.offsets(ids[a:b]) for a, b in rows]
                    out |= {"ids": pa.array([ids[a:b].tolist() for a, b in rows], pa.list_(pa.int64())), "char_start": pa.array([m["char_start"].tolist() for m in marks], pa.list_(pa.int64())), "char_end": pa.array([m["char_end"].tolist() for m in marks], pa.list_(pa.int64())), "decoded": pa.array([data[ends[a] : ends[b]].tobytes() for a, b in rows], pa.binary())}
                yield pa.RecordBatch.from_pydict(out)
                at += len(part)

    return run


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, full: bool = False) -> DataFrame:
    """Digests of each text's ids and of the bytes that they decode to; with ``full`` the ids, their character offsets and the bytes too."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long"
    return texts(docs).mapInArrow(_encoded(ranks_path, pattern, full), schema + ", ids array<long>, char_start array<long>, char_end array<long>, decoded binary" * full)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(documents(tuned(spark), sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
