"""Words and their fingerprints over Arrow arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of all texts, and how many each text has.  A null text has none."""
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    flat = lists.flatten()
    offsets = np.asarray(lists.offsets).astype(np.int64)
    full = np.asarray(pc.binary_length(flat)) > 0
    upto = np.concatenate([[0], np.cumsum(full)])[offsets - offsets[0]]
    return (flat if full.all() else flat.filter(pa.array(full))), np.diff(upto)


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit fingerprint of each word; each distinct word is hashed once."""
    coded = words.dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))[np.asarray(coded.indices)]


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A fingerprint of the sequence a, b from those of its two parts."""
    x = a * _A
    x += b
    x ^= x >> np.uint64(32)
    x *= _B
    x ^= x >> np.uint64(29)
    return x


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The fingerprints of all sequences of n words, by doubling."""
    power, size, out, done = hashes, 1, None, 0
    while True:
        if n & size:
            rest = power[done:]
            out = power if out is None else mix(out[: len(rest)], rest[: len(out)])
            done += size
        if size * 2 > n:
            return out[: max(len(hashes) - n + 1, 0)]
        power = mix(power[:-size], power[size:]) if len(power) > size else power[:0]
        size *= 2


def sliding_least(values: np.ndarray, n: int) -> np.ndarray:
    """The least value of each n neighbours, by doubling."""
    least, size = values, 1
    while size * 2 <= n:
        least = np.minimum(least[:-size], least[size:]) if len(least) > size else least[:0]
        size *= 2
    rest = n - size
    return np.minimum(least[:-rest], least[rest:]) if rest and len(least) > rest else least[: max(len(values) - n + 1, 0)]
