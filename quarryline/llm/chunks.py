"""Fast exact encoding with the ``tokenizers`` library over Arrow arrays.

Both public tokenizers used here cut a text at white space before any merge takes
place, so the ids of a text are the concatenation of the ids of its chunks.  The
distinct chunks of a block of texts are found with Arrow's dictionary encoding; the
encoder hands every *new* one to ``Tokenizer.encode_batch`` and keeps the answer in a
bounded table, and the ids of the texts are gathered with numpy.  A full table is
dropped, never text: results do not depend on the table at all.  A text that holds the string
of an added token (in either case, as chunks come in lower case) goes to the library whole.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space by the Unicode property, which is what the tokenizers mean by ``\s``.
UNICODE_SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: A chunk of the byte-level tokenizer: one white space at most, then all that is no white space; or the rest of a run of white space.
_BYTE_CHUNK = re.compile(f"[{UNICODE_SPACE}]?[^{UNICODE_SPACE}]+|[{UNICODE_SPACE}]+(?![^{UNICODE_SPACE}])")


#: Signs after a letter at a word's end: a letter whose lower case is one letter too, and no apostrophe or mark among the signs.
_ENDING = r"([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])([^\pL\pN\pM\s']+)([ \n]|$)"


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Chunks of a tokenizer that lower-cases and drops white space, and where each text's chunks end.

    Only ASCII white space is cut at; the signs at a word's end become a chunk of their own, as the
    tokenizer's own pattern has it.  Only ASCII chunks come in lower case: the tokenizer composes
    letters with their marks first, and some have a composed form in lower case only.
    """
    lists = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, _ENDING, r"\1 \2\3"))
    found = lists.flatten()
    chunks = pc.if_else(pc.string_is_ascii(found), pc.ascii_lower(found), found)
    return chunks, np.asarray(lists.offsets)[1:].astype(np.int64) - lists.offsets[0].as_py()


def split_bytes(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Chunks of a byte-level tokenizer, which together are the text, and where each text's chunks end."""
    found: list[str] = []
    ends = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts.to_pylist()):
        found.extend(_BYTE_CHUNK.findall(text))
        ends[k] = len(found)
    return pa.array(found, pa.string()), ends


def blocks(texts: pa.Array, size: int = 1 << 20):
    """Slices of the array of about ``size`` bytes, one text at least."""
    sizes = np.asarray(pc.binary_length(texts).fill_null(0)).astype(np.int64)
    at, held = 0, 0
    for k, n in enumerate(sizes):
        if held and held + n > size:
            yield texts.slice(at, k - at)
            at, held = k, 0
        held += int(n)
    if at < len(texts):
        yield texts.slice(at)


class ChunkEncoder:
    """``encode(texts)`` -> (ids of all texts as one array, number of ids of each text).

    ``limit`` bounds the chunks and ``max_ids`` the ids in the table.  ``plain`` gives the model's own
    spelling of a chunk that normalizer and pre-tokenizer leave as one piece, and None for others: such
    a chunk goes straight to the library's model.
    """

    def __init__(self, tokenizer, split, limit: int = 500_000, max_ids: int = 3_000_000, plain=None):
        self.tokenizer, self.split, self.limit, self.max_ids, self.plain = tokenizer, split, limit, max_ids, plain
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self._reset()

    def _reset(self) -> None:
        self.seen: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int32)

    def _encoded(self, chunks: list[str]) -> list[list[int]]:
        if self.plain is None:
            return [e.ids for e in self.tokenizer.encode_batch(chunks, add_special_tokens=False)]
        spelled, model = [self.plain(c) for c in chunks], self.tokenizer.model.tokenize
        others = iter(self.tokenizer.encode_batch([c for c, s in zip(chunks, spelled, strict=True) if s is None], add_special_tokens=False))
        return [next(others).ids if s is None else [t.id for t in model(s)] for s in spelled]

    def _learn(self, new: list[str]) -> None:
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            got = self._encoded(part)
            lengths = np.fromiter(map(len, got), np.int64, len(got))
            total, rows = int(lengths.sum()), len(self.seen)
            while self.used + total > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while rows + len(got) > len(self.starts):
                self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
                self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
            self.ids[self.used : self.used + total] = np.fromiter((i for ids in got for i in ids), np.uint32, total)
            self.starts[rows : rows + len(got)] = self.used + np.cumsum(lengths) - lengths
            self.lengths[rows : rows + len(got)] = lengths
            self.seen.update(zip(part, range(rows, rows + len(part)), strict=True))
            self.used += total

    def _block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        held = [pc.match_substring(texts, a, ignore_case=True) for a in self.added]
        whole = functools.reduce(pc.or_, held) if held else pa.array(np.zeros(len(texts), bool))
        if not pc.any(whole).as_py():
            return self._chunked(texts)
        ids, counts = self._chunked(pc.if_else(whole, "", texts))
        rows = np.flatnonzero(np.asarray(whole))
        own = [np.asarray(self.tokenizer.encode(texts[int(r)].as_py(), add_special_tokens=False).ids, np.uint32) for r in rows]
        places = np.repeat((np.cumsum(counts) - counts)[rows], [len(x) for x in own])
        counts[rows] = [len(x) for x in own]
        return np.insert(ids, places, np.concatenate(own)), counts

    def _chunked(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.seen) > self.limit or self.used > self.max_ids:
            self._reset()
        chunks, ends = self.split(texts)
        coded = chunks.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if new := [w for w in words if w not in self.seen]:
            self._learn(new)
        rows = np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))[np.asarray(coded.indices)]
        lengths = self.lengths[rows].astype(np.int64)
        after = np.cumsum(lengths)
        total = int(after[-1]) if len(after) else 0
        ids = self.ids[np.repeat(self.starts[rows] - after + lengths, lengths) + np.arange(total)]
        upto = np.concatenate([[0], after])[ends]
        return ids, np.diff(upto, prepend=0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A null text counts as empty."""
        got = [self._block(part) for part in blocks(texts.fill_null(""), 2 << 20)]
        if not got:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate([i for i, _ in got]), np.concatenate([n for _, n in got])


#: Lower-case letters of one or two bytes, which no normalizer changes.
_PLAIN = re.compile("[a-z\xdf-\xf6\xf8-\xff]+").fullmatch


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else the next one from U+0100 on."""
    out, free = [], 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


_SHOWN = dict(enumerate(byte_characters()))


def _spelled(chunk: str) -> str | None:
    if chunk.isascii():
        return chunk if chunk.isalpha() and chunk.islower() else None
    return chunk.encode().decode("latin-1").translate(_SHOWN) if _PLAIN(chunk) else None


@functools.lru_cache(2)
def word_encoder(path: str) -> ChunkEncoder:
    """Of a tokenizer file whose pre-tokenizer drops white space; one for each Python worker."""
    from tokenizers import Tokenizer

    return ChunkEncoder(Tokenizer.from_file(path), split_words, plain=_spelled)
