"""Removal of passages that an earlier document has, by suffix trees in partitions.

A window of 50 words is the start of a suffix, down to depth 50 of the suffix tree of all
documents; it repeats an earlier document if the node at that depth also has a leaf of a
smaller doc_id.

1.  Candidates.  Equal windows have the same least 8-word gram, so a window whose least gram only
    its own document holds has no equal one, and its suffix is a leaf of its own: such suffixes (three
    quarters of all, usually) are left out.  Neighbouring windows nearly always share their least gram
    and are one row, without words.
2.  Prefixes.  The tree is split by prefixes of its suffixes: by the first 8 words, or the first 16, 32
    or 50 where more than ``GROUP`` suffixes begin with them.  A prefix is looked at for that only if
    some block of texts holds it ``LOCAL`` times, so what goes uncounted is smaller than that for each block.
    Whatever has the same prefix is a group, and goes to the task of its bin; bins are as many as hold
    ``SUFFIXES`` each on average.
3.  Subtrees.  A task takes a bin, sorts its suffixes by group and path, which puts the leaves of a node
    side by side, and reads the nodes at depth 50 with more than one document below them: the deep internal
    nodes.  A leaf whose doc_id is not the node's least is a repeat.  Of a text the starts of all repeats
    are put together again at the end: runs of them are the maximal repeats, which cover the words that go.

Before the shuffles each block of texts is treated the same way: a suffix that repeats a smaller
doc_id of its own block is settled there and not sent, and a gram that the block shows in two documents
tells the others so with two rows, so a passage that a third of all documents hold is sent once for each
block and no more.

A path is named by a 64-bit fingerprint of its words, beside the 64 bits of its group's prefix: two paths
can only be mistaken for each other within a group.  A null text has no words.  A row without doc_id counts
as later than all others; rows that share a doc_id do not remove from each other.  Texts of fewer than 50
words stay whole.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import blocks
from .common import documents, texts, tuned, written
from .words import grams, mix, sliding_least, word_hashes, words_of

#: Words of a window, and of the prefixes that name groups; the least is also the length of the grams that candidates share.
WINDOW, PREFIXES = 50, (8, 16, 32)

#: Suffixes of a group from which its prefix is lengthened, of one prefix in a block from which it is counted, and of a bin on average.
GROUP, LOCAL, SUFFIXES = 125_000, 8, 2_000_000

#: Bins at least: so many that a text's suffixes are spread over them alike whatever the size of the table.
BINS = 256

#: Bytes of texts in a block, and rows of one gram that are held until a second document comes.
BLOCK, HELD = 4 << 20, 500_000

#: Stands for a missing doc_id.
LAST = (1 << 63) - 1

_RUNS = "key long, known boolean, doc long, row_hash long, start int, n int"
_BINS = "bin int, doc long, row_hash long, starts binary, leaves binary"
_STARTS = "doc long, row_hash long, starts binary"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _runs(*same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs in which all of the arrays stay as they are."""
    n = len(same[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(first, append=n)


def _gathered(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about BLOCK bytes of the column's text, one row at least."""
    held, size = [], 0
    for batch in batches:
        at = 0
        for part in blocks(batch.column(column), BLOCK):
            if held and size + part.nbytes > BLOCK:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
            held.append(batch.slice(at, len(part)))
            at, size = at + len(part), size + part.nbytes
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class _Words:
    """The words of a block of texts as hashes, and the windows in them."""

    def __init__(self, part: pa.Array, window: int):
        words, self.counts = words_of(part)
        self.hashes, self.window = word_hashes(words), window
        self.owner = np.repeat(np.arange(len(part)), self.counts)
        self.place = np.flatnonzero(self.owner[: max(len(self.owner) - window + 1, 0)] == self.owner[window - 1 :])
        self.own = self.owner[self.place]
        self.pos = self.place - (np.cumsum(self.counts) - self.counts)[self.own]

    def prefix(self, n: int, which=slice(None)) -> np.ndarray:
        """Fingerprints of the first n words of windows."""
        return grams(self.hashes, n)[self.place[which]] if len(self.place) else self.hashes[:0]

    def least_gram(self) -> np.ndarray:
        n = min(PREFIXES[0], self.window)
        return sliding_least(grams(self.hashes, n), self.window - n + 1)[self.place] if len(self.place) else self.hashes[:0]


def _levels(window: int) -> list[int]:
    return [*(n for n in PREFIXES if n < window), window]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


# 1: candidates


def _grams_of_runs(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, "text"):
            doc, row = (np.asarray(batch.column(c)) for c in ("doc", "row_hash"))
            w = _Words(batch.column("text"), window)
            if not len(w.place):
                continue
            gram = w.least_gram()
            first, n = _runs(w.own, gram)
            gram, own, start = gram[first].view(np.int64), w.own[first], w.pos[first].astype(np.int32)
            order = np.lexsort((doc[own], gram))
            at, size = _runs(gram[order])
            low, high = order[at], order[at + size - 1]
            shared = doc[own[low]] != doc[own[high]]
            known = np.empty(len(gram), bool)
            known[order] = np.repeat(shared, size)
            kept = np.concatenate([np.arange(len(gram)), low[shared], high[shared]])  # those at the end tell other blocks
            told = np.arange(len(kept)) >= len(gram)
            passes = known[kept] & ~told
            spread = mix(doc[own[kept]].view(np.uint64), start[kept].astype(np.uint64)).view(np.int64)
            key = np.where(passes, spread, gram[kept])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(passes), pa.array(doc[own[kept]]), pa.array(row[own[kept]]), pa.array(start[kept]), pa.array(np.where(told, 0, n[kept]).astype(np.int32))], _names(_RUNS))

    return run


def _shared_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs whose gram has more than one doc_id, from rows in order of gram and doc_id.

    Of the gram at hand only its first document's rows are held; where many rows share that doc_id they are
    candidates all the same, from HELD of them on.
    """
    gram, doc, shared, held = None, None, False, []
    for batch in batches:
        known = np.asarray(batch.column("known"))
        if known.any():
            yield batch.filter(pa.array(known)).select(["doc", "row_hash", "start", "n"])
            batch = batch.filter(pa.array(~known))
        if not len(batch):
            continue
        keys, docs = np.asarray(batch.column("key")), np.asarray(batch.column("doc"))
        rows = batch.select(["doc", "row_hash", "start", "n"])
        first, size = _runs(keys)
        several = docs[first] != docs[first + size - 1]
        goes_on = keys[0] == gram
        if goes_on and (shared or several[0] or docs[0] != doc):
            several[0] = True
            yield from held
        if not goes_on or several[0] or len(first) > 1:
            held = []
        if several.any():
            yield rows.filter(pa.array(np.repeat(several, size)))
        gram, doc, shared = keys[-1], docs[first[-1]], bool(several[-1])
        if not shared:
            held.append(rows.slice(int(first[-1])))
            if sum(map(len, held)) >= HELD:
                yield from held
                held, shared = [], True


def candidates(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc, row_hash and runs (start, n) of windows whose least gram another document holds too, as a table; rows: doc, text, row_hash."""
    runs = rows.select("doc", "row_hash", "text").mapInArrow(_grams_of_runs(window), _RUNS)
    shared = runs.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(_shared_runs, "doc long, row_hash long, start int, n int")
    return written(shared.filter("n > 0"), "substring-candidates")


# 2: prefixes


def _common_prefixes(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, "text"):
            w, which = _Words(batch.column("text"), window), slice(None)
            for level, n in enumerate(_levels(window)[:-1]):
                keys = w.prefix(n, which)
                order = np.argsort(keys, kind="stable")
                first, size = _runs(keys[order])
                often = size >= LOCAL
                if not often.any():
                    break
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(often.sum()), level, np.int32)), pa.array(keys[order][first[often]].view(np.int64)), pa.array(size[often].astype(np.int64))], ["level", "prefix", "n"])
                inside = order[np.repeat(often, size)]
                which = inside if isinstance(which, slice) else which[inside]

    return run


def large_prefixes(rows: DataFrame, window: int = WINDOW) -> list[np.ndarray]:
    """For each length the prefixes of more than GROUP suffixes, in order: fewer than all suffixes divided by that."""
    counted = rows.select("text").mapInArrow(_common_prefixes(window), "level int, prefix long, n long").groupBy("level", "prefix").agg(F.sum("n").alias("n"))
    found = counted.filter(F.col("n") > GROUP).select("level", "prefix").collect()
    return [np.sort(np.array([r["prefix"] for r in found if r["level"] == level], np.int64).view(np.uint64)) for level in range(len(_levels(window)) - 1)]


def _group_keys(w: _Words, which: np.ndarray, path: np.ndarray, large: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each suffix's prefix, as long as is needed."""
    out, left = np.empty(len(which), np.uint64), np.arange(len(which))
    for level, n in enumerate(_levels(w.window)):
        if not len(left):
            break
        last = level == len(large)
        keys = path[left] if last else w.prefix(n, which[left])
        more = np.zeros(len(left), bool) if last else _among(keys, large[level])
        out[left[~more]] = mix(keys[~more], np.full(int((~more).sum()), n, np.uint64))
        left = left[more]
    return out


# 3: subtrees

_LEAF = np.dtype([("group", "<u8"), ("path", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("pos", "<i4")])


def _packed(group: np.ndarray, path: np.ndarray, of: np.ndarray, pos: np.ndarray, doc: np.ndarray, row: np.ndarray) -> bytes:
    """Leaves of some texts of a block: column by column, each text's doc_id and row once."""
    used, of = np.unique(of, return_inverse=True)
    head = np.array([len(pos), len(used)], "<u4")
    return b"".join(x.tobytes() for x in (head, group.astype("<u8"), path.astype("<u8"), of.astype("<u4"), pos.astype("<u4"), doc[used].astype("<i8"), row[used].astype("<i8")))


def _unpacked(data) -> np.ndarray:
    n, m = np.frombuffer(data, "<u4", 2).tolist()
    at, out = 8, np.empty(n, _LEAF)
    for name, kind, size in (("group", "<u8", n), ("path", "<u8", n), ("of", "<u4", n), ("pos", "<u4", n), ("doc", "<i8", m), ("row", "<i8", m)):
        column = np.frombuffer(data, kind, size, at)
        at += column.nbytes
        if name == "of":
            of = column
        else:
            out[name] = column[of] if name in ("doc", "row") else column
    return out


def _repeats(group: np.ndarray, path: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each leaf lies under a node that has a smaller doc_id."""
    order = np.lexsort((path, group))
    first, n = _runs(group[order], path[order])
    least = np.minimum.reduceat(doc[order], first) if len(first) else doc[:0]
    out = np.empty(len(doc), bool)
    out[order] = doc[order] > np.repeat(least, n)
    return out


def _starts_of(of: np.ndarray, pos: np.ndarray, doc: np.ndarray, row: np.ndarray) -> list[pa.Array]:
    """doc, row_hash and the sorted starts of each text, from leaves with their text's number."""
    order = np.lexsort((pos, of))
    first, n = _runs(of[order])
    data = pos[order].astype("<i4").tobytes()
    ends = 4 * np.concatenate([[0], np.cumsum(n)])
    texts_ = of[order][first]
    return [pa.array(doc[texts_]), pa.array(row[texts_]), pa.array([data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())]


def _suffixes(window: int, large: Broadcast, bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, "text"):
            doc, row = (np.asarray(batch.column(c)) for c in ("doc", "row_hash"))
            w = _Words(batch.column("text"), window)
            runs = batch.column("runs")
            offsets, flat = np.asarray(runs.offsets), runs.flatten()
            text, n = np.repeat(np.arange(len(batch)), np.diff(offsets)), np.asarray(flat.field("n")).astype(np.int64)
            begin = np.asarray(flat.field("start")).astype(np.int64)
            # the windows of a text stand one after another: from its first one on by their start
            ahead = np.searchsorted(w.own, np.arange(len(batch)))
            which = np.unique(np.repeat(ahead[text] + begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            if not len(which):
                continue
            path = w.prefix(window, which)
            group, of, pos = _group_keys(w, which, path, large.value), w.own[which], w.pos[which]
            settled = _repeats(group, path, doc[of])
            if settled.any():
                docs, rows, starts = _starts_of(of[settled], pos[settled], doc, row)
                anywhere = mix(np.asarray(docs).view(np.uint64), np.asarray(rows).view(np.uint64)) % np.uint64(bins)
                yield pa.RecordBatch.from_arrays([pa.array(anywhere.astype(np.int32)), docs, rows, starts, pa.nulls(len(docs), pa.binary())], _names(_BINS))
            left = np.flatnonzero(~settled)
            where = (group[left] % np.uint64(bins)).astype(np.int32)
            order = np.argsort(where, kind="stable")
            left, where = left[order], where[order]
            at, size = _runs(where)
            packed = [_packed(*(x[left[a : a + k]] for x in (group, path, of, pos)), doc, row) for a, k in zip(at.tolist(), size.tolist(), strict=True)]
            nothing = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(where[at]), nothing, nothing, pa.nulls(len(at), pa.binary()), pa.array(packed, pa.binary())], _names(_BINS))

    return run


def _subtree(leaves: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Starts of repeats in each text, from all leaves of a bin."""
    all_ = np.concatenate(leaves)
    found = all_[_repeats(all_["group"], all_["path"], all_["doc"])]
    if len(found):
        order = np.lexsort((found["row"], found["doc"]))
        found = found[order]
        first, n = _runs(found["doc"], found["row"])
        of = np.repeat(np.arange(len(first)), n)
        yield pa.RecordBatch.from_arrays(_starts_of(of, found["pos"], found["doc"][first], found["row"][first]), _names(_STARTS))


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bin_, held = None, []
    for batch in batches:
        settled = np.asarray(batch.column("leaves").is_null())
        if settled.any():
            yield batch.filter(pa.array(settled)).select(_names(_STARTS))
        for number, data in zip(batch.column("bin").to_pylist(), batch.column("leaves"), strict=True):
            if not data.is_valid:
                continue
            if number != bin_ and held:
                yield from _subtree(held)
                held = []
            bin_ = number
            held.append(_unpacked(data.as_buffer()))
    if held:
        yield from _subtree(held)


def dealt_suffixes(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """The leaves of candidates by bin, and the starts that are settled already; rows: doc_id, doc, text, row_hash."""
    found, large = candidates(rows, window), large_prefixes(rows, window)
    total = found.agg(F.sum("n").alias("n")).first()["n"] or 0
    bins = max(BINS, 1 + total // SUFFIXES)
    runs = found.groupBy("doc", "row_hash").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    # all columns of rows, as in the last join, so that the texts are dealt once for both
    wanted = rows.join(runs, ["doc", "row_hash"]).select("doc_id", "doc", "row_hash", "text", "runs")
    known = rows.sparkSession.sparkContext.broadcast(large)
    return wanted.mapInArrow(_suffixes(window, known, bins), _BINS)


def repeated_starts(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc, row_hash and starts (32-bit integers) of windows that a smaller doc_id has; a text may have several rows."""
    return dealt_suffixes(rows, window).repartition("bin").sortWithinPartitions("bin").mapInArrow(_subtrees, _STARTS)


def _kept(window: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in blocks(batch.column(1)):
                words, counts = words_of(part)
                repeats = batch.column(2).slice(at, len(part)).to_pylist()
                ends = np.cumsum(counts)
                n, removed, digests, out = counts.tolist(), [], [], []
                for k, found in enumerate(repeats):
                    own = words.slice(int(ends[k]) - n[k], n[k])
                    gone = 0
                    if found:
                        starts = np.concatenate([np.frombuffer(x, "<i4") for x in found])
                        change = np.bincount(starts, minlength=n[k] + 1) - np.bincount(starts + window, minlength=n[k] + 1)
                        stay = np.cumsum(change[:-1]) == 0
                        gone = int(n[k] - stay.sum())
                        own = own.filter(pa.array(stay))
                    text = " ".join(own.to_pylist())
                    removed.append(gone)
                    digests.append(hashlib.sha256(text.encode()).hexdigest())
                    out.append(text)
                arrays = [batch.column(0).slice(at, len(part)), pa.array(counts), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(out, pa.string())] if keep_text else arrays, ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * keep_text])
                at += len(part)

    return run


def without_repeats(docs: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words joined by one space; with ``keep_text`` these words too."""
    rows = texts(docs).select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "text", F.xxhash64("text").alias("row_hash"))
    starts = repeated_starts(rows, window).groupBy("doc", "row_hash").agg(F.collect_list("starts").alias("starts"))
    joined = rows.join(starts, ["doc", "row_hash"], "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(_kept(window, keep_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(tuned(spark), sf_dir))
