"""Near-duplicates by bottom-k sketches from one hash function.

A text's set holds its distinct shingles of ``n`` words (A-Z lower-cased); its sketch the k least
fingerprints of the set.  Equal sets are one node: a 64-bit hash over the full set names it, and a
second one over the full set tells sets of one name apart.  Nodes are linked where
100 * intersection >= percent * union.

1.  Inverted lists of runs.  A key is a run of ``run_length`` consecutive retained values, the ends of a
    set standing as values too.  Two sets that are similar enough share ``meetings`` runs: whole ones
    surely, cut ones all but surely, as the least values of the union are a sample of it (of 64 values
    at 0.8, fewer than three begin a shared run of three with a chance of 1 in 70 million).
    A single value is shared by texts that have nothing but a frequent phrase in common, and the more of
    them the larger the table; a run is not.  Where the threshold is too low for runs, the keys are a
    sketch's rarest values: with ``NEEDED`` more than the complement of ``least_shared``, two such
    sketches meet in NEEDED lists, or in all values they must share where these are fewer.  A key's
    frequency is counted over all sketches; the ``HOT_VALUES`` most frequent are sent to all tasks,
    in a table of bounded size.
2.  A short list gives its pairs, and pairs that meet in too few lists fall away.  A long
    list gives, for each member, a pair with the list's least and with its scattered member: no
    pairs within the group.  After the components of these are known, a long list whose members
    are still in more than one component gives a query set, its members outside its largest
    component, which is compared with all its members by full sets, in blocks of bounded bytes and
    rows; each pair of blocks is a row of its own, dealt by both numbers.  Lists with the same
    largest component are compared once.  No pair is written there but links,
    one for each component that a member is linked with, so no link between components is lost.
3.  The estimate over the union's sketch drops pairs far below the threshold; the full sets of
    those that remain are compared.

A text with fewer words than n has its whole sequence as its one shingle.  A text without words, or
null, has an empty set and is linked with nothing, and so is a row without doc_id.  A component's
name is its smallest doc_id, ``kept`` marks the row that has it.  Rows that share doc_id and set
are all marked alike; ``deduplicated`` returns one of them.  An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import blocks
from .common import arrow_rows, documents, fresh, texts, tuned, written
from .components import components
from .words import grams, mix, word_hashes, words_of

#: Values of a sketch; lists that two sketches must meet in at most; members of a short list at most; rows of the table of frequent values.
K, NEEDED, SHORT, HOT_VALUES = 64, 3, 32, 100_000

#: Bytes and rows of sets in a block, about, cells of a matrix, and pairs of blocks that a worker holds.
BLOCK_BYTES, BLOCK_ROWS, CELLS, BLOCK_PAIRS = 1 << 20, 2048, 1 << 21, 4

#: Parts that a list's rows are dealt to where lists are joined.
SALTS = 32

#: Standard errors that the estimate may lie below the threshold; the chance to miss a link at the threshold that is taken.
SLACK, MISSED = 5.5, 1e-7

#: Values of a run at most; orders by which long lists choose their scattered members, so that lists of the same members choose few.
RUN, ORDERS = 3, 8

#: Stands before and after a set's values.
_EDGE = np.uint64(0xA0761D6478BD642F)

_SETS = "doc_id long, row_hash long, node long, proof long, n long, sketch array<long>"
_WHOLE = np.uint64(0x5851F42D4C957F2D)


def sets_of(part: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of all texts, sorted, one after another, and their sizes."""
    words, counts = words_of(pc.ascii_lower(part))
    hashes = word_hashes(words)
    owner = np.repeat(np.arange(len(part)), counts)
    shingles = grams(hashes, n)
    inside = owner[: len(shingles)] == owner[n - 1 :] if len(shingles) else np.zeros(0, bool)
    values, own = shingles[inside], owner[: len(shingles)][inside]
    few = np.flatnonzero((counts > 0) & (counts < n))
    if len(few):
        starts = np.cumsum(counts) - counts
        whole = np.array([mix(np.array([_WHOLE]), np.array([xxhash.xxh3_64_intdigest(hashes[starts[k] : starts[k] + counts[k]].tobytes())], np.uint64))[0] for k in few], np.uint64)
        values, own = np.concatenate([values, whole]), np.concatenate([own, few])
    order = np.lexsort((values, own))
    values, own = values[order], own[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (own[1:] != own[:-1])
    return values[new], np.bincount(own[new], minlength=len(part)).astype(np.int64)


def set_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes over each full set: its node's name, and the proof that a name stands for one set."""
    data = [values[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    return tuple(np.fromiter((xxhash.xxh3_64_intdigest(x, seed) for x in data), np.uint64, len(data)).view(np.int64) for seed in (0, 1))


def _sketched(n: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in blocks(batch.column(1)):
                values, sizes = sets_of(part, n)
                ends = np.cumsum(sizes)
                starts = ends - sizes
                node, proof = set_hashes(values, starts, ends)
                held = np.minimum(sizes, k)
                offsets = np.concatenate([[0], np.cumsum(held)]).astype(np.int32)
                flat = values[np.repeat(starts - offsets[:-1], held) + np.arange(offsets[-1])].view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), batch.column(2).slice(at, len(part)), pa.array(node), pa.array(proof), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [x.split()[0] for x in _SETS.split(", ")])
                at += len(part)

    return run


def sketches(docs: DataFrame, n: int, k: int = K) -> DataFrame:
    """doc_id, row_hash, the set's node and proof, its size and its sketch (a signed view of unsigned values, in unsigned order)."""
    return texts(docs).withColumn("row_hash", F.xxhash64("text")).mapInArrow(_sketched(n, k), _SETS)


def least_shared(size: np.ndarray, k: int, percent: int) -> np.ndarray:
    """Retained values that a sketch shares with each one that is similar enough."""
    j = percent / 100
    cut = int(k * (j - SLACK * (j * (1 - j) / k) ** 0.5))
    return np.where(size * 100 <= k * percent, -(-size * percent // 100), max(cut, 1))


def too_few(k: int, percent: int, run: int, times: int) -> float:
    """The chance that of k values, each shared with the threshold's chance, fewer than ``times`` begin a run of shared ones."""
    j, state = percent / 100, {(0, 0): 1.0}
    for _ in range(k):
        after: dict[tuple[int, int], float] = {}
        for (row, found), chance in state.items():
            more = (min(row + 1, run), found + (row + 1 >= run))
            if more[1] < times:
                after[more] = after.get(more, 0) + chance * j
            after[0, found] = after.get((0, found), 0) + chance * (1 - j)
        state = after
    return sum(state.values())


def run_length(k: int, percent: int) -> int:
    """Values of a key: as many as whole sets share in a row surely, and cut ones all but surely."""

    def surely(run: int) -> bool:  # so many values on one side only part the shared ones and the two ends
        return percent == 100 or all(-(-(-(-percent * m // (100 - percent)) + 2) // (m + 1)) >= run for m in range(1, k + 1))

    return next((r for r in range(RUN, 1, -1) if surely(r) and too_few(k, percent, r, 1) <= MISSED), 1)


def meetings(size: np.ndarray, k: int, percent: int, run: int) -> np.ndarray:
    """Lists that a sketch shares with each one that is similar enough; size: of the larger set."""
    if run == 1:
        return np.minimum(least_shared(size, k, percent), NEEDED)
    cut = max((t for t in range(1, NEEDED + 1) if too_few(k, percent, run, t) <= MISSED), default=1)
    union = np.arange(k * 100 // percent + 1)
    surely = union + 3 - run - run * (union * (100 - percent) // 100)  # the keys that shared values and ends have with as many others between them as may be
    whole = [surely[n : n * 100 // percent + 1].min() for n in range(k + 1)]
    return np.where(size <= k, np.clip(whole, 1, NEEDED)[np.minimum(size, k)], cut)


def keys_of(batch: pa.RecordBatch, k: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all sketches, one after another, and how many each has."""
    sketch = batch.column("sketch")
    values, held = np.asarray(sketch.flatten()), np.diff(np.asarray(sketch.offsets)).astype(np.int64)
    if run == 1:
        return values, held
    whole = np.asarray(batch.column("n")) <= k
    length = held + 1 + whole
    ends = np.cumsum(length)
    inside = np.ones(length.sum(), bool)
    inside[ends - length] = False
    inside[ends[whole] - 1] = False
    row = np.full(len(inside), _EDGE)
    row[inside] = values.view(np.uint64)
    own = np.repeat(np.arange(len(held)), length)
    if len(row) < run:
        return np.zeros(0, np.int64), np.zeros(len(held), np.int64)
    keys = grams(row, run)
    return keys[own[: len(keys)] == own[run - 1 :]].view(np.int64), np.maximum(length - run + 1, 0)


def _counted(k: int, run: int):
    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(keys_of(batch, k, run)[0])], ["value"])

    return run_


def _listed(table: Broadcast, k: int, percent: int, run: int, long: bool):
    """Rows (value, node, n) of the long lists that the table names, or of all others."""

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, often = table.value
        for batch in batches:
            values, held = keys_of(batch, k, run)
            size, node = np.asarray(batch.column("n")), np.asarray(batch.column("node"))
            own = np.repeat(np.arange(len(node)), held)
            place = np.minimum(np.searchsorted(hot, values), max(len(hot) - 1, 0))
            known = hot[place] == values if len(hot) else np.zeros(len(values), bool)
            if run == 1:
                freq = np.where(known, often[place] if len(hot) else 0, 0)
                order = np.lexsort((values, freq, own))
                rank = np.arange(len(values)) - np.repeat(np.cumsum(held) - held, held)
                stay = order[rank < np.minimum(held, held - least_shared(size, k, percent) + NEEDED)[own]]
                stay = stay[known[stay] == long]
            else:
                stay = np.flatnonzero(known == long)
            yield pa.RecordBatch.from_arrays([pa.array(values[stay]), pa.array(node[own[stay]]), pa.array(size[own[stay]])], ["value", "node", "n"])

    return run_


def _distinct(columns: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array(c) for c in np.unique(np.stack(columns), axis=1)]


def _stars(pivots: Broadcast):
    """Pairs of a long list's members with its pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, *ends = pivots.value
        for batch in batches:
            place, node = np.searchsorted(value, np.asarray(batch.column("value"))), np.asarray(batch.column("node"))
            u, v = np.tile(node, len(ends)), np.concatenate([end[place] for end in ends])
            yield pa.RecordBatch.from_arrays(_distinct([np.minimum(u, v)[u != v], np.maximum(u, v)[u != v]]), ["u", "v"])

    return run


def _opened(lists: Broadcast):
    """Members of open lists with the list's largest component; a row for several lists of a batch that have the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, main = lists.value
        for batch in batches:
            value, node, label = (np.asarray(batch.column(c)) for c in ("value", "node", "label"))
            place = np.minimum(np.searchsorted(values, value), len(values) - 1)
            held = values[place] == value
            yield pa.RecordBatch.from_arrays(_distinct([main[place[held]], node[held], label[held]]), ["main", "node", "label"])

    return run


def _list_pairs(k: int, percent: int, run: int):
    """Pairs of the members of each list and the lists they need, from rows sorted by value; a list that is longer than SHORT all the same gives stars and chains."""

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, members, n = None, [], 0
        for batch in batches:
            us, vs, star, larger = [], [], [], []
            values = np.asarray(batch.column("value"))
            same = values[1:] == values[:-1]
            some = pa.array(np.append(True, same) | np.append(same, True))  # the last row may go on in the next batch
            for x, node, size in zip(*(batch.column(c).filter(some).to_pylist() for c in ("value", "node", "n")), strict=True):
                if x != value:
                    value, members, n = x, [], 0
                if n < SHORT:
                    for other, its in members:
                        if 100 * min(size, its) >= percent * max(size, its):
                            us.append(min(node, other))
                            vs.append(max(node, other))
                            star.append(False)
                            larger.append(max(size, its))
                    members.append((node, size))
                else:
                    for other, its in (members[0], members[-1]):
                        us.append(min(node, other))
                        vs.append(max(node, other))
                        star.append(True)
                        larger.append(size)
                    members[-1] = (node, size)
                n += 1
            if us:
                need = meetings(np.array(larger), k, percent, run)
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64()), pa.array(star, pa.bool_()), pa.array(need, pa.int64())], ["u", "v", "star", "need"])

    return run_


def _estimated(k: int, percent: int):
    j = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("sketch_u"), batch.column("sketch_v")
            ao, bo = np.asarray(a.offsets), np.asarray(b.offsets)
            av, bv = np.asarray(a.values).view(np.uint64), np.asarray(b.values).view(np.uint64)
            na, nb = np.asarray(batch.column("n_u")), np.asarray(batch.column("n_v"))
            stay = np.zeros(len(batch), bool)
            for r in np.flatnonzero(100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)):
                x = np.sort(np.concatenate([av[ao[r] : ao[r + 1]], bv[bo[r] : bo[r + 1]]]), kind="stable")
                twice = x[1:] == x[:-1]
                union = len(x) - int(twice.sum())
                whole = na[r] <= k and nb[r] <= k
                if not whole and union > k:  # the k least of the union: k distinct values from the front
                    new = np.append(True, ~twice)
                    last = int(np.searchsorted(np.cumsum(new), k + 1))
                    twice, union = twice[: last - 1], k
                estimate = twice.sum() / union
                stay[r] = estimate >= (j - 1e-9 if whole else j - SLACK * (j * (1 - j) / union) ** 0.5)
            yield batch.select(["u", "v"]).filter(pa.array(stay))

    return run


def _full_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in blocks(batch.column(1)):
                values, sizes = sets_of(part, n)
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array([values[b - c : b].tobytes() for b, c in zip(ends, sizes, strict=True)], pa.binary())], ["node", "whole"])
                at += len(part)

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = np.zeros(len(batch), bool)
            for r, (a, b) in enumerate(zip(batch.column("whole_u"), batch.column("whole_v"), strict=True)):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (a, b))
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                stay[r] = 100 * shared >= percent * (len(both) - shared)
            yield batch.select(["u", "v"]).filter(pa.array(stay))

    return run


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b: products of their incidence matrices, some columns at a time."""
    shared = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)))
    out = np.zeros((len(a), len(b)), np.float32)
    width = max(64, CELLS // max(len(a), len(b), 1))
    for at in range(0, len(shared), width):
        columns = shared[at : at + width]
        each = []
        for side in (a, b):
            matrix = np.zeros((len(side), len(columns)), np.float32)
            for r, values in enumerate(side):
                place = np.searchsorted(columns, values)
                place[place == len(columns)] = 0
                matrix[r, place[columns[place] == values]] = 1
            each.append(matrix)
        out += each[0] @ each[1].T
    return out


def _blocks_compared(percent: int):
    """Links between a block of the query set and a block of members: for each query one with each other component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few, many in zip(batch.column("few"), batch.column("many"), strict=True):
                sides = []
                for side in (few.values, many.values):
                    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in side.field("whole")]
                    sides.append((np.asarray(side.field("node")), np.asarray(side.field("label")), sets, np.array([len(x) for x in sets])))
                (na, la, a, sa), (nb, lb, b, sb) = sides
                both = _overlaps(a, b)
                linked = (100 * both >= percent * (sa[:, None] + sb[None] - both)) & (la[:, None] != lb[None])
                rows, columns = np.nonzero(linked)
                if len(rows):
                    _, first = np.unique(np.stack([rows, lb[columns]]), axis=1, return_index=True)
                    yield pa.RecordBatch.from_arrays([pa.array(na[rows[first]]), pa.array(nb[columns[first]])], ["u", "v"])

    return run


def _joined(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    for side in ("u", "v"):
        pairs = pairs.join(table.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return pairs


def _whole_sets(wanted: DataFrame, nodes: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """node and its full set, made anew from a text that has it; rows: a text for each doc_id and row_hash."""
    some = wanted.join(nodes.select("node", "rep", "row_hash"), "node")
    found = rows.join(some.select(F.col("rep").alias("doc_id"), "row_hash", "node"), ["doc_id", "row_hash"]).select("node", "text")
    return written(found.mapInArrow(_full_sets(n), "node long, whole binary").dropDuplicates(["node"]), "near-sets")


def _links(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, n: int, k: int, percent: int) -> DataFrame:
    """Those pairs (u, v) of nodes that are links."""
    likely = written(_joined(pairs, nodes, "n", "sketch").mapInArrow(_estimated(k, percent), "u long, v long"), "near-likely")
    whole = _whole_sets(likely.select(F.explode(F.array("u", "v")).alias("node")).distinct(), nodes, rows, n)
    return written(_joined(likely, whole, "whole").mapInArrow(_confirmed(percent), "u long, v long"), "near-links")


def _links_between(open_lists: DataFrame, nodes: DataFrame, rows: DataFrame, n: int, percent: int, few_lists: bool) -> DataFrame:
    """Links between components within the open lists (main, node, label); ``few_lists``: there are fewer than HOT_VALUES."""
    asks = open_lists.groupBy("main", "node", "label").agg(F.max(F.col("label") != F.col("main")).alias("asks"))
    members = written(asks.join(nodes.select("node", "n"), "node"), "near-members")
    size = lambda side: F.when(F.col("asks") == side, 1)
    parts = lambda side: (F.greatest(F.floor(F.sum(size(side) * F.col("n")) * 8 / BLOCK_BYTES), F.floor(F.sum(size(side)) / BLOCK_ROWS)) + 1).cast("int")
    sizes = members.groupBy("main").agg(F.coalesce(parts(True), F.lit(0)).alias("p_few"), F.coalesce(parts(False), F.lit(0)).alias("p_rest"))
    dealt = members.join(F.broadcast(sizes) if few_lists else sizes, "main")
    # the rest's blocks are numbered first, those of the query set after them
    own = F.pmod(F.xxhash64("node"), F.when(F.col("asks"), F.col("p_few")).otherwise(F.col("p_rest"))).cast("int")
    placed = dealt.withColumn("block", own + F.when(F.col("asks"), F.col("p_rest")).otherwise(0))
    whole = _whole_sets(members.select("node").distinct(), nodes, rows, n)
    block = written(placed.join(whole, "node").groupBy("main", "block", "p_few", "p_rest").agg(F.collect_list(F.struct("node", "label", "whole")).alias("sets")), "near-blocks")
    queries = block.filter("block >= p_rest")
    # a query block meets all blocks of the rest, and those of the query set from its own on
    meets = F.filter(F.sequence(F.lit(0), F.col("p_rest") + F.col("p_few") - 1), lambda b: (b < F.col("p_rest")) | (b >= F.col("block")))
    few = queries.select("main", F.col("block").alias("fb"), F.explode(meets).alias("mb"), F.col("sets").alias("few"))
    met = F.filter(F.sequence(F.col("p_rest"), F.col("p_rest") + F.col("p_few") - 1), lambda b: (F.col("block") < F.col("p_rest")) | (b <= F.col("block")))
    many = block.filter("p_few > 0").select("main", F.explode(met).alias("fb"), F.col("block").alias("mb"), F.col("sets").alias("many"))
    with arrow_rows(nodes.sparkSession, BLOCK_PAIRS):
        return written(few.join(many, ["main", "fb", "mb"]).select("few", "many").mapInArrow(_blocks_compared(percent), "u long, v long"), "near-links")


def _told_apart(all_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows, and the nodes with the least row of each; a name that stands for different sets is replaced."""
    linked = all_rows.filter("n > 0 AND doc_id IS NOT NULL")
    least = F.min(F.struct("doc_id", "row_hash", "n", "sketch")).alias("m")
    nodes = written(linked.groupBy("node").agg(least, (F.min("proof") != F.max("proof")).alias("differ")).select("node", F.col("m.doc_id").alias("rep"), "m.row_hash", "m.n", "m.sketch", "differ"), "near-nodes")
    differ = nodes.filter("differ").select("node", "differ")
    if differ.isEmpty():
        return all_rows, nodes
    renamed = all_rows.join(differ, "node", "left").withColumn("node", F.when(F.col("differ"), F.xxhash64("node", "proof")).otherwise(F.col("node"))).drop("differ")
    return _told_apart(written(renamed, "near-sketches"))


def _named(names: DataFrame) -> DataFrame:
    """node and the least doc_id of its component, from node, rep and label.

    The largest components, of which there are HOT_VALUES at most, reach their nodes by a broadcast, so no
    task gets all nodes of one; the others meet in a join.
    """
    least = written(names.groupBy("label").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("members")), "near-names")
    large = least.filter(F.col("members") > SHORT).orderBy(F.desc("members"), "label").limit(HOT_VALUES).select("label", F.col("component_id").alias("large_id"))
    marked = names.join(F.broadcast(large), "label", "left")
    rest = marked.filter("large_id IS NULL").join(least, "label").select("node", "component_id")
    return marked.filter("large_id IS NOT NULL").select("node", F.col("large_id").alias("component_id")).unionByName(rest)


def near_groups(docs: DataFrame, n: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """doc_id, row_hash, n_shingles, component_id and kept for each row of ``docs``."""
    all_rows, nodes = _told_apart(written(sketches(docs, n, k), "near-sketches"))
    run, sketched = run_length(k, percent), nodes.select("node", "n", "sketch")
    often = sketched.mapInArrow(_counted(k, run), "value long").groupBy("value").agg(F.count(F.lit(1)).alias("often"))
    hot = often.filter(F.col("often") > SHORT).orderBy(F.desc("often"), "value").limit(HOT_VALUES).toArrow().sort_by("value")
    table = docs.sparkSession.sparkContext.broadcast((hot.column("value").to_numpy(), hot.column("often").to_numpy()))  # at most HOT_VALUES rows
    in_list = "value long, node long, n long"
    long = written(sketched.mapInArrow(_listed(table, k, percent, run, True), in_list), "near-long")
    pivots = long.groupBy("value").agg(F.min("node").alias("first"), F.min_by("node", F.xxhash64(F.pmod("value", F.lit(ORDERS)), "node")).alias("scattered"))
    ends = pivots.toArrow().sort_by("value")  # at most HOT_VALUES rows
    stars = long.mapInArrow(_stars(docs.sparkSession.sparkContext.broadcast(tuple(ends.column(c).to_numpy() for c in ("value", "first", "scattered")))), "u long, v long")
    rest = sketched.mapInArrow(_listed(table, k, percent, run, False), in_list)
    short = rest.repartition("value").sortWithinPartitions("value", "node").mapInArrow(_list_pairs(k, percent, run), "u long, v long, star boolean, need long")
    meet = short.groupBy("u", "v").agg(F.count(F.lit(1)).alias("lists"), F.max("star").alias("star"), F.max("need").alias("need"))
    enough = meet.filter((F.col("lists") >= F.col("need")) | F.col("star")).select("u", "v")
    rows = texts(docs).withColumn("row_hash", F.xxhash64("text"))
    links = _links(stars.unionByName(enough).distinct(), nodes, rows, n, k, percent)
    labels = components(links)
    # what is left: long lists that hold more than one component
    listed = long.select("value", "node")
    if len(hot) == HOT_VALUES:  # more values are frequent than the table holds: their lists are long as well
        others = rest.select("value", "node")
        listed = listed.unionByName(others.join(others.groupBy("value").count().filter(F.col("count") > SHORT).select("value"), "value"))
    members = listed.join(labels, "node", "left").select("value", "node", F.coalesce("label", "node").alias("label"))
    sizes = members.groupBy("value", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("value").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count(F.lit(1)).alias("labels"))
    few_lists, some = len(hot) < HOT_VALUES, sizes.filter("labels > 1").select("value", "main")
    if few_lists:  # a row for each long list
        mains = some.toArrow().sort_by("value")
        table = docs.sparkSession.sparkContext.broadcast(tuple(mains.column(c).to_numpy() for c in ("value", "main")))
        open_lists = members.mapInArrow(_opened(table), "main long, node long, label long") if len(mains) else members.select(F.col("label").alias("main"), "node", "label").limit(0)
    else:  # one value may have a third of all rows
        salts = F.explode(F.array(*map(F.lit, range(SALTS))))
        open_lists = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(some.select("*", salts.alias("salt")), ["value", "salt"])
    open_lists = written(open_lists.select("main", "node", "label"), "near-open")
    if not open_lists.isEmpty():
        more = _links_between(open_lists, nodes, rows, n, percent, few_lists)
        if not more.isEmpty():
            labels = components(links.unionByName(more))
    names = nodes.select("node", "rep").join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    named = _named(names)
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    done = all_rows.select("doc_id", "row_hash", "node", "n").join(named, "node", "left").select("doc_id", "row_hash", F.col("n").alias("n_shingles"), own.alias("component_id"))
    return done.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group."""
    key = fresh(docs, "_hash")
    kept = near_groups(docs, n, percent).filter("kept").groupBy(F.col("doc_id").alias("_kept_id"), F.col("row_hash").alias("_kept_hash")).agg(F.count(F.lit(1)).alias("_n"))
    kept = written(kept, "near-kept")
    ids = kept.select(*[F.col(c).alias(fresh(docs, c)) for c in ("_kept_id", "_kept_hash")])
    rows = docs.withColumn(key, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    found = rows.join(ids, F.col("doc_id").cast("long").eqNullSafe(ids[0]) & (F.col(key) == ids[1]), "left_semi")
    if not kept.filter("_n > 1 AND _kept_id IS NOT NULL").isEmpty():  # rows equal in doc_id and text: any one of them stays
        found = found.filter("doc_id IS NULL").unionByName(found.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id", key]))
    return found.select(*docs.columns)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(tuned(spark), sf_dir), n=2).select("doc_id", "n_shingles", "component_id", "kept")
