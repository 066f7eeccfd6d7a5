"""Each operator against brute force on small tables, with null, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from quarryline.llm import byte_bpe, chunks, components, exact_dedup, language, media, near_dedup, packing, records, secrets, substring_dedup, toxicity
from quarryline.llm.common import shared_folder, tuned

from .conftest import BODY, EDGES, LONG

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module", autouse=True)
def _tuned(spark):
    tuned(spark)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD_BPE)


@pytest.fixture(scope="module")
def rank_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def known(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


# chunks

_MIXED = st.lists(st.sampled_from([*"abzAZ\u00e9 \u00df\t\n .,'!-09\u2019\x1c\x85\xa0\u2028", "'s", " the", "\U0001d518", "\u017f", "\u0130", "e\u0301"]), max_size=60).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(_MIXED, max_size=5))
def test_word_chunks_give_the_ids_of_whole_texts(texts):
    import pyarrow as pa

    encoder = chunks.word_encoder(WORD_BPE)
    ids, counts = encoder.encode(pa.array(texts, pa.string()))
    expected = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for e in expected for i in e]
    assert counts.tolist() == [len(e) for e in expected]


_MARKED = st.lists(st.sampled_from([*"aJjHTWKẞÉ \n.'!’\xa0", "\u030c", "\u0331", "\u0308", "\u030a", "\u0323", "\u212a", "\u0130", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext"]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(_MARKED, max_size=5))
@example(["J\u030c", "xH\u0331 T\u0308. W\u030a"])
@example(["a<|endoftext|>\u030cb", "", "plain", "<|startoftext|><|ENDOFTEXT|>"])
def test_word_chunks_give_the_ids_of_an_unaltered_tokenizer(texts):
    """Letters with marks of their own, which the tokenizer composes before it lower-cases."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    own = test_word_chunks_give_the_ids_of_an_unaltered_tokenizer.__dict__.setdefault("own", Tokenizer.from_file(WORD_BPE))
    ids, counts = chunks.word_encoder(WORD_BPE).encode(pa.array(texts, pa.string()))
    expected = [own.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for e in expected for i in e]
    assert counts.tolist() == [len(e) for e in expected]


@settings(max_examples=300, deadline=None)
@given(st.one_of(_MIXED, st.text(max_size=40)))
def test_byte_chunks_give_the_ids_of_the_ranks(text):
    import pyarrow as pa
    import tiktoken

    ranks = byte_bpe.read_ranks(RANKS)
    own = test_byte_chunks_give_the_ids_of_the_ranks.__dict__.setdefault("own", tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    bpe = byte_bpe.byte_bpe(RANKS, public_tokenizers.PATTERN)
    ids, _ = bpe.encoder.encode(pa.array([text], pa.string()))
    assert ids.tolist() == own.encode_ordinary(text)
    assert bpe.decode_text(ids) == text
    marks = bpe.offsets(ids)
    for a, b, i in zip(marks["char_start"], marks["char_end"], ids, strict=True):
        token = bpe.decode(np.array([i])).tobytes()
        assert token in text[a:b].encode()


def test_a_full_table_changes_nothing(tokenizer):
    import pyarrow as pa

    small = chunks.ChunkEncoder(tokenizer, chunks.split_words, limit=5, max_ids=20)
    texts = [f"alpha beta{k} gamma{k % 3}, delta" for k in range(50)]
    for _ in range(2):
        got = [i for t in texts for i in small.encode(pa.array([t]))[0].tolist()]
        assert got == [i for t in texts for i in tokenizer.encode(t, add_special_tokens=False).ids]


# 1: records


def _ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_records(spark, edges, empty, tokenizer):
    folder = shared_folder(spark, "t")
    records.write_records(edges, folder, WORD_BPE)
    records.write_index(spark, folder)
    rows = records.read_index(spark, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted((i for i, _ in EDGES), key=lambda i: (i is not None, i or 0))
    before = 0
    for r in rows:
        assert r["start"] == before
        before += r["n_tokens"]
    expected = Counter((i, zlib.crc32(np.array(_ids(tokenizer, t), "<u4").tobytes())) for i, t in EDGES)
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in rows) == expected
    read = {(r["doc_id"], tuple(r["ids"])) for r in records.read_records(spark, folder).collect()}
    assert read == {(i, tuple(_ids(tokenizer, t))) for i, t in EDGES}
    folder = shared_folder(spark, "t")
    records.write_records(empty, folder, WORD_BPE)
    records.write_index(spark, folder)
    assert records.read_index(spark, folder).count() == 0 and records.read_shuffled(spark, folder).count() == 0


def test_shuffled_reads(spark, make, tokenizer, monkeypatch):
    """By offset, in any order, from many shards of several tasks; starts are those of the ascending order."""
    monkeypatch.setattr(records, "BLOCK", 200)
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(k % 37))) for k in range(300)]
    folder = shared_folder(spark, "t")
    records.write_records(make(*rows), folder, WORD_BPE)
    records.write_index(spark, folder)
    index = records.read_index(spark, folder).collect()
    assert len({r["shard"] for r in index}) > 8
    expected, before = {i: _ids(tokenizer, t) for i, t in rows}, 0
    for r in sorted(index, key=lambda r: r["doc_id"]):
        assert r["start"] == before
        before += len(expected[r["doc_id"]])
    assert [r["shard_no"] for r in sorted(index, key=lambda r: (r["shard"], r["offset"]))] == sorted(r["shard_no"] for r in index)
    for k in np.random.default_rng(0).permutation(len(index)):
        r = index[k]
        with open(f"{folder.removeprefix('file:')}/{r['shard']}", "rb") as file:
            doc_id, ids = records.read_at(file, r["offset"])
        assert doc_id == r["doc_id"] and ids.tolist() == expected[doc_id]
    first, second = ([(r["doc_id"], r["ids"]) for r in records.read_shuffled(spark, folder, seed).collect()] for seed in (1, 2))
    assert dict(first) == dict(second) == expected and first != second


def test_frames_are_checked():
    data = records.frame(b"abc") + records.EMPTY_FRAME + records.frame(b"")
    assert [bytes(p) for _, _, p in records.frames(data)] == [b"abc"]
    for k in range(len(records.frame(b"abc"))):
        broken = bytearray(records.frame(b"abc"))
        broken[k] ^= 1
        with pytest.raises(ValueError):
            list(records.frames(bytes(broken)))
    with pytest.raises(ValueError):
        list(records.frames(data[:9]))


# 2: language


def test_language(spark, sf, edges, empty, docs):
    found = language.op2_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.95 * len(found)
    model = language.learn(docs.select("text", "lang"))
    rows = language.identify(edges, *model).collect()
    assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 4)} == {"und"}
    assert language.identify(empty, *model).count() == 0
    assert language.learn(empty.select("text", "lang"))[0] == []
    assert {r["lang_pred"] for r in language.identify(edges, *language.learn(empty.select("text", "lang"))).collect()} == {"und"}


def _plain_vector(text, letters):
    """A text's bundle, letter by letter: three neighbours bound after two, one and no cyclic shifts, white space and signs as one gap."""
    symbols = []
    for c in f" {text.lower()} ":
        x = ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 37 if c.isalpha() else 0
        if x or not symbols or symbols[-1]:
            symbols.append(x)
    total = np.zeros(language.DIMENSIONS)
    for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False):
        total += np.roll(letters[a], 2).astype(int) * np.roll(letters[b], 1) * letters[c]
    return total


def test_languages_against_plain_profiles(make, docs):
    letters = np.random.default_rng(language.SEED).choice(np.array([-1, 1], np.int8), (language.SYMBOLS, language.DIMENSIONS))
    train = [(r["text"], r["lang"]) for r in docs.filter("lang IS NOT NULL AND text IS NOT NULL").limit(60).collect()]
    spark = docs.sparkSession
    langs, prototypes = language.learn(spark.createDataFrame(train, "text string, lang string"))
    sums = {}
    for text, lang in train:
        sums[lang] = sums.get(lang, 0) + _plain_vector(text, letters)
    assert langs == sorted(sums)
    rows = [*EDGES[:5], *EDGES[10:], *((100 + k, t[:400]) for k, (t, _) in enumerate(train[:12])), (200, "…123"), (201, "Straße ÀÉÎ 東京 ж")]
    got = Counter((r["doc_id"], r["lang_pred"], round(r["score"], 4)) for r in language.identify(make(*rows), langs, prototypes).collect())
    expected = []
    for i, t in rows:
        vector = _plain_vector(t or "", letters)
        cosines = {x: float(vector @ s / max(np.linalg.norm(vector) * np.linalg.norm(s), 1e-9)) for x, s in sums.items()}
        best = max(sorted(cosines), key=cosines.get)
        lettered = any(c.isalpha() for c in t or "")
        expected.append((i, best if lettered else "und", round(min(max(cosines[best], 0), 1), 4) if lettered else 0.0))
    assert {(i, x): s for i, x, s in got}.keys() == {(i, x) for i, x, _ in expected}
    for (i, x, s), n in got.items():
        assert any(j == i and y == x and abs(s - z) < 2e-3 for j, y, z in expected) and n == sum(j == i and y == x and abs(s - z) < 2e-3 for j, y, z in expected)


# 3: near duplicates


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _near(rows, n, percent=80):
    sets = []
    for _, t in rows:
        w = _words(t)
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and rows[a][0] is not None and rows[b][0] is not None and 100 * len(x & y) >= percent * len(x | y):
                parent[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return Counter((i, len(sets[k]), least[top(k)] if i is not None else None) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("n", [2, 5])
def test_near_groups(edges, empty, docs, known, n):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(edges, n).collect())
    assert got == _near(EDGES, n)
    rows = sorted(known.items())
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(docs, n).collect())
    assert got == _near(rows, n)
    assert near_dedup.near_groups(empty, n).count() == 0


def test_near_groups_with_long_lists(make, monkeypatch):
    """A dense group around one text, some of it linked by few members only, a passage that all share, and more frequent values than the table holds."""
    monkeypatch.setattr(near_dedup, "SHORT", 4)
    monkeypatch.setattr(near_dedup, "HOT_VALUES", 60)
    rng = np.random.default_rng(3)
    base = [f"b{k}" for k in range(80)]
    passage = [f"p{k}" for k in range(30)]
    rows = []
    for i in range(60):
        words = list(base)
        for k in rng.choice(80, int(rng.integers(0, 9)), replace=False):
            words[k] = f"x{i}_{k}" if rng.random() < 0.5 else f"y{k}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join([f"u{i}_{k}" for k in range(int(rng.integers(5, 60)))] + passage)) for i in range(40)]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(make(*rows), 2).collect())
    assert got == _near(rows, 2)


@pytest.mark.parametrize("percent", [30, 50, 74, 95])
def test_near_groups_at_other_thresholds(make, percent):
    """Small sets share fewer values than the lists that larger ones meet in."""
    rng = np.random.default_rng(percent)
    rows = [(1, "a b c"), (2, "a b"), (3, "x y z v w"), (4, "x y z v u")]
    rows += [(10 + i, " ".join(rng.choice(list("abcdefgh"), int(rng.integers(1, 9))))) for i in range(40)]
    rows += [(100 + i, " ".join(rng.choice([f"m{k}" for k in range(6)], 150))) for i in range(10)]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(make(*rows), 2, percent).collect())
    assert got == _near(rows, 2, percent)


def test_near_groups_with_names_that_collide(make, monkeypatch):
    """All sets have one of two names; the second hash tells them apart."""
    rows = [(i, " ".join(f"w{i // 2}x{k}" for k in range(20))) for i in range(20)] + [(40, "a"), (41, "b"), (42, None)]
    monkeypatch.setattr(near_dedup, "sketches", _renamed)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(make(*rows), 2).collect())
    assert got == _near(rows, 2)


def _renamed(docs, n, k):
    F = near_dedup.F
    rows = near_dedup.texts(docs).withColumn("row_hash", F.xxhash64("text")).mapInArrow(near_dedup._sketched(n, k), near_dedup._SETS)
    return rows.withColumn("node", F.pmod("node", F.lit(2)).cast("long"))


def test_near_groups_of_tiny_sets_in_one_list(make):
    """Thousands of texts of five words that share a shingle: blocks are bounded by rows, and all links are found."""
    rows = [(i, f"same pair x{i // 3} y{i // 3} z{i % 3 if i % 5 else 0}") for i in range(6000)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(make(*rows), 2, 60).collect()}
    # four shingles: three of the same third are shared where only the last differs (3 / 5 = 60 %)
    assert got == {i: i // 3 * 3 for i in range(6000)}


def test_near_groups_of_frequent_shingles(make, monkeypatch):
    """Texts of one small vocabulary share many single values, but hardly a run: pairs don't grow with the length of such lists."""
    rng = np.random.default_rng(8)
    words = [list(rng.choice([f"v{k}" for k in range(50)], 100)) for _ in range(1500)]
    words += [[*w[:50], "other", *w[51:]] for w in words[:40]]
    seen, links = [], near_dedup._links
    monkeypatch.setattr(near_dedup, "_links", lambda pairs, *more: (seen.append(pairs.count()), links(pairs, *more))[1])
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(make(*[(i, " ".join(w)) for i, w in enumerate(words)]), 2).collect()}
    assert got == {i: i if i < 1500 else i - 1500 for i in range(1540)}
    assert 40 <= seen[0] < 1540


@pytest.mark.parametrize("percent", [60, 74, 80, 90])
def test_runs_that_similar_sets_share(percent):
    """Each way to lay out shared values and others of two whole sets: they share as many runs as the lists they must meet in."""
    run, least = near_dedup.run_length(64, percent), near_dedup.meetings(np.arange(65), 64, percent, near_dedup.run_length(64, percent))
    assert run > 1
    for union in range(2, 11):
        for layout in itertools.product((0, 1, 2), repeat=union):
            shared = layout.count(0)
            if union > shared and 100 * shared >= percent * union:
                row = [1, *[v == 0 for v in layout], 1]
                assert sum(all(row[k : k + run]) for k in range(len(row) - run + 1)) >= least[shared + max(layout.count(1), layout.count(2))]


def test_near_deduplicated(edges, empty):
    kept = near_dedup.deduplicated(edges)
    assert kept.columns == edges.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids == Counter({1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 8: 1, 9: 1, None: 2})
    assert near_dedup.deduplicated(empty).count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# 4: exact duplicates


def _exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    last = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return Counter((i, last[t or ""], len(groups[t or ""]), i == last[t or ""]) for i, t in rows)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: exact_dedup.F.substring(exact_dedup.sha256(c), 1, 0)])
def test_exact_groups(edges, empty, digest):
    """The second digest is the same for all texts, so only the full bytes tell texts of one length apart."""
    rows = [*EDGES, (20, "ab"), (21, "cd"), (22, "ab")]
    more = edges.unionByName(edges.sparkSession.createDataFrame([(i, t) for i, t in rows[-3:]], "doc_id long, text string"), allowMissingColumns=True)
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(more, digest).collect())
    assert got == _exact(rows)
    assert exact_dedup.exact_groups(empty, digest).count() == 0


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: exact_dedup.F.substring(exact_dedup.sha256(c), 1, 0)])
def test_a_second_run_goes_on_with_the_state(spark, make, empty, tmp_path, digest):
    """Rows added later, hits within and across runs: the result is that of one run over all rows."""
    runs = [EDGES, [(40, BODY), (41, "new"), (3, "a")], [(42, None), (43, "new"), (1, "b"), (44, "xyz")]]
    state, seen = str(tmp_path / "state"), []
    for k, rows in enumerate(runs):
        path = str(tmp_path / f"docs {k}")
        make(*rows).write.parquet(path)
        seen += rows
        found = exact_dedup.exact_groups(spark.read.parquet(path), digest, state)
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found.collect()) == _exact(seen)
    assert exact_dedup.exact_groups(empty, digest, state).count() == len(seen)
    again = {r["digest"]: r for r in exact_dedup.exact_groups(empty, digest, state).collect()}
    assert all("docs%20" in r["locator"]["file"] for r in again.values())


def test_content_of_a_former_run_must_be_readable(make, tmp_path):
    state = str(tmp_path / "state")
    assert exact_dedup.exact_groups(make((1, "a"), (2, "a")), state=state).count() == 2
    with pytest.raises(ValueError):
        exact_dedup.exact_groups(make((3, "a")), state=state)


def test_texts_without_hits_are_not_moved(make, monkeypatch):
    """With and without a broadcast the same rows; only texts of hits reach the comparison."""
    rows = [(k, f"text {k % 50}" if k < 100 else f"alone {k}") for k in range(200)]
    for most in (0, 200_000):
        monkeypatch.setattr(exact_dedup, "BROADCAST_HITS", most)
        got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(make(*rows)).collect())
        assert got == _exact(rows)


def test_exact_deduplicated(edges, empty):
    kept = exact_dedup.deduplicated(edges)
    assert kept.columns == edges.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()).keys() == {(i, t) for i, t in EDGES if (i, t) not in {(1, None), (None, None), (5, BODY), (None, BODY)}}
    assert kept.count() == len({t or "" for _, t in EDGES})
    assert exact_dedup.deduplicated(empty).count() == 0


# 5: secrets

_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def _base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


SECRETS = [
    (30, "Password = 'hunter2222' 𝔘 token:abc token:abcdefg AKIA" + "A1" * 8 + " " + "0af" * 9),
    (31, "PASSWD=" + "x" * 5 + "secret=" + "y" * 9 + " api_key:  apikey=k.k/k+k= AKIAAKIA" + "B" * 14),
    (32, "ghp_" + "Zy" * 18 + " xoxb-1234567890ab eyJhbGciOi12.eyJzdWIiOi12.abcdefgh1 -----BEGIN RSA PRIVATE KEY-----"),
    (33, "AKIA" + "Z" * 15 + " " + "a" * 23),
]


def test_secrets(make, empty):
    rows = [*EDGES, *SECRETS]
    found = secrets.scan(make(*rows)).select("doc_id", secrets.span_list(secrets.F.filter("found", lambda s: s.kind_no < 3)).alias("base"), secrets.span_list(secrets.F.col("found")).alias("spans")).collect()
    assert Counter((r["doc_id"], r["base"]) for r in found) == Counter((i, _base_spans(t)) for i, t in rows)
    spans = {r["doc_id"]: r["spans"] for r in found}
    assert [x.split(":")[0] for x in spans[32].split(",")] == ["code_host", "chat", "web_token", "private_key"]
    assert secrets.scan(empty).count() == 0


def test_a_long_text_with_many_secrets(make):
    """Spans and replaced text of thousands of matches, with characters of several bytes between them and matches of two rules that overlap."""
    text = "".join(f"ü{k} token=abc{k:06d} 𝔘 {'0a' * 13}{k:04d} token: AKIA{'Q' * 16}{k} password=ab " for k in range(3000))
    rows = [(1, text), (2, text[:3000]), (None, "token=abcdefgh"), (None, "token=abcdefgh"), (None, "none")]
    found = secrets.scan(make(*rows)).select("doc_id", secrets.span_list(secrets.F.filter("found", lambda s: s.kind_no < 3)).alias("base")).collect()
    assert Counter((r["doc_id"], r["base"]) for r in found) == Counter((i, _base_spans(t)) for i, t in rows)
    spans = sorted(tuple(map(int, x.split(":")[1:])) for x in _base_spans(text).split(","))
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = max(at, b)
    done = {r["doc_id"]: r["text"] for r in secrets.redacted(make(*rows)).filter("doc_id IS NOT NULL").collect()}
    assert done[1] == "".join(out) + text[at:]


def test_sums_before_each(spark):
    F = secrets.F
    for n in (0, 1, 127, 128, 129, 1000):
        values = [(7 * k) % 5 for k in range(n)]
        row = spark.createDataFrame([(values,)], "v array<int>").select(secrets.before_each(F.col("v"), lambda a, x: a + x).alias("s"), secrets.before_each(F.col("v"), lambda a, x: F.greatest(a, x)).alias("m")).first()
        assert row["s"] == [sum(values[:k]) for k in range(n)] and row["m"] == [max([0, *values[:k]]) for k in range(n)]


def test_trigram_queries():
    assert secrets.trigram_query(r"AKIA[A-Z0-9]+") == {frozenset({"aki", "kia"})}
    assert secrets.trigram_query(r"[0-9a-f]+") is None
    assert secrets.trigram_query(r"(abc|x*)d") is None
    query = secrets.trigram_query(r"(alpha|beta)[0-9]")
    for text, hit in (("alpha7", True), ("xbeta1", True), ("gamma", False)):
        assert any(all(g in text for g in s) for s in query) is hit


def test_redaction(make):
    rows = [(1, "a token=abcdef123 z"), (2, "clean"), (3, None), (4, "AKIA" + "A" * 20 + " x " + "ab0" * 10)]
    done = {r["doc_id"]: r for r in secrets.redacted(make(*rows)).collect()}
    assert done[1]["text"] == "a [secret] z" and done[1]["n_chars"] == len("a [secret] z")
    assert done[2]["text"] == "clean" and done[3]["text"] is None and done[4]["text"] == "[secret] x [secret]"
    assert done[2]["_hash"] == "h"


# 6: toxicity


def brute_distance(text, model):
    """Window by window with zstandard alone; a text under a window's size is one window."""
    import zstandard

    data = (text or "").lower().encode()
    parts = []
    while data or not parts:
        cut = len(data)
        if cut > toxicity.WINDOW:
            cut = data[: toxicity.WINDOW].rfind(b" ") + 1
            cut = cut if cut > toxicity.WINDOW // 2 + 1 else toxicity.WINDOW
        parts.append(data[:cut])
        data = data[cut:]
    total = 0.0
    for part in parts:
        sizes = []
        for content in (model.ordinary, model.toxic):
            kind = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            kind.precompute_compress(level=model.level)
            sizes.append(len(zstandard.ZstdCompressor(level=model.level, dict_data=kind, write_content_size=False, write_dict_id=False).compress(part)))
        total += max(sizes[0] - sizes[1] - model.margin, 0)
    return total / len(parts)


def _talk():
    rng = np.random.default_rng(5)
    syllables = ["ka", "lo", "mi", "ne", "ru", "sa", "to", "vi", "pel", "dor", "gan", "shi"]
    word = lambda: "".join(rng.choice(syllables, int(rng.integers(1, 4))))
    good = [" ".join(word() for _ in range(int(rng.integers(60, 150)))) for _ in range(240)]
    # a whole word, and a stem inside ever changing words
    bad = [" ".join(("grumble" if rng.random() < 0.5 else "xqzw" + word()) if rng.random() < 0.05 else word() for _ in range(120)) for _ in range(120)]
    return bad, good


def test_toxicity(spark, docs, edges, empty):
    bad, good = _talk()
    model = toxicity.fit(bad[:80], good[:160], 0.3)
    flags = lambda some: [model.distance(t) >= model.threshold for t in some]
    assert np.mean(flags(bad[80:])) > 0.9 and np.mean(flags(good[160:])) < 0.05
    rows = toxicity.score(edges, model).collect()
    assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert toxicity.score(empty, model).count() == 0
    assert {r["score"] for r in toxicity.score(edges, None).collect()} == {0.0}
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit(*toxicity.sample(docs, labels)) is None
    assert toxicity.without_toxic(edges, model).columns == edges.columns


def test_toxicity_scores_are_those_of_brute_force(make, edges):
    bad, good = _talk()
    model = toxicity.fit(bad, good, 0.3)
    rows = [*EDGES[:10], *EDGES[11:], *enumerate(bad[:10] + good[:10] + ["x" * 1000, "grumble " * 400, "a  b\n" * 90], 100)]
    got = Counter((r["doc_id"], round(r["score"], 9)) for r in toxicity.score(make(*rows), model).collect())
    expected = [(i, 1 / (1 + np.exp(-np.clip((brute_distance(t, model) - model.threshold) / model.scale, -50, 50)))) for i, t in rows]
    assert got == Counter((i, round(x, 9)) for i, x in expected)


def test_toxic_samples_are_runs_of_whole_words():
    toxic = [b" some xqzwka%d here " % k for k in range(9)] + [b" plain words %d " % k for k in range(9)]
    ordinary = [b" plain words of %d " % k for k in range(30)]
    [runs] = toxicity.toxic_samples(toxic, ordinary, (2.0,))
    assert any(r.startswith(b" some xqzwka") or r.startswith(b" xqzwka") for r in runs) and not any(b"plain" in r for r in runs)
    assert toxicity.toxic_samples([], [], (2.0,)) == [[]] and toxicity.toxic_samples(toxic[:3], [], (2.0,)) == [[]]


def test_nothing_is_rejected_where_nothing_is_told_apart():
    texts = [f"some talk number {k} about the weather" for k in range(40)]
    model = toxicity.fit(texts[::2], texts[1::2], 0.1)
    assert sum(model.distance(t) >= model.threshold for t in texts) <= 2


# 7: byte-level BPE


def test_byte_bpe(edges, empty, rank_encoding):
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in byte_bpe.encode_documents(edges, RANKS, public_tokenizers.PATTERN).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = [(i, t or "", rank_encoding.encode_ordinary(t or "")) for i, t in EDGES]
    assert got == Counter((i, len(x), sha(np.array(x, "<u4").tobytes()), sha(t.encode())) for i, t, x in ids)
    full = byte_bpe.encode_documents(edges, RANKS, public_tokenizers.PATTERN, full=True).filter("doc_id = 9").first()
    assert full["decoded"].decode() == EDGES[11][1]
    assert byte_bpe.encode_documents(empty, RANKS, public_tokenizers.PATTERN).count() == 0


# 8: media


@pytest.mark.parametrize("kind", [0, 1, 2, None])
def test_png_round_trip(kind):
    rng = np.random.default_rng(1)
    for n in (1, 2, 33, 500):
        data = rng.integers(0, 256, n * 64, dtype=np.uint8).tobytes()
        assert media.read_png(media.write_png(data, filter_type=kind)).tobytes() == data


def test_unfilter_all_kinds():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 256, (40, 64)).astype(int)
    kinds = rng.integers(0, 5, 40)
    lines = np.zeros_like(rows)
    for r in range(40):
        for k in range(64):
            a = rows[r, k - 1] if k else 0
            b = rows[r - 1, k] if r else 0
            c = rows[r - 1, k - 1] if r and k else 0
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            lines[r, k] = (rows[r, k] - [0, a, b, (a + b) // 2, near][kinds[r]]) % 256
    assert (media.unfilter(kinds, lines.astype(np.uint8)) == rows).all()


def test_png_checks():
    good = media.write_png(media.payload("some text"))
    for k in range(len(good)):
        broken = bytearray(good)
        broken[k] ^= 1
        with pytest.raises(ValueError):
            media.read_png(bytes(broken))
    with pytest.raises(ValueError):
        media.read_png(good[:-3])


def test_png_errors_are_value_errors():
    """Chunks with right checksums but wrong contents: a short head, samples that are no zlib stream, too few of them, an unknown filter."""
    head = media.struct.pack(">IIBBBBB", 64, 1, 8, 0, 0, 0, 0)
    end = media._chunk(b"IEND", b"")
    lines = lambda data: media._chunk(b"IDAT", data)
    for parts in (
        [media._chunk(b"IHDR", head[:5]), lines(zlib.compress(bytes(65))), end],
        [media._chunk(b"IHDR", head), lines(b"no zlib"), end],
        [media._chunk(b"IHDR", head), lines(zlib.compress(bytes(65))[:-3]), end],
        [media._chunk(b"IHDR", head), lines(zlib.compress(bytes(64))), end],
        [media._chunk(b"IHDR", head), lines(zlib.compress(b"\x07" + bytes(64))), end],
        [media._chunk(b"IHDR", head), end],
        [media._chunk(b"IHDR", media.struct.pack(">IIBBBBB", 64, 1, 16, 0, 0, 0, 0)), lines(zlib.compress(bytes(65))), end],
    ):
        with pytest.raises(ValueError):
            media.read_png(media.SIGNATURE + b"".join(parts))


def _plain_feature(text):
    """The hash by its definition: means of a 32 by 32 grid, a cosine transform term by term, bits above the median of all but the first."""
    import math

    data = (text or "").encode()
    data += bytes(-len(data) % 64 if data else 64)
    rows = [list(data[k : k + 64]) for k in range(0, len(data), 64)]
    cut = lambda n: [(i * n // 32, max((i + 1) * n // 32, i * n // 32 + 1)) for i in range(32)]
    grid = [[sum(rows[y][x] for y in range(a, b) for x in range(c, d)) / ((b - a) * (d - c)) for c, d in cut(64)] for a, b in cut(len(rows))]
    low = [round(sum(grid[y][x] * math.cos(math.pi * u * (2 * y + 1) / 64) * math.cos(math.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)), 6) for u in range(8) for v in range(8)]
    rest = sorted(low[1:])
    middle = rest[len(rest) // 2]
    bits = "".join("1" if x > middle else "0" for x in low)
    return f"{int(bits, 2):016x}"


def test_features_are_those_of_the_definition(make):
    rng = np.random.default_rng(4)
    rows = [(1, None), (2, "a"), (3, "ab" * 40), *((10 + k, " ".join(rng.choice(["alpha", "beta", "Gamma", "ü"], 20 + 60 * k))) for k in range(8))]
    got = {r["doc_id"]: r["feature"] for r in media.features(media.store(make(*rows))).collect()}
    assert got == {i: _plain_feature(t) for i, t in rows}


def test_media(edges, empty):
    got = Counter((r["doc_id"], r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in media.features(media.store(edges)).collect())
    pads = [(i, (t or "").encode()) for i, t in EDGES]
    full = [(i, b, b + bytes(-len(b) % 64 if b else 64)) for i, b in pads]
    assert got == Counter((i, len(b), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for i, b, p in full)
    by_text = {}
    for r in media.features(media.store(edges)).collect():
        by_text.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by_text.values())
    assert media.features(media.store(empty)).count() == 0


# 9: packing


@pytest.mark.parametrize("size", [7, 4096])
def test_packing(edges, empty, tokenizer, size):
    pieces = packing.pack_documents(edges, WORD_BPE, size=size, keep_ids=True)
    rows = sorted(pieces.collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    held = {}
    for r in rows:
        assert r["offset"] == held.get(r["sequence_id"], 0)
        held[r["sequence_id"]] = r["offset"] + r["length"]
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and r["length"] > 0
    assert set(held) == set(range(len(held))) and all(n == size for k, n in held.items() if k < len(held) - 1)
    stream = np.frombuffer(b"".join(r["ids"] for r in rows), "<u4").tolist()
    order = {}
    docs, at = [], 0
    for r in rows:
        if r["start"] == 0:
            docs.append((r["doc_id"], stream[at : at + r["doc_tokens"]]))
            at += r["doc_tokens"]
    assert at == len(stream) and not order
    assert Counter((i, tuple(x)) for i, x in docs) == Counter((i, tuple(_ids(tokenizer, t))) for i, t in EDGES)
    whole = packing.sequences(pieces, size).orderBy("sequence_id").collect()
    assert np.frombuffer(b"".join(r["ids"] for r in whole), "<u4").tolist() == stream
    last = whole[-1]
    assert last["padded_length"] == (last["length"] if last["length"] & (last["length"] - 1) == 0 else size)
    assert packing.pack_documents(empty, WORD_BPE).count() == 0


# 10: substrings


def _removed(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    rank = [substring_dedup.LAST if i is None else i for i, _ in rows]
    first = {}
    for k, w in enumerate(words):
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            first[key] = min(rank[k], first.get(key, rank[k]))
    out = []
    for k, w in enumerate(words):
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < rank[k]:
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((rows[k][0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("window", "suffixes"), [(50, 2_000_000), (3, 2_000_000), (9, 10)])
def test_substrings(edges, empty, make, monkeypatch, window, suffixes):
    monkeypatch.setattr(substring_dedup, "SUFFIXES", suffixes)
    got = Counter(tuple(r) for r in substring_dedup.without_repeats(edges, window).collect())
    assert got == _removed(EDGES, window)
    rng = np.random.default_rng(window)
    rows = [(int(rng.integers(0, 25)), " ".join(rng.choice(["a", "b", "A"], int(rng.integers(0, 120))))) for _ in range(30)]
    got = Counter(tuple(r) for r in substring_dedup.without_repeats(make(*rows), window).collect())
    assert got == _removed(rows, window)
    assert substring_dedup.without_repeats(empty, window).count() == 0


def test_long_text_is_whole(edges):
    row = substring_dedup.without_repeats(edges, keep_text=True).filter("doc_id = 8").first()
    assert row["kept_text"] == LONG and row["n_removed"] == 0


def _groups(docs, window=50):
    """Leaves of each group that is dealt, as (doc, row, pos)."""
    F = substring_dedup.F
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(substring_dedup.LAST)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("row_hash"))
    out = {}
    for r in substring_dedup.dealt_suffixes(rows, window).filter("leaves IS NOT NULL").collect():
        for leaf in substring_dedup._unpacked(bytes(r["leaves"])):
            out.setdefault(int(leaf["group"]), []).append((int(leaf["path"]), int(leaf["doc"]), int(leaf["pos"])))
    return out


def test_a_common_line_makes_no_large_group(make, monkeypatch):
    """A line of 30 words in different surroundings: windows that begin with it share 8 and 16 words, and are told apart by longer prefixes."""
    monkeypatch.setattr(substring_dedup, "GROUP", 25)
    monkeypatch.setattr(substring_dedup, "LOCAL", 1)
    monkeypatch.setattr(substring_dedup, "SUFFIXES", 100)
    line = " ".join(f"licence{k}" for k in range(30))
    rows = [(d, " ".join(f"x{d % 40}-{k}" for k in range(40)) + f" {line} " + " ".join(f"z{d % 20}-{k}" for k in range(40))) for d in range(60)]
    docs = make(*rows)
    groups = _groups(docs)
    assert max(map(len, groups.values())) <= 25
    monkeypatch.setattr(substring_dedup, "GROUP", 10**9)
    assert max(map(len, _groups(docs).values())) > 25
    monkeypatch.setattr(substring_dedup, "GROUP", 25)
    assert Counter(tuple(r) for r in substring_dedup.without_repeats(docs).collect()) == _removed(rows, 50)


def test_suffixes_of_one_document_alone_are_not_dealt(make):
    far = [" ".join(f"f{d}-{k}" for k in range(120)) for d in range(6)]
    assert _groups(make(*enumerate(far))) == {}
    assert _groups(make((1, far[0]), (1, far[0] + " more"))) == {}
    assert len(_groups(make((1, far[0]), (2, far[0])))) > 0


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_shared_runs(size, monkeypatch):
    """Whatever the batches, runs come back if their gram has a second document; rows told by other blocks count as one."""
    import pyarrow as pa

    rng = np.random.default_rng(size)
    for _ in range(60):
        rows = sorted((int(rng.integers(0, 4)), bool(rng.random() < 0.1), int(rng.integers(0, 3)), k, k, int(rng.integers(0, 2))) for k in range(int(rng.integers(0, 25))))
        rows.sort(key=lambda r: (r[0], r[2]))
        names = substring_dedup._names(substring_dedup._RUNS)
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[a : a + size], strict=True), kinds, strict=True)], names) for a in range(0, len(rows), size)]
        docs = {}
        for r in rows:
            if not r[1]:
                docs.setdefault(r[0], set()).add(r[2])
        expected = sorted(r[3] for r in rows if r[1] or len(docs[r[0]]) > 1)
        assert sorted(x for b in substring_dedup._shared_runs(iter(batches)) for x in b.column("row_hash").to_pylist()) == expected
        monkeypatch.setattr(substring_dedup, "HELD", 2)  # more candidates than needed, never fewer
        assert set(expected) <= {x for b in substring_dedup._shared_runs(iter(batches)) for x in b.column("row_hash").to_pylist()}
        monkeypatch.setattr(substring_dedup, "HELD", 500_000)


def test_rows_without_ids_hold_no_memory(make, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HELD", 3)
    far = " ".join(f"f{k}" for k in range(70))
    rows = [(None, f"{far} {k}") for k in range(30)] + [(5, far)]
    assert Counter(tuple(r) for r in substring_dedup.without_repeats(make(*rows)).collect()) == _removed(rows, 50)


@pytest.mark.parametrize("window", [3, 50])
def test_split_groups_of_repeating_words(make, monkeypatch, window):
    """A pair of words over and over has two nodes, which come as one row each; other repeats keep their places."""
    monkeypatch.setattr(substring_dedup, "GROUP", 1)
    monkeypatch.setattr(substring_dedup, "LOCAL", 1)
    monkeypatch.setattr(substring_dedup, "BLOCK", 300)
    rng = np.random.default_rng(3)
    far = " ".join(f"f{k}" for k in range(90))
    rows = [(1, "a b " * 400), (2, "x " + "a b " * 300), (3, f"{far} u {far} v v {far}"), (4, f"y {far}"), (None, "a b " * 60)]
    rows += [(int(rng.integers(0, 9)), " ".join(rng.choice(["a", "b"], 80))) for _ in range(20)]
    assert Counter(tuple(r) for r in substring_dedup.without_repeats(make(*rows), window).collect()) == _removed(rows, window)
