"""The pipeline's stages against brute force, each on its predecessor's output."""

from __future__ import annotations

import re

import corpus_pipeline
import pytest

from quarryline.llm import toxicity

from .test_operators import _near, brute_distance


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name.replace(" ", "-"))
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "secret scans", "packing"]
    for docs in stages[1:5]:
        assert docs.columns == stages[0].columns and [f.dataType for f in docs.schema] == [f.dataType for f in stages[0].schema]


def test_toxic_documents_go(spark, sf, stages):
    model = toxicity.fit(*toxicity.sample(stages[0], spark.read.parquet(f"{sf}/labels.parquet")))
    expected = {r["doc_id"] for r in stages[0].collect() if not model or r["text"] is None or brute_distance(r["text"], model) < model.threshold}
    assert {r["doc_id"] for r in stages[1].collect()} == expected


def test_one_of_each_text_stays(stages):
    last = {}
    for r in stages[1].collect():
        last[r["text"]] = max(r["doc_id"], last.get(r["text"], -1))
    assert {r["doc_id"] for r in stages[2].collect()} == set(last.values())


def test_one_of_each_near_group_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    assert {r["doc_id"] for r in stages[3].collect()} == {i for i, _, c in _near(rows, 5) if i == c}


def test_secrets_are_replaced(stages):
    before = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    after = {r["doc_id"]: r for r in stages[4].collect()}
    assert before.keys() == after.keys()
    secret = re.compile(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}")
    for i, r in after.items():
        assert not secret.search(r["text"]) and r["n_chars"] == len(r["text"])
        if "[secret]" not in r["text"]:
            assert r["text"] == before[i]


def test_all_ids_are_packed(stages):
    packed = {}
    for r in stages[5].collect():
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["length"]
        assert r["length"] <= 4096
    assert packed.keys() == {r["doc_id"] for r in stages[4].collect()}


def test_run_and_empty_tables(spark, sf, stages):
    assert corpus_pipeline.run(spark, sf).count() == stages[5].count()
    docs = stages[0].filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_stages_take_odd_rows(spark, sf, edges):
    """Nulls, empty and very long texts, repeated rows and clashing columns; of null and empty texts one row stays."""
    docs = edges
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf)
        assert docs.columns == edges.columns
    assert sorted(r["doc_id"] for r in docs.collect()) == [2, 3, 4, 5, 6, 8, 9]
    packed = corpus_pipeline.STAGES[4][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.collect()} == {2, 3, 4, 5, 6, 8, 9}
