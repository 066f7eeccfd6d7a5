"""From raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read
again as the next stage's docs.  All but the last give the columns of documents.

1.  toxicity: documents that the compression distance rejects go; it is fitted on labels.parquet.
2.  exact dedup: of equal texts the row with the largest doc_id stays.
3.  near dedup: of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the
    smallest doc_id stays.
4.  secret scans: spans of secrets are replaced in the text; no document goes.
5.  packing: sequences of at most 4096 ids, a row for each piece of a document.

A null text is never toxic, counts as empty in the deduplications (of null and empty texts one row
stays), has no secrets and packs to the end id alone.  A row without doc_id stays in the exact
deduplication only where no row of its text has one, and is linked with nothing in the near one.
Rows equal in doc_id and text are one.  Empty tables stay empty.  Other columns pass through as they
are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarryline.llm import exact_dedup, near_dedup, packing, secrets, toxicity
from quarryline.llm.common import tuned, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tuned(spark)
    model = toxicity.fit(*toxicity.sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.without_toxic(docs, model)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tuned(spark)
    return near_dedup.deduplicated(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tuned(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("secret scans", secrets_stage),
    ("packing", packing_stage),
]

#: SQL has no zstandard and no tokenizers; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
