"""Exact deduplication as a stateful stream, in DataFrame operations only.

A batch pass makes one small row for each document: the SHA-256 of its text, its length in
bytes, its doc_id and its locator (file and doc_id).  A stream over those rows keeps, in a RocksDB
state store without expiry, for each digest the largest doc_id (the stable identifier), the
locator of that row and the number of rows.  Partial sums come before the shuffle, so a digest
that a third of all rows share is one row for each task.  The state itself is then read as a
table.  With a ``state`` folder of the caller's the next call goes on with what the state retains,
and gives the result of one call over the rows of all of them.

Full bytes are checked on hits, that is for digests that more than one row has: the content that
the state's locator names is compared with the least and the greatest text of the digest (both
summed up before the shuffle).  No other text is moved.  Content of former calls is read from the
files that the locators name.  Where texts differ, the groups of that digest are made anew by
digest and text, so a collision cannot merge different texts.

Of equal texts the row with the largest doc_id stays; a row without doc_id stays only where no
row of its group has one.  A null text counts as empty.  Rows that are equal in text and doc_id
all carry ``kept`` alike; ``deduplicated`` returns one of them.  An empty table gives an empty
result.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager, suppress
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh, shared_folder, texts, written

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "32",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}

#: Rows of a part of the state, about; there are no more parts than the session has shuffle partitions.
STATE_ROWS = 40_000

#: Digests with hits of which an eight-byte hash is sent to all tasks, at most (some 32 bytes each there); with more all texts meet them in a join.
BROADCAST_HITS = 1_000_000

KEY = ["digest", "n_bytes"]


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _digested(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    rows = texts(docs, F.input_file_name().alias("file"))
    return rows.select("doc_id", "text", digest(F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"), F.struct("file", "doc_id").alias("locator"))


def keyed_state(spark: SparkSession, fingerprints: str, schema, checkpoint: str, files_a_batch: int = 4096) -> DataFrame:
    """digest, n_bytes, keep_id, locator and group_size from a stream over the fingerprint files that ``checkpoint`` does not know yet."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(fingerprints)
    groups = stream.groupBy("digest", "n_bytes").agg(F.max(F.struct("doc_id", "locator")).alias("last"), F.count(F.lit(1)).alias("n"))
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + spark.read.schema(schema).parquet(fingerprints).count() // STATE_ROWS)
    with _settings(spark, STATE_STORE | {"spark.sql.shuffle.partitions": str(parts)}):  # a known checkpoint keeps its own number of parts
        query = groups.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        state = spark.read.format("statestore").load(checkpoint)
        return written(state.select("key.digest", "key.n_bytes", F.col("value.max.doc_id").alias("keep_id"), F.col("value.max.locator").alias("locator"), F.col("value.count").alias("group_size")), "dedup-groups")


def _content(spark: SparkSession, docs: DataFrame, hits: DataFrame, fingerprints: DataFrame, run: int, digest: Callable[[Column], Column]) -> DataFrame:
    """Rows of all calls that may be hits: those of ``docs``, and of the files that the locators of former calls' hits name."""
    rows = _digested(docs, digest)
    former = fingerprints.filter(F.col("run") < run).join(hits, KEY, "left_semi").select("locator.file").distinct()
    files = sorted(unquote(r["file"]) for r in former.collect()) if run else []  # a name for each file, as Spark's own listing has
    if "" in files:
        raise ValueError("rows of a former call did not come from files, so their content cannot be read again")
    return rows.unionByName(_digested(spark.read.parquet(*files), digest)) if files else rows


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, state: str | None = None) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept and the keeper's locator for each row of ``docs``, and of all former calls with the same ``state`` folder."""
    spark = docs.sparkSession
    folder = state or shared_folder(spark, "dedup-state")
    path, run = f"{folder}/fingerprints", 0
    if state:
        with suppress(AnalysisException):  # there is no table yet
            run = 1 + (spark.read.parquet(path).agg(F.max("run")).first()[0] or 0)
    rows = _digested(docs, digest).select("doc_id", "digest", "n_bytes", "locator", F.lit(run).alias("run"))
    rows.write.mode("append").parquet(path)
    fingerprints = spark.read.schema(rows.schema).parquet(path)
    if fingerprints.isEmpty():
        return fingerprints.select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "locator")
    groups = keyed_state(spark, path, rows.schema, f"{folder}/checkpoint")
    hits = groups.filter("group_size > 1").select(*KEY, F.col("locator").alias("retained"))
    content = _content(spark, docs, hits, fingerprints, run, digest)
    if hits.count() <= BROADCAST_HITS:  # texts without hits stay where they are
        hashed = F.xxhash64(*KEY)
        some = F.broadcast(hits.select(hashed.alias("_hash")).distinct())
        content = content.withColumn("_hash", hashed).join(some, "_hash", "left_semi").drop("_hash")
    # summed up before anything is joined, so the texts of a large group stay one row a task
    last = F.struct("doc_id", "locator")
    same = content.groupBy(*KEY).agg(F.min("text").alias("least"), F.max("text").alias("most"), F.max_by("text", last).alias("content"), F.max(last).locator.alias("found"))
    differ = ~F.col("found").eqNullSafe(F.col("retained")) | (F.col("least") != F.col("content")) | (F.col("most") != F.col("content"))
    collided = written(same.join(hits, KEY).filter(differ).select(*KEY), "dedup-collisions")
    if collided.isEmpty():
        found = fingerprints.select("doc_id", *KEY).join(groups, KEY)
    else:
        anew = content.join(collided, KEY, "left_semi")
        each = anew.groupBy(*KEY, "text").agg(F.max(F.struct("doc_id", "locator")).alias("last"), F.count(F.lit(1)).alias("group_size"))
        again = anew.select("doc_id", *KEY, "text").join(each, [*KEY, "text"]).select("doc_id", *KEY, "last.doc_id", "last.locator", "group_size").toDF("doc_id", *KEY, "keep_id", "locator", "group_size")
        found = fingerprints.select("doc_id", *KEY).join(groups.join(collided, KEY, "left_anti"), KEY).unionByName(again)
    return found.select("doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "locator")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one for each text."""
    key = fresh(docs, "_digest")
    kept = exact_groups(docs).filter("kept").groupBy(F.col("doc_id").alias("_kept_id"), F.col("digest").alias("_kept_digest")).agg(F.count(F.lit(1)).alias("_n"))
    kept = written(kept, "dedup-kept")
    ids = kept.select(*[F.col(c).alias(fresh(docs, c)) for c in ("_kept_id", "_kept_digest")])
    rows = docs.withColumn(key, sha256(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    found = rows.join(ids, F.col("doc_id").cast("long").eqNullSafe(ids[0]) & (F.col(key) == ids[1]), "left_semi")
    if not kept.filter("_n > 1").isEmpty():  # rows equal in doc_id and text: any one of them stays
        found = found.dropDuplicates(["doc_id", key])
    return found.select(*docs.columns)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
