"""Listings of files, file names, and readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def listing(spark: SparkSession, root: str, pattern: str = "*.{pdf,PDF}") -> DataFrame:
    """path, mtime and size of the files below a root, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.regexp_replace("path", F.lit(r"^.*/"), F.lit("")).alias("name"))


def roots(text: Column, separator: str = ":") -> Column:
    """Entries of a path list: unquoted, without blanks, each once."""
    parts = F.transform(F.split(text, separator), lambda p: F.trim(F.regexp_replace(F.trim(p), r"^[\"']|[\"']$", "")))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def matching(files: DataFrame, query: str) -> DataFrame:
    """Files whose relative path holds all terms in any case; backslash and slash are the same."""
    plain = F.replace(F.lower("relpath"), F.lit("\\"), F.lit("/"))
    terms = query.lower().replace("\\", "/").split()
    for term in terms:
        files = files.filter(F.contains(plain, F.lit(term)))
    return files


def found(files: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """The first matches in order of path; a file that several roots hold counts once, for the first root."""
    once = matching(files, query).withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("root_order"))).filter("_n = 1").drop("_n")
    return once.orderBy(F.lower("relpath"), "relpath").limit(max(1, min(limit, 500)))


def unique_stems(files: DataFrame, stem: str, order: str) -> DataFrame:
    """The first keeps its stem, later ones get -2, -3 and so on; a number that another file has as its own name is passed over."""
    numbered = files.withColumn("_rn", F.row_number().over(Window.partitionBy(stem).orderBy(order)))
    proposed = numbered.withColumn("stem", F.when(F.col("_rn") == 1, F.col(stem)).otherwise(F.concat(F.col(stem), F.lit("-"), F.col("_rn").cast("string"))))
    taken = files.select(F.col(stem).alias("stem")).distinct().withColumn("_taken", F.lit(True))
    clash = proposed.join(taken, "stem", "left").withColumn("_clash", F.coalesce(F.col("_taken"), F.lit(False)) & (F.col("_rn") > 1))
    shift = F.sum(F.col("_clash").cast("int")).over(Window.partitionBy(stem).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    # after a clash the numbers of this stem move on by the clashes so far
    moved = F.when((F.col("_rn") > 1) & (shift > 0), F.concat(F.col(stem), F.lit("-"), (F.col("_rn") + shift).cast("string"))).otherwise(F.col("stem"))
    return clash.withColumn("stem", moved).drop("_rn", "_taken", "_clash")


def kilobytes(size: Column) -> Column:
    return F.ceil(size / 1024)


def is_stale(listed_at: Column, now: Column, seconds: int = 86_400) -> Column:
    """Older than a day, or from the future."""
    age = F.unix_timestamp(now) - F.unix_timestamp(listed_at)
    return (age < 0) | (age > seconds)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a log of JSON lines; lines that do not parse are dropped, and so are session marks."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).filter(F.col("kind") != "session_start")


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document for each file; NaN parses as a number."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


PAGE_MARK = r"--- PAGE (\d+) ---"


def page_texts(documents: DataFrame, text: str = "text") -> DataFrame:
    """page and its text from one string with page marks; blank lines at a page's ends go."""
    numbers = F.regexp_extract_all(F.col(text), F.lit(PAGE_MARK), 1)
    bodies = F.slice(F.split(F.col(text), PAGE_MARK), F.lit(2), F.size(numbers))
    pairs = F.arrays_zip(numbers.alias("page"), bodies.alias("body"))
    others = [c for c in documents.columns if c != text]
    return documents.select(*others, F.inline(pairs)).select(*others, F.col("page").cast("int").alias("page"), F.regexp_replace(F.regexp_replace("body", r"^[\r\n]+", ""), r"\s+$", "").alias("page_text"))


def marked_text(pages: DataFrame, key: str) -> DataFrame:
    """The way back: one string with page marks for each document."""
    part = F.concat(F.lit("--- PAGE "), F.col("page").cast("string"), F.lit(" ---\n"), F.col("page_text"))
    return pages.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", part.alias("p")))), lambda x: x.p), "\n").alias("text"))


def page_body(text: Column, page: Column) -> Column:
    """One page of a text with page marks, without its mark and blank ends; null where there is no such page."""
    mark = F.concat(F.lit("--- PAGE "), page.cast("string"), F.lit(" ---"))
    at = F.instr(text, mark)
    rest = F.substring(text, at + F.length(mark), F.length(text))
    body = F.regexp_replace(rest, rf"(?s){PAGE_MARK}.*\z", "")
    return F.when(at > 0, F.regexp_replace(F.regexp_replace(body, r"\A[\r\n]+", ""), r"\s+\z", ""))
