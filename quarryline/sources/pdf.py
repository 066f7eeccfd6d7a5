"""Documents as bytes: checks before anything reads them, and a source of pages for those who have a PDF library."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a document at most, and how far into it its mark may stand.
LARGEST, MARK_WITHIN = 100 << 20, 1024


def problem(content: Column, content_type: Column, url: Column) -> Column:
    """Why a downloaded document is refused, or null."""
    head = F.substring(content.cast("binary"), 1, MARK_WITHIN)
    return (
        F.when(~F.rlike(url, F.lit("^https?://")), "not an http address")
        .when((content_type != "") & ~F.contains(F.lower(content_type), F.lit("pdf")), "not a PDF by its type")
        .when(F.octet_length(content) == 0, "empty")
        .when(F.octet_length(content) > LARGEST, "too large")
        .when(~F.contains(head, F.lit(b"%PDF-")), "not a PDF by its content")
    )


def accepted(documents: DataFrame) -> DataFrame:
    """Documents (url, content_type, content) without a problem."""
    return documents.filter(problem(F.col("content"), F.coalesce("content_type", F.lit("")), F.col("url")).isNull())


class _Pages(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class PdfBlocks(DataSource):
    """``spark.read.format("pdf_blocks").load(path)``: text blocks of a PDF, some pages to a task.  Needs PyMuPDF on the executors."""

    @classmethod
    def name(cls) -> str:
        return "pdf_blocks"

    def schema(self) -> str:
        return "page int, block_no int, x0 double, y0 double, x1 double, y1 double, text string, block_type int, page_width double, page_height double"

    def reader(self, schema) -> DataSourceReader:
        return _BlockReader(self.options["path"], int(self.options.get("pagesPerTask", "16")))


class _BlockReader(DataSourceReader):
    def __init__(self, path: str, pages: int):
        self.path, self.pages = path, pages

    def partitions(self) -> list[InputPartition]:
        import pymupdf

        with pymupdf.open(self.path) as doc:
            return [_Pages(self.path, k, min(k + self.pages, len(doc))) for k in range(0, len(doc), self.pages)]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        import pymupdf

        with pymupdf.open(partition.path) as doc:
            for number in range(partition.first, partition.last):
                page = doc[number]
                for x0, y0, x1, y1, text, block_no, kind in page.get_text("blocks"):
                    yield number + 1, block_no, x0, y0, x1, y1, text, kind, page.rect.width, page.rect.height


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PdfBlocks)
