"""Column functions, and table functions for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register_table_functions(spark: SparkSession) -> None:
    """``text_lines(text)``: number and length of each line of a text, for SQL users."""
    from pyspark.sql.functions import udtf

    class TextLines:
        def eval(self, text: str):
            for number, line in enumerate((text or "").split("\n")):
                yield number, len(line)

    spark.udtf.register("text_lines", udtf(TextLines, returnType="line_no int, chars int", useArrow=False))
