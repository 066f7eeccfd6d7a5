"""Sections that tell members of a family apart, ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranked(sections: DataFrame, most: int) -> DataFrame:
    """(doc_id, rank, a, b) in order of rank and place; a range that lies in one taken before, or holds one, is passed over."""
    start = F.expr("cast(array() as array<struct<rank:int,a:bigint,b:bigint>>)")
    ordered = F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), "a", "b")))

    def step(kept, x):
        clash = F.exists(kept, lambda k: ((k.a <= x.a) & (x.b <= k.b)) | ((x.a <= k.a) & (k.b <= x.b)))
        return F.when(clash | (F.size(kept) >= most), kept).otherwise(F.concat(kept, F.array(x)))

    taken = sections.groupBy("doc_id").agg(F.aggregate(ordered, start, step).alias("kept"))
    return taken.select("doc_id", F.posexplode("kept").alias("k", "s")).select("doc_id", (F.col("k") + 1).alias("place"), "s.rank", "s.a", "s.b")
