"""spark-submit -m quarryline IN OUT: builds manifests for the documents at IN that are not in the manifest at OUT yet."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans import index, manifest, options


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("source", help="Parquet with doc_id and text")
    parser.add_argument("out", help="folder for the manifest rows")
    parser.add_argument("--version", type=int, default=1, help="number of the manifest's version to write")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("quarryline").getOrCreate()
    docs, key = spark.read.parquet(args.source), options.Options().key()
    old = spark.read.schema(manifest.MANIFEST).parquet(f"{args.out}/manifest/version={args.version - 1}") if args.version > 1 else spark.createDataFrame([], manifest.MANIFEST)
    # a version's rows are replaced when it is written again; a reader takes each document's last version (artifacts.current)
    index.manifest(manifest.to_build(docs, old, key)).write.mode("overwrite").parquet(f"{args.out}/rows/version={args.version}")
    manifest.publish(spark, manifest.fingerprint(docs, key).withColumn("complete", F.lit(True)), f"{args.out}/manifest", args.version)


if __name__ == "__main__":
    main()
