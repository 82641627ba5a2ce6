"""A column that stored files got later: reading files of both kinds, and filling it where it is lacking.

Tables are in folders ``bucket=B``. Files of before the column lack it, and the marker ``generation`` with it, so
merged schemas show both as null there. The filling reads all markers but rewrites the buckets that hold such
rows only; rows that had the column, with null too, stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutflow.sources.maintained import bucket_of

MARKER = "generation"


def append(rows: DataFrame, folder: str, key: str, buckets: int, generation: int | None = None) -> None:
    """Adds files of ``rows``; those of before a column came have no generation."""
    marked = rows if generation is None else rows.withColumn(MARKER, F.lit(generation))
    marked.withColumn("bucket", bucket_of(key, buckets)).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(folder)


def add_column(spark: SparkSession, folder: str, scratch: str, fill: Callable[[DataFrame], DataFrame], generation: int) -> list[int]:
    """Fills what ``fill`` adds to rows without a generation; returns the buckets that were rewritten.

    The new rows of those buckets are in ``scratch`` before any file is replaced, so that a run that is
    lost half-way can be repeated: rows that are filled already have the marker.
    """
    table = read(spark, folder)
    if MARKER not in table.columns:  # no file has it yet
        table = table.withColumn(MARKER, F.lit(None).cast("int"))
    touched = sorted(r.bucket for r in table.where(F.col(MARKER).isNull()).select("bucket").distinct().collect())  # as many as there are buckets, at most
    if not touched:
        return []
    rows = table.where(F.col("bucket").isin(touched))
    filled = fill(rows.where(F.col(MARKER).isNull())).withColumn(MARKER, F.lit(generation))
    kept = rows.where(F.col(MARKER).isNotNull())
    kept.unionByName(filled, allowMissingColumns=True).write.mode("overwrite").parquet(scratch)
    ready = spark.read.parquet(scratch)
    ready.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)
    return touched
