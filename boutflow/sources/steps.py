"""Frames written to the folder that the cluster shares and read back from there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Steps:
    """Writes frames to a folder of their own under ``spark.checkpoint.dir`` and reads them back."""

    def __init__(self, spark: SparkSession):
        context = spark.sparkContext
        folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="spark-")  # one machine: tests
        self.spark, self.folder, self.n = spark, f"{folder}/steps-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.folder}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.n}")


def is_whole(spark: SparkSession, folder: str) -> bool:
    """Whether a written frame is still there, to its mark of success."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)
