"""A table kept as numbered snapshots. The mark that commits a snapshot is written last, and readers take the last one that has it."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Snapshots:
    def __init__(self, spark: SparkSession, folder: str, schema: str, by: str):
        self.spark, self.folder, self.schema, self.by = spark, folder, T.StructType.fromDDL(schema), by

    def number(self) -> int:
        """The number of the last committed snapshot, 0 where there is none."""
        try:
            return self.spark.read.schema("number int").parquet(f"{self.folder}/commits").agg({"number": "max"}).first()[0] or 0
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0

    def read(self) -> DataFrame:
        n = self.number()
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/snapshot={n}") if n else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame) -> None:
        """``df`` as the next snapshot; it may be read from the last one. A snapshot that failed half-way is written over."""
        n = self.number() + 1
        df.select(*self.schema.names).sortWithinPartitions(self.by).write.mode("overwrite").parquet(f"{self.folder}/snapshot={n}")
        self.spark.createDataFrame([(n,)], "number int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/mark={n}")
