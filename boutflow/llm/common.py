"""Helpers shared by the text operators."""

from __future__ import annotations

import math
import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutflow.shipping import ship

#: White space of the text contracts: space and the control characters 9 to 13.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of the session's ``spark.checkpoint.dir``.

    Where that is unset, a temporary one if all runs on one machine; on a cluster that would be an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^,]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder that the cluster shares, and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


#: Rows and bytes that Spark sends to a Python worker at once, at most: texts can be long, and both sides hold a batch.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def _lowered(spark: SparkSession, settings: dict[str, int]) -> None:
    for name, most in settings.items():
        now = (spark.conf.get(name, None) or "").lower().removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's limits of an Arrow batch to BATCH_ROWS and BATCH_BYTES, where they are higher.

    Spark reads the settings when a result is asked for, so they have to stay.
    """
    _lowered(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES})


#: What a task holds of whole documents at once, at most, by setting: the Arrow batch, the batch that the Parquet
#: reader fills (4,096 rows else, in arrays that double) and the row group that the writer gathers (128 MB else).
SMALL_TASKS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": 256, "spark.sql.execution.arrow.maxBytesPerBatch": 2 << 20,
    "spark.sql.parquet.columnarReaderBatchSize": 512, "parquet.block.size": 32 << 20,
}


def small_tasks(spark: SparkSession) -> None:
    """Lowers the session's settings to SMALL_TASKS, where they are higher; they stay, as those of ``bounded_batches`` do."""
    _lowered(spark, SMALL_TASKS)


def per_batch(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], dict[str, pa.Array]]],
    keep: list[str],
    added: list[tuple[str, T.DataType]],
) -> DataFrame:
    """``keep`` of ``df`` and the columns ``added``, which a function of an Arrow batch computes.

    ``make`` runs once in each task (it loads a model, say) and gives that function. A column of ``keep``
    whose name clashes with an added one, in any case, makes way for it.
    """
    taken = {n.lower() for n, _ in added}
    keep = [c for c in keep if c.lower() not in taken]
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(n, t) for n, t in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            new = work(batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(new[n] for n, _ in added)], names=[f.name for f in schema])

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def filter_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[bool]]]) -> DataFrame:
    """The rows of ``df``, with all columns, for which a function of an Arrow batch says true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            yield batch.filter(pa.array(work(batch), pa.bool_()))

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, df.schema)


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def gapless(df: DataFrame, name: str, group: list[str], order: list[str], rows: int) -> DataFrame:
    """``df`` with the column ``name``: the row's place, from 0, in its ``group``.

    Places follow a hash of ``order`` and then ``order``. Each group is cut into slices by that hash, so
    no task sorts a whole group: rows are numbered in their slice, and the slices' counts, summed up
    before them, give where each slice starts. ``rows`` is the number of rows of ``df``; there
    are about its square root of slices, so that neither a slice nor a group's list of slices is large.
    """
    from pyspark.sql import Window

    slices = max(1, math.isqrt(rows))
    sliced = df.withColumn("__slice", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    before = Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = sliced.groupBy(*group, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.select(*group, "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(*group, "__slice").orderBy(F.xxhash64(*order), *order)
    numbered = sliced.withColumn("__place", F.row_number().over(within) - 1)
    return numbered.join(starts, [*group, "__slice"]).withColumn(name, (F.col("__place") + F.col("__start")).cast("long")).drop("__slice", "__place", "__start")
