"""Incremental ingest of landed pages to a table of bouts with Structured Streaming.

Each micro-batch of pages is parsed and appended under its number: the bouts of each page's last readable version of
the batch. A batch that runs twice after a failure writes over what it wrote, so it leaves the same table, and no
file of an earlier batch is touched. ``current`` reads the table: of each page the version fetched last, whatever the
order in which versions landed. Versions without a readable bout go to a quarantine folder, under the batch's number, with
the reason; what earlier versions of such a page gave stays.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutflow.sources import pages as source
from boutflow.streaming.maintain import PAGES, last_readable, unreadable, versions


def ingest(spark: SparkSession, landing: str, target: str, quarantine: str, progress: str):
    """Parses what has newly landed in ``landing`` (Parquet of PAGES) into ``target``; returns the finished query."""
    stream = spark.readStream.schema(PAGES).parquet(landing)

    def append(batch: DataFrame, number: int) -> None:
        parsed = source.parsed(versions(batch)).persist()
        last_readable(parsed).drop("mark", "error", "url").write.mode("overwrite").parquet(f"{target}/batch={number}")
        unreadable(batch, parsed).write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        parsed.unpersist()

    query = stream.writeStream.foreachBatch(append).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def current(spark: SparkSession, target: str) -> DataFrame:
    """The bouts of each page's last version, of those fetched at one time that of the last batch; an empty frame before the first batch."""
    try:
        rows = spark.read.parquet(target)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "page_id long, fetched_at timestamp")
    last = rows.groupBy("page_id").agg(F.max(F.struct("fetched_at", "batch")).alias("l")).select("page_id", "l.*")
    return rows.join(last, ["page_id", "fetched_at", "batch"], "left_semi").drop("batch")
