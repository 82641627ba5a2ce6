"""Search in names by stored grams.

A gram is one, two or three consecutive characters of a name in lower case; the index has a row for each gram and
name. A text is looked for by its grams of three (shorter texts by themselves). The names that have the rarest
few of these are candidates, and those that hold the whole text are found, as a scan of all names would find them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boutflow.sources.maintained import bucket_of

#: Grams of a text that are intersected, rarest first.
RAREST = 3


def _grams(text: Column, n: int) -> Column:
    last = F.length(text) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda k: F.substring(text, k, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def index(names: DataFrame) -> DataFrame:
    """gram, competitor_id, n_names (how many names have the gram)."""
    lower = F.lower("name")
    rows = names.select("competitor_id", F.explode(F.array_distinct(F.concat(*[_grams(lower, n) for n in (1, 2, 3)]))).alias("gram"))
    counts = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n_names"))
    return rows.join(counts, "gram").select("gram", "competitor_id", "n_names")


def write_index(rows: DataFrame, folder: str, buckets: int = 32) -> None:
    """By bucket of the gram, sorted by it, so that a lookup reads a few row groups of a bucket."""
    rows.withColumn("bucket", bucket_of("gram", buckets)).hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("gram string, competitor_id long, n_names long, bucket int").parquet(folder)


def find(texts: DataFrame, grams: DataFrame, names: DataFrame, limit: int = 50) -> DataFrame:
    """text, rank, competitor_id, name: for each of ``texts`` (text) the first ``limit`` names that hold it in any case; the name itself first, then by name and id.

    An empty text is in every name, which needs no index: such texts are left out.
    """
    asked = texts.select("text").where("text <> ''").distinct()
    lower = F.lower("text")
    wanted = asked.select("text", F.explode(F.array_distinct(F.when(F.length("text") < 3, F.array(lower)).otherwise(_grams(lower, 3)))).alias("gram"))
    known = grams.groupBy("gram").agg(F.first("n_names").alias("n_names"))
    sized = wanted.join(known, "gram", "left").withColumn("n_names", F.coalesce("n_names", F.lit(0)))
    rarest = F.row_number().over(Window.partitionBy("text").orderBy("n_names", "gram"))  # a text has as many grams as characters
    chosen = sized.withColumn("k", rarest).where(F.col("k") <= RAREST)
    needed = chosen.groupBy("text").agg(F.count(F.lit(1)).alias("needed"))
    met = chosen.join(grams.select("gram", "competitor_id"), "gram").groupBy("text", "competitor_id").agg(F.count(F.lit(1)).alias("met"))
    candidates = met.join(needed, "text").where("met = needed").select("text", "competitor_id")
    found = candidates.join(names.select("competitor_id", "name"), "competitor_id").where(F.contains(F.lower("name"), lower))
    first = F.row_number().over(Window.partitionBy("text").orderBy(F.when(F.lower("name") == lower, 0).otherwise(1), "name", "competitor_id"))
    return found.withColumn("rank", first).where(F.col("rank") <= limit).select("text", "rank", "competitor_id", "name")


def find_one(spark: SparkSession, folder: str, names: DataFrame, text: str, limit: int = 50, buckets: int = 32) -> DataFrame:
    """``find`` for one text, from a stored index: only the buckets of its grams are read."""
    lower = text.lower()
    grams = sorted({lower[k : k + 3] for k in range(len(lower) - 2)}) if len(lower) >= 3 else [lower]
    rows = read_index(spark, folder)
    of_gram = F.lit(False)
    for g in grams:  # as many as the text has characters
        of_gram = of_gram | ((F.col("bucket") == bucket_of(F.lit(g), buckets)) & (F.col("gram") == g))
    return find(spark.createDataFrame([(text,)], "text string"), rows.where(of_gram), names, limit)
