"""Co-appearance networks by year.

Callers pass the lists of the cohort, or of a part of it. Pairs are counted once in each owner's list, so a bout that both list counts twice. A node is a
co-participant with at least ``threshold`` listed bouts in the year; a link joins two nodes with more than
one listed bout together. Weights are base-10 logarithms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _pairs(listings: DataFrame) -> DataFrame:
    return listings.select("year", F.col("competitor_id").alias("owner"), F.explode("participants").alias("other")).where("owner <> other")


def nodes(listings: DataFrame, primary: DataFrame, names: DataFrame, threshold: int = 8) -> DataFrame:
    """year, competitor_id, name, org, group (a dense number of the year's organisations), weight.

    ``names``: competitor_id, name, and the year where names go by year.
    """
    listed = listings.groupBy("year", "competitor_id").agg(F.count(F.lit(1)).alias("n_bouts")).where(F.col("n_bouts") >= threshold)
    seen = _pairs(listings).select("year", F.col("other").alias("competitor_id")).distinct()
    found = listed.join(seen, ["year", "competitor_id"], "left_semi").join(primary.select("competitor_id", "year", F.col("primary_org").alias("org")), ["competitor_id", "year"], "left")
    orgs = found.select("year", "org").distinct()  # a few rows a year
    numbered = orgs.withColumn("group", F.dense_rank().over(Window.partitionBy("year").orderBy("org")) - 1)
    out = found.join(F.broadcast(numbered), (found.year == numbered.year) & found.org.eqNullSafe(numbered.org)).select(found["*"], "group")
    return out.join(names, [c for c in ("competitor_id", "year") if c in names.columns], "left").select("year", "competitor_id", F.coalesce(F.nullif("name", F.lit("")), F.lit("Unknown")).alias("name"), "org", "group", F.round(F.log10("n_bouts"), 6).alias("weight"))


def links(listings: DataFrame, threshold: int = 8) -> DataFrame:
    """year, source, target (source < target), n_listed, weight."""
    pairs = _pairs(listings).groupBy("year", F.least("owner", "other").alias("source"), F.greatest("owner", "other").alias("target")).agg(F.count(F.lit(1)).alias("n_listed")).where("n_listed > 1")
    listed = listings.groupBy("year", "competitor_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= threshold).select("year", "competitor_id")
    for end in ("source", "target"):
        pairs = pairs.join(listed.withColumnRenamed("competitor_id", end), ["year", end], "left_semi")
    return pairs.select("year", "source", "target", "n_listed", F.round(F.log10("n_listed"), 6).alias("weight"))


def write_graph(nodes: DataFrame, links: DataFrame, folder: str) -> None:
    """Nodes and links as JSON, by year; a year without nodes leaves no folder."""
    nodes.write.mode("overwrite").partitionBy("year").json(f"{folder}/nodes")
    links.write.mode("overwrite").partitionBy("year").json(f"{folder}/links")
