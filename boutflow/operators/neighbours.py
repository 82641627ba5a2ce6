"""Edges between the owner of a bout list and its co-participants, and questions on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutflow.operators.rollup import opponents


def edge_weights(listings: DataFrame) -> DataFrame:
    """src, dst, year, n_bouts."""
    return opponents(listings).select(F.col("competitor_id").alias("src"), F.col("key").alias("dst"), "year", F.col("n").alias("n_bouts"))


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def cohort_share(edges: DataFrame, competitors: DataFrame) -> DataFrame:
    """Per competitor: neighbours, those in the cohort, and their share (0 without neighbours)."""
    flags = competitors.select(F.col("competitor_id").alias("dst"), "in_cohort")
    per = distinct_edges(edges).join(flags, "dst", "left").groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("in_cohort", F.lit(False))).alias("k"))
    out = competitors.join(per, F.col("competitor_id") == F.col("src"), "left")
    n, k = F.coalesce("n", F.lit(0)), F.coalesce("k", F.lit(0))
    return out.select("competitor_id", "in_cohort", n.alias("n_neighbours"), k.alias("n_cohort"), F.round(F.when(n > 0, k / n).otherwise(0.0), 6).alias("cohort_share"))


def reverse_neighbours(edges: DataFrame) -> DataFrame:
    """Per id that occurs in a list: how many lists hold it, over how many listed bouts."""
    return edges.groupBy(F.col("dst").alias("competitor_id")).agg(F.count_distinct("src").alias("n_sources"), F.sum("n_bouts").alias("n_bouts"))


def missing(edges: DataFrame, competitors: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Ids in lists (those of ``sources``, competitor_id, or all) that have no profile, with referrers and appearances."""
    if sources is not None:
        edges = edges.join(sources.select(F.col("competitor_id").alias("src")), "src", "left_semi")
    known = competitors.select(F.col("competitor_id").alias("dst"))
    return reverse_neighbours(edges.where("dst <> -1").join(known, "dst", "left_anti")).withColumnsRenamed({"competitor_id": "missing_id", "n_sources": "n_referrers", "n_bouts": "appearances"})


def bucket(n, bounds: list[int]):
    """``1``, ``2-5``, ... and ``k+`` for the ranges that end at ``bounds``."""
    out, low = None, 1
    for b in bounds:
        label = str(b) if b == low else f"{low}-{b}"
        out = F.when(n <= b, label) if out is None else out.when(n <= b, label)
        low = b + 1
    return out.otherwise(f"{bounds[-1]}+")


def frequency_buckets(counts: DataFrame, n: str, bounds: list[int]) -> DataFrame:
    """Per range of ``n``: ids, their sum, largest and mean."""
    rows = counts.withColumn("bucket", bucket(F.col(n), bounds))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_ids"), F.sum(n).alias("total"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 6).alias("mean"))


def outside_appearances(edges: DataFrame, competitors: DataFrame) -> DataFrame:
    """Per out-of-cohort id: how many in-cohort lists hold it."""
    flags = competitors.select("competitor_id", "in_cohort")
    inside = flags.where("in_cohort").select(F.col("competitor_id").alias("src"))
    outside = flags.where("not in_cohort").select(F.col("competitor_id").alias("dst"))
    return distinct_edges(edges).join(inside, "src", "left_semi").join(outside, "dst", "left_semi").groupBy(F.col("dst").alias("competitor_id")).agg(F.count(F.lit(1)).alias("n_lists"))


def org_members(listings: DataFrame) -> DataFrame:
    """org, competitor_id: whoever was in a bout of the organisation that an in-cohort list holds."""
    return listings.where("in_cohort").select("org", F.explode("participants").alias("competitor_id")).where("competitor_id <> -1").distinct()


def active_members(listings: DataFrame, last_year: int, window: int = 2, least: int = 10) -> DataFrame:
    """org, competitor_id, n_bouts in the organisation, for those with ``least`` in the last ``window`` years."""
    recent = listings.where(F.col("year").between(last_year - window + 1, last_year) & (F.col("competitor_id") != -1))
    return recent.groupBy("org", "competitor_id").agg(F.count(F.lit(1)).alias("n_bouts")).where(F.col("n_bouts") >= least)


def org_frequency(listings: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Per organisation: bouts in in-cohort lists (or those of ``targets``, competitor_id), which is how the plan ranks organisations."""
    lists = listings.where("in_cohort") if targets is None else listings.join(targets.select("competitor_id").distinct(), "competitor_id", "left_semi")
    return lists.groupBy("org").agg(F.count(F.lit(1)).alias("n_bouts"), F.count_distinct("competitor_id").alias("n_competitors"))
