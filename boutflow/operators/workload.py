"""Distributions of the number of bouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutflow.functions.quantiles import exclusive_quartile_of_counts


def by_org(listings: DataFrame, primary: DataFrame, least: int = 5) -> DataFrame:
    """Per year and primary organisation of ``least`` in-cohort competitors or more: total, exclusive quartiles, largest.

    Values are counted first: what is ranked in a group is its distinct numbers of bouts, which a year bounds.
    """
    per = primary.join(listings.where("in_cohort").select("competitor_id", "year").distinct(), ["competitor_id", "year"], "left_semi")
    counts = per.groupBy("year", F.col("primary_org").alias("org"), "n_bouts").agg(F.count(F.lit(1)).alias("n"))
    agg = counts.groupBy("year", "org").agg(F.sum("n").alias("n_competitors"), F.sum(F.col("n") * F.col("n_bouts")).alias("total"), F.max("n_bouts").alias("most"), F.array_sort(F.collect_list(F.struct("n_bouts", "n"))).alias("values"))
    quartiles = [F.round(exclusive_quartile_of_counts(F.col("values"), F.col("n_competitors"), i), 6).alias(n) for i, n in ((1, "q1"), (2, "median"), (3, "q3"))]
    return agg.where(F.col("n_competitors") >= least).select("year", "org", "n_competitors", "total", *quartiles, "most")


def histogram(listings: DataFrame, low: int = 0, high: int = 120, bins: int = 20) -> DataFrame:
    """Per year and bin of the in-cohort competitors' bouts: competitors. The last bin takes ``high`` itself; what lies outside is left out."""
    per = listings.where("in_cohort").groupBy("year", "competitor_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(low, high))
    at = F.least(F.width_bucket(F.col("n").cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)), F.lit(bins)).cast("int")
    return per.groupBy("year", at.alias("bin")).agg(F.count(F.lit(1)).alias("n_competitors"))


def percentiles(listings: DataFrame) -> DataFrame:
    """Per year: inclusive 25th, 50th and 75th percentiles of the in-cohort competitors' bouts."""
    per = listings.where("in_cohort").groupBy("year", "competitor_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("year").agg(*[F.round(F.percentile("n", F.lit(q)), 6).alias(f"p{int(q * 100)}") for q in (0.25, 0.5, 0.75)])
