"""Samples and short reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows, the same for a seed: those of the smallest hash of the key."""
    return rows.orderBy(F.md5(F.concat_ws("-", F.lit(seed), F.col(key))), key).limit(n)


def write_json(rows: DataFrame, folder: str) -> None:
    """Rows as JSON lines, as a sample to look at."""
    rows.write.mode("overwrite").json(folder)


def most_common(rows: DataFrame, key: Column, n: int, name: str = "key") -> DataFrame:
    """The ``n`` most frequent keys and how often they occur; ties go to the smaller key."""
    return rows.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n")).where(F.col(name).isNotNull()).orderBy(F.desc("n"), name).limit(n)


def most_active(listings: DataFrame, years: list[int], names: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` in-cohort competitors with most bouts in ``years``."""
    per = listings.where(F.col("in_cohort") & F.col("year").isin(years)).groupBy("competitor_id").agg(F.count(F.lit(1)).alias("n_bouts"))
    return per.orderBy(F.desc("n_bouts"), "competitor_id").limit(n).join(names, "competitor_id", "left").select("competitor_id", F.coalesce("name", F.lit("Unknown")).alias("name"), "n_bouts")


def ordered_by_bouts(listings: DataFrame, year: int) -> DataFrame:
    """The competitors of a year by their number of bouts, most first."""
    per = listings.where(F.col("year") == year).groupBy("competitor_id").agg(F.count(F.lit(1)).alias("n_bouts"))
    return per.orderBy(F.desc("n_bouts"), "competitor_id")


def top_by_both(rows: DataFrame, key: str, flag: str, n: int = 15) -> DataFrame:
    """The ``n`` keys with the largest count over both histograms of a flag, and the two counts."""
    both = rows.groupBy(key).agg(F.count_if(flag).alias("n_yes"), F.count_if(~F.col(flag)).alias("n_no"))
    return both.orderBy(F.desc(F.col("n_yes") + F.col("n_no")), key).limit(n)
