"""Per-competitor summaries and name search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boutflow.functions.text import counter_text
from boutflow.operators.rollup import counted


def find_by_name(competitors: DataFrame, text: str, limit: int = 50, cohort_only: bool = False) -> DataFrame:
    """Competitors whose name holds ``text`` in any case; the exact name first, then by name."""
    rows = competitors.where(F.contains(F.lower("name"), F.lower(F.lit(text))))
    if cohort_only:
        rows = rows.where("in_cohort")
    exact = F.when(F.lower("name") == text.lower(), 0).otherwise(1)
    return rows.orderBy(exact, "name", "competitor_id").limit(limit)


def dossiers(listings: DataFrame, edges: DataFrame, shares: DataFrame, top: int = 10, by_years: bool = True) -> DataFrame:
    """Per owner of a list: bouts, years, counts per year, countries and organisations as text, frequent opponents, neighbours.

    Opponents count by years together, or, with ``by_years`` off, by bouts.
    """
    weight = F.count(F.lit(1)) if by_years else F.sum("n_bouts")
    met = edges.groupBy("src", "dst").agg(weight.alias("n"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst"))
    best = met.withColumn("rank", rank).where(F.col("rank") <= top)
    rivals = best.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "dst", "n").alias("text")))).alias("x")).select(F.col("src").alias("competitor_id"), F.array_join(F.transform("x", lambda r: r["text"]), ",").alias("top_opponents"))
    text = lambda key, name: counted(listings, key, ["competitor_id"]).groupBy("competitor_id").agg(counter_text(F.collect_list(F.struct("key", "n"))).alias(name))
    out = listings.groupBy("competitor_id").agg(F.count(F.lit(1)).alias("n_bouts"), F.count_distinct("year").alias("n_years"))
    for frame in (text("year", "years"), text("country", "countries"), text("org", "orgs"), rivals, shares.select("competitor_id", "n_neighbours", "cohort_share")):
        out = out.join(frame, "competitor_id", "left")
    return out


def missing_dossiers(rows: DataFrame) -> DataFrame:
    """Per unprofiled subject, of what ``classify.appearances`` gives: lists, rows, years, organisations and countries."""
    text = lambda key, name: counted(rows, key, ["subject_id"]).groupBy("subject_id").agg(counter_text(F.collect_list(F.struct("key", "n"))).alias(name))
    out = rows.groupBy("subject_id").agg(F.count_distinct("competitor_id").alias("n_lists"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct("bout_id").alias("n_bouts"))
    for frame in (text("year", "years"), text("country", "countries"), text("org", "orgs")):
        out = out.join(frame, "subject_id", "left")
    return out
