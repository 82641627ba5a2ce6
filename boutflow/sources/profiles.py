"""Stored profiles and organisations: JSON text to maps, rows with defaults, and what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutflow.functions.dates import flexible_date
from boutflow.sources.pages import in_cohort, profile_name

#: The id that stands for a participant without a profile.
SENTINEL = -1


def decoded(rows: DataFrame) -> DataFrame:
    """``rows`` with ``profile_json`` as the map ``profile``; null or unreadable text is an empty map."""
    return rows.withColumn("profile", F.coalesce(F.from_json("profile_json", "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))).drop("profile_json")


def career_year(text: Column) -> Column:
    """The year of a career date: ``dd.MM.yyyy``, ``MM.yyyy`` or ``yyyy``."""
    return F.year(flexible_date(text))


def full_date(text: Column) -> Column:
    """A career date that has its day, else null."""
    return F.when(text.rlike(r"^\d{2}\.\d{2}\.\d{4}$"), flexible_date(text))


def facts(rows: DataFrame, abbreviations: DataFrame, overrides: tuple[int, ...] = ()) -> DataFrame:
    """Per competitor with a ``profile`` map: name, cohort flag, diverse flag, short organisation, career years and birthplace."""
    p = F.col("profile")
    flat = rows.select(
        "competitor_id", profile_name(p).alias("name"), in_cohort(p, F.col("competitor_id"), overrides).alias("in_cohort"), F.coalesce(p["Gender"] == "diverse", F.lit(False)).alias("diverse"),
        p["Promotion"].alias("org"), career_year(p["Career start"]).alias("career_start"), career_year(p["Career end"]).alias("career_end"), p["Birthplace"].alias("birthplace"),
    )
    short = abbreviations.select(F.col("name").alias("org"), "short")
    return flat.join(short, "org", "left").withColumn("org", F.coalesce("short", "org", F.lit("Freelancer"))).drop("short")


def without_profile(rows: DataFrame) -> DataFrame:
    """Competitors whose profile is missing or empty."""
    return rows.where(F.col("profile").isNull() | (F.size("profile") == 0)).select("competitor_id")


def scan(competitors: DataFrame, updates: DataFrame) -> DataFrame:
    """competitor_id, name (empty: Unknown) and ``updated``, seconds since 1970 (0: never); a row for the sentinel comes too."""
    rows = competitors.join(updates, "competitor_id", "left")
    epoch = F.coalesce(F.unix_timestamp("last_updated"), F.lit(0)).cast("long")
    out = rows.select("competitor_id", F.coalesce(F.nullif("name", F.lit("")), F.lit("Unknown")).alias("name"), epoch.alias("updated"))
    return out.unionByName(competitors.sparkSession.createDataFrame([(SENTINEL, "Unknown", 0)], "competitor_id long, name string, updated long"))


def seeded(rows: DataFrame, known_missing: list[int]) -> DataFrame:
    """``rows`` (competitor_id, name, updated) with a placeholder for each id known to have no page."""
    spark = rows.sparkSession
    new = spark.createDataFrame([(i, "Missing", 0) for i in known_missing], "competitor_id long, name string, updated long")
    return rows.unionByName(new.join(rows.select("competitor_id"), "competitor_id", "left_anti").select(rows.columns))


def due(rows: DataFrame, stale: Column, known_missing: list[int]) -> DataFrame:
    """Competitors to refresh: stale or without a profile, but for those known to have no page."""
    gone = F.col("competitor_id").isin(*known_missing, SENTINEL)
    return rows.where(~gone & (stale | F.col("profile").isNull() | (F.size("profile") == 0)))
