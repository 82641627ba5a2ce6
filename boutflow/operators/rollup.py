"""Yearly roll-ups of bout lists, and what is read off them.

All functions take ``listings`` (a row per bout and owner of a list: competitor_id, bout_id, year, org,
country, participants) and return frames keyed by competitor_id, or competitor_id and year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutflow.functions.text import counter_text, is_proxy_org

KEY = ["competitor_id", "year"]


def counted(listings: DataFrame, key: Column | str, by: list[str] | None = None) -> DataFrame:
    """Bouts by ``by`` and ``key``; rows with a null key are left out."""
    by = KEY if by is None else by
    rows = listings.withColumn("key", F.col(key) if isinstance(key, str) else key).where("key is not null")
    return rows.groupBy(*by, "key").agg(F.count(F.lit(1)).alias("n"))


def opponents(listings: DataFrame) -> DataFrame:
    """competitor_id, year, key (a co-participant, the owner left out), n."""
    rows = listings.select(*KEY, F.explode("participants").alias("key")).where("key <> competitor_id")
    return rows.groupBy(*KEY, "key").agg(F.count(F.lit(1)).alias("n"))


def modal(counts: DataFrame, by: list[str], name: str) -> DataFrame:
    """The key with the largest count (``name``) and that count (``name``_bouts); ties go to the smaller key."""
    best = counts.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), "key")).alias("best"))
    return best.select(*by, F.col("best.key").alias(name), (-F.col("best.n")).alias(f"{name}_bouts"))


def as_text(counts: DataFrame, name: str) -> DataFrame:
    return counts.groupBy(*KEY).agg(counter_text(F.collect_list(F.struct("key", "n"))).alias(name))


def yearly_rollup(listings: DataFrame, names_used: DataFrame) -> DataFrame:
    """Per (competitor, year): number of bouts, opponents by frequency, and counters as text."""
    met = opponents(listings)
    by_frequency = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "key")))
    ordered = met.groupBy(*KEY).agg(F.array_join(F.transform(by_frequency, lambda x: x["key"].cast("string")), ",").alias("opponents"), F.count(F.lit(1)).alias("n_opponents"))
    out = listings.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_bouts")).join(ordered, KEY, "left")
    for frame, name in ((counted(listings, "country"), "countries"), (counted(listings, "org"), "orgs"), (counted(names_used, "name_used"), "names")):
        out = out.join(as_text(frame, name), KEY, "left")
    return out.select(*KEY, "n_bouts", F.coalesce("n_opponents", F.lit(0)).alias("n_opponents"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("opponents", "countries", "orgs", "names")])


def primary_orgs(listings: DataFrame, share: float = 0.40) -> DataFrame:
    """Per (competitor, year): ``primary_org``, the modal organisation from that share of all bouts on.

    Else, and for stand-in organisations, ``Freelancer (country)`` with the year's modal country.
    """
    bouts = listings.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_bouts"))
    joined = bouts.join(modal(counted(listings, "org"), KEY, "org"), KEY, "left").join(modal(counted(listings, "country"), KEY, "country"), KEY, "left")
    free = F.coalesce(F.concat(F.lit("Freelancer ("), F.col("country"), F.lit(")")), F.lit("Freelancer"))
    settled = (F.col("org_bouts") >= share * F.col("n_bouts")) & ~is_proxy_org(F.col("org"))
    return joined.select(*KEY, "n_bouts", F.when(settled, F.col("org")).otherwise(free).alias("primary_org"), F.col("country").alias("primary_country"))


def inactive(competitors: DataFrame, primary: DataFrame, this_year: int, ends: DataFrame | None = None) -> DataFrame:
    """Per competitor: whether its career has an end (``ends``: competitor_id, career_end), or no bout is of the last three years."""
    last = primary.groupBy("competitor_id").agg(F.max("year").alias("last_year"))
    rows = competitors.select("competitor_id").join(last, "competitor_id", "left")
    ended = F.lit(False)
    if ends is not None:
        rows, ended = rows.join(ends.select("competitor_id", "career_end"), "competitor_id", "left"), F.col("career_end").isNotNull()
    return rows.select("competitor_id", "last_year", (ended | F.col("last_year").isNull() | (F.col("last_year") < this_year - 3)).alias("inactive"))


def latest_orgs(competitors: DataFrame, primary: DataFrame, this_year: int, ends: DataFrame | None = None) -> DataFrame:
    """Per competitor: the organisation of the last year; ``Inactive`` for those that ``inactive`` says so of."""
    last = primary.groupBy("competitor_id").agg(F.max_by("primary_org", "year").alias("latest_org"))
    idle = inactive(competitors, primary, this_year, ends)
    return idle.join(last, "competitor_id", "left").select("competitor_id", "last_year", F.when(F.col("inactive"), "Inactive").otherwise(F.col("latest_org")).alias("latest_org"))


def home_countries(listings: DataFrame) -> DataFrame:
    """Per competitor: the modal country over all years, its bouts, and the countries' counts as text."""
    counts = counted(listings, "country", ["competitor_id"])
    text = counts.groupBy("competitor_id").agg(counter_text(F.collect_list(F.struct("key", "n"))).alias("countries"))
    return modal(counts, ["competitor_id"], "country").join(text, "competitor_id")


def nationality(primary: DataFrame, country: DataFrame, home: str, home_orgs: list[str], listed: list[int] = ()) -> DataFrame:
    """Per competitor: whether at home, by a list, by the modal country or by the last organisation."""
    last = primary.groupBy("competitor_id").agg(F.max_by("primary_org", "year").alias("org"))
    rule = F.col("competitor_id").isin(*listed) | F.coalesce(F.col("country") == home, F.lit(False)) | F.coalesce(F.col("org").contains(home) | F.col("org").isin(*home_orgs), F.lit(False))
    return last.join(country, "competitor_id", "left").select("competitor_id", rule.alias("at_home"))


def nationality_by_year(primary: DataFrame, country: DataFrame, home: str, home_orgs: list[str], listed: list[int] = ()) -> DataFrame:
    """Per (competitor, year): whether at home, by a list, by the modal country of all years, or by the year's organisation."""
    rule = F.col("competitor_id").isin(*listed) | F.coalesce(F.col("country") == home, F.lit(False)) | F.coalesce(F.col("primary_org").contains(home) | F.col("primary_org").isin(*home_orgs), F.lit(False))
    return primary.select("competitor_id", "year", "primary_org").join(country.select("competitor_id", "country"), "competitor_id", "left").select("competitor_id", "year", rule.alias("at_home"))


def national_cohort(competitors: DataFrame, profiles: DataFrame, listings: DataFrame, year: int, home: str, home_orgs: list[str], listed: list[int] = ()) -> DataFrame:
    """In-cohort competitors of the national network: by a list, by their own country, by any bout of ``year`` at home, or by the organisation of their profile (competitor_id, org)."""
    there = listings.where((F.col("year") == year) & (F.col("country") == home)).select("competitor_id").distinct().withColumn("there", F.lit(True))
    rows = competitors.where("in_cohort").select("competitor_id", "country").join(profiles.select("competitor_id", "org"), "competitor_id", "left").join(there, "competitor_id", "left")
    rule = F.col("competitor_id").isin(*listed) | F.coalesce(F.col("country") == home, F.lit(False)) | F.coalesce("there", F.lit(False)) | F.coalesce(F.col("org").contains(home) | F.col("org").isin(*home_orgs), F.lit(False))
    return rows.where(rule).select("competitor_id")


def year_totals(listings: DataFrame) -> DataFrame:
    """Per year: competitors, in-cohort ones, bouts of lists, and their average."""
    per = listings.groupBy("competitor_id", "year", "in_cohort").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("year").agg(F.count(F.lit(1)).alias("n_competitors"), F.count_if("in_cohort").alias("n_cohort"), F.sum("n").alias("n_bouts"), F.sum(F.when(F.col("in_cohort"), F.col("n")).otherwise(0)).alias("cohort_bouts"), F.round(F.avg("n"), 6).alias("avg_bouts"))


def available_years(listings: DataFrame, least: int = 8) -> DataFrame:
    """Years with a competitor above ``least`` bouts, with the year before and after among these."""
    per = listings.groupBy("competitor_id", "year").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    years = per.select("year").distinct()  # a row a year: the window is over these few
    w = Window.orderBy("year")
    return years.select("year", F.lag("year").over(w).alias("previous_year"), F.lead("year").over(w).alias("next_year"))


def singles(bouts: DataFrame, competitors: DataFrame) -> DataFrame:
    """Distinct (bout_date, a, b, is_victory) of bouts of one against another, both in the cohort."""
    one = bouts.where((F.size("sides") == 2) & F.forall("sides", lambda s: F.size(s) == 1) & ~F.array_contains("participants", F.lit(-1).cast("long")) & F.col("bout_date").isNotNull())
    pairs = one.select("bout_date", F.get(F.get("sides", 0), 0).alias("a"), F.get(F.get("sides", 1), 0).alias("b"), "is_victory").where("a <> b").distinct()
    ids = competitors.where("in_cohort").select("competitor_id")
    return pairs.join(ids.withColumnRenamed("competitor_id", "a"), "a", "left_semi").join(ids.withColumnRenamed("competitor_id", "b"), "b", "left_semi").select("bout_date", "a", "b", "is_victory")


def recently_active(listings: DataFrame, this_year: int) -> DataFrame:
    """Competitors with a bout in either of the two years before ``this_year``."""
    return listings.where(F.col("year").isin(this_year - 1, this_year - 2)).select("competitor_id").distinct()
