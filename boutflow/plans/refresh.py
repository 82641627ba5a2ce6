"""The refresh plan: what to fetch next, by priority, from staleness and coverage.

Stages are frames of (priority, stage, operation, object_id, year), joined by name; the first stage that
names an (operation, object, year) wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boutflow.functions import scoring
from boutflow.functions.dates import age_days
from boutflow.operators.neighbours import org_frequency as org_frequency_of
from boutflow.operators.organisations import is_stale
from boutflow.operators.rollup import recently_active


def importances(listings: DataFrame, this_year: int) -> DataFrame:
    """Per competitor: bouts and distinct opponents over the two years before, and the importance they give."""
    recent = listings.where(F.col("year").isin(this_year - 1, this_year - 2))
    bouts = recent.groupBy("competitor_id").agg(F.count(F.lit(1)).alias("n_bouts"))
    met = recent.select("competitor_id", F.explode("participants").alias("o")).where("o <> competitor_id").groupBy("competitor_id").agg(F.count_distinct("o").alias("n_opponents"))
    out = bouts.join(met, "competitor_id", "left").fillna(0, ["n_opponents"])
    return out.withColumn("importance", F.round(scoring.importance(F.col("n_bouts"), F.col("n_opponents")), 6))


_ITEM = "priority int, stage int, operation string, object_id string, year int"


def _items(rows: DataFrame, priority: Column, stage: int, operation: str, object_id: str, year: Column | None = None) -> DataFrame:
    none = F.lit(None)
    return rows.select(priority.cast("int").alias("priority"), F.lit(stage).alias("stage"), F.lit(operation).alias("operation"), F.col(object_id).cast("string").alias("object_id"), (none if year is None else year).cast("int").alias("year"))


def _known(competitors: DataFrame, listings: DataFrame, updates: DataFrame, this_year: int, as_of: str) -> DataFrame:
    """``competitors`` with the age of their profile, whether they are active, and their importance."""
    known = competitors.join(updates, "competitor_id", "left").withColumn("age", age_days(F.col("last_updated"), F.lit(as_of).cast("timestamp"))).drop("last_updated")
    active = recently_active(listings, this_year).withColumn("active", F.lit(True))
    weight = importances(listings, this_year).select("competitor_id", "importance")
    return known.join(active, "competitor_id", "left").join(weight, "competitor_id", "left").fillna(False, ["active"]).fillna(0.0, ["importance"])


def stale_years(known: DataFrame, lists: DataFrame, targets: Column, this_year: int, as_of: str, transition: bool = False, force: bool = False) -> DataFrame:
    """competitor_id, year, priority of the lists of ``targets`` (a flag on ``known``) to read again.

    Each list (competitor_id, year, last_updated; stubs too) is judged by its own time, null being never; only
    in-cohort competitors have lists that get stale. Active ones without a list of this year, not even a stub, get one.
    """
    age = age_days(F.col("last_updated"), F.lit(as_of).cast("timestamp"))
    rows = lists.select("competitor_id", "year", age.alias("list_age")).join(known.where(targets), "competitor_id")
    now, in_transition = F.lit(this_year), F.lit(transition)
    fresh = scoring.year_refresh_priority(F.col("year"), now, F.col("active"), in_transition, F.col("importance"))
    due = scoring.bouts_are_stale(F.col("list_age"), F.col("year"), now, F.col("active"), F.col("in_cohort"), F.lit(False))
    old = scoring.stale_year_priority(F.col("year"), now, F.col("active"), F.col("in_cohort"))
    stored = rows.select("competitor_id", "year", fresh.alias("priority")) if force else rows.where(F.col("in_cohort") & due).select("competitor_id", "year", old.alias("priority"))
    has_now = lists.where(F.col("year") == this_year).select("competitor_id").distinct()
    new = known.where(targets & F.col("active")).join(has_now, "competitor_id", "left_anti").withColumn("year", now)
    return stored.unionByName(new.select("competitor_id", "year", fresh.alias("priority")))


def _list_items(years: DataFrame) -> DataFrame:
    """One item for all of a competitor's years from three years on, else one for each."""
    per = years.groupBy("competitor_id").agg(F.count(F.lit(1)).alias("n"), F.min("priority").alias("best"), F.collect_list(F.struct("year", "priority")).alias("years"))
    single = per.where("n < 3").select("competitor_id", F.explode("years").alias("y"))
    return _items(per.where("n >= 3"), F.col("best"), 4, "refresh_all_bouts", "competitor_id").unionByName(_items(single, F.col("y.priority"), 4, "refresh_bouts", "competitor_id", F.col("y.year")))


def _org_items(frequency: DataFrame, organisations: DataFrame | None, as_of: str, force: bool) -> DataFrame:
    often = F.greatest(F.lit(0), F.least(F.lit(95), 95 - F.floor(F.col("n_bouts") / 100)))
    due = frequency if organisations is None or force else frequency.join(organisations.where(~is_stale(as_of)).select("org"), "org", "left_anti")
    return _items(due, often, 5, "refresh_org", "org")


def _first_of(parts: list[DataFrame], spark: SparkSession) -> DataFrame:
    plan = spark.createDataFrame([], _ITEM)
    for p in parts:
        plan = plan.unionByName(p)
    first = plan.where("object_id <> '-1'").groupBy("operation", "object_id", "year").agg(F.min(F.struct("stage", "priority")).alias("first"))
    return first.select(F.col("first.priority").alias("priority"), F.col("first.stage").alias("stage"), "operation", "object_id", "year")


def build(competitors: DataFrame, listings: DataFrame, lists: DataFrame, updates: DataFrame, missing: DataFrame, confidence: DataFrame, org_frequency: DataFrame, this_year: int, as_of: str, transition: bool = False, force: bool = False, only_bouts: bool = False, organisations: DataFrame | None = None) -> DataFrame:
    """The full plan. ``lists``: competitor_id, year, last_updated of each stored list and stub; ``missing``: missing_id, n_referrers, from in-cohort lists;
    ``confidence``: subject_id, confidence; ``org_frequency``: org, n_bouts.

    Profiles are judged by ``updates``, lists by their own times. Of the organisations those come that are stale by
    ``organisations`` (org, last_updated), or not in it, or all if forced. With ``only_bouts`` nothing but lists comes.
    """
    known = _known(competitors, listings, updates, this_year, as_of)
    bouts = _list_items(stale_years(known, lists, F.col("in_cohort"), this_year, as_of, transition, force))
    if only_bouts:
        return _first_of([bouts], competitors.sparkSession)
    found = missing.join(confidence, missing.missing_id == confidence.subject_id, "left")
    lost = _items(found, scoring.missing_priority(F.col("n_referrers"), F.col("confidence")), 1, "refresh_profile", "missing_id")
    stale = F.lit(True) if force else scoring.profile_is_stale(F.col("age"), F.col("in_cohort"))
    profile = lambda which, stage: _items(known.where(which & stale), F.lit(10), stage, "refresh_profile", "competitor_id")
    now = lists.where(F.col("year") == this_year).select("competitor_id", age_days(F.col("last_updated"), F.lit(as_of).cast("timestamp")).alias("list_age"), F.lit(True).alias("has_now"))
    other = known.where("diverse").join(now, "competitor_id", "left")
    check = F.col("has_now").isNull() | F.lit(force) | scoring.bouts_are_stale(F.col("list_age"), F.lit(this_year), F.lit(this_year), F.lit(True), F.col("in_cohort"), F.lit(True))
    base = scoring.adjusted(F.lit(50 if transition else 10), F.col("importance"))
    diverse = _items(other.where(check), base, 6, "refresh_bouts", "competitor_id", F.lit(this_year))
    return _first_of([lost, profile(F.col("in_cohort"), 2), profile(~F.col("in_cohort"), 3), bouts, _org_items(org_frequency, organisations, as_of, force), diverse], competitors.sparkSession)


def restricted(competitors: DataFrame, listings: DataFrame, lists: DataFrame, updates: DataFrame, targets: DataFrame, this_year: int, as_of: str, transition: bool = False, force: bool = False, only_bouts: bool = False, organisations: DataFrame | None = None) -> DataFrame:
    """The plan for a set of ids (``targets``, competitor_id), in or out of the cohort: stale profiles, ids without one, lists, and the organisations of their lists.

    Ids without a profile come at a fixed priority of 10. Lists get stale in the cohort only, but each active target has its list of this year read.
    """
    targets = targets.select("competitor_id").distinct()
    known = _known(competitors, listings, updates, this_year, as_of).join(targets, "competitor_id", "left_semi")
    bouts = _list_items(stale_years(known, lists, F.lit(True), this_year, as_of, transition, force))
    if only_bouts:
        return _first_of([bouts], competitors.sparkSession)
    stale = F.lit(True) if force else scoring.profile_is_stale(F.col("age"), F.col("in_cohort"))
    inside = _items(known.where(stale), F.lit(10), 2, "refresh_profile", "competitor_id")
    lost = _items(targets.join(competitors.select("competitor_id"), "competitor_id", "left_anti"), F.lit(10), 1, "refresh_profile", "competitor_id")
    orgs = _org_items(org_frequency_of(listings, targets), organisations, as_of, force)
    return _first_of([lost, inside, bouts, orgs], competitors.sparkSession)


def in_order(plan: DataFrame, session_limit: int | None = None) -> DataFrame:
    """The order of work; a session takes the first ``session_limit`` items."""
    rows = plan.orderBy("priority", "stage", "object_id", "year", "operation")
    return rows if session_limit is None else rows.limit(session_limit)


def stats(plan: DataFrame) -> DataFrame:
    """By operation, decade of priority and year, each alone, and in all: items and distinct objects."""
    rows = plan.select("operation", (F.floor(F.col("priority") / 10) * 10).cast("int").alias("decade"), "year", "object_id")
    sets = rows.groupingSets([["operation"], ["decade"], ["year"], []], "operation", "decade", "year")
    agg = sets.agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n_items"), F.count_distinct("object_id").alias("n_objects"))
    return agg.select("level", "operation", "decade", "year", "n_items", "n_objects")


def valid_predictions(cache: DataFrame, version: int, as_of: str, hours: float = 2.0) -> DataFrame:
    """The rows of a prediction cache (subject_id, confidence, made_at, version) that still hold."""
    return cache.where((F.col("version") == version) & (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("made_at") <= hours * 3600))


def refresh_predictions(cache: DataFrame, wanted: DataFrame, compute, version: int, as_of: str, hours: float = 2.0) -> DataFrame:
    """The cache with ``wanted`` (subject_id) ids recomputed by ``compute`` where no valid row is left; stale rows go."""
    valid = valid_predictions(cache, version, as_of, hours)
    new = compute(wanted.join(valid, "subject_id", "left_anti")).select("subject_id", "confidence")
    made = new.select("subject_id", "confidence", F.lit(as_of).cast("timestamp").alias("made_at"), F.lit(version).alias("version"))
    return valid.select("subject_id", "confidence", "made_at", "version").unionByName(made)
