"""The registered queries over bouts, each with the SQL that gives the same rows (``oracle.SQL``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutflow.functions import dates, glicko, text
from boutflow.operators import audit, classify, dossier, neighbours, network, organisations, rollup, teams, workload
from boutflow.plans import ranking, refresh
from boutflow.sources import pages, profiles, store
from boutflow.sources.tables import COHORT_ORGS, HOME, RAISED, RENAMES, SHORT, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: The clock of rules that need one. Bouts end in 2001, events in January 2024.
THIS_YEAR, AS_OF = 2002, "2024-06-30 00:00:00"
#: The day for anniversaries of first bouts, which are early in a year here.
DEBUT_DAY = "2024-02-20"
#: The share of bouts that makes an organisation primary; here the modal share is 0.27 on average.
SHARE = 0.25


def query(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
    return f


def _edges(t: Tables) -> DataFrame:
    return neighbours.edge_weights(t.listings)


def _now_primary(t: Tables) -> DataFrame:
    """Primary organisations under their names of today."""
    return rollup.primary_orgs(t.listings, SHARE)


def _former(t: Tables) -> DataFrame:
    return organisations.former_names(t.spark.createDataFrame(RENAMES, "name string, change_year int, old_name string"))


def _abbreviations(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(SHORT, "name string, short string")


def _primary(t: Tables) -> DataFrame:
    """Primary organisations under their names of the year."""
    return organisations.named_for_year(_now_primary(t), _former(t))


def _short_primary(t: Tables) -> DataFrame:
    """The same, by short names."""
    return organisations.with_short(_primary(t), _abbreviations(t), short="short_org").withColumn("primary_org", F.col("short_org")).drop("short_org")


def _names_by_year(t: Tables) -> DataFrame:
    """competitor_id, year, name: the name most used in the year, or the profile's."""
    used = rollup.modal(rollup.counted(t.names_used, "name_used"), rollup.KEY, "used").select(*rollup.KEY, "used")
    years = t.listings.select(*rollup.KEY).distinct()
    rows = years.join(used, rollup.KEY, "left").join(t.competitors.select("competitor_id", "name"), "competitor_id", "left")
    return rows.select(*rollup.KEY, F.coalesce("used", "name").alias("name"))


def _facts(t: Tables) -> DataFrame:
    return profiles.facts(profiles.decoded(t.profiles), _abbreviations(t))


def _ends(t: Tables) -> DataFrame:
    return _facts(t).where("career_end is not null")


def _cohort(t: Tables) -> DataFrame:
    return t.listings.where("in_cohort")


def _scored(t: Tables) -> DataFrame:
    return classify.with_probability(t.bouts, COHORT_ORGS, HOME, RAISED)


def _singles(t: Tables) -> DataFrame:
    return rollup.singles(t.bouts, t.competitors)


@query
def singles_bouts(t: Tables) -> DataFrame:
    return _singles(t)


@query
def yearly_rollup(t: Tables) -> DataFrame:
    return rollup.yearly_rollup(t.listings, t.names_used)


@query
def edge_weights(t: Tables) -> DataFrame:
    return _edges(t)


@query
def cohort_share(t: Tables) -> DataFrame:
    return neighbours.cohort_share(_edges(t), t.competitors)


@query
def neighbours_reverse(t: Tables) -> DataFrame:
    return neighbours.reverse_neighbours(_edges(t))


@query
def missing_ids(t: Tables) -> DataFrame:
    return neighbours.missing(_edges(t), t.competitors)


@query
def missing_buckets(t: Tables) -> DataFrame:
    return neighbours.frequency_buckets(neighbours.missing(_edges(t), t.competitors), "appearances", [1, 5, 10, 20])


@query
def outside_buckets(t: Tables) -> DataFrame:
    return neighbours.frequency_buckets(neighbours.outside_appearances(_edges(t), t.competitors), "n_lists", [1, 5, 10, 20, 50])


@query
def primary_org(t: Tables) -> DataFrame:
    return _primary(t)


@query
def latest_org(t: Tables) -> DataFrame:
    return rollup.latest_orgs(t.competitors, _primary(t), THIS_YEAR, _ends(t))


@query
def primary_country(t: Tables) -> DataFrame:
    return rollup.home_countries(t.listings)


@query
def primary_name(t: Tables) -> DataFrame:
    return rollup.modal(rollup.counted(t.names_used, "name_used"), rollup.KEY, "primary_name")


@query
def org_members(t: Tables) -> DataFrame:
    return neighbours.org_members(t.listings)


@query
def active_members(t: Tables) -> DataFrame:
    return neighbours.active_members(t.listings, THIS_YEAR - 1)


@query
def org_frequency(t: Tables) -> DataFrame:
    return neighbours.org_frequency(t.listings)


@query
def workload_by_org(t: Tables) -> DataFrame:
    return workload.by_org(t.listings, _short_primary(t))


@query
def workload_hist(t: Tables) -> DataFrame:
    return workload.histogram(t.listings)


@query
def workload_percentiles(t: Tables) -> DataFrame:
    return workload.percentiles(t.listings)


@query
def year_stats(t: Tables) -> DataFrame:
    return rollup.year_totals(t.listings)


@query
def available_years(t: Tables) -> DataFrame:
    return rollup.available_years(t.listings)


@query
def network_nodes(t: Tables) -> DataFrame:
    return network.nodes(_cohort(t), _short_primary(t), _names_by_year(t))


@query
def network_links(t: Tables) -> DataFrame:
    return network.links(_cohort(t))


@query
def glicko_period_terms(t: Tables) -> DataFrame:
    """v and the improvement of every month, all players at the starting ratings."""
    games = ranking.results(_singles(t))
    phi = F.lit(glicko.START_DEVIATION / glicko.SCALE)
    e, g = glicko.expected(F.lit(0.0), F.lit(0.0), phi), glicko.g(phi)
    per = games.groupBy("period", "competitor_id").agg(F.sum(g * g * e * (1 - e)).alias("information"), F.sum(g * (F.col("score") - e)).alias("improvement"))
    return per.select("period", "competitor_id", F.round(1 / F.col("information"), 6).alias("v"), F.round(F.col("improvement") / F.col("information"), 6).alias("delta"))


@query
def ranking_table(t: Tables) -> DataFrame:
    """The ranking of each year under the names most used in it, with short organisations; three bouts rank here."""
    spark = t.spark
    used = rollup.modal(rollup.counted(t.names_used, "name_used"), rollup.KEY, "used").select(*rollup.KEY, "used")
    years = [r.year for r in rollup.available_years(t.listings).select("year").collect()]
    state = ranking.by_year(spark, _singles(t), years, 3)
    names = state.select(*rollup.KEY).join(used, rollup.KEY, "left").join(t.competitors.select("competitor_id", "name"), "competitor_id", "left")
    return ranking.table(state, names.select(*rollup.KEY, F.coalesce("used", "name").alias("name")), _short_primary(t).select(*rollup.KEY, F.col("primary_org").alias("org")), 3)


@query
def upsets(t: Tables) -> DataFrame:
    singles = _singles(t)
    years = [r.year for r in singles.select(F.year("bout_date").alias("year")).distinct().collect() if r.year is not None]
    return ranking.surprises(singles, ranking.by_year(t.spark, singles, years, 3))


@query
def mixed_features(t: Tables) -> DataFrame:
    return classify.compare_features(classify.compositions(t.bouts, t.competitors))


@query
def mixed_by_year_ma(t: Tables) -> DataFrame:
    return classify.mixed_share_by_year(classify.compositions(t.bouts, t.competitors))


@query
def mixed_probability(t: Tables) -> DataFrame:
    return _scored(t).select("bout_id", "size", F.round("probability", 6).alias("probability"))


@query
def confidence(t: Tables) -> DataFrame:
    out = classify.confidence(classify.appearances(_scored(t), t.listings, t.competitors))
    return out.withColumn("label", text.confidence_label(F.col("confidence")))


@query
def missing_features(t: Tables) -> DataFrame:
    out = classify.features(classify.appearances(_scored(t), t.listings, t.competitors))
    return out.select("subject_id", *[F.round(c, 6).alias(c) for c in out.columns if c != "subject_id"])


def _known_vectors(t: Tables) -> DataFrame:
    rows = classify.appearances(_scored(t), t.listings, t.competitors, t.competitors)
    flags = t.competitors.select(F.col("competitor_id").alias("subject_id"), "in_cohort")
    return classify.features(rows).join(flags, "subject_id")


@query
def rule_precision(t: Tables) -> DataFrame:
    return classify.rule_precision(_known_vectors(t), "in_cohort")


@query
def feature_summary(t: Tables) -> DataFrame:
    return classify.summarise_features(ranking.Steps(t.spark).save(_known_vectors(t)), "in_cohort")  # read several times


@query
def reclassify(t: Tables) -> DataFrame:
    return classify.reclassify(t.competitors, neighbours.cohort_share(_edges(t), t.competitors))


@query
def team_counts(t: Tables) -> DataFrame:
    return teams.combinations(t.bouts).select("org", "size", "team", "n_bouts")


@query
def team_ends(t: Tables) -> DataFrame:
    return teams.ends(teams.combinations(t.bouts))


@query
def partners(t: Tables) -> DataFrame:
    return teams.participation(teams.partners(teams.combinations(t.bouts)))


@query
def never_partners(t: Tables) -> DataFrame:
    return teams.never_partners(neighbours.active_members(t.listings, THIS_YEAR - 1), teams.partners(teams.combinations(t.bouts)))


@query
def possible_teams(t: Tables) -> DataFrame:
    return teams.possible_combinations(neighbours.active_members(t.listings, THIS_YEAR - 1))


@query
def side_overlap(t: Tables) -> DataFrame:
    return audit.overlaps(t.bouts)


@query
def quality_issues(t: Tables) -> DataFrame:
    return audit.quality_issues(t.bouts)


@query
def profile_totals(t: Tables) -> DataFrame:
    return audit.profile_totals(t.competitors, t.listings)


@query
def coverage(t: Tables) -> DataFrame:
    return audit.coverage(t.competitors, t.listings)


@query
def freshness(t: Tables) -> DataFrame:
    return audit.freshness(t.competitors, t.updates, AS_OF)


@query
def stub_audit(t: Tables) -> DataFrame:
    """In-cohort competitors whose history isn't whole: many stubs, or a single year in a long career."""
    return audit.stub_audit(t.patchy_lists, t.competitors, _facts(t), THIS_YEAR, AS_OF).drop("stub_years")


@query
def stub_seed(t: Tables) -> DataFrame:
    spans = t.competitors.select("competitor_id", F.lit(1993).alias("first_year"), F.lit(THIS_YEAR).alias("last_year"))
    lists = t.listings.select("competitor_id", "year").distinct()
    return store.missing_stubs(store.year_spans(spans, THIS_YEAR), lists, AS_OF)


@query
def name_search(t: Tables) -> DataFrame:
    return dossier.find_by_name(t.competitors, "r#0000000", 50).select("competitor_id", "name", "in_cohort")


@query
def importance(t: Tables) -> DataFrame:
    return refresh.importances(t.listings, THIS_YEAR)


def _plan(t: Tables, **modes: bool) -> DataFrame:
    cohort = t.competitors.where("in_cohort")
    lost = neighbours.missing(neighbours.edge_weights(_cohort(t)), t.competitors, cohort)
    guess = classify.confidence(classify.appearances(_scored(t), t.listings, t.competitors)).select("subject_id", "confidence")
    return refresh.build(t.competitors, t.listings, t.dated_lists, t.updates, lost, guess, neighbours.org_frequency(t.listings), THIS_YEAR, AS_OF, organisations=t.organisations, **modes)


@query
def refresh_plan(t: Tables) -> DataFrame:
    return _plan(t)


@query
def plan_modes(t: Tables) -> DataFrame:
    """The plan by force, of lists only, and in early January."""
    modes = ("force", "only_bouts", "transition")
    plans = [_plan(t, **{m: True}).withColumn("mode", F.lit(m)) for m in modes]
    return plans[0].unionByName(plans[1]).unionByName(plans[2])


@query
def session_items(t: Tables) -> DataFrame:
    """The first forty items of the plan, in the order of work."""
    return refresh.in_order(_plan(t), 40)


@query
def plan_stats(t: Tables) -> DataFrame:
    return refresh.stats(_plan(t))


@query
def anniversaries(t: Tables) -> DataFrame:
    """In-cohort competitors whose first bout's day is within 60 days of the clock's, with the years since."""
    as_of = F.to_date(F.lit(DEBUT_DAY))
    debut = t.listings.where("in_cohort").groupBy("competitor_id").agg(F.min("bout_date").alias("debut"))
    near = debut.where(dates.near_anniversary(F.col("debut"), as_of, 60))
    return near.select("competitor_id", "debut", (F.year(as_of) - F.year("debut")).alias("years"), dates.anniversary(F.col("debut"), as_of).alias("anniversary"))


@query
def decades(t: Tables) -> DataFrame:
    starts = t.listings.groupBy("competitor_id").agg(F.min("year").alias("start_year"))
    return audit.decades(starts)


@query
def dossiers(t: Tables) -> DataFrame:
    edges = _edges(t)
    return dossier.dossiers(t.listings, edges, neighbours.cohort_share(edges, t.competitors))


@query
def missing_dossiers(t: Tables) -> DataFrame:
    return dossier.missing_dossiers(classify.appearances(_scored(t), t.listings, t.competitors))


@query
def page_links(t: Tables) -> DataFrame:
    return pages.links(t.read("pages"))


@query
def page_titles(t: Tables) -> DataFrame:
    return pages.titles(t.read("pages"))


@query
def page_urls(t: Tables) -> DataFrame:
    return pages.url_parts(t.read("pages"))


from boutflow import queries_kept, queries_store  # noqa: E402, F401  register more
