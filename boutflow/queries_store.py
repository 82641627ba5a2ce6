"""More registered queries: stored profiles and lists, organisations, reports, and pages of bouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutflow.functions import dates, numbers, scoring, text
from boutflow.operators import audit, classify, neighbours, network, organisations, rollup, samples, teams, workload
from boutflow.plans import ranking, refresh
from boutflow.queries import AS_OF, SHARE, THIS_YEAR, _abbreviations, _cohort, _edges, _ends, _facts, _names_by_year, _now_primary, _primary, _short_primary, query
from boutflow.sources import pages, profiles, store
from boutflow.sources.tables import HOME, KNOWN_MISSING, Tables

LAST_YEARS = [THIS_YEAR - 1, THIS_YEAR - 2]


def _text(ids):
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")


# Organisations


@query
def org_lookup(t: Tables) -> DataFrame:
    """Names, default names and staleness of organisations, of one that is unknown too."""
    keys = t.organisations.select("org_id").unionByName(t.organisations.select((F.col("org_id") + 100).alias("org_id")).where("org_id = 101"))
    return organisations.looked_up(keys, t.organisations, AS_OF)


@query
def named_orgs(t: Tables) -> DataFrame:
    """Primary organisations under their names of the year, with short names."""
    return organisations.with_short(_primary(t), _abbreviations(t))


@query
def upserted_orgs(t: Tables) -> DataFrame:
    new = t.organisations.where("org_id in (2, 3)").select("org_id", "org", F.concat(F.lit("New "), "org").alias("name"), F.when(F.col("org_id") == 2, "1900").alias("founded"), F.lit(AS_OF).cast("timestamp").alias("last_updated"))
    old = t.organisations.select("org_id", "org", "name", "founded", "last_updated")
    return store.upsert_profiles(old, new, "org_id", ("founded",))


# Profiles


@query
def profile_facts(t: Tables) -> DataFrame:
    return _facts(t)


@query
def profile_rows(t: Tables) -> DataFrame:
    """Profiles with seconds of their update, the sentinel's row, and placeholders of ids known to have no page."""
    return profiles.seeded(profiles.scan(t.competitors, t.updates), KNOWN_MISSING)


@query
def without_profile(t: Tables) -> DataFrame:
    return profiles.without_profile(profiles.decoded(t.profiles))


@query
def due_profiles(t: Tables) -> DataFrame:
    rows = profiles.decoded(t.profiles).join(t.competitors.select("competitor_id", "in_cohort"), "competitor_id").join(t.updates, "competitor_id", "left")
    age = dates.age_days(F.col("last_updated"), F.lit(AS_OF).cast("timestamp"))
    return profiles.due(rows, scoring.profile_is_stale(age, F.col("in_cohort")), KNOWN_MISSING).select("competitor_id", numbers.rounded(age, 4).alias("age"), dates.age_text(age).alias("age_text"))


@query
def upserted_profiles(t: Tables) -> DataFrame:
    """A new read of every third profile; where it has no country, the one of before stays."""
    old = t.competitors.select("competitor_id", "name", "country")
    new = old.where("competitor_id % 3 = 0").select("competitor_id", F.upper("name").alias("name"), F.when(F.col("competitor_id") % 2 == 0, F.lit(None)).otherwise("NEW").alias("country"))
    return store.upsert_profiles(old, new)


@query
def inactive(t: Tables) -> DataFrame:
    return rollup.inactive(t.competitors, _now_primary(t), THIS_YEAR, _ends(t))


@query
def nationality(t: Tables) -> DataFrame:
    return rollup.nationality(_now_primary(t), rollup.home_countries(t.listings), HOME, ["BUILDING"], [1, 2, 3])


@query
def debut_anniversaries(t: Tables) -> DataFrame:
    """In-cohort competitors at home, not retired, whose debut has its anniversary within 60 days, with the organisation of last year."""
    as_of = F.to_date(F.lit(AS_OF))
    debut = profiles.decoded(t.profiles).select("competitor_id", profiles.full_date(F.col("profile")["Career start"]).alias("debut"))
    rows = debut.where(dates.near_anniversary(F.col("debut"), as_of, 60)).join(_facts(t).where("in_cohort").select("competitor_id", "name"), "competitor_id")
    rows = rows.join(inactive_ids(t), "competitor_id", "left_anti").join(nationality_ids(t), "competitor_id", "left_semi")
    orgs = _primary(t).where(F.col("year") == THIS_YEAR - 1).select("competitor_id", F.col("primary_org").alias("org"))
    out = rows.join(orgs, "competitor_id", "left").select("competitor_id", "name", "debut", (F.year(as_of) - F.year("debut")).alias("years"), dates.anniversary(F.col("debut"), as_of).alias("anniversary"), "org")
    return out.orderBy("years", "name", "competitor_id")


def inactive_ids(t: Tables) -> DataFrame:
    return rollup.inactive(t.competitors, _now_primary(t), THIS_YEAR, _ends(t)).where("inactive").select("competitor_id")


def nationality_ids(t: Tables) -> DataFrame:
    return rollup.nationality(_now_primary(t), rollup.home_countries(t.listings), HOME, ["BUILDING"], [1, 2, 3]).where("at_home").select("competitor_id")


@query
def completeness(t: Tables) -> DataFrame:
    return audit.completeness(_facts(t), t.listings, ["career_start", "career_end", "birthplace"])


@query
def career_decades(t: Tables) -> DataFrame:
    return audit.decades(_facts(t).where("career_start is not null").select("competitor_id", F.col("career_start").alias("start_year")))


@query
def guessed_spans(t: Tables) -> DataFrame:
    """The years that a career tells, for lists to be looked for."""
    spans = _facts(t).where("career_end is not null or career_start > 1985").select("competitor_id", F.col("career_start").alias("first_year"), F.col("career_end").alias("last_year"))
    return store.year_spans(spans, 1995)


# Stored lists


@query
def stored_lists(t: Tables) -> DataFrame:
    """Lists by way of their JSON text."""
    return store.decoded_lists(store.encoded_lists(t.listings)).select("competitor_id", "year", "bout_id", "bout_date", "org", "country", "is_victory", _text("participants").alias("participants"))


@query
def list_lengths(t: Tables) -> DataFrame:
    stored = store.encoded_lists(t.listings)
    return stored.select("competitor_id", "year", F.json_array_length("bouts_json").alias("n_bouts"))


@query
def rollup_counters(t: Tables) -> DataFrame:
    names = ["countries", "orgs", "names"]
    return store.decoded_counters(store.encoded_counters(rollup.yearly_rollup(t.listings, t.names_used), names), names)


def _new_lists(t: Tables) -> DataFrame:
    """The lists of 2000, read anew: only bouts of an even id are left."""
    return t.listings.where("year = 2000 and bout_id % 2 = 0")


@query
def upserted_lists(t: Tables) -> DataFrame:
    """Roll-up numbers after the lists of a year came in again."""
    now = store.replace_keys(t.listings, _new_lists(t), ["competitor_id", "year"])
    met = rollup.opponents(now).groupBy("competitor_id", "year").agg(F.count(F.lit(1)).alias("n_opponents"))
    per = now.groupBy("competitor_id", "year").agg(F.count(F.lit(1)).alias("n_bouts"))
    return per.join(met, ["competitor_id", "year"], "left").select("competitor_id", "year", "n_bouts", F.coalesce("n_opponents", F.lit(0)).alias("n_opponents"))


@query
def replaced_edges(t: Tables) -> DataFrame:
    return store.replace_keys(_edges(t), neighbours.edge_weights(_new_lists(t)), ["src", "year"])


def _with_stubs(t: Tables) -> DataFrame:
    stubs = store.missing_stubs(store.year_spans(t.competitors.select("competitor_id", F.lit(1993).alias("first_year"), F.lit(THIS_YEAR).alias("last_year")), THIS_YEAR), t.lists, AS_OF)
    return t.lists.select("competitor_id", "year", "n_bouts").unionByName(stubs.select("competitor_id", "year", "n_bouts"))


@query
def split_history(t: Tables) -> DataFrame:
    """Lists after every second competitor's whole history came in; bouts of an id that ends in 7 have no known date."""
    history = t.listings.where("competitor_id % 2 = 0").select("competitor_id", F.when(F.col("bout_id") % 10 != 7, F.col("bout_date")).alias("bout_date"))
    return store.split_history(history, _with_stubs(t))


@query
def purged_stubs(t: Tables) -> DataFrame:
    """What a purge of competitors with nothing but empty lists of late years would take, and what it would leave."""
    late = _with_stubs(t).where("competitor_id % 9 <> 0 or year > 2000").withColumn("n_bouts", F.when(F.col("competitor_id") % 9 == 0, 0).otherwise(F.col("n_bouts")))
    gone, left = audit.purge(late, audit.stub_only(late, (2001, 2002)))
    count = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("competitor_id").alias("n_competitors")).withColumn("kind", F.lit(kind))
    return count(gone, "gone").unionByName(count(left, "left"))


@query
def empty_before(t: Tables) -> DataFrame:
    """Empty lists of before 1995, and the competitors that have one."""
    return store.drop_empty(_with_stubs(t), _with_stubs(t).where("year < 1995").select("competitor_id", "year")).groupBy("year").agg(F.count(F.lit(1)).alias("n_lists"), F.count_if(F.col("n_bouts") == 0).alias("n_empty"))


@query
def list_freshness(t: Tables) -> DataFrame:
    return audit.list_freshness(t.lists, AS_OF)


@query
def list_updates(t: Tables) -> DataFrame:
    """Seconds of the last update of each competitor's list of each year, 0 where there is none."""
    spans = store.year_spans(t.competitors.select("competitor_id", F.lit(2000).alias("first_year"), F.lit(THIS_YEAR).alias("last_year")), THIS_YEAR)
    return spans.join(t.lists, ["competitor_id", "year"], "left").select("competitor_id", "year", F.coalesce(F.unix_timestamp("last_updated"), F.lit(0)).cast("long").alias("updated"))


@query
def aged_stubs(t: Tables) -> DataFrame:
    """The years to be read again of in-cohort competitors with many stubs: empty lists, never read or over a year ago."""
    found = audit.stub_audit(t.patchy_lists, t.competitors, _facts(t), THIS_YEAR, AS_OF)
    return found.where("several").select("competitor_id", "stub_years", "n_bouts")


@query
def empty_records(t: Tables) -> DataFrame:
    return audit.empty_records(t.patchy_lists, THIS_YEAR)


@query
def earlier_stubs(t: Tables) -> DataFrame:
    """Competitors with an empty list of 2001 and an empty one of before."""
    return audit.earlier_stubs(t.patchy_lists.withColumn("n_bouts", F.when(F.col("competitor_id") % 2 == 0, F.col("n_bouts")).otherwise(F.when(F.col("year") == 2001, 0).otherwise(F.col("n_bouts")))), THIS_YEAR - 1)


@query
def recent_gaps(t: Tables) -> DataFrame:
    return audit.recent_gaps(t.competitors, t.listings, THIS_YEAR)


# Reports


@query
def most_active(t: Tables) -> DataFrame:
    return samples.most_active(t.listings, LAST_YEARS, t.competitors.select("competitor_id", "name"))


@query
def by_bouts(t: Tables) -> DataFrame:
    return samples.ordered_by_bouts(t.listings, THIS_YEAR - 1)


@query
def top_countries(t: Tables) -> DataFrame:
    """The ten most frequent countries of the cohort's lists of two years."""
    return samples.most_common(t.listings.where(F.col("in_cohort") & F.col("year").isin(LAST_YEARS)), F.col("country"), 10, "country")


@query
def top_orgs(t: Tables) -> DataFrame:
    """The most frequent organisations of in-cohort profiles."""
    return samples.most_common(_facts(t).where("in_cohort"), F.col("org"), 15, "org")


@query
def top_mixed_countries(t: Tables) -> DataFrame:
    return samples.top_by_both(classify.compositions(t.bouts, t.competitors), "country", "mixed")


@query
def outside_shares(t: Tables) -> DataFrame:
    return audit.outside_shares(neighbours.cohort_share(_edges(t), t.competitors))


@query
def outside_summary(t: Tables) -> DataFrame:
    return audit.outside_summary(neighbours.cohort_share(_edges(t), t.competitors))


@query
def competitor_years(t: Tables) -> DataFrame:
    return t.listings.groupBy("competitor_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("year")), lambda y: y.cast("string")), ",").alias("years"))


@query
def bouts_within_members(t: Tables) -> DataFrame:
    """Bouts with a side of active members only."""
    return teams.within(t.bouts, neighbours.active_members(t.listings, THIS_YEAR - 1)).select("bout_id", "org")


@query
def sampled_bouts(t: Tables) -> DataFrame:
    return samples.sample(t.bouts.where("size(participants) > 0"), "bout_id", 100).select("bout_id", "bout_date", _text("participants").alias("participants"))


@query
def sampled_json(t: Tables) -> DataFrame:
    """Sampled bouts written as JSON, sides and all, and read again."""
    folder = f"{ranking.Steps(t.spark).folder}/sample"
    rows = samples.sample(t.bouts.where("size(participants) > 0"), "bout_id", 200, 7)
    samples.write_json(rows, folder)
    back = t.spark.read.schema(rows.schema).json(folder)
    return back.select("bout_id", "bout_date", "org", "is_victory", _text(F.get("sides", 0)).alias("won"), _text(F.get("sides", 1)).alias("lost"))


@query
def workload_report(t: Tables) -> DataFrame:
    """The workload of each year, written as a report by year and read again."""
    folder = f"{ranking.Steps(t.spark).folder}/workload"
    report = workload.by_org(t.listings, _short_primary(t))
    ranking.write_report(report, folder)
    return t.spark.read.schema(report.schema).json(folder).orderBy("year", F.desc("median"))


@query
def graph_report(t: Tables) -> DataFrame:
    """Nodes and links written as JSON by year, and how many are read again."""
    folder = f"{ranking.Steps(t.spark).folder}/graph"
    network.write_graph(network.nodes(_cohort(t), _short_primary(t), _names_by_year(t)), network.links(_cohort(t)), folder)
    count = lambda kind: t.spark.read.json(f"{folder}/{kind}").groupBy(F.col("year").cast("int").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 3).alias("weight")).withColumn("kind", F.lit(kind))
    return count("nodes").unionByName(count("links"))


@query
def national_links(t: Tables) -> DataFrame:
    """The network of the cohort at home, at the lower threshold."""
    home = rollup.national_cohort(t.competitors, _facts(t), t.listings, THIS_YEAR - 1, HOME, ["BLD"], [1, 2, 3])
    return network.links(_cohort(t).join(home, "competitor_id", "left_semi"), 2)


@query
def nationality_by_year(t: Tables) -> DataFrame:
    return rollup.nationality_by_year(_primary(t), rollup.home_countries(t.listings), HOME, ["BUILDING"], [1, 2, 3])


@query
def prediction_cache(t: Tables) -> DataFrame:
    """Predictions that still hold, of a cache with several versions and times."""
    guess = classify.confidence(classify.appearances(classify.with_probability(t.bouts, ("BUILDING", "MACHINERY"), HOME, ("NATION_1", "NATION_2", "NATION_3")), t.listings, t.competitors))
    made = F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(F.lit(0), (F.col("subject_id") / 10 % 5).cast("int"))
    cache = guess.select("subject_id", "confidence", made.alias("made_at"), (F.col("subject_id") / 10 % 2).cast("int").alias("version"))
    return refresh.valid_predictions(cache, 1, AS_OF).select("subject_id", "confidence", "made_at")


@query
def restricted_plan(t: Tables) -> DataFrame:
    """The plan for a quarter of all listed competitors, and some without a profile."""
    listed = t.bouts.select(F.explode("participants").alias("competitor_id")).distinct()
    return refresh.restricted(t.competitors, t.listings, t.dated_lists, t.updates, listed.where("competitor_id % 4 = 1 or competitor_id % 20 = 0"), THIS_YEAR, AS_OF, organisations=t.organisations)


@query
def date_texts(t: Tables) -> DataFrame:
    """Dates of all forms read back from text, and the week, the year and the anniversary."""
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 5
    form = F.when(k == 0, F.date_format(day, "dd.MM.yyyy")).when(k == 1, F.date_format(day, "MM.yyyy")).when(k == 2, F.date_format(day, "yyyy")).when(k == 3, "31.02.2001").otherwise("Unknown")
    rows = t.read("orders").select("o_orderkey", day.alias("day"), form.alias("form"))
    found = F.concat(F.lit("on "), F.date_format("day", "dd.MM.yyyy"), F.lit(" and 01.01.1900"))
    return rows.select(
        "o_orderkey", dates.flexible_date(F.col("form")).alias("read"), dates.first_date(found).alias("first"), dates.year_of_text(F.when(F.col("o_orderkey") % 5 == 4, F.col("form")).otherwise(F.col("day").cast("string"))).alias("year"),
        dates.iso_week_key(F.col("day")).alias("week"), dates.anniversary(F.col("day"), F.lit("2023-03-01").cast("date")).alias("anniversary"),
    )


@query
def venues(t: Tables) -> DataFrame:
    """Countries read from the text of an event, and stand-in organisations."""
    kinds = ["Event", "Online Stream", "TV-Show", "Pay Per View", "Dark Match", "House Show", "Party"]
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("c_custkey") % 7 + 1).cast("int"))
    rows = t.read("customer").join(t.read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    line = F.concat(kind, F.lit(" @ Hall in Town, Region, "), "n_name", F.when(F.col("c_custkey") % 2 == 0, ".").otherwise(""))
    org = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Wrestling In "), "n_name", F.lit(" - Freelance Shows"))).otherwise(F.col("n_name"))
    return rows.select("c_custkey", text.venue_country(line, {"NATION_1": "First"}).alias("country"), text.is_proxy_org(org).alias("stand_in"), text.trimmed_label(F.concat(F.lit(" : "), "n_name", F.lit(": "))).alias("label"))


# Pages of bouts


def _parsed(t: Tables) -> DataFrame:
    return pages.bouts(t.bout_pages)


@query
def parsed_bouts(t: Tables) -> DataFrame:
    """Bouts read from their markup."""
    side = lambda k: _text(F.get("sides", k))
    return _parsed(t).select("page_id", "bout_date", "bout_type", "country", "org_id", "is_victory", F.size("sides").alias("n_sides"), side(0).alias("won"), side(1).alias("lost"), _text("participants").alias("participants"), F.size("teams").alias("n_teams"), text.bout_type(F.col("sides")).alias("type"))


@query
def parsed_teams(t: Tables) -> DataFrame:
    return _parsed(t).select("page_id", F.explode("teams").alias("team")).select("page_id", "team.team_id", "team.name", "team.kind", _text("team.members").alias("members"))


@query
def team_links(t: Tables) -> DataFrame:
    return audit.team_links(_parsed(t), t.bout_pages)


@query
def reparse_audit(t: Tables) -> DataFrame:
    """Stored bouts of an older reading against a new one of the same markup: every tenth was lost, of every seventh the loser's side is missing, every fifth was a draw."""
    new = _parsed(t).select(F.col("page_id").alias("bout_id"), "sides", "is_victory")
    old = new.where("bout_id % 10 <> 3").withColumns({"sides": F.when(F.col("bout_id") % 7 == 0, F.slice("sides", 1, 1)).otherwise(F.col("sides")), "is_victory": F.col("is_victory") & (F.col("bout_id") % 5 != 0)})
    return audit.parse_differences(old, new)


@query
def profile_pages(t: Tables) -> DataFrame:
    """Profile and organisation fields and year options read from markup."""
    field = lambda k, v: F.concat(F.lit(f'<div class="InformationBoxTitle">{k}:</div> <div class="InformationBoxContents">'), v, F.lit("</div>"))
    i = F.col("competitor_id")
    html = F.concat(
        F.when(i % 3 != 0, field("Current gimmick", F.concat(F.lit("<b>"), "name", F.lit("</b>")))).otherwise(""), field("Alter egos", F.concat(F.lit("Ego "), "name", F.lit(" a.k.a. Other, Third"))),
        field("Gender", F.when(F.col("in_cohort"), "FEMALE").otherwise("male")), field("Active Time", F.concat((1950 + i % 40).cast("string"), F.lit(" - today"))), field("Location", F.concat(F.lit("Town, Region, "), "country")),
        F.lit('<select><option value="1999"><option value="2000"><option value="1999"><option value="all"></select>'),
    )
    rows = t.competitors.select(i.alias("page_id"), F.lit("u").alias("url"), html.alias("html"))
    read = pages.labelled(rows).join(pages.year_options(rows), "page_id")
    org = pages.organisation(F.col("profile"))
    return read.select("page_id", pages.profile_name(F.col("profile")).alias("name"), pages.in_cohort(F.col("profile"), F.col("page_id"), (1, 2)).alias("in_cohort"), org["founded"].alias("founded"), org["country"].alias("country"), _text("years").alias("years"))
