"""Coverage, freshness and data-quality audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutflow.functions.bounded import k_smallest
from boutflow.functions.dates import age_days
from boutflow.sources.steps import Steps


def profile_totals(competitors: DataFrame, listings: DataFrame) -> DataFrame:
    """Per country: competitors, in-cohort ones, their share, and how many have a bout."""
    listed = listings.select("competitor_id").distinct().withColumn("listed", F.lit(True))
    rows = competitors.join(listed, "competitor_id", "left")
    agg = rows.groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.count_if("in_cohort").alias("n_cohort"), F.count_if(F.coalesce("listed", F.lit(False))).alias("n_listed"), F.count_if(F.col("name").isNotNull() & (F.col("name") != "")).alias("n_named"))
    return agg.withColumn("cohort_share", F.round(F.col("n_cohort") / F.col("n"), 6))


def coverage(competitors: DataFrame, listings: DataFrame) -> DataFrame:
    """Per year: in-cohort competitors with data, and their share of the cohort."""
    total = competitors.where("in_cohort").agg(F.count(F.lit(1)).alias("n_cohort"))
    per = listings.where("in_cohort").groupBy("year").agg(F.count_distinct("competitor_id").alias("n_with_data"))
    return per.join(F.broadcast(total)).select("year", "n_with_data", "n_cohort", F.round(F.col("n_with_data") / F.col("n_cohort"), 6).alias("share"))


def upper_medians(rows: DataFrame, by: list[str], value: str, name: str = "upper_median") -> DataFrame:
    """Per group: the upper median, the value of rank n // 2 from 0.

    Values are counted, the group's range is cut into PARTS, and running sums over the parts tell which of
    them holds the median; only in it are values ranked one by one. So no task gathers a group.
    """
    ranges = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    below = F.sum("n").over(Window.partitionBy(*by, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
    bounds = ranges.groupBy(*by).agg(F.sum("n").alias("rows"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / PARTS
    at = F.least(F.when(width > 0, F.floor((F.col("v") - F.col("lo")) / width)).otherwise(0), F.lit(PARTS - 1)).cast("int")
    dealt = ranges.join(bounds, by).withColumn("part", at)
    parts = dealt.groupBy(*by, "part").agg(F.sum("n").alias("in_part"), F.first("rows").alias("rows"))  # PARTS rows a group
    before = F.coalesce(F.sum("in_part").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    middle = F.floor(F.col("rows") / 2)
    held = parts.withColumn("before", before).where((F.col("before") <= middle) & (middle < F.col("before") + F.col("in_part"))).select(*by, "part", "before", middle.alias("middle"))
    inside = dealt.join(held, [*by, "part"]).withColumn("start", F.col("before") + F.coalesce(below, F.lit(0)))
    return inside.where((F.col("start") <= F.col("middle")) & (F.col("middle") < F.col("start") + F.col("n"))).select(*by, F.col("v").alias(name))


#: Parts of a group's range of values, of which the one with the median is looked at value by value.
PARTS = 4096


def freshness(competitors: DataFrame, updates: DataFrame, as_of: str) -> DataFrame:
    """Per cohort flag: profiles, those with an update, and mean, upper median, least and largest age in days."""
    rows = competitors.join(updates, "competitor_id", "left").withColumn("age", age_days(F.col("last_updated"), F.lit(as_of).cast("timestamp")))
    agg = rows.groupBy("in_cohort").agg(F.count(F.lit(1)).alias("n"), F.count("age").alias("n_updated"), F.avg("age").alias("mean"), F.min("age").alias("newest"), F.max("age").alias("oldest"))
    out = agg.join(upper_medians(rows, ["in_cohort"], "age", "middle"), "in_cohort", "left")
    return out.select("in_cohort", "n", "n_updated", *[F.round(c, 5).alias(n) for c, n in (("mean", "mean_age"), ("middle", "upper_median_age"), ("newest", "newest_age"), ("oldest", "oldest_age"))])


def list_freshness(lists: DataFrame, as_of: str) -> DataFrame:
    """Per year of lists (competitor_id, year, last_updated): lists with an update, and their mean, least and largest age in days."""
    age = age_days(F.col("last_updated"), F.lit(as_of).cast("timestamp"))
    return lists.where("last_updated is not null").groupBy("year").agg(F.count(F.lit(1)).alias("n_lists"), *[F.round(f(age), 5).alias(n) for f, n in ((F.avg, "mean_age"), (F.min, "newest_age"), (F.max, "oldest_age"))])


def recent_gaps(competitors: DataFrame, listings: DataFrame, this_year: int) -> DataFrame:
    """One row of the cohort: active competitors (with a list of one of the two years before), those of them without one of this year, and all without one of the year before."""
    per = listings.where("in_cohort").groupBy("competitor_id").agg(*[F.bool_or(F.col("year") == this_year - k).alias(f"y{k}") for k in range(3)])
    rows = competitors.where("in_cohort").select("competitor_id").join(per, "competitor_id", "left").fillna(False, ["y0", "y1", "y2"])
    active = F.col("y1") | F.col("y2")
    return rows.agg(F.count(F.lit(1)).alias("n_cohort"), F.count_if(active).alias("n_active"), F.count_if(active & ~F.col("y0")).alias("active_without_this_year"), F.count_if(~F.col("y1")).alias("without_last_year"))


def outside_shares(shares: DataFrame, least: int = 10) -> DataFrame:
    """Per in-cohort competitor of ``neighbours.cohort_share`` with a neighbour outside: their number and share, and whether they are most of ``least`` or more."""
    outside = F.col("n_neighbours") - F.col("n_cohort")
    return shares.where(F.col("in_cohort") & (outside > 0)).select("competitor_id", "n_neighbours", outside.alias("n_outside"), F.round(outside / F.col("n_neighbours"), 6).alias("outside_share"), ((2 * outside > F.col("n_neighbours")) & (F.col("n_neighbours") >= least)).alias("mostly_outside"))


def outside_summary(shares: DataFrame) -> DataFrame:
    """One row: in-cohort competitors, those with neighbours outside, these neighbours' mean number, and those with most outside."""
    rows = outside_shares(shares)
    total = shares.where("in_cohort").agg(F.count(F.lit(1)).alias("n_cohort"))
    return rows.agg(F.count(F.lit(1)).alias("n_with_outside"), F.round(F.avg("n_outside"), 6).alias("mean_outside"), F.count_if("mostly_outside").alias("n_mostly_outside")).join(F.broadcast(total))  # a row each


def completeness(facts: DataFrame, listings: DataFrame, fields: list[str]) -> DataFrame:
    """Per cohort flag: profiles, those with each optional field, and with and without bouts."""
    listed = listings.select("competitor_id").distinct().withColumn("listed", F.lit(True))
    has = lambda c: F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    rows = facts.join(listed, "competitor_id", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    return rows.groupBy("in_cohort").agg(F.count(F.lit(1)).alias("n"), *[has(c).alias(f"with_{c}") for c in fields], F.count_if("listed").alias("with_bouts"), F.count_if(~F.col("listed")).alias("without_bouts"))


def team_links(bouts: DataFrame, pages: DataFrame) -> DataFrame:
    """Per year of parsed ``bouts`` (page_id, bout_date, sides): bouts, those with a side of two or more, those whose page links a team or names one before parentheses, and distinct teams."""
    # fixed value: the markup of a link to a team
    link = r'<a href="\?id=(?:28|29)&amp;nr=(\d+)[^"]*">[^<]+</a>'
    marks = pages.select("page_id", F.array_distinct(F.regexp_extract_all("html", F.lit(link), F.lit(1))).alias("team_ids"), F.col("html").rlike(r">([^<(]+)</a> \([^)]+&amp;[^)]+\)").alias("named"))
    rows = bouts.withColumn("tag", F.exists("sides", lambda s: F.size(s) >= 2)).join(marks, "page_id")
    per = rows.groupBy(F.year("bout_date").alias("year")).agg(F.count(F.lit(1)).alias("n_bouts"), F.count_if("tag").alias("n_tag"), F.count_if(F.size("team_ids") > 0).alias("n_linked"), F.count_if(F.col("named") & F.col("tag")).alias("n_named"))
    teams = rows.select(F.year("bout_date").alias("year"), F.explode("team_ids").alias("team")).groupBy("year").agg(F.count_distinct("team").alias("n_teams"))
    return per.join(teams, "year", "left").withColumn("n_teams", F.coalesce("n_teams", F.lit(0)))


def stubs(listings: DataFrame, competitors: DataFrame, first: int, last: int) -> DataFrame:
    """Per competitor and year of a span: the number of bouts, 0 for years without a list."""
    years = competitors.select("competitor_id", "in_cohort", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year"))
    counts = listings.groupBy("competitor_id", "year").agg(F.count(F.lit(1)).alias("n_bouts"))
    return years.join(counts, ["competitor_id", "year"], "left").fillna(0, ["n_bouts"])


def stub_audit(lists: DataFrame, competitors: DataFrame, careers: DataFrame, this_year: int, as_of: str, least: int = 3, stale_days: int = 365, career: int = 3) -> DataFrame:
    """In-cohort competitors with ``least`` stubs or more (``several``), or with a single populated year in a career of ``career`` years or more (``single``).

    ``lists``: competitor_id, year, n_bouts, last_updated; a stub is an empty one that is never read (null) or over ``stale_days``
    old. ``careers``: competitor_id, career_start; without a start there is no length, so never ``single``.
    """
    age = age_days(F.col("last_updated"), F.lit(as_of).cast("timestamp"))
    full, stub = F.col("n_bouts") > 0, (F.col("n_bouts") == 0) & F.coalesce(age > stale_days, F.lit(True))
    per = lists.groupBy("competitor_id").agg(
        F.count_if(stub).alias("n_stubs"), F.count_if(full).alias("n_populated"), F.min(F.when(full, F.col("year"))).alias("first_year"), F.max(F.when(full, F.col("year"))).alias("last_year"), F.sum("n_bouts").alias("n_bouts"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(stub, F.col("year")))), lambda y: y.cast("string")), ",").alias("stub_years"),
    )
    rows = per.join(competitors.where("in_cohort").select("competitor_id"), "competitor_id").join(careers.select("competitor_id", (F.lit(this_year) - F.col("career_start")).alias("career_length")), "competitor_id", "left")
    single = (F.col("n_populated") == 1) & F.coalesce(F.col("career_length") >= career, F.lit(False))
    return rows.withColumns({"single": single, "several": F.col("n_stubs") >= least}).where("single or several")


def empty_records(lists: DataFrame, before: int) -> DataFrame:
    """Per competitor with an empty list of a year before ``before``: those years as text."""
    years = F.array_join(F.transform(F.array_sort(F.collect_list("year")), lambda y: y.cast("string")), ",")
    return lists.where((F.col("year") < before) & (F.col("n_bouts") == 0)).groupBy("competitor_id").agg(years.alias("years"))


def earlier_stubs(lists: DataFrame, year: int) -> DataFrame:
    """Competitors whose list of ``year`` is stored and empty, and who have an empty one of before."""
    empty = F.col("n_bouts") == 0
    per = lists.where(F.col("year") <= year).groupBy("competitor_id").agg(F.count_if(empty & (F.col("year") == year)).alias("now"), F.count_if(empty & (F.col("year") < year)).alias("before"))
    return per.where("now > 0 and before > 0").select("competitor_id")


def stub_only(years: DataFrame, recent: tuple[int, ...]) -> DataFrame:
    """Competitors whose every list is empty and of a recent year."""
    return years.groupBy("competitor_id").agg(F.sum("n_bouts").alias("n"), F.bool_and(F.col("year").isin(*recent)).alias("recent")).where("n = 0 and recent").select("competitor_id")


def purge(rows: DataFrame, targets: DataFrame, key: str = "competitor_id") -> tuple[DataFrame, DataFrame]:
    """What a purge of ``targets`` would take, and what it would leave."""
    return rows.join(targets.select(key), key, "left_semi"), rows.join(targets.select(key), key, "left_anti")


def overlaps(bouts: DataFrame) -> DataFrame:
    """Bouts with a participant on both of the first two sides, with those participants as text."""
    both = F.array_sort(F.array_intersect(F.col("sides")[0], F.col("sides")[1]))
    return bouts.where(F.size("sides") >= 2).withColumn("both", both).where("size(both) > 0").select("bout_id", "bout_date", F.array_join(F.transform("both", lambda x: x.cast("string")), ",").alias("on_both_sides"), F.size("both").alias("n_both"))


def _issues() -> dict[str, Column]:
    flat = F.flatten("sides")
    return {
        "sentinel": F.array_contains("participants", F.lit(-1).cast("long")),
        "sides_differ": (F.size(F.array_except(flat, F.col("participants"))) > 0) | (F.size(F.array_except(F.col("participants"), flat)) > 0),
        "empty_side": F.exists("sides", lambda s: F.size(s) == 0),
        "no_winner": ~F.col("is_victory"),
        "on_both_sides": F.size(F.array_intersect(F.col("sides")[0], F.col("sides")[1])) > 0,
        "large": F.size("participants") > 6,
    }


def _by_kind(kinds: dict[str, Column], name: str) -> Column:
    """A row for each kind, with whether it was found."""
    return F.explode(F.array(*[F.struct(F.lit(n).alias(name), F.coalesce(c, F.lit(False)).alias("found")) for n, c in kinds.items()])).alias("i")


def quality_issues(bouts: DataFrame) -> DataFrame:
    """Per issue and organisation: bouts with it, and their share of all of the organisation."""
    rows = bouts.select("org", F.explode(F.array(*[F.struct(F.lit(n).alias("issue"), c.alias("found")) for n, c in _issues().items()])).alias("i")).select("org", "i.issue", "i.found")
    return rows.groupBy("issue", "org").agg(F.count_if("found").alias("n_bouts"), F.round(F.avg(F.col("found").cast("double")), 6).alias("share"))


def with_examples(rows: DataFrame, by: str, key: str, k: int = 3, n: str = "n") -> DataFrame:
    """Per kind (``by``) of ``rows`` (``by``, ``found``, ``key``): how many were found, and the ``k`` smallest keys of these as text."""
    counts = rows.groupBy(by).agg(F.count_if("found").alias(n))
    few = k_smallest(rows.where("found").select(by, key), [by], key, k)
    shown = F.array_join(F.transform("examples", lambda x: x.cast("string")), ",")
    return counts.join(few, by, "left").select(by, n, F.coalesce(shown, F.lit("")).alias("examples"))


def issue_examples(bouts: DataFrame, k: int = 3) -> DataFrame:
    """Per issue: bouts with it, and the first ``k``."""
    return with_examples(bouts.select("bout_id", _by_kind(_issues(), "issue")).select("bout_id", "i.*"), "issue", "bout_id", k, "n_bouts")


def error_report(parsed: DataFrame, k: int = 3) -> DataFrame:
    """Per error of a parse: pages with it, and the first ``k``."""
    rows = parsed.where("error is not null").select("error", "page_id", F.lit(True).alias("found")).distinct()
    return with_examples(rows, "error", "page_id", k, "n_pages")


def reparse_report(old: DataFrame, parsed: DataFrame, k: int = 3) -> DataFrame:
    """Per kind of outcome of reading stored bouts anew: how many, and the first ``k``.

    ``old``: bout_id, version (null: 1), sides (null: stored without them); ``parsed``: a row for each bout, by page_id, of
    ``pages.parsed``. Changes of version are kinds of their own; sides are compared where both have them.
    """
    new = parsed.select(F.col("page_id").alias("bout_id"), F.col("version").alias("new_version"), F.col("sides").alias("new_sides"), "error")
    rows = old.withColumn("version", F.coalesce("version", F.lit(1))).join(new, "bout_id", "left").withColumn("error", F.when(F.col("new_version").isNull(), "no page").otherwise(F.col("error")))
    good = F.col("error").isNull()
    kinds = {
        "all": F.lit(True), "reparsed": good, "parse_error": ~good, "missing_sides": F.col("sides").isNull(),
        "newly_multi_sided": good & (F.size("new_sides") > 2) & (F.coalesce(F.size("sides"), F.lit(0)) <= 2),
        "side_differences": good & F.col("sides").isNotNull() & ~F.col("sides").eqNullSafe(F.col("new_sides")),
    }
    other = F.when(good & (F.col("version") != F.col("new_version")), F.concat(F.lit("version "), "version", F.lit(" to "), "new_version"))
    flags = Steps(old.sparkSession).save(rows.select("bout_id", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in kinds.items()], other.alias("changed")))  # a parse is read once
    changed = flags.where("changed is not null").select("bout_id", F.col("changed").alias("kind"), F.lit(True).alias("found"))
    return with_examples(flags.select("bout_id", _by_kind({n: F.col(n) for n in kinds}, "kind")).select("bout_id", "i.kind", "i.found").unionByName(changed), "kind", "bout_id", k)


def decades(starts: DataFrame) -> DataFrame:
    """Per decade of the first year: competitors, and their share."""
    per = starts.groupBy((F.floor(F.col("start_year") / 10) * 10).cast("int").alias("decade")).agg(F.count(F.lit(1)).alias("n"))
    total = starts.agg(F.count(F.lit(1)).alias("total"))
    return per.join(F.broadcast(total)).select("decade", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def parse_differences(old: DataFrame, new: DataFrame, key: str = "bout_id") -> DataFrame:
    """Per kind of difference between two parses of the same bouts: how many."""
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    kinds = {
        "only_old": F.col(f"b.{key}").isNull(), "only_new": F.col(f"a.{key}").isNull(),
        "sides": ~F.col("a.sides").eqNullSafe(F.col("b.sides")), "victory": ~F.col("a.is_victory").eqNullSafe(F.col("b.is_victory")),
        "newly_multi_sided": (F.size("a.sides") <= 2) & (F.size("b.sides") > 2), "all": F.lit(True),
    }
    rows = joined.select(F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), F.coalesce(c, F.lit(False)).alias("found")) for n, c in kinds.items()])).alias("k")).select("k.*")
    return rows.groupBy("kind").agg(F.count_if("found").alias("n"))
