"""The adapter from star-schema tables to bouts, bout lists and competitors.

An order is a bout; the suppliers of its odd and even line numbers are its two sides; the first side won
unless the order's status is ``P`` (a draw). Suppliers whose key is no multiple of 10 have profiles; only
they have bout lists, as in a store that holds a list for each known competitor.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutflow.operators.organisations import numbered
from boutflow.shipping import ship
from boutflow.sources.steps import Steps, is_whole

#: Organisations of the cohort, and the country that counts as home.
COHORT_ORGS = ("BUILDING", "MACHINERY")
HOME = "NATION_0"
RAISED = ("NATION_1", "NATION_2", "NATION_3")
#: Renamed organisations: name, year of the change, name before it; and short names.
RENAMES = [("BUILDING", 1999, "OLD BUILDING"), ("OLD BUILDING", 1997, "FIRST BUILDING"), ("MACHINERY", 1998, "ENGINES")]
SHORT = [("BUILDING", "BLD"), ("OLD BUILDING", "OLD"), ("MACHINERY", "MCH"), ("FURNITURE", "FUR")]
#: Ids that are known to have no profile page.
KNOWN_MISSING = [5, 10, 20, 7777777]
#: Frames that a session has written, by application, folder of the tables and name.
_WRITTEN: dict[tuple[str, str, str], tuple[str, DataFrame]] = {}


class Tables:
    """Frames over one folder of tables; each is planned once for a session's query.

    Bouts and listings, which most queries read many times, are written once a session to the folder that the
    cluster shares, so a session sees these as the tables were when it first used them. They aren't bucketed: a competitor may
    have a third of all rows, and sums before a shuffle bear that better than a bucket does.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        ship(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _once(self, name: str, df: DataFrame) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _WRITTEN or not is_whole(self.spark, _WRITTEN[key][0]):  # someone may have cleared the folder
            steps = Steps(self.spark)
            frame = steps.save(df)
            _WRITTEN[key] = f"{steps.folder}/{steps.n}", frame
        return _WRITTEN[key][1]

    @cached_property
    def bouts(self) -> DataFrame:
        """bout_id, bout_date, year, org, country, is_victory, sides, participants."""
        return self._once("bouts", self._bouts())

    def _bouts(self) -> DataFrame:
        side = lambda odd: F.sort_array(F.collect_set(F.when(F.col("l_linenumber") % 2 == odd, F.col("l_suppkey"))))
        lines = self.read("lineitem").groupBy("l_orderkey").agg(side(1).alias("won"), side(0).alias("lost"))
        lines = lines.where("size(won) > 0 and size(lost) > 0")
        customers = self.read("customer").join(self.read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        orders = self.read("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
        joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
        return joined.select(
            F.col("o_orderkey").alias("bout_id"), F.to_date("o_orderdate").alias("bout_date"), F.year("o_orderdate").alias("year"),
            F.col("c_mktsegment").alias("org"), F.col("n_name").alias("country"), (F.col("o_orderstatus") != "P").alias("is_victory"),
            F.array("won", "lost").alias("sides"), F.sort_array(F.array_union("won", "lost")).alias("participants"),
        )

    @cached_property
    def competitors(self) -> DataFrame:
        """competitor_id, name, country, in_cohort, diverse, last_updated (from the events)."""
        s = self.read("supplier").where("s_suppkey % 10 <> 0").join(self.read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        return s.select(
            F.col("s_suppkey").alias("competitor_id"), F.col("s_name").alias("name"), F.col("n_name").alias("country"),
            (F.col("s_nationkey") % 3 != 0).alias("in_cohort"), (F.col("s_acctbal") < 0).alias("diverse"),
        )

    @cached_property
    def listings(self) -> DataFrame:
        """A row for each bout and profiled participant: the bout as that competitor's list holds it."""
        rows = self.bouts.withColumn("competitor_id", F.explode("participants"))
        return self._once("listings", rows.join(self.competitors.select("competitor_id", "in_cohort"), "competitor_id"))

    @cached_property
    def names_used(self) -> DataFrame:
        """competitor_id, bout_id, year, name_used: the brands of the competitor's lines."""
        used = self.brands.distinct()
        return used.join(self.listings.select("bout_id", "competitor_id", "year"), ["bout_id", "competitor_id"])

    @property
    def brands(self) -> DataFrame:
        """bout_id, competitor_id, name_used of each line, bouts and competitors without a list too."""
        lines = self.read("lineitem").join(self.read("part"), F.col("l_partkey") == F.col("p_partkey"))
        return lines.select(F.col("l_orderkey").alias("bout_id"), F.col("l_suppkey").alias("competitor_id"), F.col("p_brand").alias("name_used"))

    @cached_property
    def updates(self) -> DataFrame:
        """competitor_id, last_updated: the last event of the object of that number."""
        return self.read("events").groupBy(F.col("user_id").alias("competitor_id")).agg(F.max("ts").alias("last_updated"))

    @cached_property
    def organisations(self) -> DataFrame:
        """org, org_id, name (null for one), founded, last_updated (null for one): the customers' segments."""
        rows = numbered(self.read("customer").select(F.col("c_mktsegment").alias("org")))
        seen = self.read("events").groupBy((F.col("user_id") % 5 + 1).alias("org_id")).agg(F.max("ts").alias("seen"))
        updated = F.when(F.col("org_id") != 4, F.col("seen") - F.make_dt_interval((F.col("org_id") * 100).cast("int")))
        named = F.when(F.col("org_id") != 3, F.concat(F.lit("Org "), "org"))
        return rows.join(seen, "org_id", "left").select("org", "org_id", named.alias("name"), (1990 + F.col("org_id")).cast("string").alias("founded"), updated.alias("last_updated"))

    @cached_property
    def profiles(self) -> DataFrame:
        """competitor_id, profile_json: what a profile page tells, as JSON text; null or empty for some."""
        i, c = F.col("competitor_id"), self.competitors
        start = F.date_add(F.lit("1960-01-01").cast("date"), ((i * 397) % 11000).cast("int"))
        org = F.element_at(F.array(*map(F.lit, ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))), (i % 5 + 1).cast("int"))
        fields = {
            "Name": F.col("name"), "Current gimmick": F.when(i % 3 == 0, F.concat(F.lit("G "), "name")), "Gender": F.when(F.col("diverse"), "diverse").when(F.col("in_cohort"), "Female").otherwise("male"),
            "Promotion": F.when(i % 4 != 0, org), "Birthplace": F.when(i % 6 != 0, F.col("country")), "Career start": F.when(i % 5 != 0, F.date_format(start, "dd.MM.yyyy")).otherwise(F.date_format(start, "yyyy")),
            "Career end": F.when(i % 7 == 0, "06.1996"),
        }
        text = F.to_json(F.struct(*[x.alias(k) for k, x in fields.items()]))
        return c.select("competitor_id", F.when(i % 11 == 0, F.lit(None)).when(i % 13 == 0, "{}").otherwise(text).alias("profile_json"))

    @cached_property
    def lists(self) -> DataFrame:
        """competitor_id, year, n_bouts, last_updated of each stored list; older years were read earlier."""
        per = self.listings.groupBy("competitor_id", "year").agg(F.count(F.lit(1)).alias("n_bouts"))
        return per.join(self.updates, "competitor_id", "left").withColumn("last_updated", F.col("last_updated") - F.make_dt_interval(((2002 - F.col("year")) * 50).cast("int")))

    @cached_property
    def dated_lists(self) -> DataFrame:
        """competitor_id, year, n_bouts, last_updated: stored lists with times of their own (null: never), and stubs of 2002 for every fourth competitor."""
        i, y = F.col("competitor_id"), F.col("year")
        read = F.col("last_updated") + F.make_dt_interval(((i * 37 + y * 61) % 400).cast("int"))
        stored = self.lists.select(i, y, "n_bouts", F.when((i + y) % 11 != 0, read).alias("last_updated"))
        seen = F.lit("2024-06-30 00:00:00").cast("timestamp") - F.make_dt_interval((i * 7 % 40).cast("int"))
        stubs = self.competitors.where("competitor_id % 4 = 0").select(i, F.lit(2002).alias("year"), F.lit(0).cast("long").alias("n_bouts"), seen.alias("last_updated"))
        return stored.unionByName(stubs)

    @cached_property
    def patchy_lists(self) -> DataFrame:
        """Lists with gaps: every ninth competitor has that of 1995 only, and a third of the years from 1990 without a list have an empty one."""
        i, y = F.col("competitor_id"), F.col("year")
        stored = self.dated_lists.where("year < 2002 and (competitor_id % 9 <> 0 or year = 1995)")
        years = self.competitors.select(i, F.explode(F.sequence(F.lit(1990), F.lit(2002))).alias("year")).where((i + y) % 3 == 0)
        seen = F.lit("2024-06-30 00:00:00").cast("timestamp") - F.make_dt_interval(((i * 31 + y * 17) % 800).cast("int"))
        stubs = years.join(stored.select("competitor_id", "year"), ["competitor_id", "year"], "left_anti").select(i, y, F.lit(0).cast("long").alias("n_bouts"), F.when((i + y) % 13 != 0, seen).alias("last_updated"))
        return stored.unionByName(stubs)

    @cached_property
    def bout_pages(self) -> DataFrame:
        """page_id, url, html: each bout as the row of a bout list; participants without a profile are unlinked, and some sides are named teams."""
        known = self.competitors.select(F.col("competitor_id").alias("id"), F.col("name").alias("person"))
        ids = self.bouts.select("bout_id", F.posexplode("sides").alias("side", "ids"))
        people = ids.select("bout_id", "side", "ids", F.explode("ids").alias("id")).join(known, "id", "left")
        linked = F.concat(F.lit('<a href="?id=2&amp;nr='), "id", F.lit('">'), "person", F.lit("</a>"))
        shown = F.when(F.col("person").isNotNull(), linked).otherwise(F.concat(F.lit("Stranger "), "id"))
        cards = people.groupBy("bout_id", "side", "ids").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", shown.alias("shown")))), lambda x: x["shown"]), " &amp; ").alias("text"), F.count("person").alias("n_known"))
        total = F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)
        team = (F.size("ids") == 2) & (F.col("n_known") == 2) & (total % 3 == 0)
        named = F.concat(F.when(total % 2 == 0, '<a href="?id=28&amp;nr=').otherwise('<a href="?id=29&amp;nr='), total, F.lit('">Team '), total, F.lit("</a> ("), "text", F.lit(")"))
        card = cards.groupBy("bout_id").agg(F.max(F.when(F.col("side") == 0, F.when(team, named).otherwise(F.col("text")))).alias("won"), F.max(F.when(F.col("side") == 1, F.when(team, named).otherwise(F.col("text")))).alias("lost"))
        org = self.organisations.select("org", "org_id")
        rows = self.bouts.join(card, "bout_id").join(org, "org")
        html = F.concat(
            F.lit("<table><tr><td>"), F.date_format("bout_date", "dd.MM.yyyy"), F.lit('</td><td><span class="MatchType">Bout: </span><span class="MatchCard">'), "won", F.when(F.col("is_victory"), " defeats ").otherwise(" vs. "), "lost",
            F.lit(' (10:00)</span><div class="MatchEventLine"><a href="?id=8&amp;nr='), "org_id", F.lit('">'), "org", F.lit("</a> House Show @ Hall, City, "), "country", F.lit(".</div></td></tr></table>"),
        )
        return rows.select(F.col("bout_id").alias("page_id"), F.concat(F.lit("https://bouts.example/?id=1&nr="), "bout_id").alias("url"), html.alias("html"))

    @cached_property
    def card_pages(self) -> DataFrame:
        """page_id, url, html: bouts as cards of up to three sides, some sides as named teams, and some pages and cards that can't be read.

        Every fourth bout of three or more has a side for each of its first two participants and one for all others.
        """
        n, people = F.col("bout_id") % 50, F.col("participants")
        several = (F.col("bout_id") % 4 == 0) & (F.size(people) >= 3)
        three = F.array(F.slice(people, 1, 1), F.slice(people, 2, 1), F.slice(people, F.lit(3), F.size(people)))
        shown = self.bouts.withColumn("shown", F.when(several, three).otherwise(F.col("sides")))
        members = shown.select("bout_id", F.posexplode("shown").alias("side", "ids")).select("bout_id", "side", "ids", F.posexplode("ids").alias("place", "id"))
        known = self.competitors.select(F.col("competitor_id").alias("id"), "name")
        linked = F.concat(F.lit('<a href="?id=2&amp;nr='), "id", F.lit('">'), "name", F.lit("</a>"))
        one = F.struct("place", F.when(F.col("name").isNotNull(), linked).otherwise(F.concat(F.lit("Stranger "), "id")).alias("text"))
        sides = members.join(known, "id", "left").groupBy("bout_id", "side", "ids").agg(F.sort_array(F.collect_list(one)).alias("m"), F.count("name").alias("n_known"))
        total = F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)
        joined = lambda by: F.array_join(F.transform("m", lambda x: x["text"]), by)
        named = F.concat(F.lit('<a href="?id=28&amp;nr='), total, F.lit('">Team '), total, F.lit("</a> ("), joined(" and "), F.lit(")"))
        team = (F.size("ids") == 2) & (F.col("n_known") == 2) & (total % 3 == 1)
        cards = sides.select("bout_id", F.struct("side", F.when(team, named).otherwise(joined(" &amp; ")).alias("text")).alias("s")).groupBy("bout_id").agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["text"]).alias("texts"))
        rest = F.array_join(F.slice("texts", F.lit(2), F.size("texts")), " and ")
        result = F.when(F.col("is_victory"), F.concat(F.get("texts", 0), F.lit(" defeats "), rest)).otherwise(F.array_join("texts", " vs. "))
        card = F.when(n == 10, "-").otherwise(F.concat(result, F.lit(" (10:00)")))
        date = F.when(n == 11, "99.99.2000").otherwise(F.date_format("bout_date", "dd.MM.yyyy"))
        row = F.concat(F.lit("<table><tr><td>"), date, F.lit('</td><td><span class="MatchType">Bout: </span><span class="MatchCard">'), card, F.lit("</span></td></tr></table>"))
        html = F.when(n == 8, "<p>gone</p>").when(n == 9, "<table><tr><td>none</td></tr></table>").when(n != 7, row)
        return self.bouts.join(cards, "bout_id").select(F.col("bout_id").alias("page_id"), F.concat(F.lit("https://cards.example/?id=1&nr="), "bout_id").alias("url"), html.alias("html"))
