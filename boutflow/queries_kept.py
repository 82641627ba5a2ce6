"""More registered queries: tables kept up to date by upserts and streams, lookups, stored predictions, and bout cards with errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutflow.functions import text
from boutflow.operators import audit, classify, search
from boutflow.plans import predictions, ranking
from boutflow.queries import AS_OF, _scored, query
from boutflow.sources import migrate, pages, profiles
from boutflow.sources.maintained import Maintained
from boutflow.sources.tables import Tables
from boutflow.streaming import maintain

LIST_UNIT = (["competitor_id", "year"], "competitor_id long, year int")


def _folder(t: Tables, name: str) -> str:
    return f"{ranking.Steps(t.spark).folder}/{name}"


def _list_rows(t: Tables) -> DataFrame:
    """Rows of lists with the names used in each bout."""
    names = t.brands.groupBy("bout_id", "competitor_id").agg(F.sort_array(F.collect_set("name_used")).alias("names"))
    return t.listings.select("competitor_id", "year", "bout_id", "org", "country", "participants").join(names, ["bout_id", "competitor_id"], "left")


def kept_lists(t: Tables) -> Maintained:
    """A store of all lists after three upserts: the lists of 2000 with bouts of an even id only, every third competitor's with another
    organisation for each fourth bout, and the lists of 2000 of even competitors as they first were."""
    store = Maintained(t.spark, _folder(t, "lists"), *LIST_UNIT, buckets=16)
    rows = ranking.Steps(t.spark).save(_list_rows(t))  # a read of the source, which each upsert takes a part of
    units = lambda which: rows.where(which).select(*LIST_UNIT[0]).distinct()
    store.apply(0, rows)
    store.apply(1, rows.where("year = 2000 and bout_id % 2 = 0"), units("year = 2000"))
    third = rows.where("competitor_id % 3 = 0")
    store.apply(2, third.withColumn("org", F.when(F.col("bout_id") % 4 == 1, F.concat(F.lit("NEW "), "org")).otherwise(F.col("org"))), units("competitor_id % 3 = 0"))
    store.apply(3, rows.where("year = 2000 and competitor_id % 2 = 0"))
    return store


@query
def kept_rollup(t: Tables) -> DataFrame:
    """Yearly roll-ups by signed deltas, after the upserts of ``kept_lists``."""
    return kept_lists(t).rollup()


@query
def kept_edges(t: Tables) -> DataFrame:
    """Edges by signed deltas after the same upserts, folded into one batch in between."""
    store = kept_lists(t)
    store.compact()
    rows = store.rows().where("year = 1999 and competitor_id % 5 = 1")
    store.apply(4, rows.where("bout_id % 3 <> 0"), rows.select(*LIST_UNIT[0]).distinct())
    return store.edges()


@query
def edges_of_one(t: Tables) -> DataFrame:
    """The edges of competitor 7 from either end, each read from one bucket."""
    store = kept_lists(t)
    both = store.edges_from(7).withColumn("direction", F.lit("from")).unionByName(store.edges_to(7).withColumn("direction", F.lit("to")))
    return both.select("direction", "src", "dst", "year", "n_bouts")


def _in_large_files(df: DataFrame, folder: str) -> None:
    """Appends ``df`` in as many files as tasks run at once, each with several row groups: few micro-batches, whose tasks share a file."""
    df.coalesce(df.sparkSession.sparkContext.defaultParallelism).write.option("parquet.block.size", 4 << 20).mode("append").parquet(folder)


def _landed(t: Tables) -> str:
    """Pages that land in three lots: all of them; newer versions of every third with another country; old ones of every fifth and unreadable ones."""
    folder, html = _folder(t, "landing"), F.col("html")
    days = lambda n: F.lit(AS_OF).cast("timestamp") + F.make_dt_interval(F.lit(n))
    elsewhere = lambda place: F.regexp_replace(html, r", City, [^<]*\.</div>", f", City, {place}.</div>")
    made = t.bout_pages.select("page_id", "url", "html", F.when(F.col("page_id") % 5 == 0, days(2)).otherwise(days(1)).alias("fetched_at"))
    _in_large_files(made, folder)
    page = t.spark.read.schema(made.schema).parquet(folder)  # the first lot, whose files are listed here; the others are made of it
    lots = [
        page.where("page_id % 3 = 0").select("page_id", "url", elsewhere("Elsewhere").alias("html"), days(3).alias("fetched_at")),
        page.where("page_id % 5 = 0 or page_id % 7 = 1").select("page_id", "url", F.when(F.col("page_id") % 5 == 0, elsewhere("Nowhere")).otherwise("gone").alias("html"), F.when(F.col("page_id") % 5 == 0, days(0)).otherwise(days(9)).alias("fetched_at")),
    ]
    for lot in lots:
        _in_large_files(lot, folder)
    return folder


def kept_pages(t: Tables) -> tuple[Maintained, str]:
    """The store that a stream over landed pages keeps, and the folder of the unreadable ones."""
    store, bad = maintain.store_of(t.spark, _folder(t, "pages"), 16), _folder(t, "bad")
    maintain.maintain(t.spark, _landed(t), store, bad, _folder(t, "progress"), files=8)
    return store, bad


@query
def streamed_rollup(t: Tables) -> DataFrame:
    """Roll-ups that a stream keeps while versions of pages land in any order."""
    return kept_pages(t)[0].rollup().drop("names")


@query
def indexed_search(t: Tables) -> DataFrame:
    """The first twenty names that hold the end of every tenth competitor's name, by stored grams."""
    folder = _folder(t, "grams")
    search.write_index(search.index(t.competitors), folder)
    texts = t.competitors.where("competitor_id % 10 = 3").select(F.lower(F.substring("name", -3, 3)).alias("text"))
    return search.find(texts, search.read_index(t.spark, folder), t.competitors, 20)


@query
def filled_column(t: Tables) -> DataFrame:
    """Stored profiles of two generations, of which the older got the end of the career later."""
    folder, buckets = _folder(t, "profiles"), 16
    ended = lambda rows: rows.withColumn("career_end", profiles.career_year(F.get_json_object("profile_json", "$['Career end']")))
    migrate.append(t.profiles.where("competitor_id % 3 = 1"), folder, "competitor_id", buckets)
    migrate.append(ended(t.profiles.where("competitor_id % 3 <> 1")), folder, "competitor_id", buckets, 2)
    migrate.add_column(t.spark, folder, _folder(t, "scratch"), ended, 3)
    return migrate.read(t.spark, folder).select("competitor_id", "career_end", migrate.MARKER)


@query
def stored_predictions(t: Tables) -> DataFrame:
    """Predictions of three hours ago, of an hour ago and of another version, after a refresh of most and a purge."""
    guess = ranking.Steps(t.spark).save(classify.confidence(classify.appearances(_scored(t), t.listings, t.competitors)).select("subject_id", "confidence"))
    stored = predictions.Predictions(t.spark, _folder(t, "predictions"))
    tenth, marked = F.col("subject_id") / 10 % 4, lambda rows: rows.withColumn("confidence", F.lit(0.125))  # the stored values differ from what would be computed
    stored.put(marked(guess.where(tenth == 1)), "2024-06-29 21:00:00")
    stored.put(marked(guess.where(tenth == 2)), "2024-06-29 23:00:00")
    stored.put(marked(guess.where(tenth == 3)), "2024-06-29 23:00:00", version=0)
    stored.refresh(guess.where("subject_id % 30 <> 0"), lambda ids: guess.join(ids, "subject_id", "left_semi"), AS_OF)
    stored.purge(AS_OF)
    return stored.all()


# Cards with several sides, and pages that can't be read


@query
def card_bouts(t: Tables) -> DataFrame:
    """Bouts of cards with up to three sides, draws and named teams."""
    side = lambda s: F.array_join(F.transform(s, lambda x: x.cast("string")), ",")
    good = pages.parsed(t.card_pages).where("error is null")
    return good.select("page_id", "version", "bout_date", "is_victory", F.size("sides").alias("n_sides"), F.array_join(F.transform("sides", side), "|").alias("sides"), text.bout_type(F.col("sides")).alias("type"), F.size("teams").alias("n_teams"))


@query
def parse_errors(t: Tables) -> DataFrame:
    """What can't be read, by reason: pages, and the first three of them."""
    return audit.error_report(pages.parsed(t.card_pages))


@query
def reparsed_cards(t: Tables) -> DataFrame:
    """Stored bouts of three versions against a new reading: those of version 1 have no sides, older ones never more than two."""
    whole = t.bouts.select("bout_id", (F.col("bout_id") % 3 + 1).cast("int").alias("version"), "sides")
    rest = F.array_sort(F.flatten(F.slice("sides", 2, 9)))
    old = whole.select("bout_id", "version", F.when(F.col("version") == 2, F.array(F.get("sides", 0), rest)).when(F.col("version") == 3, F.col("sides")).alias("sides"))
    return audit.reparse_report(old, pages.parsed(t.card_pages))


@query
def issue_examples(t: Tables) -> DataFrame:
    """Issues of bouts, with the first three bouts of each."""
    return audit.issue_examples(t.bouts)
